"""Workbooks are read back as they were written, and as other programs write them."""

from __future__ import annotations

import io
import zipfile

import pytest

from kelvane.sources import workbooks

ROWS = [("007", "Žaga & <b> \"x\"", 1.5, 3, True), (None, "  ", None, -4, False), ("12", "two\nlines\x01", 0.1, 10**15, None)]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id string, name string, share double, n long, flag boolean").coalesce(1)
    path = f"{tmp_path}/book.xlsx"
    for _ in range(2):  # a file that is there is replaced
        workbooks.export_workbook(df, path, "id", texts=["n"])
    got = workbooks.read_workbook(spark, path, "all", {"company": ["x", " NAME "]})
    assert got.columns == ["id", "company", "share", "n", "flag"]
    assert [tuple(r) for r in got.collect()] == [("007", ROWS[0][1], "1.5", "3", "True"), (None, None, None, "-4", "False"), ("12", "two\nlines", "0.1", "1000000000000000", None)]
    assert [r.id for r in workbooks.read_workbook(spark, path, "with").collect()] == ["007", "12"] and workbooks.read_workbook(spark, path, "without").count() == 1
    with pytest.raises(ValueError):
        workbooks.read_workbook(spark, path, "none")


def test_shared_strings_gaps_and_empty_rows(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Firma</t></si><si><r><t>Al</t></r><r><t>fa</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row/><row><c r="AA3"><v>1</v></c><c r="C3"><v>7</v></c><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    got = workbooks.read_workbook(spark, f"{tmp_path}/b.xlsx")
    assert got.columns == ["Firma", "column_2", "n"] and [tuple(r) for r in got.collect()] == [("Alfa", None, "7")]


def test_too_many_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "MOST_ROWS", 5)
    with pytest.raises(ValueError):
        workbooks.write_workbook({"x": spark.range(5)}, f"{tmp_path}/x.xlsx")
