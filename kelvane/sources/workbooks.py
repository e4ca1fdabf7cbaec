"""Workbooks (.xlsx): read as text columns, written with one sheet for each table.

A workbook is one zip file whose sheets have 1,048,576 rows at most, so a file is read by one task and written by
the driver, row by row; larger tables are refused. Many workbooks under one path are read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import column_for

MOST_ROWS = 1 << 20
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _column(reference: str) -> int:
    """Place of the column of a cell such as AB12."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a sheet (the first one, if none is named) as texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = {s.get("name"): s.get(_LINK) for s in book.iter(_MAIN + "sheet")}
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet!r} in {sorted(names)}")
        target = links[names[sheet] if sheet is not None else next(iter(names.values()))]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        with z.open(target.lstrip("/") if target.startswith("/") else "xl/" + target) as source:
            for _, row in ElementTree.iterparse(source):
                if row.tag != _MAIN + "row":
                    continue
                out: list[str | None] = []
                for place, cell in enumerate(row.iter(_MAIN + "c")):
                    at = _column(cell.get("r")) if cell.get("r") else place
                    value, kind = cell.find(_MAIN + "v"), cell.get("t")
                    if kind == "inlineStr":
                        found = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                    else:
                        found = None if value is None else shared[int(value.text)] if kind == "s" else value.text
                    out += [None] * (at + 1 - len(out))
                    out[at] = found
                row.clear()
                yield out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows below the first, which names the columns, of one sheet of each workbook under ``path``; all columns are text, rows without any value are dropped.

    The columns are those of the first workbook; ``aliases`` renames columns found by any of their names.
    """
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("content").first()
    names = [n or f"column_{i + 1}" for i, n in enumerate(next(sheet_rows(bytes(first.content), sheet), []))] if first else []
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[list[str | None]] = []
                rows = sheet_rows(content.as_py(), sheet)
                here = [n or f"column_{i + 1}" for i, n in enumerate(next(rows, []))]
                place = [here.index(n) if n in here else -1 for n in names]
                for row in rows:
                    texts = [(row[p] or "").strip() or None if 0 <= p < len(row) else None for p in place]
                    if any(t is not None for t in texts):
                        held.append(texts)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    df = files.select("content").mapInArrow(run, schema)
    for name, known in (aliases or {}).items():
        found = column_for(df.columns, [name, *known])
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_ODD.sub("", str(value)))}</t></is></c>'
    return f"<c><v>{value!r}</v></c>"


def write_workbook(sheets: dict[str, DataFrame], path: str, texts: Sequence[str] = ()) -> None:
    """One workbook with a sheet for each table, in the tables' order of rows; ``texts`` are columns written as text (identifiers). It replaces a file of that name only when it is whole."""
    buffer, spark = io.BytesIO(), next(iter(sheets.values())).sparkSession
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        base = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{base}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{base}"><sheets>{listed}</sheets></workbook>')
        linked = "".join(f'<Relationship Id="r{i}" Type="{base}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{linked}</Relationships>')
        for i, (name, df) in enumerate(sheets.items(), 1):
            df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns])
            if df.limit(MOST_ROWS).count() >= MOST_ROWS:
                raise ValueError(f"sheet {name!r} would have more than {MOST_ROWS} rows: write delimited files instead")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                out.write(("<row>" + "".join(map(_cell, df.columns)) + "</row>").encode())
                for row in df.toLocalIterator():  # MOST_ROWS at most
                    out.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                out.write(b"</sheetData></worksheet>")
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    stream.write(bytearray(buffer.getvalue()))
    stream.close()
    fs.delete(target, False)
    fs.rename(part, target)


def export_workbook(df: DataFrame, path: str, filled: str, texts: Sequence[str] = ()) -> None:
    """Three sheets: all rows, those with a value in ``filled``, and those without."""
    there = F.coalesce(F.col(filled).cast("string"), F.lit("")) != ""
    write_workbook({"all": df, "with": df.filter(there), "without": df.filter(~there)}, path, texts)
