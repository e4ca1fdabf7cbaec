from __future__ import annotations

import json
import sqlite3

import pytest

from kelvane import sources


def test_snapshots_publish_atomically(spark, tmp_path):
    table = sources.Snapshots(spark, str(tmp_path / "t"))
    assert table.read() is None
    table.publish(spark.range(3))

    def reject(df):
        raise ValueError("no")

    with pytest.raises(ValueError):
        table.publish(spark.range(9), reject)
    assert table.read().count() == 3 and table.versions() == [1]
    table.publish(spark.range(5))
    assert table.read().count() == 5 and table.read(1).count() == 3


def test_sqlite(spark, tmp_path):
    path = tmp_path / "x.db"
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "c t" (id INTEGER, name TEXT)')
        db.executemany('INSERT INTO "c t" VALUES (?, ?)', [(i, f"n{i}") for i in range(100)])
    spark.dataSource.register(sources.SqliteSource)
    df = spark.read.format("kelvane_sqlite").schema("id long, name string").option("path", str(path)).option("table", "c t").option("partitions", "3").load()
    assert df.count() == 100 and df.filter("id = 7").first().name == "n7" and df.rdd.getNumPartitions() == 3


def test_delimited_headers_and_blank_rows(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Company Name,Davčna\nALFA, 007\n , \n", encoding="utf-8")
    df = sources.read_delimited(spark, str(path), {"company_name": ["naziv", "companyname"], "tax_number": ["davčna"]})
    assert [tuple(r) for r in df.collect()] == [("ALFA", "007")] and df.columns == ["company_name", "tax_number"]
    assert sources.column_for(["A b", "ab"], ["x", "AB"]) == "A b"


def test_reports(spark, tmp_path):
    good = {"selected_ids": [1, 2], "companies": [{"company_id": 1, "status": "VERIFIED"}], "complete": True}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"selected_ids": [2], "circuit_breaker": {"triggered": True}}))
    got = {r.file[-6:]: (r.state, r.valid) for r in sources.read_reports(spark, str(tmp_path)).collect()}
    assert got == {"a.json": ("complete", True), "b.json": ("circuit-breaker", False)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.si"), (2, "")], "id int, primary_email string")
    sources.export_sheets(df, str(tmp_path / "out"), "primary_email")
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out/with").glob("*.csv"))
    assert text.startswith("﻿id,primary_email") and "a@b.si" in text
    before = sources.snapshot_digest(spark, str(tmp_path / "out")).collect()
    assert before == sources.snapshot_digest(spark, str(tmp_path / "out")).collect()
