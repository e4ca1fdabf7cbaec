"""Timed task state, quarantine, tails of files, remembered aggregates."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kelvane import sources
from kelvane.functions import udtfs
from kelvane.operators import keywords, quarantine
from kelvane.sources.partials import Partials
from kelvane.sources.tail import TailSource, last_lines


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "5", "2024-01-02"), (2, "x", "2024-13-01"), (3, " ", None), (4, "-3", "2024-01-02")], "id int, amount_raw string, day_raw string")
    made = quarantine.checked(rows, {"amount": ("amount_raw", F.col("amount_raw").try_cast("double")), "day": ("day_raw", F.col("day_raw").try_cast("date"))}, {"NEGATIVE": F.col("amount") >= 0})
    good, bad = quarantine.split(made)
    assert sorted((r.id, r.amount, str(r.day)) for r in good.collect()) == [(1, 5.0, "2024-01-02"), (3, None, "None")]
    assert {r.id: [(e.field, e.reason, e.raw) for e in r.errors] for r in bad.collect()} == {2: [("amount", "UNREADABLE", "x"), ("day", "UNREADABLE", "2024-13-01")], 4: [("", "NEGATIVE", None)]}


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_rules_by_automaton(spark, most):
    rules = [("a", "Družinsko", 3), ("b", "druž", 2), ("b", "inc", 5), ("c", "inc", 7), ("d", "incorporated", 1), ("e", "", 4), ("f", "ne", 9), ("g", "x" * 30, 1)]
    texts = [(1, "DRUŽINSKO podjetje, Inc."), (2, None), (3, "incorporatedincorporated"), (4, "drug"), (5, "x" * 29), (6, "x" * 31)]
    df, listed = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(rules, "category string, keyword string, score int")
    assert len(keywords.rule_parts(listed, most)) == (1 if most > 40 else 2)
    hits = sorted((r.id, r.category, r.keyword) for r in keywords.rule_hits(df, "id", "t", listed, most).collect())
    assert hits == sorted((i, c, k) for i, t in texts for c, k, _ in rules if k.lower() in (t or "").lower())
    got = {r.id: (r.score, r.n_matches) for r in keywords.score_by_rules(df, "id", "t", listed, most).collect()}
    assert got == {i: (sum(s for c, k, s in rules if k.lower() in (t or "").lower()), sum(k.lower() in (t or "").lower() for _, k, _ in rules)) for i, t in texts}
    assert keywords.rule_hits(df, "id", "t", listed.limit(0), most).count() == 0


def test_table_functions(spark):
    assert set(udtfs.register(spark)) == set(udtfs.FUNCTIONS)
    page = '<body><section><h2>A</h2><a href="mailto:a@b.si">a@b.si</a><a hidden href="/x">x</a></section><a href="/y">y  z</a>'
    spark.createDataFrame([(1, page), (2, None)], "id int, html string").createOrReplaceTempView("some_pages")
    rows = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert rows("SELECT id, b.href, b.visible_email FROM some_pages, LATERAL page_blocks(html) b") == [(1, "mailto:a@b.si", "a@b.si")]
    assert rows("SELECT id, l.position, l.href, l.shown FROM some_pages, LATERAL page_links(html) l ORDER BY 2") == [(1, 0, "mailto:a@b.si", "a@b.si"), (1, 1, "/y", "y z")]
    assert rows("SELECT id, o.name FROM some_pages, LATERAL page_objects(html) o") == []


def test_tails(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "in").mkdir(parents=True)
    (root / "in/a.log").write_bytes(b"".join(b"line %d\n" % k for k in range(1000)))
    (root / "b.log").write_text("one\ntwo")
    (tmp_path / "secret.log").write_text("no\n")
    os.symlink(tmp_path / "secret.log", root / "out.log")
    os.symlink(root / "b.log", root / "in/link.log")
    with open(root / "big.log", "wb") as f:  # a file larger than any heap: a hole of a terabyte before its end
        f.truncate(1 << 40)
        f.seek(0, os.SEEK_END)
        f.write(b"\nlast\n")
    spark.dataSource.register(TailSource)
    read = lambda **o: spark.read.format("kelvane_tail").options(root=str(root), **o).load()
    got = {}
    for r in read(bytes="30").collect():
        got.setdefault(r.file, []).append((r.offset, r.line))
    assert [x for _, x in got["in/a.log"]] == ["line 997", "line 998", "line 999"]
    assert got["b.log"] == [(0, "one"), (4, "two")] and got["in/link.log"] == got["b.log"] and got["big.log"] == [((1 << 40) + 1, "last")]
    assert "out.log" not in got
    assert {r.file for r in read(newest="1").select("file").distinct().collect()} == {"big.log"}
    assert read(path=str(root / "in"), suffix="a.log").count() == 1000
    with pytest.raises(Exception, match="inside root"):
        read(path=str(tmp_path)).count()
    assert last_lines(str(root / "b.log"), 7, 3) == (4, [(4, "two")])
    (root / "none.log").write_text("")
    assert last_lines(str(root / "none.log"), 0, 10) == (0, [])


def test_partials_read_changed_files_only(spark, tmp_path):
    folder = str(tmp_path / "data")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(folder)
    cache = Partials(spark, str(tmp_path / "cache"), folder, ["g"], {"n": (F.count("*"), "sum"), "top": (F.max("v"), "max"), "low": (F.min("v"), "min")})
    rows = lambda: sorted(tuple(r) for r in cache.read().select("g", "n", "top", "low").collect())
    assert len(cache.update()) == 3 and rows() == [(0, 15, 28, 0), (1, 15, 29, 1)]
    assert cache.update() == [] and cache.catalog.version() == 1
    spark.range(100, 101).select((F.col("id") % 2).alias("g"), F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(folder)
    assert len(cache.update()) == 1 and rows() == [(0, 16, 100, 0), (1, 15, 29, 1)]
    gone = sorted(p for p in os.listdir(folder) if p.endswith(".parquet"))[0]
    os.remove(f"{folder}/{gone}")
    assert sum(r[1] for r in rows()) in (21, 30)  # what the file held is no longer counted, without a new read
    assert cache.update() == []


@pytest.mark.parametrize("files", [1, 4])
def test_timed_tasks(spark, tmp_path, files):
    pytest.importorskip("google.protobuf")
    from kelvane.streaming.lifecycle import rocks, task_actions

    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    seen = [("a", "FAIL", 0), ("a", "FAIL", 1), ("a", "SUCCESS", 9), ("a", "FAIL", 20), ("a", "FAIL", 50), ("b", "SUCCESS", 2), ("b", "FAIL", 60), ("b", "FAIL", 61), ("b", "FAIL", 62), ("c", "FAIL", 100), ("d", "FAIL", 101)]
    folder = str(tmp_path / "in")
    rows = [(k, s, hour(h), n) for n, (k, s, h) in enumerate(sorted(seen, key=lambda x: x[2]))]
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], "k string, s string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("k string, s string, ts timestamp_ntz, n int").option("maxFilesPerTrigger", 1).parquet(folder)
    with rocks(spark):
        made = task_actions(stream, "k", "s", "ts", "n", base_minutes=120, delay="1 hour")
        made.writeStream.format("memory").queryName(f"actions{files}").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    first = 1704067200000
    got = sorted((r.k, (r.t - first) / 3_600_000, r.action, r.attempts) for r in spark.table(f"actions{files}").collect())
    assert got == [("a", 5, "WAKE", 2), ("a", 9, "DONE", 3), ("a", 33, "EXPIRED", 3), ("a", 52, "WAKE", 1), ("b", 2, "DONE", 1), ("b", 26, "EXPIRED", 1), ("b", 62, "ERROR", 3), ("b", 86, "EXPIRED", 3)]


def test_shared_folder(spark):
    assert sources.shared_folder(spark, "x") != sources.shared_folder(spark, "x")


def test_a_batch_of_results_touches_the_state_once():
    import collections

    import pandas as pd

    from kelvane.streaming.lifecycle import Tasks

    calls, held = collections.Counter(), {}

    class Store:
        def __getattr__(self, name):
            def call(*args):
                calls[name] += 1
                if name == "update":
                    held["task"] = args[0]
                return {"exists": "task" in held, "get": held.get("task"), "listTimers": iter(())}.get(name)

            return call

    tasks = Tasks("k", "s", "n", 10, 500, 1000)
    tasks.handle = tasks.state = Store()
    rows = pd.DataFrame({"t": range(100), "n": range(100), "s": ["FAIL"] * 99 + ["SUCCESS"]})
    out = pd.concat(list(tasks.handleInputRows(("a",), iter([rows]), None)))
    assert out.values.tolist() == [["a", 99, "DONE", 100]] and held["task"] == (100, "DONE", 1099)
    assert calls["registerTimer"] == 1 and sum(calls.values()) <= 4


def test_hits_are_handed_on_in_parts(spark, monkeypatch):
    """Neither the hits of a batch nor an automaton grow with the tables."""
    from kelvane.operators import keywords

    monkeypatch.setattr(keywords, "HITS", 8)
    assert keywords.AUTOMATON_BYTES <= 4 << 20
    texts = spark.createDataFrame([(i, "Alfa beta gama") for i in range(50)] + [(50, None)], "i int, text string").coalesce(1)
    rules = spark.createDataFrame([("a", "ALFA", 1), ("b", "alfa", 2), ("c", "Gama", 4), ("d", "", 8), ("e", "delta", 16)], "category string, keyword string, score int")
    got = keywords.rule_hits(texts, "i", "text", rules).collect()
    assert sorted((r.i, r.category, r.keyword, r.score) for r in got) == sorted([(i, c, k, s) for i in range(50) for c, k, s in (("a", "ALFA", 1), ("b", "alfa", 2), ("c", "Gama", 4), ("d", "", 8))] + [(50, "d", "", 8)])
