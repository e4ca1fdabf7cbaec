"""The pipeline as a whole: odd rows, clashing columns, empty tables, and what mixing makes of the sources."""

from __future__ import annotations

import collections
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

pytest.importorskip("kelvane.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from kelvane.llm import fm_index, line_runs, mixing, near_dups, packing, rules, substrings  # noqa: E402
from test_llm_operators import CLASH, SCHEMA, clash_unchanged, prose  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def write(folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    text = prose(rng, 40)
    rows = [(None, prose(rng, 30)), (None, prose(rng, 30)), (1, text), (1, text), (2, text), (2, prose(rng, 25)), (3, None), (4, ""), (5, "two words"), (6, prose(rng, 6000)), (7, text + " tail")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    folder = write(tmp_path, docs, spark.createDataFrame([], LABELS))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        assert now.columns == docs.columns and clash_unchanged(now), name
    ids = collections.Counter(r.doc_id for r in now.collect())
    assert {1, 2, 6} <= set(ids) and not {3, 4, 5} & set(ids) and ids[1] <= 3  # the second text of doc_id 2 is like no other
    other = near_dups.near_duplicates(docs)  # not read yet: its tables must stay
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in found} == set(ids) and other.count() == len(rows)


def test_no_distinct_text_goes(spark):
    rng = random.Random(9)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(2, one), (2, two), (3, three), (3, three + " tail"), (4, one), (4, one), (5, two + " tail"), (2, None), (2, ""), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumns({k: F.lit(v) for k, v in (CLASH | {"tid": "t", "_tid": "u"}).items()})
    for parts in (1, 3):
        kept = near_dups.drop_near_duplicates(docs.repartition(parts))
        assert kept.columns == docs.columns
        got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
        assert {k: n for k, n in got.items() if k[0] != 3} == {(2, one): 1, (2, two): 1, (2, None): 1, (2, ""): 1, (None, one): 2}
        assert sum(n for k, n in got.items() if k[0] == 3) == 1
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert collections.Counter((r.doc_id, r.text) for r in near_dups.drop_near_duplicates(named).collect())[("d2", two)] == 1


def test_string_and_null_ids(spark):
    rng = random.Random(8)
    rows = [(None, prose(rng, 40)), (None, prose(rng, 40)), ("b", prose(rng, 60)), ("a", prose(rng, 9)), ("a", None)]
    rows += [("c", rows[2][1]), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA.replace("doc_id long", "doc_id string"))
    packed = packing.pack_documents(docs).collect()
    assert sorted(r.doc_id or "" for r in packed) == sorted(i or "" for i, _ in rows)
    found = substrings.digest(substrings.without_repeats(docs)).collect()
    assert sorted((r.doc_id or "", r.n_removed > 0) for r in found) == [("", False), ("", False), ("", True), ("a", False), ("a", False), ("b", False), ("c", True)]
    for operator in (mixing.mix_sources, line_runs.without_runs, near_dups.near_duplicates, fm_index.without_passages):
        assert operator(docs).count() == len(rows)
    assert rules.with_stats(docs).count() == len(rows)


def test_runs_own_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from kelvane.llm._spark import Run, cut

    def one(k):
        steps, df = Run(spark), spark.range(5)
        for _ in range(3):
            df = steps.settled(lambda df=df: cut(df).withColumn("k", F.lit(k)).select("id"))
        return df.count()

    outside = cut(spark.range(3))
    steps = Run(spark)
    steps.settled(lambda: spark.range(2))
    lazy = cut(spark.range(4))
    steps.settled(lambda: spark.range(2))
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(one, range(8))) == [5] * 8
    assert (outside.count(), lazy.count()) == (3, 4)


def test_nothing_to_do(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.run(spark, write(tmp_path / "a", none, spark.createDataFrame([], LABELS))).count() == 0
    bad = spark.createDataFrame([(1, "x", None, "a", 1), (2, None, None, "a", 0)], SCHEMA)
    assert corpus_pipeline.run(spark, write(tmp_path / "b", bad, spark.createDataFrame([(1, 1, 0)], LABELS))).count() == 0


def test_sources_come_to_their_targets(spark):
    rng = random.Random(4)
    sources = ["a"] * 700 + ["b"] * 200 + [None] * 300 + ["c"] * 60
    docs = spark.createDataFrame([(i, "w " * rng.randrange(20, 200), "en", s, None) for i, s in enumerate(sources)], SCHEMA).repartition(4)
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    size = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    before, after = size(docs), size(mixed)
    order = ["a", "b", "c", None]
    want = dict(zip(order, brute.targets([before[s] for s in order], [1, 2, 3, 1]), strict=True))
    assert all(abs(after[s] - want[s]) <= 0.05 * want[s] for s in order), (after, want)
    assert sum(after.values()) == pytest.approx(sum(before.values()), rel=0.03)
