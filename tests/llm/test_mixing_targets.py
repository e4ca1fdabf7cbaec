"""Sources of every size come to their targets, also beside much larger ones."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

mixing = pytest.importorskip("kelvane.llm.mixing")


def test_last_blocks():
    for words in range(1, 40):
        for block in range(1, 9):
            n = -(-words // block)
            for rank in range(n):
                size = [words - (n - 1) * block if r == rank else block for r in range(n)]
                for rest in range(words):
                    full, part = mixing.last_blocks(rest, words, block, rank)
                    assert sum(size[:full]) + part == rest and (not part or part <= size[full])


@pytest.mark.parametrize("blocks", [1, mixing.BLOCKS])
def test_targets_of_small_sources(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "BLOCKS", blocks)  # 1: the block that a corpus of 5e9 words has
    words = {"a": [7] * 9 + [37], "b": [1500], "c": [1], "d": [2500, 0, 2500], "e": [40] * 2000, "f": [0], None: [333, 100]}
    rows = [(f"{s}{i}", s, "w " * n) for s, sizes in words.items() for i, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id string, source string, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        times = r.target / max(r.source_size, 1)
        assert int(times) * r.size <= r.taken + 1 and r.taken <= (int(times) + 1) * r.size
    assert sum(taken.values()) == sum(map(sum, words.values()))
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)


def test_copies_of_one_row_are_dealt_apart(spark, monkeypatch):
    """A row that stands thousands of times is no hot key: its copies get keys, and so shards, of their own."""
    rows = [(None, "a", "one two three")] * 3000 + [(i, "a", "w " * (i % 9 + 1)) for i in range(1000)] + [(7, None, "x y")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    sized = docs.select("doc_id", "source", mixing.text_words("text").alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    for most in (64, 1 << 16):
        made = mixing.apart(sized, most)
        assert made.count() == len(rows) and made.select("key").distinct().count() == 1000 + 3000 + 5
        held = [r["count"] for r in made.groupBy(F.pmod(F.xxhash64("key"), F.lit(8)).alias("shard")).count().collect()]
        assert max(held) < 2 * min(held)
    monkeypatch.setattr(mixing, "COPIES", 64)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert {r.source_size for r in got if r.source == "a"} == {9000 + sum(i % 9 + 1 for i in range(1000))}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix_sources(docs)
