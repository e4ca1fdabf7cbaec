"""Passages that stand at more than one place: the index against plain counting, the operator against its definition."""

from __future__ import annotations

import collections
import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kelvane.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from kelvane.llm import _grams, fm_index  # noqa: E402


def by_definition(texts, window=35):
    """(n_words, n_removed, sha256) of each text, in order."""
    every = [brute.words(t) for t in texts]
    times = collections.Counter(tuple(w[i : i + window]) for w in every for i in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def rows(df):
    return sorted(tuple(r)[1:] for r in fm_index.digest(df).collect())


@pytest.mark.parametrize("levels", [1, 3, 9])
def test_wavelet_matrix_counts_symbols(levels):
    values = np.random.default_rng(levels).integers(0, 1 << levels, 777)
    matrix = fm_index.WaveletMatrix(values, levels)
    at = np.arange(len(values) + 1)
    for symbol in {0, int(values[0]), (1 << levels) - 1}:
        s = np.full(len(at), symbol)
        assert (matrix.walk(s, at) - matrix.walk(s, np.zeros_like(at))).tolist() == np.append(0, np.cumsum(values == symbol)).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    rng = np.random.default_rng(seed)
    pieces = [rng.integers(1, 4 + seed, rng.integers(1, 30)) for _ in range(25)]
    pieces += [pieces[3], pieces[4]]
    text = np.concatenate([np.append(p, 0) for p in pieces])
    index = fm_index.FMIndex(text, 30)
    joined, ends, most = np.concatenate(pieces), [], []
    for p, begin in zip(pieces, np.cumsum([0, *map(len, pieces)]), strict=False):
        ends += [begin + k for k in range(1, len(p) + 1)]
        most += list(range(1, len(p) + 1))
    found = collections.Counter(tuple(p[i:j].tolist()) for p in pieces for i in range(len(p)) for j in range(i + 1, len(p) + 1))
    got = index.matching(joined, np.array(ends), np.array(most))
    for e, m, n in zip(ends, most, got.tolist(), strict=True):
        assert n == max([k for k in range(1, m + 1) if found[tuple(joined[e - k : e].tolist())] > 1], default=0)


def test_repeated_grams(spark):
    grams = [random.Random(k % 400).getrandbits(63) * 2 for k in range(1000)] + [5 << 40] * 50
    df = spark.createDataFrame([(str(g),) for g in grams], "g string").repartition(3)
    bitmap, often = _grams.repeated_grams(df, lambda b: iter([np.array([int(v) for v in b.column(0).to_pylist()], np.uint64)]), 5, 20, 49)
    times = collections.Counter(grams)
    assert often.tolist() == [5 << 40]
    shared = {g >> 44 for g, n in times.items() if n > 1}
    assert _grams.told(bitmap, np.array(list(times), np.uint64), 20).tolist() == [g >> 44 in shared for g in times]


def texts_of(seed=3):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(300))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, short = say(50), say(34)
    out = [say(rng.choice([0, 10, 34, 35, 80])) for _ in range(30)]
    out += [say(20) + " " + passage + "\n" + say(30) for _ in range(5)] + [say(9) + "\t" + short + " " + say(9) for _ in range(5)]
    out += [out[5], out[5], passage, passage[:-1] + "x", " ".join([say(40)] * 2), "a " * 200, "b " * 36, "é ñ " * 40, None, "", " \n\t "]
    near = out[30].split()
    return out + [" ".join([*near[:20], "other", *near[21:]]), " ".join(near)]


@pytest.mark.parametrize("often", [8192, 1])
def test_passages(spark, monkeypatch, often):
    texts = texts_of()
    want = sorted(by_definition(texts))
    docs = spark.createDataFrame([(i * 7 - 50, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    assert rows(fm_index.without_passages(docs, part_bytes=2048, shard=300, often=often)) == want
    # any ids: strings, nulls, repeated rows; and long texts in segments
    monkeypatch.setattr(fm_index, "SEGMENT", 64)
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.concat(F.lit("id"), F.col("doc_id").cast("string"))))
    assert rows(fm_index.without_passages(odd, often=often)) == want
    twice = docs.unionAll(docs)
    assert rows(fm_index.without_passages(twice)) == sorted(by_definition(texts + texts))


def test_long_texts_in_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fm_index, "SEGMENT", 16)
    text = " ".join(f"word{k}" for k in range(300)) + " " + "x" * 500 + " end"
    words = brute.words(text)
    for overlap in (0, 4):
        seen = {}
        for rows_, base, found in fm_index.word_segments(pa.array([text]), overlap):
            assert rows_.tolist() == [0]
            for k, (a, b) in enumerate(zip(found.starts, found.ends, strict=True)):
                seen[base + k] = found.data[a:b].tobytes().decode()
        assert seen == dict(enumerate(words))


def test_spans_are_maximal_and_empty_tables_stay_empty(spark):
    texts = ["a b c d e f", "x b c d e y", "b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r.kept) for r in fm_index.without_passages(docs, window=3, gram=2).collect()}
    assert got == {0: ([(1, 5)], "a f"), 1: ([(1, 5)], "x y"), 2: ([(0, 4)], "")}
    assert fm_index.without_passages(docs.limit(0)).count() == 0
