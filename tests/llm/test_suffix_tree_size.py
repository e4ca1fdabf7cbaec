"""The suffix tree has no bound of its own: more symbols than 2**20, and bitmaps that are full."""

from __future__ import annotations

import math
import random
import sys
import zlib
from pathlib import Path

import pytest

pytest.importorskip("kelvane.llm")
sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from kelvane.llm import suffix_tree  # noqa: E402


def test_more_symbols_than_a_million(spark, monkeypatch):
    """Every word stands twice, each time after the same ones, so each context of the tree is as good as certain of the next word."""
    monkeypatch.setattr(suffix_tree, "LEAST", 2)
    monkeypatch.setattr(suffix_tree, "ROOT", 0.0)
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10][:1060]
    held = next(i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0)
    text = lambda k: " ".join(f"w{n}" for n in range(2000 * k, 2000 * (k + 1)))
    rows = [(i, text(k // 2)) for k, i in enumerate(train)] + [(held, text(5))]
    known, words = 1060 * 2001, 530 * 2000
    assert words > 1 << 20
    got = [r for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r.doc_id == held][0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (2001, 2001, known)
    p = (2 + 0.1) / (known + 0.1 * (words + 2))
    chain = []
    for _ in range(3):
        p = (2 - suffix_tree.DISCOUNT) / 2 + suffix_tree.DISCOUNT / 2 * p
        chain.append(math.log10(p))
    # words 2 and 3 have one and two levels, those from the fourth on three; the first one and the end, which all texts share, are left a margin
    assert chain[0] + chain[1] + 1997 * chain[2] - 20 < got.score < chain[0] + chain[1] + 1997 * chain[2]


def test_full_bitmap(spark, monkeypatch):
    """Where the bitmap is full it keeps nothing out, to the same result."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = list(enumerate(" ".join(words[(3 * i + k // 2 + (rng.random() < 0.3) * rng.randrange(40)) % 40] for k in range(rng.randrange(0, 70))) for i in range(90)))
    monkeypatch.setattr(suffix_tree, "LEAST", 3)
    monkeypatch.setattr(suffix_tree, "BITS", 6)
    monkeypatch.setattr(suffix_tree, "BLOCK", 100)
    got = {r.doc_id: round(r.score, 6) for r in suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute.tree_scores(rows, 3, 1 << 62, suffix_tree.SHARE, suffix_tree.DEPTH, suffix_tree.DIVERGENCE, suffix_tree.DISCOUNT)
    assert got == {i: round(v, 6) for i, v in want.items()}
