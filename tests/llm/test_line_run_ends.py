"""Repeated runs of lines go to their last line, against the definition itself."""

from __future__ import annotations

import random

import pytest

line_runs = pytest.importorskip("kelvane.llm.line_runs")


def by_definition(docs, span=20):
    """Kept text of each text: without the lines in any run of span words or more that stands earlier as well."""
    runs, out = [], []
    for d, text in enumerate(docs):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        for a in range(len(full)):
            for b in range(a, len(full)):
                if sum(len(lines[i].split()) for i in full[a : b + 1]) >= span:
                    runs.append((d, a, tuple(lines[i] for i in full[a : b + 1]), full[a], full[b]))
    first = {}
    for d, a, body, *_ in runs:
        first.setdefault(body, (d, a))
    for d, text in enumerate(docs):
        gone = {i for e, a, body, start, end in runs if e == d and first[body] < (d, a) for i in range(start, end + 1)}
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone))
    return out


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_ends_of_runs(spark):
    long_, short = words("l", 50), words("s", 5)
    rng = random.Random(3)
    lines = [words(chr(97 + k), n) for k, n in enumerate([1, 2, 4, 5, 7, 9, 10, 11, 19, 20, 25])]
    texts = [long_ + "\n" + short, long_ + "\n" + short, long_ + "\nother", short + "\n" + long_ + "\n\n" + short + "\nnew"]
    # the earliest place of a run is not always the one that goes on as the later one does
    texts += [words("p", 30) + "\nx", words("p", 30) + "\ny", words("p", 30) + "\ny"]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.row.doc_id: r.kept for r in line_runs.without_runs(df).collect()}
    assert got[1] == "" and got[2] == "other" and got[6] == ""
    assert got == dict(enumerate(by_definition(texts)))
