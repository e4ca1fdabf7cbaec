"""Product codes and ball clusters against plain integers, with ties, repeated, odd and huge vectors."""

from __future__ import annotations

import hashlib
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("kelvane.llm")

from kelvane.llm import _vectors, ball_clusters, product_codes  # noqa: E402

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def lloyd(points, centroids, rounds):
    """Labels, squared distances and final centroids."""
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(p)[1] for p in points]
        new = []
        for k, c in enumerate(centroids):
            mine = [p for p, w in zip(points, at, strict=True) if w == k]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
        centroids = new
    found = [near(p) for p in points]
    return [k for _, k in found], [d for d, _ in found], centroids


def vectors(n, size, seed=1, huge=False):
    rng = random.Random(seed)
    out = [[rng.gauss(0, 1) * (1e6 if huge and i % 5 == 0 else 0.2) for _ in range(size)] for i in range(n)]
    for i in range(3, n, 7):
        out[i] = out[3]  # a common vector
    return out


@pytest.mark.parametrize(("size", "huge"), [(1, False), (3, False), (8, True)])
def test_annuli_find_what_a_full_search_finds(size, huge):
    rng = np.random.default_rng(size)
    scale = 1 << 40 if huge else 9
    entries = rng.integers(-scale, scale, (16, size))
    entries[7] = entries[2]
    x = np.concatenate([rng.integers(-scale, scale, (300, size)), entries, np.zeros((1, size), np.int64)])
    at, far, asked = product_codes.Annuli(entries).nearest(x)
    for row, k, d in zip(x.tolist(), at.tolist(), far.tolist(), strict=True):
        assert (d, k) == min((sum((a - b) ** 2 for a, b in zip(row, c, strict=True)), j) for j, c in enumerate(entries.tolist()))
    assert asked <= len(x) * 16
    apart = np.arange(1, 17)[:, None] * np.full((1, size), 1000)
    assert product_codes.Annuli(apart).nearest(apart[[0, 5, 15]] + 1)[2] <= 6  # norms tell entries apart


@pytest.mark.parametrize("huge", [False, True])
def test_product_codes(spark, huge):
    vecs = vectors(70, 10, huge=huge)
    rows = [(i * 3, v, i % 3 if i % 4 else None) for i, v in enumerate(vecs)]
    bad = [(1, None, 1), (2, [0.0] * 9 + [None], 1), (4, [NAN] + [0.0] * 9, 2), (5, [0.0] * 9 + [INF], 2), (7, [1.0] * 6, 1), (8, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("x")).repartition(3)
    codes, books = product_codes.product_codes(df, parts=4, entries=6, rounds=3)
    got = {r.vec_id: r for r in product_codes.digest(codes, books).collect()}
    assert set(got) == {r[0] for r in rows}
    whole = [[math.floor(4096 * x) for x in v] + [0, 0] for v in vecs]
    error, code, final = [0] * len(rows), [""] * len(rows), []
    for p in range(4):
        mine = [v[3 * p : 3 * p + 3] for v in whole]
        at, far, entries = lloyd(mine, mine[:6], 3)
        final += [x for e in entries for x in e]
        error, code = [a + b for a, b in zip(error, far, strict=True)], [c + f"{k:02x}" for c, k in zip(code, at, strict=True)]
    sums = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    name = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    for (i, _, label), c, e in zip(rows, code, error, strict=True):
        assert tuple(got[i])[1:] == (c, min(e, _vectors.LONG), min(sums[label], _vectors.LONG), name)


def test_product_codes_of_few_and_odd_rows(spark):
    schema = "vec_id string, embedding array<float>, label string"
    empty = spark.createDataFrame([], schema)
    assert product_codes.digest(*product_codes.product_codes(empty)).count() == 0
    few = spark.createDataFrame([(None, [1e38, -1e38], None), ("a", [0.5, 0.25], "x"), ("a", [0.5, 0.25], "x")], schema)
    got = product_codes.digest(*product_codes.product_codes(few, parts=2)).collect()
    assert sorted((r.vec_id or "", r.code, r.error, r.label_error) for r in got) == [("", "0202", 0, 0), ("a", "0000", 0, 0), ("a", "0000", 0, 0)]


@pytest.mark.parametrize(("leaf", "huge"), [(1, False), (5, False), (5, True)])
def test_balls_give_the_labels_of_a_full_search(leaf, huge):
    x = np.array([[math.floor(256 * v) for v in row] for row in vectors(200, 6, 4, huge)], np.int64) * (1 << 20 if huge else 1)
    x[100:, 0] += 5000  # two groups apart
    tree, order = ball_clusters.BallTree.build(x, leaf)
    assert (tree.points == x[order]).all()
    centroids = np.concatenate([x[[3, 3, 1, 150, 2]], x[[3]] + 1])
    want, far, _ = lloyd(tree.points.tolist(), centroids.tolist(), 0)
    assert tree.labels(centroids).tolist() == want
    assert ball_clusters.squared(tree.points, centroids[want]).tolist() == [min(d, _vectors.LONG) for d in far]
    sums = tree.sums_of(centroids)
    for k in range(len(centroids)):
        mine = [p for p, w in zip(tree.points.tolist(), want, strict=True) if w == k]
        assert sums[k].tolist() == ([sum(v) for v in zip(*mine, strict=True)] if mine else [0] * 6) + [len(mine)]
    if leaf == 5 and not huge:
        whole, rows, _ = tree.assign(np.array([x[:100].mean(axis=0), x[100:].mean(axis=0)]).astype(np.int64))
        assert not len(rows) and sum(len(b) for b, _ in whole) < 40  # groups apart go as balls
    again = ball_clusters.BallTree.of_bytes(tree.points, tree.to_bytes())
    assert again.labels(centroids).tolist() == want


def test_ball_clusters(spark):
    vecs = vectors(150, 64)
    rows = list(enumerate(vecs))
    bad = [(1000, None), (1001, [0.0] * 63), (1002, [None] * 64), (1003, [NAN] + [0.0] * 63), (1004, [0.0] * 63 + [-INF])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit(7)).repartition(4)
    got = {r.vec_id: tuple(r)[1:] for r in ball_clusters.digest(*ball_clusters.cluster(df, block=32, leaf=4)).collect()}
    whole = [[math.floor(256 * x) for x in v] for v in vecs]
    first = sorted(range(len(vecs)), key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:40]
    at, far, final = lloyd(whole, [whole[i] for i in first], 5)
    for i, (k, d) in enumerate(zip(at, far, strict=True)):
        name = hashlib.sha256(",".join(map(str, final[k])).encode()).hexdigest()
        assert got[i] == (k, d, sum(e for w, e in zip(at, far, strict=True) if w == k), sum(far), name)
    assert set(got) == set(range(150))


def test_ball_clusters_of_few_and_odd_rows(spark):
    schema = "vec_id string, embedding array<float>"
    assert ball_clusters.digest(*ball_clusters.cluster(spark.createDataFrame([], schema))).count() == 0
    few = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), (None, [3.0, 1e38])], schema)
    got = ball_clusters.digest(*ball_clusters.cluster(few, size=2)).collect()
    assert sorted((r.vec_id or "", r.cluster, r.distance) for r in got) == [("", 2, 0), ("a", 0, 0), ("a", 0, 0)]


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("operator", [product_codes, ball_clusters])
def test_sql(spark, operator):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = operator.query(spark, SF)
    found = db.execute(operator.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(map(tuple, found.fetchall()))


def test_the_neighbour_graph_holds_k_neighbours_and_not_all():
    import tracemalloc

    from kelvane.llm.neighbours import neighbour_graph

    x = np.random.default_rng(1).normal(size=(4000, 8)).astype(np.float32)
    tracemalloc.start()
    graph = neighbour_graph(x, 5)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert graph.shape == (4000, 5) and held < 1 << 20 and peak < 60 << 20
