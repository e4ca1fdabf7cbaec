"""Clusters around centroids: whole balls of vectors are assigned at once.

Vectors become whole numbers, and each task builds metric trees over blocks of the vectors that it reads: a node is a
ball with the count and the whole-number sum of its vectors, their mean as its centre, and a radius. Trees are written
once. A round sends the centroids to all trees and descends each: by the triangle inequality, a centroid whose distance
from a ball's centre exceeds the least such distance by more than twice the radius is nearest to no vector inside. Where
one centroid is left, the whole ball goes to it, by count and sum; otherwise the ball's halves are asked, and in the end
the vectors of leaves, by exact distances in whole numbers. Tasks add up sums and counts by centroid, so what is
shuffled depends on the number of centroids alone.

Edge cases: vectors that are null, hold null or non-finite components or have another number of components than asked
are dropped; the first centroids go by hash, null ids last, and equal ones by components; with fewer vectors than
centroids, there are as many centroids as vectors; equal vectors and centroids are allowed: ties of distance go to the
smaller number, and of equal centroids only the smallest number can win; empty clusters stay where they are; an empty
table gives an empty result; components beyond 2**50 (after scaling) are taken as that, and sums of distances beyond a
long as the largest long; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from ._vectors import LONG, exact, finite, longs, sums_by, totals, whole_numbers

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256.0
#: Vectors of a tree and of a leaf, at most.
BLOCK, LEAF = 4096, 24


class BallTree:
    """Balls of rows of ``points``, the root first; ``start`` and ``end`` are their ranges, ``child`` the first of two halves (0: a leaf)."""

    FIELDS = {"start": "<i4", "end": "<i4", "child": "<i4", "radius": "<f8", "sums": "<i8"}  # noqa: RUF012

    def __init__(self, points: np.ndarray, **fields: np.ndarray) -> None:
        self.points = points
        self.start, self.end, self.child, self.radius, self.sums = (fields[k] for k in self.FIELDS)

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF) -> tuple[BallTree, np.ndarray]:
        """A tree, and the order in which it holds the rows: halves at the median of the widest component."""
        order, nodes, k = np.arange(len(points)), [[0, len(points), 0]], 0
        while k < len(nodes):
            a, b, _ = nodes[k]
            if b - a > leaf:
                mine = points[order[a:b]]
                widest = np.ptp(mine, axis=0).argmax()
                if mine[:, widest].min() < mine[:, widest].max():
                    half = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(mine[:, widest], half)]
                    nodes[k][2] = len(nodes)
                    nodes += [[a, a + half, 0], [a + half, b, 0]]
            k += 1
        points = points[order]
        start, end, child = np.array(nodes, "<i4").reshape(-1, 3).T
        sums = np.stack([points[a:b].sum(axis=0) for a, b in zip(start, end, strict=True)])
        radius = np.array([np.sqrt(((points[a:b] - s / (b - a)) ** 2).sum(axis=1).max()) for a, b, s in zip(start, end, sums, strict=True)])
        return BallTree(points, start=start, end=end, child=child, radius=radius, sums=sums), order

    def to_bytes(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, k), t).tobytes() for k, t in self.FIELDS.items()]

    @staticmethod
    def of_bytes(points: np.ndarray, blobs: list[bytes]) -> BallTree:
        fields = {k: np.frombuffer(b, t) for (k, t), b in zip(BallTree.FIELDS.items(), blobs, strict=True)}
        fields["sums"] = fields["sums"].reshape(-1, points.shape[1])
        return BallTree(points, **fields)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """Whole balls with their centroids (pairs of arrays), and the other vectors with theirs."""
        numbers = np.sort(np.unique(centroids, axis=0, return_index=True)[1])
        places = centroids[numbers].astype(np.float64)
        slack = 1e-9 * (np.abs(places).max(initial=0) + np.abs(self.points).max(initial=0) + 1) * places.shape[1] ** 0.5
        balls, leaves, nodes, open_ = [], [], np.array([0]), np.ones((1, len(numbers)), bool)
        while len(nodes):
            centre = self.sums[nodes] / (self.end[nodes] - self.start[nodes])[:, None]
            far = np.sqrt(np.stack([((centre - p) ** 2).sum(axis=1) for p in places], axis=1))
            far[~open_] = np.inf
            open_ = far <= far.min(axis=1, keepdims=True) + 2 * self.radius[nodes, None] + slack
            one = open_.sum(axis=1) == 1
            balls.append((nodes[one], numbers[open_[one].argmax(axis=1)]))
            leaf = ~one & (self.child[nodes] == 0)
            leaves.append(nodes[leaf])
            on = ~one & ~leaf
            nodes, open_ = np.concatenate([self.child[nodes[on]], self.child[nodes[on]] + 1]), np.concatenate([open_[on]] * 2)
        rows = np.concatenate([np.arange(self.start[k], self.end[k]) for k in np.concatenate(leaves)] or [np.zeros(0, np.int64)])
        return balls, rows, numbers[nearest(self.points[rows], centroids[numbers])]

    def labels(self, centroids: np.ndarray) -> np.ndarray:
        """The centroid of each row."""
        out = np.zeros(len(self.points), np.int64)
        balls, rows, at = self.assign(centroids)
        out[rows] = at
        for nodes, who in balls:
            for k, w in zip(nodes.tolist(), who.tolist(), strict=True):
                out[self.start[k] : self.end[k]] = w
        return out

    def sums_of(self, centroids: np.ndarray) -> np.ndarray:
        """Sums and counts of the rows of each centroid."""
        balls, rows, at = self.assign(centroids)
        out = sums_by(self.points[rows], at, len(centroids))
        for nodes, who in balls:
            np.add.at(out, who, np.column_stack([self.sums[nodes], self.end[nodes] - self.start[nodes]]).astype(object))
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row; ties go to the smaller number."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * most * most * centroids.shape[1] < 1 << 53:  # whole numbers that floats hold
        y, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((c * c).sum(axis=1) - 2 * (y @ c.T)).argmin(axis=1)
    y, c = exact(x, centroids)
    return np.stack([((y - row) ** 2).sum(axis=1) for row in c], axis=1).argmin(axis=1) if len(y) else np.zeros(0, np.int64)


def squared(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as longs."""
    x, to = exact(x, to)
    return longs(((x - to) ** 2).sum(axis=1))


def _tree(row: dict, size: int) -> BallTree:
    return BallTree.of_bytes(np.frombuffer(row["points"], "<i4" if row["short"] else "<i8").reshape(-1, size).astype(np.int64), [row[k] for k in BallTree.FIELDS])


def metric_trees(kept: DataFrame, size: int, scale: float = SCALE, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Trees over blocks of the rows (vec_id, embedding) that a task reads: a row each, with ids in the order of the points."""
    kind = kept.schema["vec_id"].dataType.simpleString()
    names = ["ids", "short", "points", *BallTree.FIELDS]

    def grow(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tree, order = BallTree.build(whole_numbers(whole.column(1), size, scale), leaf)
        short = bool(np.abs(tree.points).max(initial=0) < 1 << 31)
        ids = whole.column(0).take(pa.array(order))
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([short]), *(pa.array([b], pa.binary()) for b in (tree.points.astype("<i4" if short else "<i8").tobytes(), *tree.to_bytes()))]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= block:
                yield grow([*held, batch.slice(0, block - n)])
                batch, held, n = batch.slice(block - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield grow(held)

    return kept.select("vec_id", "embedding").mapInArrow(run, f"ids array<{kind}>, short boolean, points binary, " + ", ".join(f"{k} binary" for k in BallTree.FIELDS))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: float = SCALE, seed: str = "2", block: int = BLOCK, leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of all usable rows (vec_id, embedding) of ``vectors``, and the final centroids."""
    vector = F.col("embedding").cast("array<double>")
    kept = vectors.select("vec_id", vector.alias("embedding")).filter((F.size("embedding") == size) & finite(F.col("embedding")))
    kind = kept.schema["vec_id"].dataType.simpleString()
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("embedding", named.alias("name")).orderBy(F.col("name").asc_nulls_last(), "embedding").limit(clusters).select("embedding").toArrow()  # as many as centroids
    centroids = whole_numbers(first.column(0).combine_chunks(), size, scale) if first.num_rows else np.zeros((0, size), np.int64)
    trees = cut(metric_trees(kept, size, scale, block, leaf))
    for _ in range(rounds if len(centroids) else 0):

        def sums(batch: pa.RecordBatch, centroids: np.ndarray = centroids) -> np.ndarray:
            return sum((_tree(row, size).sums_of(centroids) for row in batch.to_pylist()), np.zeros((len(centroids), size + 1), object))

        found = totals(trees.drop("ids"), sums, (len(centroids), size + 1))
        centroids, used = centroids.copy(), found[:, -1] > 0
        centroids[used] = (found[used][:, :-1] // found[used][:, -1:]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree = _tree(batch.select(batch.schema.names[1:]).slice(k, 1).to_pylist()[0], size)
                at = tree.labels(centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1).flatten(), pa.array(at, pa.int32()), pa.array(squared(tree.points, centroids[at]))], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), centroids


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The vectors with the sums of distances of their clusters and of all, and their centroids' hashes."""
    found = cut(found)
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row for each centroid
    inertia = {r.cluster: int(r.inertia) for r in sums}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, min(inertia.get(k, 0), LONG), name) for k, name in enumerate(names)]
    of = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(of), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(min(sum(inertia.values()), LONG)).cast("long").alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(*cluster(table(spark, sf_dir, "embeddings")))


def _oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The definition in SQL: every vector with every centroid, round by round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT k, c FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v AS c FROM kept) WHERE k < {clusters}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, v, m % 64 AS k, m // 64 AS d FROM (
    SELECT vec_id, any_value(v) AS v, min(CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 64 + k) AS m
    FROM kept CROSS JOIN c{i} GROUP BY vec_id)
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, {COMPONENTS + 1})) AS i) GROUP BY k, i) GROUP BY k
  ) n USING (k)
)""")
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLE = _oracle()
