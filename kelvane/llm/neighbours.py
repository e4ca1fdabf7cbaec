"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into equal parts (spectral bisection, then moves that
keep the parts near equal), and a small network learns to which parts a vector's neighbours belong. Every vector
is indexed under its most probable part; a query is sent to its most probable parts, as many as reached
the wished recall for a part of the sample held back from training (or more, until it meets enough vectors), and
what it meets there is ranked by the exact inner product in double precision. Parts are searched in blocks, so neither
a large part nor a popular one meets in a single task; equal vectors are indexed once, with their smallest ids.

Edge cases: null vectors, zero vectors, and those with null or non-finite components take no part, nor do vectors
of another length than the commonest (the longer one, if two are as common), nor rows with a null vec_id; rows with equal
vec_id and vector are one; equal scores go to the smaller vec_id; an empty table, or one vector alone, gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, share_of, table

NEAREST, EVERY = 20, 20
#: Vectors of a part, about, and parts at most: one driver learns the partition.
PART, MAX_PARTS = 800, 512
#: Distinct vectors that the partition and the network are learned from (about), or 48 for each part: 24,576 at most.
SAMPLE = 6000
#: A query is sent to as many of its most probable parts as find this share of the true neighbours of sampled
#: vectors that the router was not trained on.
RECALL = 0.96
#: Vectors that one task holds, and queries that it is sent, one batch after the other.
BLOCK, TURN = 16_384, 1 << 18


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k vectors with the largest inner products, for each."""
    k, out = min(k, len(x) - 1), []
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())  # a view would hold the indices of all vectors
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for each node of the graph: spectral bisection down to ``parts``, then moves to where most neighbours are."""
    n, k = graph.shape
    rng, out = np.random.default_rng(seed), np.zeros(n, np.int64)
    a, b = np.repeat(np.arange(n), k), graph.ravel()

    def split(nodes: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            out[nodes] = first
            return
        inner = np.full(n, -1)
        inner[nodes] = np.arange(len(nodes))
        keep = (inner[a] >= 0) & (inner[b] >= 0)
        i, j = inner[a[keep]], inner[b[keep]]
        degree = np.sqrt(np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes)) + 1.0)
        v = rng.normal(size=len(nodes))
        for _ in range(60):  # towards the second eigenvector of the scaled adjacency
            v -= degree * (v @ degree) / (degree @ degree)
            w = v / degree
            v = v + (np.bincount(i, w[j], minlength=len(nodes)) + np.bincount(j, w[i], minlength=len(nodes)) + w) / degree
            v /= np.linalg.norm(v) + 1e-300
        half = count // 2
        order, at = np.argsort(v / degree, kind="stable"), len(nodes) * half // count
        split(nodes[order[:at]], first, half)
        split(nodes[order[at:]], first + half, count - half)

    split(np.arange(n), 0, parts)
    room = int(np.ceil(slack * n / parts))
    for _ in range(rounds):
        votes = np.bincount(np.concatenate([a * parts + out[b], b * parts + out[a]]), minlength=n * parts).reshape(n, parts)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), out]
        size, moved = np.bincount(out, minlength=parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < room:
                size[out[v]] -= 1
                size[best[v]] += 1
                out[v] = best[v]
                moved += 1
        if not moved:
            break
    return out


@dataclass
class Router:
    """A network with one hidden layer: vector to log-odds of the parts."""

    weights: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x.astype(np.float32) @ a + b, 0) @ c + d

    @staticmethod
    def train(x: np.ndarray, goal: np.ndarray, hidden: int = 128, epochs: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> Router:
        """Fit to ``goal``: the shares of each vector's neighbours (and itself) by part."""
        rng, x = np.random.default_rng(seed), x.astype(np.float32)
        w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, goal.shape[1])), np.zeros(goal.shape[1])]
        w = [v.astype(np.float32) for v in w]
        m, s, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                d = (p / p.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
                dh = (d @ w[2].T) * (h > 0)
                t += 1
                now = rate * (1 - (t - 1) / steps)
                for k, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    w[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return Router(w)


def learn(x: np.ndarray, parts: int, k: int = NEAREST, recall: float = RECALL) -> tuple[Router, int]:
    """Partition the sample's neighbour graph, train the router, and find how many parts a query must be sent to."""
    x = x.astype(np.float32)
    back = np.arange(0, len(x), 10)
    fit = np.setdiff1d(np.arange(len(x)), back)
    graph = neighbour_graph(x[fit], k)
    of = balanced_parts(graph, parts)
    goal = np.zeros((len(fit), parts), np.float32)
    np.add.at(goal, (np.repeat(np.arange(len(fit)), graph.shape[1]), of[graph.ravel()]), 1)
    goal[np.arange(len(fit)), of] += 3
    router = Router.train(x[fit], goal / goal.sum(axis=1, keepdims=True))
    scores = router.scores(x)
    near = scores.argmax(axis=1)[neighbour_graph(x, k)[back]]
    place = np.argsort(np.argsort(-scores[back], axis=1), axis=1)  # how probable each part is: 0 for the most
    found = np.take_along_axis(place, near, axis=1)
    reached = [(found < p).mean() for p in range(1, parts + 1)]
    return router, 1 + int(np.argmax(np.array(reached) >= recall))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part, once each."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = found.filter(~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda v: v != 0))
    common = found.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.filter(F.size("embedding") == (common.n if common else 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _once(rows: DataFrame, keep: int) -> DataFrame:
    """Each distinct vector with its ``keep`` smallest ids: first within batches, then within groups of batches, then in all."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, dims = np.asarray(batch.column(0)), len(batch.column(1)[0])
            x = np.ascontiguousarray(_matrix(batch.column(1), dims) + 0.0)  # -0.0 is 0.0
            order = np.argsort(ids, kind="stable")
            _, first, at = np.unique(x[order].view(f"V{8 * dims}").ravel(), return_index=True, return_inverse=True)
            by = np.argsort(at, kind="stable")
            counts = np.bincount(at)
            nth = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = by[nth < keep]
            cuts = np.append(0, np.cumsum(np.minimum(counts, keep))).astype(np.int32)
            lists = pa.ListArray.from_arrays(cuts, pa.array(ids[order][kept]))
            values = pa.ListArray.from_arrays(np.arange(len(first) + 1, dtype=np.int32) * dims, pa.array(x[order][first].ravel()))
            yield pa.RecordBatch.from_arrays([values, lists], names=["embedding", "ids"])

    least = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, keep)
    some = rows.mapInArrow(batchwise, "embedding array<double>, ids array<long>")
    some = some.groupBy("embedding", F.pmod(F.element_at("ids", 1), F.lit(256)).alias("__salt")).agg(least("ids").alias("ids"))
    return some.groupBy("embedding").agg(least("ids").alias("ids"))


def best_of(q: np.ndarray, own: np.ndarray, c: np.ndarray, counts: np.ndarray, flat: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids and scores of the k best for each query: greatest exact inner product first, ties by the smaller id, never its own id.

    ``flat`` holds the ids of each row of ``c``, ``counts`` how many. A fast product finds the k + 1 best of ``c`` and all
    that may be as good; those are compared by the exact sums.
    """
    first, ids, scores = np.cumsum(counts) - counts, [], []
    reach, most = np.linalg.norm(c, axis=1).max(), min(k + 1, len(c))
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        s = part @ c.T
        low = np.partition(s, len(c) - most, axis=1)[:, len(c) - most]
        slack = 1e-12 * np.linalg.norm(part, axis=1) * reach
        enough = s >= np.where(np.isfinite(slack), low - slack, -np.inf)[:, None]
        for r in range(len(part)):
            at = np.flatnonzero(enough[r])
            exact = (part[r] * c[at]).sum(axis=1)
            n = counts[at]
            of = flat[np.arange(n.sum()) + np.repeat(first[at] - np.cumsum(n) + n, n)]
            value = np.repeat(exact, n)
            order = np.lexsort((of, -value))
            order = order[of[order] != own[a + r]][:k]
            ids.append(of[order])
            scores.append(value[order])
    return ids, scores


def nearest(vectors: DataFrame, every: int = EVERY, k: int = NEAREST, recall: float = RECALL, part: int = PART, block: int = BLOCK, turn: int = TURN) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each vector whose id is divisible by ``every``."""
    rows = cut(usable(vectors))
    some = rows.first()
    schema = "query_id long, rank int, vec_id long, score double"
    if some is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = len(some.embedding)
    distinct = cut(_once(rows, k + 1))
    n = distinct.count()
    parts = max(1, min(MAX_PARTS, n // part))
    sample = share_of(distinct.select("ids", "embedding"), F.element_at("ids", 1), max(SAMPLE, 48 * parts), n).orderBy(F.element_at("ids", 1)).toArrow()
    x = _matrix(sample.column("embedding"), dims)
    scale = float(np.linalg.norm(x, axis=1).max())
    router, tries = learn(x / scale, parts, k, recall) if parts > 1 else (None, 1)

    def chances(column: pa.Array) -> np.ndarray:
        x = _matrix(column, dims)
        return router.scores(x / scale) if router else np.zeros((len(x), 1), np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chances(batch.column(1)).argmax(axis=1).astype(np.int32))], names=["ids", "embedding", "part"])

    kinds = "ids array<long>, embedding array<double>, part int"
    indexed = cut(distinct.select("ids", "embedding").mapInArrow(place, kinds))
    size = np.zeros(parts, np.int64)
    for r in indexed.groupBy("part").count().collect():  # MAX_PARTS rows at most
        size[r.part] = r["count"]
    least = min(n, k + 1)  # vectors that a query must meet, so that it finds k others

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                order = np.argsort(-chances(batch.column(1)), axis=1, kind="stable")
                met = np.cumsum(size[order], axis=1)
                taken = (np.arange(parts) < tries) | (met - size[order] < least)
                row, at = np.nonzero(taken & (size[order] > 0))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(order[row, at].astype(np.int32))], names=["ids", "embedding", "part"])

    asked = rows.filter(F.col("vec_id") % every == 0).select(F.array("vec_id").alias("ids"), "embedding")
    asked = cut(asked.mapInArrow(route, kinds))
    # A cell is a block of a part's vectors and a turn of its queries, a task of its own. A part of at most ``block``
    # vectors and ``turn`` queries is one cell, so a vector is sent once, and a query once for each block of its parts.
    turns = np.ones(parts, np.int64)
    for r in asked.groupBy("part").count().collect():
        turns[r.part] = -(-r["count"] // turn)
    blocks = np.maximum(-(-size // block), 1)
    ends = np.cumsum(blocks * turns)
    plan = vectors.sparkSession.createDataFrame([(i, int(blocks[i]), int(turns[i]), int(ends[i] - blocks[i] * turns[i])) for i in range(parts)], "part int, blocks int, turns int, first int")
    plan, mine = F.broadcast(plan), lambda m: F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col(m)).cast("int")
    every_ = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    there = indexed.join(plan, "part").select(F.lit(0).alias("kind"), "first", "turns", mine("blocks").alias("b"), every_("turns").alias("t"), "ids", "embedding")
    here = asked.join(plan, "part").select(F.lit(1).alias("kind"), "first", "turns", every_("blocks").alias("b"), mine("turns").alias("t"), "ids", "embedding")
    cells = there.unionByName(here).select((F.col("first") + F.col("b") * F.col("turns") + F.col("t")).alias("cell"), "kind", "ids", "embedding")
    cells = cells.repartitionById(int(ends[-1]), "cell").sortWithinPartitions("kind")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = [], None
        for batch in batches:
            vectors_ = int((np.asarray(batch.column(1)) == 0).sum())
            if vectors_:
                held.append(batch.slice(0, vectors_))
            if vectors_ == batch.num_rows or not held:
                continue
            if index is None:
                ids = pa.concat_arrays([b.column(2) for b in held])
                index = np.concatenate([_matrix(b.column(3), dims) for b in held]), np.diff(np.asarray(ids.offsets)), np.asarray(ids.flatten())
            queries = batch.slice(vectors_)
            own = np.asarray(queries.column(2).flatten())
            ids, scores = best_of(_matrix(queries.column(3), dims), own, *index, k)
            cuts = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(v))) for v in (ids, scores)]
            yield pa.RecordBatch.from_arrays([queries.column(0), pa.array(own), *lists], names=["cell", "query_id", "ids", "scores"])

    met = cells.mapInArrow(meet, "cell int, query_id long, ids array<long>, scores array<double>")
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((-p["scores"]).alias("s"), p["ids"].alias("id")))
    least_of = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k).alias("best")
    best = met.select("query_id", F.floor(F.col("cell") / 64).alias("some"), pairs.alias("pairs")).groupBy("query_id", "some").agg(least_of("pairs"))
    best = best.groupBy("query_id").agg(least_of("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
