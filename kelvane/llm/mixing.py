"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source is cut into blocks of equal word counts; integer quotas of words go to the sources, and from each source
to its shards, by highest quotients votes / (2 * seats + 1). A shard takes every one of its words as often as the
quota divides evenly, and the remainder by a seeded permutation of its block numbers, of the last block as many words
as are wanting. What a document gives is the words of it that are taken so, repeats counted. So a source gives its
target to the word, however small it is beside the others.

Edge cases: a null text has size 0 and gives nothing; a null source is a source of its own, last in order; a null
doc_id is an ordinary row; repeated rows (equal doc_id and text) are dealt to shards one by one; an empty table gives
an empty result; other columns are never read. More than MAX_SOURCES sources are refused.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table, text_words, wrapped

WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source.
MOST = 3
#: Words of a block at most; smaller where the corpus has fewer than BLOCKS such blocks, or the source fewer than SOURCE_BLOCKS.
BLOCK_WORDS, BLOCKS, SOURCE_BLOCKS = 4096, 1 << 17, 256
#: Blocks that a shard should hold, and shards in all at most: what the driver apportions over.
SHARD_BLOCKS, MAX_SHARDS = 256, 1 << 16
#: Sources at most, since the driver apportions over them; and copies of one row that a task writes out at once.
MAX_SOURCES, COPIES = 1 << 20, 1 << 16


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what is over goes to the others."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        open_ -= set(over)
        rest -= sum(out[i] for i in over)
    return out


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2k + 1), ties to the smaller index, none above its cap."""
    votes, caps = np.asarray(votes, float), np.where(np.asarray(votes) > 0, caps, 0).astype(np.int64)
    seats = min(int(seats), int(caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), np.int64)
    at = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = votes[votes > 0].min() / (2 * caps.max() + 2), 4 * votes.max()  # all seats that caps allow; none
    for _ in range(200):
        d = (low + high) / 2
        low, high = (low, d) if at(d).sum() <= seats else (d, high)
    got = at(high)
    queue = [(-votes[i] / (2 * got[i] + 1), i) for i in np.flatnonzero(got < caps)]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def last_blocks(rest: int, words: int, block: int, rank: int) -> tuple[int, int]:
    """How many blocks, by rank, ``rest`` of ``words`` words fill, and the words of the next one; ``rank`` is that of the last block, which may be short."""
    short = -words % block
    if rest >= (rank + 1) * block - short:
        return divmod(rest + short, block)
    return min(rest // block, rank), rest - min(rest // block, rank) * block


def apart(sized: DataFrame, most: int = COPIES) -> DataFrame:
    """The rows (doc_id, source, size, key), equal ones with keys of their own: copies of one row are dealt like any others.

    Equal rows are counted, and written out again by number: those of a very frequent row in runs of ``most``, a task's
    work each, so that no task holds all of them.
    """
    rows = cut(sized.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n")))
    numbers = lambda first, last: F.explode(F.sequence(F.lit(first) if isinstance(first, int) else first, last)).alias("j")
    few = rows.filter(F.col("n") <= most).select("doc_id", "source", "size", "key", numbers(1, F.col("n")))
    runs = rows.filter(F.col("n") > most).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / most))).alias("run"))
    runs = runs.repartition("key", "run")
    many = runs.select("doc_id", "source", "size", "key", numbers(F.col("run") * most + 1, F.least("n", (F.col("run") + 1) * most)))
    key = F.when(F.col("j") == 1, F.col("key")).otherwise(F.xxhash64("key", "j"))
    return few.unionByName(many).select("doc_id", "source", "size", key.alias("key"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each row of ``docs``."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), text_words(text).alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("key"))
    sized = cut(apart(sized))
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: they are apportioned by the driver")
    found = sorted(found, key=lambda r: (r.source is None, (r.source or "").encode()))
    words = [int(r.words) for r in found]
    total = sum(words)
    goal = targets(words, [weights[i % len(weights)] for i in range(len(found))])
    block = max(1, min(BLOCK_WORDS, total // BLOCKS))
    per_shard = max(SHARD_BLOCKS * block, -(-2 * total // MAX_SHARDS), 1)
    shards = [min(max(1, w // per_shard), r.n) for w, r in zip(words, found, strict=True)]

    sizes = [max(1, min(block, w // SOURCE_BLOCKS)) for w in words]

    schema = "s_source string, s_at int, s_words long, s_target double, s_shards int, s_block long"
    plan = spark.createDataFrame([(r.source, i, words[i], goal[i], shards[i], sizes[i]) for i, r in enumerate(found)], schema)
    placed = sized.join(F.broadcast(plan) if len(found) <= MAX_SHARDS else plan, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", F.pmod(F.xxhash64("key"), "s_shards"))
    held = sorted(placed.groupBy("s_at", "shard").agg(F.sum("size").alias("w")).collect())
    by: dict[int, list[int]] = {i: [] for i in range(len(found))}
    for r in held:
        by[r.s_at].append(r.w)
    quota = sainte_lague(np.array(goal), total, MOST * np.array(words, np.int64))
    rows, k = [], 0
    for i in range(len(found)):
        rng = np.random.default_rng([seed, i])
        ws = np.array(by[i], np.int64)
        for w, q in zip(ws.tolist(), sainte_lague(ws, quota[i], MOST * ws).tolist(), strict=True):
            n = -(-w // sizes[i])
            step = int(rng.integers(1, max(n, 2)))
            while n and np.gcd(step, n) != 1:
                step += 1
            start = int(rng.integers(0, max(n, 1)))
            full, part = last_blocks(q % w, w, sizes[i], (step * (n - 1) + start) % n) if n else (0, 0)
            rows.append((i, int(held[k].shard), n, q // w if n else 0, full, part, step, start))
            k += 1
    quotas = spark.createDataFrame(rows, "q_at int, q_shard int, q_blocks long, q_copies long, q_full long, q_part long, q_step long, q_from long")
    placed = placed.join(F.broadcast(quotas) if len(rows) <= 2 * MAX_SHARDS else quotas, (F.col("s_at") == F.col("q_at")) & (F.col("shard") == F.col("q_shard")))

    run = Window.partitionBy("s_at", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("end", F.sum("size").over(run)).withColumn("start", F.col("end") - F.col("size"))
    block_ = F.col("s_block")
    first, last = F.floor(F.col("start") / block_).cast("long"), F.floor((F.col("end") - 1) / block_).cast("long")

    def extra(total_: Column, b: Column) -> Column:
        rank = (F.col("q_step") * b + F.col("q_from")) % F.col("q_blocks")
        upto = b * block_ + F.when(rank < F.col("q_full"), block_).when(rank == F.col("q_full"), F.col("q_part")).otherwise(F.lit(0))
        return total_ + F.greatest(F.least(F.col("end"), upto) - F.greatest(F.col("start"), b * block_), F.lit(0))

    more = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), extra)
    taken = F.when(F.col("size") > 0, F.col("q_copies") * F.col("size") + more).otherwise(F.lit(0))
    return placed.select("doc_id", "source", "size", F.col("s_words").alias("source_size"), F.col("s_target").alias("target"), taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the mix takes: each taken / size times, rounded up or down by a seeded draw that is right on average.

    Rows without a word go; rows of one doc_id (null too) are drawn together.
    """
    share = mix_sources(docs, weights, seed).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).filter("s > 0")
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = share.select(F.col("doc_id").alias("id"), F.floor(F.col("t") / F.col("s") + draw).cast("int").alias("copies")).filter("copies > 0")
    joined = wrapped(docs).join(copies, F.col("row.doc_id").eqNullSafe(F.col("id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
