"""Short codes of vectors: codebooks for parts of their components, searched through annuli of norms.

Vectors become whole numbers and are cut into equal parts; every part position has a codebook. The nearest entry of a
part is found by annular pruning: entries are sorted by norm, and an entry whose norm differs from the part's by more
than the best distance so far cannot be nearer (triangle inequality). So the search begins at the entry with the next
norm, and two binary searches of the norms bound the annulus that is left; its entries are evaluated outwards, exactly
and with the bounds included, and the annulus is bounded anew as the best distance falls.

Codebooks start as the first vectors and are moved by rounds of assigning and averaging. Each round reads the vectors
once; tasks add up their own sums and send one row for each component of an entry, so what is shuffled and what the
driver holds depend on the codebooks alone.

Edge cases: null vectors and those with null or non-finite components are dropped, and so are vectors of another length
than the commonest (the longer, if two are as common) and empty ones; lengths that the number of parts does not divide
are filled up with zeros; with fewer vectors than entries, codebooks have as many entries as there are vectors; the
first vectors go by id (null last) and then by components, repeated rows being vectors of their own; ties of distance
go to the lower entry; null labels are one label; an empty table gives an empty result; components beyond 2**50 (after
scaling) are taken as that, and errors beyond a long as the largest long; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from ._vectors import LONG, exact, finite, longs, sums_by, totals, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0


class Annuli:
    """The entries of a codebook in the order of their norms."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.entries, self.norms = entries[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry and squared distance of each row of ``x``, and how many distances were computed."""
        x, entries = exact(x, self.entries)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        slack = 1e-9 * (norm + self.norms[-1])  # norms are rounded, distances are not
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(len(entries) - 1, 1))
        first = np.where((len(entries) == 1) | (norm - self.norms[right - 1] <= self.norms[right % len(entries)] - norm), right - 1, right)
        best, at = np.full(len(x), LONG, x.dtype), np.full(len(x), len(entries), np.int64)
        asked = 0

        def meet(rows: np.ndarray, entry: np.ndarray, fresh: bool = False) -> None:
            nonlocal asked
            asked += len(rows)
            far = x[rows] - entries[entry]
            far = (far * far).sum(axis=1)
            number = self.order[entry]
            better = np.ones(len(rows), bool) if fresh else (far < best[rows]) | ((far == best[rows]) & (number < at[rows]))
            best[rows[better]], at[rows[better]] = far[better], number[better]

        rows = np.arange(len(x))
        meet(rows, first, fresh=True)
        left, right = first - 1, first + 1
        while len(rows):
            reach = np.sqrt(best[rows].astype(np.float64)) + slack[rows]
            low, high = np.searchsorted(self.norms, norm[rows] - reach), np.searchsorted(self.norms, norm[rows] + reach, side="right")
            down, up = left[rows] >= low, right[rows] < high
            meet(rows[down], left[rows[down]])
            meet(rows[up], right[rows[up]])
            left[rows] -= 1
            right[rows] += 1
            rows = rows[down | up]
        return at, best, asked


@dataclass
class Codebooks:
    """Entries of each part position (part, entry, component), for vectors of ``size`` components."""

    entries: np.ndarray
    size: int
    scale: float = SCALE

    def parts_of(self, column: pa.Array) -> np.ndarray:
        """The whole numbers of vectors, by vector, part and component."""
        parts, _, width = self.entries.shape
        x = whole_numbers(column, self.size, self.scale)
        return np.pad(x, ((0, 0), (0, parts * width - self.size))).reshape(len(x), parts, width)

    def assign(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entry and squared distance, for each part position."""
        for k, entries in enumerate(self.entries):
            at, best, _ = Annuli(entries).nearest(x[:, k])
            yield at, best

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for v in self.entries.ravel().tolist()).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose ``vector`` (as array<double>) is finite and has the commonest length, and that length (0: none)."""
    kept = vectors.withColumn(vector, F.col(vector).cast("array<double>")).filter(finite(F.col(vector)) & (F.size(vector) > 0))
    size = kept.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (kept.filter(F.size(vector) == size.n), size.n) if size else (kept, 0)


def learn(kept: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks:
    """Codebooks of the rows (vec_id, embedding) of ``kept``, all of whose vectors have ``size`` components."""
    first = kept.select("embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).toArrow()  # as many as entries
    width = -(-size // parts)
    books = Codebooks(np.zeros((parts, first.num_rows, width), np.int64), size, scale)
    books.entries = books.parts_of(first.column(0).combine_chunks()).transpose(1, 0, 2)
    for _ in range(rounds):

        def sums(batch: pa.RecordBatch, books: Codebooks = books) -> np.ndarray:
            x = books.parts_of(batch.column(0))
            return np.stack([sums_by(x[:, k], at, books.entries.shape[1]) for k, (at, _) in enumerate(books.assign(x))])

        found = totals(kept.select("embedding"), sums, (*books.entries.shape[:2], width + 1))
        moved = books.entries.copy()
        used = found[..., -1] > 0
        moved[used] = (found[used][:, :-1] // found[used][:, -1:]).astype(np.int64)
        books = Codebooks(moved, size, scale)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (an entry for each part) and error (squared distance of all parts) of each row of ``kept``."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = zip(*books.assign(books.parts_of(batch.column(2))), strict=True)
            error = sum(f.astype(object) for f in far)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.stack(at, axis=1).tolist(), pa.list_(pa.int32())), pa.array(longs(error))], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<int>, error long")


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable rows (vec_id, embedding, label) of ``vectors``, and the codebooks."""
    kept, size = usable(vectors.select("vec_id", "label", "embedding"), "embedding")
    books = learn(kept, size, parts, entries, rounds, scale) if size else Codebooks(np.zeros((parts, 0, 0), np.int64), 0, scale)
    return encode(kept, books), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = product_codes(table(spark, sf_dir, "embeddings"))
    return digest(codes, books)


def digest(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The codes as hex, with the errors of labels (written first, so that their size is known where they are joined)."""
    codes = cut(codes)
    error = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = cut(codes.groupBy("label").agg(error.alias("label_error"))).withColumnRenamed("label", "of")
    joined = codes.join(labels, F.col("label").eqNullSafe(F.col("of")))
    code = F.array_join(F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS, width: int = 8) -> str:
    """The definition in SQL, for vectors of PARTS * width components: every part with every entry, round by round."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cuts AS MATERIALIZED (
  SELECT vec_id, p, v[p * {width} + 1 : p * {width} + {width}] AS v FROM kept CROSS JOIN (SELECT unnest(range({PARTS})) AS p)
), c0 AS MATERIALIZED (
  SELECT p, k, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, v AS c FROM cuts) WHERE k < {ENTRIES}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, p, v, m % 64 AS k, m // 64 AS d FROM (
    SELECT vec_id, p, any_value(v) AS v, min(CAST(list_sum(list_transform(list_zip(v, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) * 64 + k) AS m
    FROM cuts JOIN c{i} USING (p) GROUP BY vec_id, p)
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, k, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, {width + 1})) AS i) GROUP BY p, k, i) GROUP BY p, k
  ) n USING (p, k)
)""")
    return "WITH " + ", ".join(steps) + f""", codes AS (
  SELECT vec_id, string_agg(lpad(printf('%x', k), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""


ORACLE = _oracle()
