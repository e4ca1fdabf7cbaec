"""Vectors of whole numbers, and sums over them that never round."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this bound are taken as it; sums over 2**12 of them are longs.
BOUND = 1 << 50
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """True for vectors that are not null and hold no null, NaN or infinity."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole_numbers(column: pa.Array, size: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length without nulls, a row each; ``scale`` is a power of two, so nothing rounds."""
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(column.flatten(), np.float64).reshape(-1, size) * scale)
    return np.clip(x, -BOUND, BOUND).astype(np.int64)


def exact(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays as they are, if squared distances between their rows fit a long, otherwise as Python's integers."""
    most = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    return arrays if 4 * most * most * arrays[0].shape[-1] <= LONG else tuple(a.astype(object) for a in arrays)


def longs(values: np.ndarray) -> np.ndarray:
    """As longs; larger ones become the largest long."""
    return np.array([min(int(v), LONG) for v in values], np.int64) if values.dtype == object else values.astype(np.int64)


def sums_by(x: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums and, last, counts of the rows of each of ``k`` groups, as Python's integers."""
    out = np.zeros((k, x.shape[1] + 1), object)
    out[:, -1] = np.bincount(who, minlength=k).astype(object)
    if int(np.abs(x).max(initial=0)) * len(x) < 1 << 53:  # whole numbers that floats hold
        out[:, :-1] = ((who == np.arange(k)[:, None]).astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
    else:
        np.add.at(out[:, :-1], who, x.astype(object))
    return out


def totals(df: DataFrame, of_batch: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``of_batch`` (Python's integers) over all batches: added up in each task, then by cell across tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(shape, object)
        for batch in batches:
            held += of_batch(batch)
        cells = np.flatnonzero(held.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([Decimal(int(v)) for v in held.ravel()[cells]], pa.decimal128(38, 0))], names=["cell", "total"])

    out = np.zeros(shape, object)
    for row in df.mapInArrow(scan, "cell long, total decimal(38,0)").groupBy("cell").agg(F.sum("total").alias("total")).collect():  # as many rows as cells, at most
        out.ravel()[row.cell] = int(row.total)
    return out
