"""Which grams of a corpus stand at more than one place: a bitmap of bounded size, and the grams that stand at very many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import release

#: Slots of a bitmap are 2**BITS at most: 128 MB. Fuller bitmaps tell less, and never say that a repeated gram is not.
BITS = 30
#: Gram hashes that a task gathers before it sends them, and before it merges what it has been sent.
GATHER = 1 << 20


def bits_for(size: int) -> int:
    """Bits of a slot for a corpus of so many bytes."""
    return min(BITS, max(20, (size >> 4).bit_length()))


def told(bitmap: np.ndarray, grams: np.ndarray, bits: int) -> np.ndarray:
    """Where the bitmap says that a gram stands at more than one place."""
    slot = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def counted(grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each stands."""
    order = np.argsort(grams, kind="stable")
    grams, times = grams[order], times[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(times, first) if len(first) else times


def repeated_grams(docs: DataFrame, grams_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int, bits: int, many: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """The packed bitmap of grams that ``grams_of`` gives more than once, and those that it gives more than ``many`` times.

    Each task of the second step owns a range of slots and counts the grams in it, so it packs its share of the bitmap
    alone: 2**bits / parts bits. A gram that stands often comes once from each task, with its count.
    """
    ranges = min(1 << (bits - 3), 1 << (parts - 1).bit_length())
    width = bits - (ranges - 1).bit_length()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            grams = np.concatenate(held)
            grams, times = counted(grams, np.ones(len(grams), np.int64))
            part = (grams >> np.uint64(64 - bits + width)).astype(np.int32)  # grams are in order, so are parts
            found, first = np.unique(part, return_index=True)
            cuts = np.append(first, len(part)).tolist()
            blobs = [pa.array([v[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for v in (grams, times)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *blobs], names=["part", "grams", "times"])

        for batch in batches:
            for grams in grams_of(batch):
                held.append(grams)
                size += len(grams)
                if size >= GATHER:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for p, g, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part = p
                held.append((np.frombuffer(g, np.uint64), np.frombuffer(t, np.int64)))
                size += len(held[-1][0])
                if size >= GATHER:
                    held, size = [counted(*map(np.concatenate, zip(*held, strict=True)))], 0
        if part is not None:
            grams, times = counted(*map(np.concatenate, zip(*held, strict=True)))
            slots = np.zeros(1 << width, bool)
            slots[((grams[times > 1] >> np.uint64(64 - bits)) & np.uint64((1 << width) - 1)).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in (np.packbits(slots), grams[times > many], times[times > many]))], names=["part", "slots", "often", "times"])
        release()

    sent = docs.mapInArrow(scan, "part int, grams binary, times binary").repartitionById(ranges, "part")
    bitmap, often = np.zeros((ranges, 1 << (width - 3)), np.uint8), []
    for row in sent.mapInArrow(settle, "part int, slots binary, often binary, times binary").collect():  # 2**bits bits in all
        bitmap[row.part] = np.frombuffer(row.slots, np.uint8)
        often.append(np.frombuffer(row.often, np.uint64))
    return bitmap.ravel(), np.sort(np.concatenate(often)) if often else np.zeros(0, np.uint64)
