"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

A window is a string of LENGTH bytes; its anchor is where its least GRAM-byte hash stands (the leftmost of equals), so
equal windows have equal anchors at equal distances. Consecutive windows with one anchor form a run. The sparse suffix
array of a batch holds one suffix for each run whose gram anchors another one too (a bitmap of grams tells, which may
say so of others as well; they then match nothing), the bytes from its anchor to the end of its last window, followed by
the bytes that lead up to the anchor; it is sorted by those bytes. Arrays are dealt by the anchor's gram to parts, and
each part keeps a family of levels: a new array is merge-scanned against every level, a run that both hold is covered
where it stands later, and levels of similar size merge, so sizes grow geometrically.

Suffixes of one gram that differ are neighbours in the merged array, with a common prefix of GRAM bytes or more. They
agree on some windows only, so their windows are compared: fingerprints bring equal ones together and their bytes
decide. A gram with so many surroundings that they would not fit a task is split: its windows are dealt once more, by
128-bit fingerprints, and settled there. A batch that meets more than LOCAL of them sends windows at once and marks the
gram, so no batch sends a task more than LOCAL runs of one gram. So each byte that is covered by a window which also
starts earlier is found, and no other.

Edge cases: a null text is empty; texts below LENGTH bytes never match; ids may be of any type that Spark orders; rows
with equal doc_id are ordered by text hash, null ids last; of repeated rows all but one stand later; an empty table gives an empty result; other columns
are never read. Long texts are taken in segments that overlap, so memory does not grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grams import bits_for, repeated_grams, told
from ._spark import cut, table
from ._text import bytes_of, fingerprints, mix, pieces, prefix_sums, release

LENGTH, GRAM = 100, 36
#: Bytes that are scanned at once, and runs of a batch.
SEGMENT, BATCH = 1 << 19, 1 << 17
#: Bytes of text whose runs make up a part, about.
PART_BYTES = 1 << 24
#: Different surroundings of one gram that a batch sends as runs, and suffixes whose windows are compared at once.
LOCAL, CHUNK = 256, 8192

# Kinds of rows. Entries: runs of a suffix array. Windows: of split grams, by fingerprint. Split: marked grams. Spans: covered bytes.
ENTRIES, WINDOWS, SPLIT, SPANS = range(4)
ROWS = "part int, kind int, docs binary, starts binary, more binary, data binary"
_SLOTS = 24  # low bits of a sliding value: a place in a segment


class Shape(NamedTuple):
    """Lengths of windows and grams, and what a key holds: bytes from the anchor on, bytes before it, least and greatest distance to a window's start."""

    length: int = LENGTH
    gram: int = GRAM

    @property
    def reach(self) -> int:
        return self.length - self.gram

    @property
    def size(self) -> int:
        return self.length + self.reach + 2

    def masks(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which bytes of a key are text."""
        at = np.arange(self.length + self.reach)
        return np.where(at < self.length, at < self.length - low[:, None].astype(np.int64), at >= self.size - 2 - high[:, None].astype(np.int64))


def segments(column: pa.Array, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, where each begins in its text, bytes, offsets): whole short texts, or overlapping segments of a long one."""
    for i, j, data, offsets in pieces(column, SEGMENT):
        if len(data) <= 4 * SEGMENT:
            yield np.arange(i, j), np.zeros(j - i, np.int64), data, offsets
        else:
            for a in range(0, len(data) - length + 1, SEGMENT):
                part = data[a : a + SEGMENT + length - 1]
                yield np.array([i]), np.array([a]), part, np.array([0, len(part)])


def runs_of(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Text index, first window, number of windows, anchor and the gram's hash of each run; places are those in ``data``."""
    n, width = len(data), shape.reach + 1
    if n < shape.length:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(n - shape.gram + 1)
    hashes = fingerprints(prefix_sums(data), at, at + shape.gram)
    least, size = (hashes >> np.uint64(_SLOTS) << np.uint64(_SLOTS)) | at.astype(np.uint64), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - shape.length + 1
    if width > size:
        least = np.minimum(least[:m], least[width - size : width - size + m])
    anchor = (least[:m] & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)  # by window start
    room = np.diff(offsets) - shape.length + 1
    full = np.flatnonzero(room > 0)
    valid = np.zeros(m + 1, np.int32)
    np.add.at(valid, offsets[:-1][full], 1)
    np.add.at(valid, offsets[:-1][full] + room[full], -1)
    inside = np.cumsum(valid[:-1]) > 0
    opens = np.ones(m, bool)
    opens[1:] = anchor[1:] != anchor[:-1]
    opens[offsets[:-1][full]] = True
    starts = np.flatnonzero(opens & inside)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], n), offsets[doc] + room[doc])
    return doc, starts, ends - starts, anchor[starts], hashes[anchor[starts]]


def keys_of(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, anchors: np.ndarray, shape: Shape) -> np.ndarray:
    """The sort keys of runs, one row of bytes each."""
    around = np.concatenate([np.zeros(shape.reach, np.uint8), data, np.zeros(shape.length, np.uint8)])
    around = sliding_window_view(around, shape.reach + shape.length)[anchors]
    out = np.empty((len(starts), shape.size), np.uint8)
    out[:, : shape.length], out[:, shape.length : -2] = around[:, shape.reach :], around[:, : shape.reach]
    high = anchors - starts
    out[:, -2], out[:, -1] = high - counts + 1, high
    out[:, :-2] *= shape.masks(out[:, -2], out[:, -1])
    return out


class Suffixes:
    """A sparse suffix array: distinct keys in the order of their bytes, each with the earliest place where its run was met."""

    __slots__ = ("docs", "keys", "starts")

    def __init__(self, keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> None:
        self.keys, self.docs, self.starts = np.ascontiguousarray(keys), docs, starts

    @property
    def text(self) -> np.ndarray:
        """The keys as strings of a fixed length, which numpy orders by bytes."""
        return self.keys.view(f"S{self.keys.shape[1]}").ravel()

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.keys[at], self.docs[at], self.starts[at])

    def spans(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the windows of these runs cover."""
        more = self.keys[at, -1].astype(np.int64) - self.keys[at, -2]
        return self.docs[at], self.starts[at].astype(np.int64), self.starts[at] + more + length

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(x, k) for x in parts]) for k in ("keys", "docs", "starts")))

    def sorted(self) -> Suffixes:
        return self.take(np.argsort(self.text, kind="stable"))

    @staticmethod
    def of_batch(runs: Suffixes, length: int) -> tuple[Suffixes, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The array of a batch of runs, and what its repeated runs cover."""
        runs = runs.take(np.lexsort((runs.starts, runs.docs))).sorted()
        again = np.zeros(len(runs.docs), bool)
        again[1:] = runs.text[1:] == runs.text[:-1]
        return runs.take(np.flatnonzero(~again)), runs.spans(np.flatnonzero(again), length)

    def groups(self, gram: int) -> np.ndarray:
        """Where runs of neighbours begin that have a common prefix of ``gram`` bytes, and the number of keys at the end."""
        new = np.ones(len(self.docs) + 1, bool)
        for i in range(1, len(self.docs), CHUNK):
            part = self.keys[i - 1 : i + CHUNK, :gram]
            new[i : i + len(part) - 1] = (part[1:] != part[:-1]).any(axis=1)
        return np.flatnonzero(new)


class Family:
    """Levels of geometrically growing size; ``covered`` holds the spans of runs that stand earlier too."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length, self.levels, self.covered = length, [], []

    def add(self, batch: Suffixes) -> None:
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.text, batch.text), len(level.docs) - 1)
            hit = level.text[at] == batch.text
            old, new = at[hit], np.flatnonzero(hit)
            sooner = (batch.docs[new] < level.docs[old]) | ((batch.docs[new] == level.docs[old]) & (batch.starts[new] < level.starts[old]))
            self.covered += [level.spans(old[sooner], self.length), batch.spans(new[~sooner], self.length)]
            level.docs[old[sooner]], level.starts[old[sooner]] = batch.docs[new[sooner]], batch.starts[new[sooner]]
            batch = batch.take(np.flatnonzero(~hit))
        if len(batch.docs):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].docs) < 2 * len(self.levels[-1].docs):
            self.levels.append(Suffixes.joined([self.levels.pop(), self.levels.pop()]).sorted())


def compare_windows(runs: Suffixes, shape: Shape, forward: bool = False) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...] | None]:
    """Spans of windows of ``runs`` that stand earlier in another of them; if asked, also the earliest of each distinct window: (doc, start, two fingerprints)."""
    runs = runs.take(np.lexsort((runs.starts, runs.docs)))  # windows are numbered as they stand in the corpus
    low, high = (runs.keys[:, k].astype(np.int64) for k in (-2, -1))
    text = np.concatenate([runs.keys[:, shape.length : -2], runs.keys[:, : shape.length]], axis=1)
    size = high - low + 1
    run = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    place = run * text.shape[1] + shape.reach - high[run] + nth
    flat = text.ravel()
    prints = fingerprints(prefix_sums(flat), place, place + shape.length)
    views = sliding_window_view(flat, shape.length)
    by = np.argsort(prints, kind="stable")
    again = np.zeros(len(by), bool)
    again[1:] = prints[by[1:]] == prints[by[:-1]]
    at = np.flatnonzero(again)
    if any((views[place[by[at[i : i + CHUNK]]]] != views[place[by[at[i : i + CHUNK] - 1]]]).any() for i in range(0, len(at), CHUNK)):
        rank = np.unique(np.ascontiguousarray(views[place]).view(f"S{shape.length}").ravel(), return_inverse=True)[1]  # equal fingerprints of different bytes
        by = np.argsort(rank, kind="stable")
        again[1:] = rank[by[1:]] == rank[by[:-1]]
    hit = np.sort(by[again])
    docs, starts = runs.docs[run], runs.starts[run].astype(np.int64) + nth
    new = np.ones(len(hit), bool)
    new[1:] = (run[hit[1:]] != run[hit[:-1]]) | (np.diff(hit) != 1)
    a = hit[new]
    b = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    spans = (docs[a], starts[a], starts[b] + shape.length)
    if not forward:
        return spans, None
    first = np.sort(by[~again])
    return spans, (docs[first], starts[first].astype(np.uint32), prints[first], _second_prints(views, place[first]))


def _second_prints(views: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Fingerprints that share nothing with the first ones but the bytes."""
    odd = np.random.default_rng(77).integers(0, 2**63, views.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(place), np.uint64)
    for i in range(0, len(place), CHUNK):
        part = (views[place[i : i + CHUNK]].astype(np.uint64) + np.uint64(1)) * odd
        out[i : i + CHUNK] = mix(part).sum(axis=1, dtype=np.uint64)
    return mix(out)


def _row(part: pa.Array, kind: int, docs=None, starts=None, more=None, data=None) -> pa.RecordBatch:
    n, nothing = len(part), lambda v: pa.array([None] * len(part) if v is None else v, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * n, pa.int32()), *map(nothing, (docs, starts, more, data))], names=["part", "kind", "docs", "starts", "more", "data"])


def _by_part(part: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The parts that occur, and each column's values of each as bytes."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    cuts = np.append(first, len(order)).tolist()
    ordered = [c[order] for c in columns]
    return found.astype(np.int32), [[c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for c in ordered]


def _span_rows(spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    docs, starts, ends = (np.concatenate([s[k].astype("<i8") for s in spans]) if spans else np.zeros(0, "<i8") for k in range(3))
    found, (d, s, e) = _by_part(docs % parts, docs, starts, ends)
    return _row(found, SPANS, d, s, e)


def _window_rows(windows: tuple[np.ndarray, ...], parts: int) -> pa.RecordBatch:
    found, columns = _by_part((windows[2] >> np.uint64(20)).astype(np.int64) % parts, *windows)
    return _row(found, WINDOWS, *columns)


def _entry_rows(array: Suffixes, grams: np.ndarray, parts: int, shape: Shape) -> pa.RecordBatch:
    """The array's entries by part, in their order; of a key only its text is sent. All but the distances is compressed: runs overlap, so entries are some four times the text."""
    part = grams.astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    array, part = array.take(order), part[order]
    ends = np.append(0, np.cumsum(shape.length + array.keys[:, -1].astype(np.int64) - array.keys[:, -2]))
    text = array.keys[:, :-2][shape.masks(array.keys[:, -2], array.keys[:, -1])]
    found, first = np.unique(part, return_index=True)
    cuts = np.append(first, len(part)).tolist()
    pick = lambda x: [x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    packed = [_packed(text[ends[a] : ends[b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    places = [[_packed(x[a:b].astype(t)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x, t in ((array.docs, "<i8"), (array.starts, "<u4"))]
    return _row(found, ENTRIES, *places, pick(array.keys[:, -2:]), packed)


def _packed(values: np.ndarray) -> bytes:
    """The bytes of the values, first bytes first, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str, n: int) -> np.ndarray:
    """``n`` values of a kind, of what ``_packed`` made of them."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _entries(docs: bytes, starts: bytes, more: bytes, data: bytes, shape: Shape) -> Suffixes:
    low_high = np.frombuffer(more, np.uint8).reshape(-1, 2)
    keys = np.zeros((len(low_high), shape.size), np.uint8)
    keys[:, -2:] = low_high
    text = shape.masks(low_high[:, 0], low_high[:, 1])
    keys[:, :-2][text] = _unpacked(data, "u1", int(text.sum()))
    return Suffixes(keys, _unpacked(docs, "<i8", len(low_high)), _unpacked(starts, "<u4", len(low_high)))


def _parts(size: int) -> int:
    """A prime number of parts for so many bytes of text, about PART_BYTES each."""
    n = max(7, -(-size // PART_BYTES))
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def covered_spans(docs: DataFrame, shape: Shape = Shape(), batch_runs: int = BATCH, local: int = LOCAL, chunk: int = CHUNK) -> tuple[DataFrame, int]:  # noqa: B008
    """Rows (part, docs, starts, ends) of spans that are covered by earlier windows, dealt by doc_id modulo the second value. ``docs``: unique non-null long doc_id, text."""
    size_ = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts, length, gram = _parts(size_), shape.length, shape.gram
    bits = bits_for(size_)

    def grams_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in segments(batch.column(0), length):
            yield runs_of(data, offsets, shape)[-1]

    shared = docs.sparkSession.sparkContext.broadcast(repeated_grams(docs.select("text"), grams_of, parts, bits)[0])

    def split(array: Suffixes, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows of the keys at ``at``: those that stand earlier among them are covered, the others go on."""
        for i in range(0, len(at), chunk):
            spans, windows = compare_windows(array.take(at[i : i + chunk]), shape, forward=True)
            yield _span_rows([spans], parts)
            yield _window_rows(windows, parts)

    def send(held: list[tuple[Suffixes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        array, spans = Suffixes.of_batch(Suffixes.joined([h[0] for h in held]), length)
        yield _span_rows([spans], parts)
        edges = array.groups(gram)
        many = np.repeat(np.diff(edges) > local, np.diff(edges))
        if many.any():
            yield from split(array, np.flatnonzero(many))
            marked = array.keys[edges[:-1][np.diff(edges) > local], :gram]
            found, (data,) = _by_part(_gram_hashes(marked).astype(np.int64) % parts, marked)
            yield _row(found, SPLIT, data=data)
            array = array.take(np.flatnonzero(~many))
        if len(array.docs):
            yield _entry_rows(array, _gram_hashes(array.keys[:, :gram]), parts, shape)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bitmap = [], 0, shared.value
        for batch in batches:
            ids = np.asarray(batch.column(0)).astype("<i8")
            for rows, begin, data, offsets in segments(batch.column(1), length):
                doc, start, count, anchor, grams = runs_of(data, offsets, shape)
                again = np.flatnonzero(told(bitmap, grams, bits))
                doc, start, count, anchor = (v[again] for v in (doc, start, count, anchor))
                if len(doc):
                    keys = keys_of(data, start, count, anchor, shape)
                    held.append((Suffixes(keys, ids[rows[doc]], (start - offsets[doc] + begin[doc]).astype("<u4")), doc))
                    size += len(doc)
                if size >= batch_runs:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, held, size, marked = Family(length), [], 0, []

        def flush() -> None:
            nonlocal held, size
            if held:
                array, spans = Suffixes.of_batch(Suffixes.joined(held), length)
                family.covered.append(spans)
                family.add(array)
                held, size = [], 0

        for batch in batches:
            kind = np.asarray(batch.column(1))
            through = np.flatnonzero((kind == WINDOWS) | (kind == SPANS))
            if len(through):
                yield batch.take(pa.array(through))
            for i in np.flatnonzero(kind == SPLIT).tolist():
                marked.append(np.frombuffer(batch.column(5)[i].as_py(), np.uint8).reshape(-1, gram))
            for i in np.flatnonzero(kind == ENTRIES).tolist():
                held.append(_entries(*(batch.column(k)[i].as_py() for k in range(2, 6)), shape))
                size += len(held[-1].docs)
                if size >= batch_runs:
                    flush()
        flush()
        while len(family.levels) > 1:
            family.levels.append(Suffixes.joined([family.levels.pop(), family.levels.pop()]).sorted())
        yield _span_rows(family.covered, parts)
        family.covered = []
        if family.levels:
            array = family.levels.pop()
            edges = array.groups(gram)
            size_ = np.diff(edges)
            far = size_ > chunk
            if marked:
                names = lambda m: np.ascontiguousarray(m).view(f"S{gram}").ravel()
                far |= np.isin(names(array.keys[edges[:-1], :gram]), names(np.concatenate(marked)))
            yield from split(array, np.flatnonzero(np.repeat(far, size_)))
            near = np.flatnonzero((size_ > 1) & ~far)
            step = np.cumsum(size_[near]) // chunk
            spans = []
            for k in np.unique(step).tolist():
                of = near[step == k]
                at = np.arange(size_[of].sum()) + np.repeat(edges[of] - np.cumsum(size_[of]) + size_[of], size_[of])
                spans.append(compare_windows(array.take(at), shape)[0])
            yield _span_rows(spans, parts)
        release()

    arrays = docs.mapInArrow(scan, ROWS)
    settled = cut(arrays.repartitionById(parts, "part").mapInArrow(settle, ROWS))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        kinds = ("<i8", "<u4", "<u8", "<u8")

        def together() -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """The earliest of each distinct window, and what the others cover."""
            doc, start, one, two = (np.concatenate([h[k] for h in held]) for k in range(4))
            by = np.lexsort((start, doc, two, one))
            again = np.zeros(len(by), bool)
            again[1:] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
            hit, first = by[again], by[~again]
            return tuple(v[first] for v in (doc, start, one, two)), (doc[hit], start[hit].astype(np.int64), start[hit].astype(np.int64) + length)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                held.append(tuple(np.frombuffer(v, t) for v, t in zip(row, kinds, strict=True)))
                size += len(held[-1][0])
            if size >= 1 << 21:
                firsts, spans = together()
                yield _span_rows([merged(*spans)], parts)
                held, size = [firsts], 0
        if held:
            yield _span_rows([merged(*together()[1])], parts)
        release()

    far = settled.filter(F.col("kind") == WINDOWS).repartitionById(parts, "part").mapInArrow(last, ROWS)
    spans = settled.filter(F.col("kind") == SPANS).unionByName(far)
    return spans.select("part", "docs", "starts", F.col("more").alias("ends")), parts


def _gram_hashes(grams: np.ndarray) -> np.ndarray:
    """Of rows of bytes; below 2**40."""
    flat = np.ascontiguousarray(grams)
    odd = np.random.default_rng(78).integers(0, 2**63, flat.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(len(flat), np.uint64)
    for k in range(flat.shape[1]):
        out += (flat[:, k].astype(np.uint64) + np.uint64(1)) * odd[k]
    return mix(out) >> np.uint64(_SLOTS)


def merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the spans, ordered by document and start."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    if not len(docs):
        return docs, starts, ends
    lift = np.cumsum(np.append(False, docs[1:] != docs[:-1])) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + lift)
    new = np.append(True, starts[1:] + lift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return docs[at], starts[at], (reach - lift)[np.append(at[1:] - 1, len(docs) - 1)]


def _keep(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, spans and kept bytes of each row of ``docs``, whose ids are unique longs."""
    spans, parts = covered_spans(docs, Shape(length, gram))
    rows = docs.select(F.pmod("doc_id", F.lit(parts)).cast("int").alias("part"), "doc_id", "text", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "starts", "ends")])
    rows = rows.unionByName(spans.select("part", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "docs", "starts", "ends"))
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("docs").isNull())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, [], None
        for batch in batches:
            part = np.asarray(batch.column(0))
            spans = np.asarray(batch.column(3).is_valid())
            edges = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (spans[1:] != spans[:-1])))
            for a, b in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True):
                if part[a] != now:
                    now, held, done = part[a], [], None
                piece = batch.slice(a, b - a)
                if spans[a]:
                    held += [[np.frombuffer(x, "<i8") for x in row] for row in zip(*(piece.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
                    continue
                if done is None:
                    done = merged(*(np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3)))
                ids = np.asarray(piece.column(1))
                data, offsets = bytes_of(piece.column(2))
                low, high = np.searchsorted(done[0], ids), np.searchsorted(done[0], ids, side="right")
                kept, listed = [], []
                for k in range(len(ids)):
                    whole, at, left = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
                    mine = list(zip(done[1][low[k] : high[k]].tolist(), done[2][low[k] : high[k]].tolist(), strict=True))
                    for s, e in mine:
                        left.append(whole[at:s])
                        at = e
                    kept.append(b"".join([*left, whole[at:]]))
                    listed.append([{"start": s, "end": e} for s, e in mine])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(listed, kind), pa.array(kept, pa.binary())], names=["doc_id", "spans", "kept"])
            release()

    return rows.mapInArrow(apply, "doc_id long, spans array<struct<start: long, end: long>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, spans (removed runs of bytes, maximal) and kept (the bytes that remain) of each row of ``docs``."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id") if whole else "doc_id", "text")
    if whole and docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).isEmpty():
        return _keep(docs, length, gram)
    # rows without an id of their own are numbered in the order that decides which of two places is the earlier: the
    # number that Spark gives to rows of a sorted table grows with its partitions, and within them
    keyed = docs.withColumn("__h", F.sha2(F.coalesce("text", F.lit("")), 256))
    ordered = keyed.groupBy("doc_id", "__h").agg(F.count("*").alias("__n")).orderBy(F.col("doc_id").asc_nulls_last(), "__h")
    numbered = cut(ordered.select(F.monotonically_increasing_id().alias("__k"), F.col("doc_id").alias("__id"), F.col("__h").alias("__h2"), "__n"))
    texts = cut(keyed.dropDuplicates(["doc_id", "__h"]).join(numbered, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__h2"))).select(F.col("__k").alias("doc_id"), "text"))
    found = _keep(texts, length, gram).withColumnRenamed("doc_id", "__k").join(numbered, "__k")
    found = found.join(texts.select(F.col("doc_id").alias("__k"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("__size")), "__k")
    found = found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    gone = (F.col("__copy") > 1) & (F.col("__size") >= length)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("__size").alias("end")))
    return found.select(F.col("__id").alias("doc_id"), F.when(gone, all_).otherwise(F.col("spans")).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_repeats(table(spark, sf_dir, "documents")))
