"""Passages that stand at more than one place, by compressed FM-indexes: every copy of them is cut out.

A window is WINDOW consecutive words of a document; its anchor is where its least GRAM-word hash stands (the leftmost of
equals), so equal windows have equal anchors at equal distances. Consecutive windows with one anchor form a run; runs
are dealt by their anchor's gram to shards, so that all copies of a window meet in one. Runs whose gram anchors no other
run stay at home: a bitmap tells (and may keep others, which then match nothing).

A shard indexes the words of its distinct runs: a suffix order by prefix doubling, the Burrows-Wheeler transform over
word numbers, and a wavelet matrix of packed bits with counts for each 64 of them. A run that stands twice or more is
indexed twice, since a third copy tells nothing new. The runs are then streamed through the index: backward search from
a window's last word gives its matching statistic, the length of the longest string that ends there and occurs twice,
and windows whose statistic reaches WINDOW are reported. Runs that stand twice need no search: all their windows do.

Grams that anchor very many runs (the words of a passage that a third of all documents share) would make a shard
without bound. Windows with such an anchor are dealt by their own 128-bit fingerprints instead and settled one by one.

Edge cases: a null text has no words; documents below WINDOW words keep all of them; a null, repeated or non-integer
doc_id is a row of its own, and repeated rows lose what they share like any other; one text repeated within a document
counts; an empty table gives an empty result; other columns are never read. Long texts are taken in segments that
overlap by a window less one word, so memory does not grow with them until their kept words are joined. Words are
compared by 64-bit fingerprints and equal runs by 128 bits: at 10**9 distinct words two differ in name only with a
chance of 3 %, and then only windows that are equal in all other words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grams import bits_for, repeated_grams, told
from ._spark import cut, table
from ._text import SPACE, Words, mix, pieces, powers, release

WINDOW, GRAM = 35, 8
#: Bytes of text whose runs make up a part; words of an index; words that a task gathers before it sends or merges them.
PART_BYTES, SHARD, GATHER = 1 << 25, 1 << 18, 1 << 22
#: A gram may anchor so many runs, or a share of 2**-OFTEN_BITS of the corpus's bytes, before its windows are dealt one by one.
OFTEN, OFTEN_BITS = 8192, 27
SEGMENT = 1 << 19

RUNS, WINDOWS, SPANS = range(3)
ROWS = "part int, kind int, meta binary, names binary, codes binary"
RUN = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "u1"), ("many", "u1")])
PLACE = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("many", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
_LOW = 24  # low bits of a sliding value: a place in a segment


class WaveletMatrix:
    """Rank over a sequence of numbers below 2**levels: one packed bit vector for each bit, from the highest."""

    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.counts, self.zeros = levels, [], [], []
        n = len(values)
        for level in range(levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            packed = np.zeros(((n >> 6) + 1) * 8, np.uint8)
            packed[: (n + 7) >> 3] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int32))
            self.zeros.append(n - int(self.counts[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where place ``at`` stands in the last order: of its difference for two places, the symbols between them."""
        for k in range(self.levels):
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            at = np.where(symbols >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over ``text`` (numbers from 1 on; 0 ends a piece) for strings of up to ``longest`` symbols."""

    def __init__(self, text: np.ndarray, longest: int) -> None:
        n, top = len(text), int(text.max(initial=0))
        levels = max(1, top.bit_length())
        # suffixes are ordered by their first symbols, as many as a search can reach
        known, rank = max(1, 62 // levels), np.zeros(n, np.int64)
        for k in range(known):
            rank = rank << levels
            rank[: max(n - k, 0)] |= text[k:]
        rank = np.unique(rank, return_inverse=True)[1]
        while known <= longest:
            after = np.zeros(n, np.int64)
            after[: max(n - known, 0)] = rank[known:] + 1
            rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1]
            known *= 2
        order = np.argsort(rank, kind="stable")
        self.size, self.matrix = n, WaveletMatrix(text[order - 1], levels)
        symbols = np.arange(top + 1)
        # first suffix of each symbol, less where its block begins in the wavelet matrix
        self.base = np.append(0, np.cumsum(np.bincount(text, minlength=top + 1)))[:-1] - self.matrix.walk(symbols, np.zeros(top + 1, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the strings with one more symbol in front."""
        both = self.matrix.walk(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.concatenate([self.base[symbols]] * 2)
        return both[: len(symbols)], both[len(symbols) :]

    def matching(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: length (``most`` at most) of the longest string that ends before each of ``ends`` in ``text`` and occurs ``least`` times."""
        reached, active = np.zeros(len(ends), np.int64), np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(int(most.max(initial=0))):
            active = active[most[active] > step]
            a, b = self.extend(text[ends[active] - 1 - step], low[active], high[active])
            enough = b - a >= least
            active = active[enough]
            low[active], high[active], reached[active] = a[enough], b[enough], step + 1
        return reached


def word_segments(column: pa.Array, overlap: int = 0) -> Iterator[tuple[np.ndarray, int, Words]]:
    """(rows, number of the first word, words): whole short texts, or segments of a long one that share ``overlap`` words."""
    for i, j, data, offsets in pieces(column, SEGMENT):
        if len(data) <= 4 * SEGMENT:
            yield np.arange(i, j), 0, Words(data, offsets)
            continue
        begin, base, n = 0, 0, len(data)
        while begin < n:
            end = begin + SEGMENT
            while True:
                while end < n and not SPACE[data[end]]:  # to the end of a word
                    step = np.flatnonzero(SPACE[data[end : end + SEGMENT]])
                    end += int(step[0]) if len(step) else SEGMENT
                end = min(end, n)
                words = Words(data[begin:end], np.array([0, end - begin]))
                count = len(words.starts)
                if count > 2 * overlap or end == n:
                    break
                end += SEGMENT
            yield np.array([i]), base, words
            if end == n:
                break
            begin, base = (begin + int(words.starts[count - overlap]), base + count - overlap) if overlap else (end, base + count)


class Prints:
    """Fingerprints of stretches of words, by prefix sums of two kinds."""

    def __init__(self, hashes: np.ndarray) -> None:
        power, self.back = powers(len(hashes) + 1)
        self.sums = []
        for odd in (0, 0x9E3779B97F4A7C15):
            sums = np.zeros(len(hashes) + 1, np.uint64)
            np.cumsum(mix(hashes ^ np.uint64(odd)) * power[: len(hashes)], out=sums[1:])
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
        s = self.sums[kind]
        return mix((s[ends] - s[starts]) * self.back[starts])


def runs_of(words: Words, prints: Prints, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and anchor's gram hash of each run."""
    n, width = len(words.starts), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    hashes = prints.of(at, at + gram)
    least, size = (hashes >> np.uint64(_LOW) << np.uint64(_LOW)) | at.astype(np.uint64), 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    m = n - window + 1
    least = np.minimum(least[:m], least[width - size : width - size + m])
    anchor = (least & np.uint64((1 << _LOW) - 1)).astype(np.int64)
    inside = words.doc[:m] == words.doc[window - 1 :]
    opens = np.append(True, (anchor[1:] != anchor[:-1]) | (words.doc[1:m] != words.doc[: m - 1]))
    starts = np.flatnonzero(opens & inside)
    last = np.append(np.flatnonzero(opens)[1:], m)[np.searchsorted(np.flatnonzero(opens), starts)]
    room = words.first[words.doc[starts] + 1] - window + 1
    return starts, np.minimum(last, room) - starts, hashes[anchor[starts]]


def _equal(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, and where in it groups of equals begin."""
    by = np.lexsort((two, one))
    new = np.append(True, (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]])) if len(by) else np.zeros(0, bool)
    return by, np.flatnonzero(new)


def _collapsed(meta: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of one row of each group of equals, their ``many`` (2 or more stand somewhere), and indexes of rows whose places are repeated."""
    by, first = _equal(one, two)
    if not len(by):
        return by, meta["many"][by], by
    size = np.diff(np.append(first, len(by)))
    many = np.maximum.reduceat(meta["many"][by], first) | (size > 1)
    again = by[np.repeat(many.astype(bool), size)]
    return by[first], many.astype(np.uint8), again[meta["many"][again] == 0]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (sizes[i] of them), one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maximal runs of the spans, ordered by document and start."""
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(docs):
        return np.zeros(0, SPAN)
    lift = np.cumsum(np.append(False, docs[1:] != docs[:-1])) * (int(ends.max()) + 2)
    reach = np.maximum.accumulate(ends + lift)
    at = np.flatnonzero(np.append(True, starts[1:] + lift[1:] > reach[:-1]))
    out = np.zeros(len(at), SPAN)
    out["doc"], out["start"], out["end"] = docs[at], starts[at], (reach - lift)[np.append(at[1:] - 1, len(docs) - 1)]
    return out


def _rows(kind: int, part: np.ndarray, meta: np.ndarray, hashes: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each part that occurs, with the records of ``meta`` and, of runs, their words by number."""
    if not len(meta):
        return
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    cuts = np.append(first, len(order))
    names, codes = [None] * len(found), [None] * len(found)
    if hashes is not None:
        sizes = meta["size"].astype(np.int64)
        begin = np.cumsum(sizes) - sizes
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if hashes is not None:
            distinct, number = np.unique(hashes[_spread(begin[order[a:b]], sizes[order[a:b]])], return_inverse=True)
            names[k], codes[k] = distinct.tobytes(), number.astype("<u2" if len(distinct) <= 1 << 16 else "<u4").tobytes()
    blobs = [meta[order[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(found.astype(np.int32)), pa.array([kind] * len(found), pa.int32()), *(pa.array(c, pa.binary()) for c in (blobs, names, codes))], names=["part", "kind", "meta", "names", "codes"]
    )


class Shard:
    """The distinct runs of a part with their words; places of runs that stand twice go to ``spans`` at once."""

    def __init__(self, window: int) -> None:
        self.window, self.spans, self.held, self.size = window, [], [], 0

    def add(self, meta: np.ndarray, words: np.ndarray) -> None:
        prints, ends = Prints(words), np.cumsum(meta["size"].astype(np.int64))
        starts = ends - meta["size"]
        self.held.append((meta, words, prints.of(starts, ends), prints.of(starts, ends, 1)))
        self.size += len(words)
        if self.size >= GATHER:
            self.merge()

    def merge(self) -> None:
        if len(self.held) > 1:
            meta, words, one, two = (np.concatenate([h[k] for h in self.held]) for k in range(4))
            kept, many, again = _collapsed(meta, one, two)
            self.spans.append(_spans(meta["doc"][again], meta["start"][again], meta["start"][again].astype(np.int64) + meta["size"][again]))
            begin = np.cumsum(meta["size"].astype(np.int64)) - meta["size"]
            words = words[_spread(begin[kept], meta["size"][kept].astype(np.int64))]
            meta = meta[kept]
            meta["many"] = many
            self.held = [(meta, words, one[kept], two[kept])]
        self.size = 0

    def search(self, shard: int) -> None:
        """Index the runs in shards of about so many words, never parting those of a gram, and stream the single ones through."""
        self.merge()
        if not self.held:
            return
        meta, words = self.held[0][:2]
        sizes = meta["size"].astype(np.int64)
        begin, order = np.cumsum(sizes) - sizes, np.argsort(meta["gram"], kind="stable")
        first = np.flatnonzero(np.append(True, meta["gram"][order[1:]] != meta["gram"][order[:-1]]))
        group = np.diff(np.append(first, len(order)))
        single = np.add.reduceat((meta["many"][order] == 0).astype(np.int64), first)
        order = order[np.repeat((single > 0) & (group > 1), group)]  # others have nothing to ask, or nobody to meet
        load = sizes[order] * (1 + (meta["many"][order] > 0))
        new = np.append(True, meta["gram"][order[1:]] != meta["gram"][order[:-1]]) if len(order) else np.zeros(0, bool)
        # a shard ends with the gram that fills it
        step = ((np.cumsum(load) - load) // shard)[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        cuts = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(order) else order
        for mine in np.split(order, cuts[1:]) if len(order) else []:
            self._search(meta, words, begin, sizes, mine)

    def _search(self, meta: np.ndarray, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, mine: np.ndarray) -> None:
        number = np.unique(words[_spread(begin[mine], sizes[mine])], return_inverse=True)[1] + 1
        at = np.cumsum(sizes[mine]) - sizes[mine]
        twice = np.flatnonzero(meta["many"][mine] > 0)
        held = np.concatenate([np.arange(len(mine)), twice])
        size = sizes[mine][held]
        text = np.zeros(int(size.sum()) + len(held), np.int64)
        text[_spread(np.cumsum(size + 1) - size - 1, size)] = number[_spread(at[held], size)]
        index = FMIndex(text, int(size.max()))
        asked = np.flatnonzero(meta["many"][mine] == 0)
        windows = sizes[mine][asked] - self.window + 1
        run = np.repeat(asked, windows)
        offset = _spread(np.zeros(len(asked), np.int64), windows)
        ends = at[run] + offset + self.window
        hit = index.matching(number, ends, np.full(len(ends), self.window)) >= self.window
        docs, starts = meta["doc"][mine][run[hit]], meta["start"][mine][run[hit]].astype(np.int64) + offset[hit]
        self.spans.append(_spans(docs, starts, starts + self.window))


def repeated_spans(docs: DataFrame, window: int, gram: int, part_bytes: int, shard: int, often: int) -> tuple[DataFrame, int]:
    """Rows (part, meta) of spans of words (records of SPAN) whose windows stand elsewhere too, dealt by key modulo the second value. ``docs``: unique long key, text."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts, bits, spark = max(8, -(-size // part_bytes)) | 1, bits_for(size), docs.sparkSession
    texts = docs.select("key", "text")

    def grams_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, words in word_segments(batch.column(0), window - 1):
            yield runs_of(words, Prints(words.hashes()), window, gram)[2]

    bitmap, hot = repeated_grams(texts.select("text"), grams_of, parts, bits, max(often, size >> OFTEN_BITS))
    bitmap, hot = spark.sparkContext.broadcast(bitmap), spark.sparkContext.broadcast(hot)

    def spans_out(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(found) if found else np.zeros(0, SPAN)
        yield from _rows(SPANS, every["doc"] % parts, every)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple] = []
        places: list[np.ndarray] = []
        held = 0

        def send() -> Iterator[pa.RecordBatch]:
            done = []
            if runs:
                meta, words, one, two = (np.concatenate([r[k] for r in runs]) for k in range(4))
                kept, many, again = _collapsed(meta, one, two)
                done.append(_spans(meta["doc"][again], meta["start"][again], meta["start"][again].astype(np.int64) + meta["size"][again]))
                begin = np.cumsum(meta["size"].astype(np.int64)) - meta["size"]
                words = words[_spread(begin[kept], meta["size"][kept].astype(np.int64))]
                meta = meta[kept]
                meta["many"] = many
                yield from _rows(RUNS, (meta["gram"] % np.uint64(parts)).astype(np.int64), meta, words)
            if places:
                meta = np.concatenate(places)
                kept, many, again = _collapsed(meta, meta["one"], meta["two"])
                done.append(_spans(meta["doc"][again], meta["start"][again], meta["start"][again].astype(np.int64) + window))
                meta = meta[kept]
                meta["many"] = many
                yield from _rows(WINDOWS, (meta["one"] % np.uint64(parts)).astype(np.int64), meta)
            yield from spans_out(done)

        for batch in batches:
            ids = np.asarray(batch.column(0)).astype("<i8")
            for rows, base, words in word_segments(batch.column(1), window - 1):
                hashes = words.hashes()
                prints = Prints(hashes)
                starts, counts, grams = runs_of(words, prints, window, gram)
                again = told(bitmap.value, grams, bits)
                wide = again & np.isin(grams, hot.value)
                place = lambda at: (ids[rows[words.doc[at]]], at - words.first[words.doc[at]] + base)  # noqa: E731, B023
                near = np.flatnonzero(again & ~wide)
                if len(near):
                    s, sizes = starts[near], counts[near] + window - 1
                    meta = np.zeros(len(near), RUN)
                    meta["gram"], meta["size"] = grams[near], sizes
                    meta["doc"], meta["start"] = place(s)
                    runs.append((meta, hashes[_spread(s, sizes)], prints.of(s, s + sizes), prints.of(s, s + sizes, 1)))
                    held += int(sizes.sum())
                if wide.any():
                    s = _spread(starts[wide], counts[wide])
                    meta = np.zeros(len(s), PLACE)
                    meta["one"], meta["two"] = prints.of(s, s + window), prints.of(s, s + window, 1)
                    meta["doc"], meta["start"] = place(s)
                    places.append(meta)
                    held += 4 * len(s)
                if held >= GATHER:
                    yield from send()
                    runs, places, held = [], [], 0
        yield from send()
        release()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, places, size, done = Shard(window), [], 0, []

        def merge() -> None:
            nonlocal places, size
            meta = np.concatenate(places)
            kept, many, again = _collapsed(meta, meta["one"], meta["two"])
            done.append(_spans(meta["doc"][again], meta["start"][again], meta["start"][again].astype(np.int64) + window))
            meta = meta[kept]
            meta["many"] = many
            places, size = [meta], 0

        for batch in batches:
            kinds = np.asarray(batch.column(1))
            through = np.flatnonzero(kinds == SPANS)
            if len(through):
                yield batch.take(pa.array(through))
            for i in np.flatnonzero(kinds == RUNS).tolist():
                meta, names, codes = (batch.column(k)[i].as_py() for k in (2, 3, 4))
                names = np.frombuffer(names, "<u8")
                runs.add(np.frombuffer(meta, RUN), names[np.frombuffer(codes, "<u2" if len(names) <= 1 << 16 else "<u4")])
            for i in np.flatnonzero(kinds == WINDOWS).tolist():
                places.append(np.frombuffer(batch.column(2)[i].as_py(), PLACE))
                size += len(places[-1])
                if size >= GATHER // 4:
                    merge()
        if places:
            merge()
        runs.search(shard)
        yield from spans_out(done + runs.spans)
        release()

    sent = texts.mapInArrow(scan, ROWS).repartitionById(parts, "part")
    return cut(sent.mapInArrow(settle, ROWS).select("part", "meta")), parts


def without_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, part_bytes: int = PART_BYTES, shard: int = SHARD, often: int = OFTEN) -> DataFrame:
    """doc_id, n_words, spans (removed runs of words, maximal) and kept (the words that remain, joined by one space) of each row of ``docs``."""
    if not 0 < gram <= window <= 128:
        raise ValueError("a window has at most 128 words, and a gram at most as many as it")
    kind = docs.schema["doc_id"].dataType
    keyed = docs.select(F.col("doc_id").alias("key"), "doc_id", "text")
    if kind.typeName() not in ("long", "integer", "short", "byte") or not keyed.groupBy("key").count().filter("count > 1 or key is null").limit(1).isEmpty():
        keyed = cut(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    keyed = keyed.select(F.col("key").cast("long").alias("key"), "doc_id", "text")
    spans, parts = repeated_spans(keyed, window, gram, part_bytes, shard, often)
    home = keyed.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), "key", "doc_id", "text", F.lit(None).cast("binary").alias("meta"))
    found = spans.select("part", F.lit(None).cast("long").alias("key"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "meta")
    rows = home.unionByName(found).repartitionById(parts, "part").sortWithinPartitions("part", F.col("key").isNotNull())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], None
        for batch in batches:
            spans = np.asarray(batch.column(4).is_valid())
            n = int(spans.sum())  # spans stand before the part's documents
            held += [np.frombuffer(v, SPAN) for v in batch.column(4).slice(0, n).to_pylist()]
            batch = batch.slice(n)
            if not batch.num_rows:
                continue
            if done is None:
                every = np.concatenate(held) if held else np.zeros(0, SPAN)
                done, held = _spans(every["doc"], every["start"], every["end"]), []
            ids = np.asarray(batch.column(1)).astype(np.int64)
            low, high = np.searchsorted(done["doc"], ids), np.searchsorted(done["doc"], ids, side="right")
            n_words, kept = np.zeros(len(ids), np.int64), [[] for _ in ids]
            for doc, base, words in word_segments(batch.column(3)):
                mine = done[_spread(low[doc], high[doc] - low[doc])]
                first = np.repeat(words.first[:-1], high[doc] - low[doc]) - base
                change = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(change, np.clip(mine["start"] + first, 0, len(words.starts)), 1)
                np.add.at(change, np.clip(mine["end"] + first, 0, len(words.starts)), -1)
                stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                size = words.ends[stays] - words.starts[stays]
                data = np.append(words.data, np.uint8(32))
                at = _spread(words.starts[stays], size + 1)
                ends = np.cumsum(size + 1)
                at[ends - 1] = len(words.data)  # a space after each
                out, edges = data[at].tobytes(), np.append(0, ends)[np.searchsorted(stays, words.first)].tolist()
                n_words[doc] += words.counts
                for d, a, b in zip(doc.tolist(), edges[:-1], edges[1:], strict=True):
                    if b > a:
                        kept[d].append(out[a : b - 1])
            listed = [[{"start": s, "end": e} for s, e in done[["start", "end"]][a:b].tolist()] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(n_words), pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([b" ".join(k).decode() for k in kept], pa.string())], names=["doc_id", "n_words", "spans", "kept"]
            )
        release()

    return rows.mapInArrow(apply, f"doc_id {kind.simpleString()}, n_words long, spans array<struct<start: long, end: long>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_passages(table(spark, sf_dir, "documents")))
