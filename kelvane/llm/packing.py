"""Packing tokenised documents into sequences by patterns fitted with non-negative least squares.

Documents are tokenised, ended with an end id and cut only where they exceed a sequence. Pieces are dealt by hash
into groups of bounded size; in each group the lengths are rounded up to steps, all patterns of two to four
rounded lengths that fill a sequence exactly are enumerated, and non-negative least squares fits how often each
pattern repeats so that the histogram of lengths is used up. The counts are rounded down, patterns are filled
with real pieces, and what is left, short pieces above all, goes best-fit into the gaps, longest first.

Edge cases: a null text is empty and becomes the end id alone; repeated rows, or rows with equal or null ids, are
packed one by one; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, table
from ._text import release, span_hashes

CAPACITY, END = 4096, 1
#: Pieces that one task packs, about.
GROUP = 100_000
STEP = 64
#: Pieces of at most so many tokens are kept out of the patterns: they fill the gaps.
FILLER = 192

#: Words whose ids a worker remembers from one call to the next at most; a call itself remembers all of its own.
_CACHED = 1 << 20
#: Texts and bytes of a call, about; a longer text is a call of its own.
_TEXTS, _BYTES = 250, 1 << 22

# Kinds of bytes: 0 white space, 1 letter (all of a multi-byte character), 2 digit, 3 other; and those that send a
# text to the tokenizer whole, since its normal forms, white space or numerals may matter there.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[*range(9), *range(14, 32), 127, 0xC2]] = True  # controls, and U+0080 to U+00BF
_ODD[0xCA:] = True  # U+0280 and above
_ONE, _TWO = np.zeros(256, bool), np.zeros((256, 256), bool)
_ONE[list(b"stmd")] = True
for _pair in (b"re", b"ve", b"ll"):
    _TWO[_pair[0], _pair[1]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold characters that are not ASCII or letters up to U+024F."""
    odd = _ODD[data]
    after = np.zeros(len(data), np.uint8)
    after[:-1] = data[1:]
    odd |= (data == 0xC3) & ((after == 0x97) | (after == 0xB7))  # the signs of multiplication and division
    odd |= (data == 0xC9) & (after >= 0x90)
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum(odd, out=count[1:])
    return count[offsets[1:]] > count[offsets[:-1]]


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's words: runs of letters, single digits, runs of other signs, and English contractions."""
    n = len(data)
    kind = _KIND[data]
    start = np.ones(n + 1, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    start[offsets] = True
    quote = np.flatnonzero(start[:-1] & (data == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~np.isin(quote + 1, offsets)]
    first, second = data[quote + 1], data[np.minimum(quote + 2, n - 1)]
    joined = (quote + 2 < n) & ~start[np.minimum(quote + 2, n)]  # the second letter belongs to the same run
    one = quote[_ONE[first]]
    two = quote[~_ONE[first] & joined & _TWO[first, second]]
    start[np.concatenate([one, two]) + 1] = False
    start[one + 2] = True
    start[two + 3] = True
    solid = kind != 0
    starts = np.flatnonzero(start[:-1] & solid)
    ends = np.flatnonzero(solid & (start[1:] | np.append(~solid[1:], True))) + 1
    return starts, ends


class WordTokenizer:
    """Ids of whole texts, as the tokenizer file gives them without special tokens, by way of remembered words.

    The file's splitter never joins characters across a word, so the ids of a text are those of its words. Texts
    are split as bytes, words are known by 64-bit hashes, and a word is encoded once for as long as it is remembered.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        new, sizes = [], []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            new.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        size = np.concatenate(sizes)
        at = len(self.ids) + np.cumsum(size) - size
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, *new])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and whether they are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.keys) > _CACHED:
            self.forget()
        raw = [t.lower().encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        if not len(data):
            return [b""] * len(texts)
        odd = _odd_texts(data, offsets)
        starts, ends = split_words(data, offsets)
        fine = ~odd[np.searchsorted(offsets, starts, side="right") - 1]
        starts, ends = starts[fine], ends[fine]
        keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(new := np.flatnonzero(~self.find(keys)[1])):
            blob = data.tobytes()
            self.learn(keys[new], [blob[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        at, known = self.find(keys)
        if not known.all():
            raise AssertionError("a word of this call is not known")
        word = self.size[at][which]
        total = np.concatenate([[0], np.cumsum(word)])
        begin = self.at[at][which]
        ids = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], word)]
        cuts = total[np.searchsorted(starts, offsets)]
        flat = ids.astype("<u4").tobytes()
        special = lambda t: "<|startoftext|>" in t or "<|endoftext|>" in t
        return [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o or special(t) else flat[4 * a : 4 * b]
            for t, o, a, b in zip(texts, odd.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _calls(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most _TEXTS texts and about _BYTES bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, n = 0, len(column)
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _BYTES, side="right"))
        j = min(max(j, i + 1), i + _TEXTS, n)
        yield i, j
        i = j


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row of ``docs`` (doc_id, text)."""
    path, mark = path or default_tokenizer(), np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(path)
        for whole in batches:
            for i, j in _calls(whole.column(1)):
                batch = whole.slice(i, j - i)
                rows, piece, start, length, crc = [], [], [], [], []
                for row, ids in enumerate(known.encode([t or "" for t in batch.column(1).to_pylist()])):
                    ids += mark
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        rows.append(row)
                        piece.append(k // (4 * capacity))
                        start.append(k // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                cols = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *cols], names=names)
            release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


@lru_cache(maxsize=4)
def patterns(bins: int, parts: int = 4) -> np.ndarray:
    """Each multiset of 2 to ``parts`` of 1..bins that sums to ``bins``, as a column of how often it uses each."""
    found: list[list[int]] = []

    def grow(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            if len(chosen) > 1:
                found.append(chosen)
            return
        if len(chosen) == parts:
            return
        for b in range(min(most, left), 0, -1):
            if b * (parts - len(chosen)) < left:
                break
            grow([*chosen, b], left - b, b)

    grow([], bins, bins)
    out = np.zeros((bins, len(found)))
    for j, chosen in enumerate(found):
        for b in chosen:
            out[b - 1, j] += 1
    return out


def nnls(a: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Minimise |a x - y| over x >= 0 with an active set of columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(steps):
        slope = a.T @ (y - a @ x)
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * (1 + np.abs(y).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], y, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            ratio = x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)
            x[at] += ratio.min() * (s - x[at])
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def pack(lengths: np.ndarray, capacity: int = CAPACITY, step: int = STEP, filler: int = FILLER) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset there of pieces with these lengths, each at most ``capacity``."""
    n, bins = len(lengths), capacity // step
    sequence, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        stock[lengths[i]].append(i)
    there = sum(1 << k for k, of in enumerate(stock) if of)

    def take(low: int, high: int) -> int:
        """The longest piece left of a length in (low, high], or -1."""
        nonlocal there
        size = (there & ((2 << high) - 1)).bit_length() - 1
        if size <= low:
            return -1
        i = stock[size].pop()
        if not stock[size]:
            there ^= 1 << size
        return i

    usable = np.bincount(-(-lengths // step), minlength=bins + 1)[1:].astype(float)
    usable[: filler // step] = 0
    columns = patterns(bins)
    columns = columns[:, (columns[(usable == 0)] == 0).all(axis=0)]
    used, gaps = 0, []
    if columns.shape[1]:
        repeats = np.floor(nnls(columns, usable) + 1e-6).astype(int)
        for j in np.argsort(-repeats, kind="stable")[: (repeats > 0).sum()]:
            need = np.repeat(np.arange(1, bins + 1), columns[:, j].astype(int))[::-1].tolist()
            for _ in range(repeats[j]):
                at, got = 0, []
                for k, b in enumerate(need):  # the last takes the longest that fits: rounding up left room
                    i = take((b - 1) * step, b * step if k < len(need) - 1 else capacity - at)
                    if i < 0:
                        break
                    got.append(i)
                    at += int(lengths[i])
                if i < 0:
                    for i in got:
                        stock[lengths[i]].append(i)
                        there |= 1 << int(lengths[i])
                    break
                at = 0
                for i in got:
                    sequence[i], offset[i] = used, at
                    at += int(lengths[i])
                gaps.append((used, at))
                used += 1
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, mask = {}, 0
    for s, at in gaps:
        filled[s] = at
        space[capacity - at].append(s)
        mask |= 1 << (capacity - at)
    for i in order.tolist():
        if sequence[i] >= 0:
            continue
        size = int(lengths[i])
        if above := mask >> size:
            free = size + (above & -above).bit_length() - 1
            s = space[free].pop()
            if not space[free]:
                mask &= ~(1 << free)
        else:
            s, free, used = used, capacity, used + 1
            filled[s] = 0
        sequence[i], offset[i] = s, filled[s]
        filled[s] += size
        space[free - size].append(s)
        mask |= 1 << (free - size)
        mask &= ~1  # a full sequence takes nothing
    return sequence, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces``, a written table, with sequence_id and offset."""
    n = max(1, round(pieces.count() / group))
    at, names = pieces.columns.index("length"), [*pieces.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])  # the same groups give the same sequences, however the rows arrived
            sequence, offset = pack(rows.column(at).to_numpy(), capacity)
            sequence += TaskContext.get().partitionId() << 40
            for b in rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).to_batches(10_000):
                yield b.rename_columns(names)

    # by place in the written table and not by content: repeated rows would all meet in one task
    dealt = pieces.repartition(n, F.xxhash64(F.monotonically_increasing_id()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack_pieces(cut(cut_documents(docs, capacity, path=path)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
