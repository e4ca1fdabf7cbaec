"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased (A to Z) words and one end for each text. Words that stand often enough in the training texts
are symbols of their own, the others share one symbol, whose probability is divided among them by their counts.
Contexts are the last one to DEPTH symbols (the end stands before the first word). A context that occurs often
enough is a candidate; it stays in the tree if its next-symbol distribution diverges from that of its own suffix,
or if a longer context that stays needs it. A distribution is the discounted counts plus what the discount freed
times the suffix's distribution, down to the smoothed word counts; so every text is scored by its longest suffix
states, and all probabilities sum to one. Often enough is a number that grows with the root of the corpus, so symbols,
contexts and entries grow with the corpus too.

Counts cover all training texts. Words are counted by parts of their hashes: each chunk of documents sends its
distinct words once and gets back the counts of exactly those, in never more rows than words. Texts are then written as
blocks of symbols. The tree is a table: each level is counted by parts of its grams and joined with the shorter levels,
and each block fetches the shares of exactly those grams that it meets, as chunks do with words. Tasks hold the
symbols (at most 1 / ROOT times the root of the tokens) and a bitmap of bounded size, which tells what need not be
sent; where it fills up more is sent, to the same result. Words and grams are known by 64-bit hashes.

Edge cases: a null or wordless text is its end alone; a null doc_id is a training row; repeated rows count and are
scored one by one; without training rows every token is unknown; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._grams import BITS, told
from ._spark import by_part, cut, table
from ._text import Words, lowered, mix, pieces, release

#: A symbol or context stands at least LEAST times in the training texts, and ROOT times the root of their tokens; an
#: entry (a symbol after a context) SHARE of that, and twice. So the tree grows with the corpus, by its root.
LEAST, ROOT, SHARE, DEPTH = 16, 0.01, 1 / 16, 3
#: For those who want a smaller tree: symbols, and entries of a level, at most, for which the least counts are doubled. There is no bound of its own.
MAX_SYMBOLS, MAX_ENTRIES = None, None
#: Nats by which a context must differ from its suffix, and the discount of its counts.
DIVERGENCE, DISCOUNT = 0.01, 0.5
#: Tokens of a block (a longer text is a block of its own), and slots of a bitmap for each of its keys.
BLOCK, SLOTS = 1 << 20, 16
END = np.uint64(0x5EED0F7E47E4D001)
#: In place of a next symbol: the context itself.
CONTEXT = np.uint64((1 << 32) - 1)
_TIMES = 24


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words followed by its end, and the n + 1 places where texts begin."""
    words = Words(lowered(data), offsets)
    first = words.first + np.arange(len(offsets))
    out = np.full(int(first[-1]), END, np.uint64)
    out[np.arange(len(words.doc)) + words.doc] = words.hashes()
    return out, first


def enough(known: int) -> float:
    """How often a symbol or context stands in so many tokens at least."""
    return max(float(LEAST), ROOT * known**0.5)


def _doubled(rows: DataFrame, least: float, most: int) -> float:
    """The least count ``n``, doubled until at most ``most`` rows have it."""
    sizes = rows.agg(*[F.count_if(F.col("n") >= least * 2**k).alias(str(k)) for k in range(_TIMES)]).first()
    return least * 2 ** next((k for k in range(_TIMES) if sizes[k] <= most), _TIMES - 1)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Symbols:
    """Symbol 0 is any rarer word, 1..n the frequent words by hash, n + 1 the end; ``total`` and ``root`` are their counts and smoothed shares."""

    words: np.ndarray
    total: np.ndarray
    root: np.ndarray
    known: int
    mass: float
    rare: float

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, ends: int, known: int, distinct: int) -> Symbols:
        mass = known + 0.1 * (distinct + 1)
        own = (np.append(counts, ends) + 0.1) / mass
        root = np.concatenate([[max(1 - own.sum(), 0.1 / mass)], own])
        total = np.concatenate([[known - counts.sum() - ends], counts, [ends]]).astype(np.int64)
        return cls(words, total, root, known, mass, max(mass - (counts.sum() + 0.1 * len(counts)) - (ends + 0.1), 0.1))

    @property
    def end(self) -> int:
        return len(self.words) + 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        return np.where(hashes == END, self.end, _lookup(self.words, hashes) + 1)


def grams(level: int, ids: np.ndarray, first: np.ndarray, end: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (among ``at``) that have a context of this level, the older symbols of it, and its last symbol with the one that stands there."""
    depth = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    at = np.flatnonzero(depth >= level) if at is None else at[depth[at] >= level]
    back = lambda k: np.where(depth[at] >= k, ids[at - k], end).astype(np.uint64)
    high = back(2) if level == 1 else back(3) << np.uint64(32) | back(2) if level == 2 else np.zeros(len(at), np.uint64)
    return at, high, back(1) << np.uint64(32) | ids[at].astype(np.uint64)


def keys_of(level: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes of grams, or of contexts where CONTEXT stands in the low half."""
    return mix(mix(low ^ np.uint64(level * 0x5851F42D4C957F2D)) * np.uint64(0xD6E8FEB86659FD93) ^ high)


def _ranges(keys: np.ndarray, parts: int) -> tuple[list[int], list[int]]:
    """Parts that the sorted keys fall in, and where each begins and the last one ends."""
    part = (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    found, first = np.unique(part, return_index=True)
    return found.astype(np.int64).tolist(), [*first.tolist(), len(keys)]


def _added(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order, their columns, and the sums of the last one."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(columns[-1][order], first) if len(first) else columns[-1]
    return [keys[first], *(c[order[first]] for c in columns[:-1]), sums]


def _packed(values: np.ndarray) -> bytes:
    """Their number, and their bytes, first bytes first, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes], kind: str, steps: bool = False) -> np.ndarray:
    """All values of what ``_packed`` made of them, or of the steps between them."""
    out, size = [np.zeros(0, kind)], np.dtype(kind).itemsize
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        planes = np.frombuffer(pa.decompress(blob[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
        values = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(values, dtype=kind) if steps else values)
    return np.concatenate(out)


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


def _blobs(values: np.ndarray, cuts: list[int], change: Callable[[np.ndarray], np.ndarray] = np.asarray) -> pa.Array:
    return pa.array([_packed(change(values[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


REQUESTS = "part int, chunk int, words binary, counts binary"


def _chunked(docs: DataFrame, salt: int = 3) -> tuple[DataFrame, int]:
    """doc_id, text, train and the chunk of each row; chunks are so many that each is half an input partition or so. Rows of one doc_id, or of none, are dealt by their texts."""
    n = max(8, 2 * docs.rdd.getNumPartitions())
    chunk = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string"), "text"), F.lit(n)).cast("int")
    return docs.select("doc_id", "text", (~held_out()).alias("train"), chunk.alias("chunk")), n


def _joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and their summed counts, given words and counts in turn."""
    words, counts = np.concatenate(arrays[::2]), np.concatenate(arrays[1::2])
    distinct, at = np.unique(words, return_inverse=True)
    return distinct, np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)


def _by_part(words: np.ndarray, parts: int) -> tuple[np.ndarray, list[int]]:
    """Order of the sorted words by part, and where each part begins in it."""
    part = (words >> np.uint64(20)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1)).tolist()


def count_words(chunked: DataFrame, parts: int) -> DataFrame:
    """Rows (kind, chunk, part, words, counts). Kind 0: the training counts of a chunk's words of one part, in the order of their hashes; 1: the part's words that may be symbols; 2: its distinct known words and tokens."""

    floor = enough(0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            chunk, train = np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in pieces(batch.column(0)):
                found, first = tokens(data, offsets)
                row = np.repeat(np.arange(i, j), np.diff(first))
                for c in np.unique(chunk[i:j]).tolist():
                    mine = chunk[row] == c
                    words, at = np.unique(found[mine], return_inverse=True)
                    have = held.setdefault(c, [])
                    have += [words, np.bincount(at, train[row[mine]], minlength=len(words)).astype(np.int64)]
                    if len(have) >= 32:
                        held[c] = list(_joined(have))
        for c, have in held.items():
            words, counts = _joined(have)
            order, cuts = _by_part(words, parts)
            words, counts = words[order], counts[order].astype("<u4")
            full = [p for p in range(parts) if cuts[p + 1] > cuts[p]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([c] * len(full), pa.int32()), pa.array([words[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary()), pa.array([counts[cuts[p] : cuts[p + 1]].tobytes() for p in full], pa.binary())], names=["part", "chunk", "words", "counts"])

    def answer(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        asked = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
        said = [np.frombuffer(c, "<u4") for c in rows.column("counts").to_pylist()]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, np.concatenate(said), minlength=len(words)).astype(np.int64)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        back = [a.astype("<i8").tobytes() for a in np.split(counts[at], cuts)]
        often = np.flatnonzero((counts >= max(floor, ROOT * counts.sum() ** 0.5)) | (words == END))
        chunks = rows.column("chunk").to_pylist()
        totals = np.array([(counts > 0).sum(), counts.sum()], "<i8").tobytes()
        n = len(chunks)
        return pa.table({
            "kind": pa.array([0] * n + [1, 2], pa.int32()), "chunk": pa.array([*chunks, -1, -1], pa.int32()), "part": pa.array([part] * (n + 2), pa.int32()),
            "words": pa.array([None] * n + [words[often].tobytes(), None], pa.binary()), "counts": pa.array([*back, counts[often].astype("<i8").tobytes(), totals], pa.binary()),
        })

    dealt = chunked.select("text", "chunk", "train").repartitionById(parts, "chunk")
    return by_part(dealt.mapInArrow(ask, REQUESTS), parts, answer, "kind int, chunk int, part int, words binary, counts binary")



def symbols_of(counted: DataFrame, known: int, distinct: int) -> tuple[Symbols, float]:
    """The symbols, and how often a context stands at least."""
    least = enough(known)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, c in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                words, counts = np.frombuffer(w, np.uint64), np.frombuffer(c, "<i8")
                often = (counts >= least) | (words == END)
                yield pa.RecordBatch.from_arrays([pa.array(words[often].astype(np.int64)), pa.array(counts[often])], names=["word", "n"])

    rows = counted.filter("kind = 1").select("words", "counts").mapInArrow(frequent, "word long, n long")
    if MAX_SYMBOLS is not None:
        least = _doubled(rows, least, MAX_SYMBOLS)
    found = rows.toArrow()  # the symbols: known / least at most
    words, counts = found.column("word").to_numpy().astype(np.uint64), found.column("n").to_numpy()
    own = np.flatnonzero((words != END) & (counts >= least))
    own = own[np.argsort(words[own])]
    return Symbols.of(words[own], counts[own], int(counts[words == END].sum()), known, distinct), least


def encode(chunked: DataFrame, counted: DataFrame, symbols: Symbols, parts: int) -> DataFrame:
    """Blocks of texts: their chunk and number; of each text its doc_id, held_out, numbers of tokens and known ones, base score and what rarer words add to its score; the symbols of all."""
    spark, kind = chunked.sparkSession, chunked.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(symbols)
    blank = lambda t, name: F.lit(None).cast(t).alias(name)
    texts = chunked.select("chunk", "doc_id", "text", (~F.col("train")).alias("held_out"), blank("int", "part"), blank("binary", "counts"))
    answers = counted.filter("kind = 0").select("chunk", blank(kind, "doc_id"), blank("string", "text"), blank("boolean", "held_out"), "part", "counts")
    both = texts.unionByName(answers).repartitionById(parts, "chunk").sortWithinPartitions("chunk", F.col("part").isNull(), "part")
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value

        def block(chunk: int, number: int, held: list[tuple]) -> pa.RecordBatch:
            columns = [pa.concat_arrays([h[k] for h in held]) for k in range(len(names))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
            ids = pa.compress(np.concatenate([h[-1] for h in held]).astype("<u4").tobytes(), codec="zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([number], pa.int32()), *lists, pa.array([ids], pa.binary())], names=["chunk", "number", *names, "ids"])

        def of(chunk: int, rows: list[pa.RecordBatch], said: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            parsed = [(b.slice(i, j - i), *tokens(d, o)) for b in rows for i, j, d, o in pieces(b.column(2))]
            asked = np.unique(np.concatenate([np.unique(p[1]) for p in parsed]))
            order, cuts = _by_part(asked, parts)
            counts = np.zeros(len(asked), np.int64)
            for p, blob in said.items():
                counts[order[cuts[p] : cuts[p + 1]]] = np.frombuffer(blob, "<i8")
            ids = symbols.ids(asked)
            base = np.log10((counts + 0.1) / symbols.mass)
            own = np.where(ids == 0, np.log10((counts + 0.1) / symbols.rare), 0.0)
            number, held, size = 0, [], 0
            for piece, found, first in parsed:
                if held and size + len(found) > BLOCK:
                    yield block(chunk, number, held)
                    number, held, size = number + 1, [], 0
                at = np.searchsorted(asked, found)
                add = lambda v, first=first: pa.array(np.add.reduceat(v, first[:-1]))
                held.append((piece.column(1), piece.column(3), pa.array(np.diff(first)), add((counts[at] > 0).astype(np.int64)), add(base[at]), add(own[at]), ids[at]))
                size += len(found)
            yield block(chunk, number, held)

        now, said, held = None, {}, []
        for batch in batches:
            chunk = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])).tolist()
            for a, b in zip(edges, [*edges[1:], len(chunk)], strict=True):
                if chunk[a] != now:
                    if held:
                        yield from of(now, held, said)
                    now, said, held = chunk[a], {}, []
                    release()
                part = batch.slice(a, b - a)
                n = len(part) - part.column(4).null_count
                said |= dict(zip(part.column(4).slice(0, n).to_pylist(), part.column(5).slice(0, n).to_pylist(), strict=True))
                if n < len(part):
                    held.append(part.slice(n))
        if held:
            yield from of(now, held, said)

    return both.mapInArrow(run, f"chunk int, number int, doc_id array<{kind}>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>, own array<double>, ids binary")


def _ids(blob: pa.BinaryScalar, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a block of texts of n tokens, and the places where texts begin."""
    first = np.append(0, np.cumsum(n))
    return np.frombuffer(pa.decompress(blob.as_py(), 4 * int(first[-1]), codec="zstd", asbytes=True), "<u4").astype(np.int64), first


def bitmap_of(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], parts: int) -> tuple[np.ndarray, int]:
    """A packed bitmap of the keys that ``keys`` gives for a batch, and the bits of a slot: SLOTS for each row, 2**BITS at most. Each task packs the slots that it owns."""
    bits = min(BITS, max(20, (SLOTS * rows.count()).bit_length()))
    ranges = 1 << (min(parts, 64) - 1).bit_length()
    width = bits - (ranges - 1).bit_length()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(keys(batch) >> np.uint64(64 - bits)).astype(np.int64)
            found, first = np.unique(slots >> width, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), _blobs((slots & ((1 << width) - 1)).astype("<u4"), [*first.tolist(), len(slots)])], names=["part", "slots"])

    def pack(rows: pa.Table) -> pa.Table:
        slots = np.zeros(1 << width, bool)
        for blob in rows.column("slots").to_pylist():
            slots[_unpacked([blob], "<u4")] = True
        return pa.table({"part": rows.column("part").slice(0, 1).cast(pa.int32()), "slots": pa.array([np.packbits(slots).tobytes()], pa.binary())})

    bitmap = np.zeros((ranges, 1 << (width - 3)), np.uint8)
    for row in by_part(rows.mapInArrow(scan, "part int, slots binary"), ranges, pack, "part int, slots binary").collect():  # 2**bits bits in all
        bitmap[row.part] = np.frombuffer(row.slots, np.uint8)
    return bitmap.ravel(), bits


def _context(level: int) -> list[str]:
    return [f"s{k}" for k in range(level + 1)]


def _row_keys(batch: pa.RecordBatch, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows s2, s1, s0, x, ... of one level, and of their contexts."""
    s2, s1, s0, x = (np.asarray(batch.column(k)).astype(np.uint64) for k in range(4))
    high = s2 << np.uint64(32) | s1
    return keys_of(level, high, s0 << np.uint64(32) | x), keys_of(level, high, s0 << np.uint64(32) | CONTEXT)


def count_entries(blocks: DataFrame, symbols: Symbols, level: int, least: float, contexts: DataFrame | None, parts: int) -> DataFrame:
    """Entries that stand often enough: symbols s2, s1, s0 of the context (0 where it is shorter) and x that follows, their count n, total of the context and root share of x."""
    spark, end = blocks.sparkSession, symbols.end
    shared = spark.sparkContext.broadcast((symbols, bitmap_of(contexts.select("s2", "s1", "s0", F.lit(0).alias("x")), lambda b: _row_keys(b, level)[1], parts) if level else None))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, zero = shared.value[1], [], np.zeros(0, np.uint64)
        for batch in batches:
            for held_out, n, blob in zip(*(batch.column(k) for k in range(3)), strict=True):
                n = np.asarray(n.values)
                ids, first = _ids(blob, n)
                train = np.flatnonzero(np.repeat(~held_out.values.to_numpy(zero_copy_only=False), n))
                _, high, low = grams(level, ids, first, end, train)
                if level:
                    live = told(bitmap[0], keys_of(level, high, low | CONTEXT), bitmap[1])
                    high, low = high[live], low[live]
                held.append(_added(keys_of(level, high, low), high, low, np.ones(len(low), np.int64)))
                if len(held) >= 8:
                    held = [_added(*map(np.concatenate, zip(*held, strict=True)))]
        keys, high, low, counts = _added(*map(np.concatenate, zip(*held, strict=True))) if held else (zero, zero, zero, zero)
        found, cuts = _ranges(keys, parts)
        order = np.concatenate([np.zeros(0, np.int64), *(a + np.argsort(low[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), _blobs(high[order], cuts), _blobs(low[order], cuts, _steps), _blobs(counts[order], cuts)], names=["part", "high", "low", "counts"])
        release()

    def add(rows: pa.Table) -> pa.Table:
        symbols = shared.value[0]
        high, low, counts = (_unpacked(rows.column(c).to_pylist(), t, c == "low") for c, t in (("high", "<u8"), ("low", "<u8"), ("counts", "<i8")))
        _, high, low, counts = _added(keys_of(level, high, low), high, low, counts)
        often = counts >= least
        high, low, counts = high[often], low[often], counts[often]
        half = lambda v: (v & CONTEXT).astype(np.int32)
        s0, x = half(low >> np.uint64(32)), half(low)
        return pa.table({"s2": half(high >> np.uint64(32)), "s1": half(high), "s0": s0, "x": x, "n": counts, "total": symbols.total[s0], "root": symbols.root[x]})

    sent = blocks.select("held_out", "n_tokens", "ids").mapInArrow(count, "part int, high binary, low binary, counts binary")
    found = by_part(sent, parts, add, "s2 int, s1 int, s0 int, x int, n long, total long, root double")
    # the bitmap lets some through that are no candidates
    return found.drop("total").join(contexts.select(*_context(level), "total"), _context(level)) if level else found


def settle(entries: DataFrame, level: int, shorter: list[DataFrame], least: float) -> DataFrame:
    """Discounted shares of a level's entries, what the discount freed, and which contexts diverge from their suffixes."""
    p = F.col("root")
    for k, of in enumerate(shorter):
        kept = of.filter("kept")
        entries = entries.join(kept.select(*_context(k), "x", F.col("share").alias(f"share{k}")), [*_context(k), "x"], "left")
        entries = entries.join(kept.groupBy(*_context(k)).agg(F.max("rest").alias(f"rest{k}")), _context(k), "left")
        p = F.coalesce(f"share{k}", F.lit(0.0)) + F.coalesce(f"rest{k}", F.lit(1.0)) * p
    every = Window.partitionBy(*_context(level)).orderBy("x").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_of = lambda e: F.sum(e).over(every)
    of = entries.select("s2", "s1", "s0", "x", "n", "total", "root", p.alias("p"), (F.col("n") / F.col("total")).alias("part"), (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("share"))
    of = of.select("*", F.greatest(1 - all_of(F.col("share")), F.lit(0.0)).alias("rest"), F.greatest(1 - all_of(F.col("part")), F.lit(0.0)).alias("left"), F.greatest(1 - all_of(F.col("p")), F.lit(1e-12)).alias("other"), all_of(F.col("part") * F.log(F.col("part") / F.col("p"))).alias("gain"))
    gain = F.col("gain") + F.when(F.col("left") > 1e-12, F.col("left") * F.log(F.col("left") / F.col("other"))).otherwise(0.0)
    return of.select("s2", "s1", "s0", "x", "n", "total", "share", "rest", ((gain >= DIVERGENCE) & (F.col("total") >= least)).alias("kept"))


def tree_table(blocks: DataFrame, symbols: Symbols, least: float, parts: int) -> DataFrame:
    """The entries of all contexts that stay: level, s2, s1, s0, x, n, total, share and rest."""
    levels, contexts = [], None
    for k in range(DEPTH):
        low = max(2.0, least * SHARE)
        entries = count_entries(blocks, symbols, k, low, contexts, parts)
        if MAX_ENTRIES is not None:
            entries = cut(entries)
            entries = entries.filter(F.col("n") >= _doubled(entries, low, MAX_ENTRIES))
        levels.append(cut(settle(entries, k, levels, least)))
        # what is frequent after a context is a context one longer, but for the end, after which nothing comes
        often = levels[k].filter((F.col("n") >= least) & (F.col("x") < symbols.end))
        longer = often.select(F.col("s1").alias("s2"), F.col("s0").alias("s1"), F.col("x").alias("s0"), F.col("n").alias("total"))
        contexts = longer if not k else longer.join(contexts.select(*_context(k)), _context(k), "left_semi")
    for k in range(DEPTH - 1, 0, -1):  # a suffix of what stays stays
        needed = levels[k].filter("kept").select(*_context(k - 1), F.lit(True).alias("needed")).distinct()
        levels[k - 1] = levels[k - 1].join(needed, _context(k - 1), "left").withColumn("kept", F.col("kept") | F.coalesce("needed", F.lit(False))).drop("needed")
    rows = [level.filter("kept").select("s2", "s1", "s0", "x", F.lit(k).alias("level"), "n", "total", "share", "rest") for k, level in enumerate(levels)]
    return cut(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@dataclass
class Level:
    """The contexts of one length in memory: keys (of level 0 all symbols), the contexts one shorter, and what follows them."""

    keys: np.ndarray
    suffix: np.ndarray
    kept: np.ndarray
    rest: np.ndarray
    entry_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    entry_shares: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """A small tree in memory, to look at."""

    root: np.ndarray
    levels: list[Level] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.root)

    def probability(self, contexts: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        """Of each symbol after its contexts."""
        p = self.root[x]
        for level, at in zip(self.levels, contexts, strict=False):
            live = np.flatnonzero((at >= 0) & level.kept[at])
            entry = _lookup(level.entry_keys, at[live] * self.size + x[live])
            share = np.where(entry >= 0, level.entry_shares[entry], 0.0) if len(level.entry_shares) else 0.0
            p[live] = share + level.rest[at[live]] * p[live]
        return p

    def chain(self, k: int, at: np.ndarray) -> list[np.ndarray]:
        """The contexts of level k and their suffixes, shortest first."""
        out = [at]
        for level in reversed(self.levels[1 : k + 1]):
            out.insert(0, level.suffix[out[0]])
        return out


def grow(chunked: DataFrame, words: np.ndarray, counts: np.ndarray, ends: int, known: int, distinct: int, parts: int, least: float) -> Tree:
    """A small corpus's tree in memory, given the frequent words in the order of their hashes, their counts, the ends, tokens and distinct tokens in all, and the least count of a context."""
    symbols = Symbols.of(words, counts, ends, known, distinct)
    tree = Tree(symbols.root)
    blocks = cut(encode(chunked, cut(count_words(chunked, parts)), symbols, parts))
    rows = tree_table(blocks, symbols, least, parts).toArrow().to_pylist()
    names, size = [], tree.size
    for k in range(DEPTH):
        mine = sorted((tuple(r[s] for s in reversed(_context(k))), r["x"], r["share"], r["rest"]) for r in rows if r["level"] == k)
        keys = sorted({r[0] for r in mine}) if k else [(s,) for s in range(size)]
        at = {s: i for i, s in enumerate(keys)}
        rest = {r[0]: r[3] for r in mine}
        suffix = np.array([names[-1][s[1:]] if k else 0 for s in keys], np.int64)
        names.append(at)
        tree.levels.append(Level(np.arange(len(keys)), suffix, np.array([s in rest for s in keys], bool), np.array([rest.get(s, 1.0) for s in keys]), np.array([at[r[0]] * size + r[1] for r in mine], np.int64), np.array([r[2] for r in mine])))
    return tree


def sought(ids: np.ndarray, first: np.ndarray, end: int, bitmap: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Sorted keys of the tree's contexts and grams in a block (and of some that the bitmap takes for such). For each level the places that have a context and its key's index; those of them (by index) that have a gram, and its key's index."""
    levels, keys, at = [], [], None
    for k in range(DEPTH):
        at, high, low = grams(k, ids, first, end, at)
        context = keys_of(k, high, low | CONTEXT)
        live = np.flatnonzero(told(bitmap, context, bits))  # a longer context stays only where its suffix does
        at, gram = at[live], keys_of(k, high[live], low[live])
        entry = np.flatnonzero(told(bitmap, gram, bits))
        levels.append((at, entry))
        keys += [context[live], gram[entry]]
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    index = np.split(index, np.cumsum([len(k) for k in keys])[:-1])
    return distinct, [(at, index[2 * k], entry, index[2 * k + 1]) for k, (at, entry) in enumerate(levels)]


def fetch(blocks: DataFrame, tree: DataFrame, shared, parts: int) -> DataFrame:
    """Rows (chunk, number, part, times, rests) for the keys of one part that a block seeks, in their order: an entry's count and 0, a context's total and what its discount freed; 0 and 0 for what the tree has not."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, bitmap, bits = shared.value[0].end, *shared.value[1]
        for batch in batches:
            for chunk, number, n, blob in zip(*(batch.column(k) for k in range(4)), strict=True):
                keys, _ = sought(*_ids(blob, np.asarray(n.values)), end, bitmap, bits)
                found, cuts = _ranges(keys, parts)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array([v.as_py()] * len(found), pa.int32()) for v in (chunk, number)), _blobs(keys, cuts, _steps), pa.nulls(len(found), pa.binary()), pa.nulls(len(found), pa.binary())], names=names)
        release()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, total, rest = (np.asarray(batch.column(k)) for k in (5, 6, 7))
            keys, first = np.unique(_tree_keys(batch), return_index=True)
            times, rests = np.concatenate([n, total])[first], np.concatenate([np.zeros(len(n)), rest])[first]
            found, cuts = _ranges(keys, parts)
            blank = pa.nulls(len(found), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), blank, blank, _blobs(keys, cuts, _steps), _blobs(times, cuts), _blobs(rests, cuts)], names=names)

    def answer(rows: pa.Table) -> pa.Table:
        has = rows.filter(rows.column("times").is_valid())
        keys, times, rests = (_unpacked(has.column(c).to_pylist(), t, c == "keys") for c, t in (("keys", "<u8"), ("times", "<i8"), ("rests", "<f8")))
        keys, first = np.unique(keys, return_index=True)
        times, rests = np.append(times[first], 0), np.append(rests[first], 0.0)  # the last ones for keys that are not found
        asks = rows.filter(rows.column("times").is_null())
        at = [_lookup(keys, _unpacked([k], "<u8", True)) for k in asks.column("keys").to_pylist()]
        said = [pa.array([_packed(v[a]) for a in at], pa.binary()) for v in (times, rests)]
        return pa.table([*(asks.column(c) for c in ("chunk", "number", "part")), *said], names=["chunk", "number", "part", "times", "rests"])

    names = ["part", "chunk", "number", "keys", "times", "rests"]
    schema = "part int, chunk int, number int, keys binary, times binary, rests binary"
    asked = blocks.select("chunk", "number", "n_tokens", "ids").mapInArrow(ask, schema)
    offered = tree.select("s2", "s1", "s0", "x", "level", "n", "total", "rest").mapInArrow(offer, schema)
    return by_part(asked.unionByName(offered), parts, answer, "chunk int, number int, part int, times binary, rests binary")


def _tree_keys(batch: pa.RecordBatch) -> np.ndarray:
    """Keys of all rows s2, s1, s0, x, level, ..., then of all their contexts."""
    level = np.asarray(batch.column(4))
    grams_, contexts = np.zeros(len(level), np.uint64), np.zeros(len(level), np.uint64)
    for k in range(DEPTH):
        mine = np.flatnonzero(level == k)
        grams_[mine], contexts[mine] = _row_keys(batch.take(pa.array(mine)), k)
    return np.concatenate([grams_, contexts])


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    chunked, parts = _chunked(docs)
    counted = cut(count_words(chunked, parts))
    totals = [np.frombuffer(r.counts, "<i8") for r in counted.filter("kind = 2").select("counts").toLocalIterator()]
    distinct, known = (int(sum(t[k] for t in totals)) for k in range(2))
    symbols, least = symbols_of(counted, known, distinct)
    blocks = cut(encode(chunked, counted, symbols, parts))
    tree = tree_table(blocks, symbols, least, parts)
    shared = spark.sparkContext.broadcast((symbols, bitmap_of(tree, _tree_keys, parts)))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "base", "own", "ids")
    blank = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in names]
    answers = fetch(blocks, tree, shared, parts).select("chunk", "number", *blank, "part", "times", "rests")
    texts = blocks.select("chunk", "number", *names, F.lit(None).cast("int").alias("part"), *(F.lit(None).cast("binary").alias(c) for c in ("times", "rests")))
    both = texts.unionByName(answers).repartitionById(parts, "chunk").sortWithinPartitions("chunk", "number", F.col("part").isNull(), "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, (bitmap, bits) = shared.value
        said: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for r, part in enumerate(batch.column(9)):
                if part.is_valid:
                    said.append(tuple(batch.column(k)[r].as_py() for k in (10, 11)))
                    continue
                doc_id, held_out, n, known, base, own = (batch.column(k)[r].values for k in range(2, 8))
                ids, first = _ids(batch.column(8)[r], np.asarray(n))
                _, levels = sought(ids, first, symbols.end, bitmap, bits)
                times, rests = (_unpacked([v[k] for v in said], t) for k, t in enumerate(("<i8", "<f8")))
                said = []
                p = symbols.root[ids]
                for at, context, entry, gram in levels:
                    total, n_x = times[context], np.zeros(len(at))
                    n_x[entry] = np.maximum(times[gram] - DISCOUNT, 0)
                    kept = np.flatnonzero(total)
                    p[at[kept]] = n_x[kept] / total[kept] + rests[context[kept]] * p[at[kept]]
                found = np.add.reduceat(np.log10(p), first[:-1]) + np.asarray(own)
                cols = [n, known, pa.array(np.full(len(n), symbols.known)), base, pa.array(found)]
                yield pa.RecordBatch.from_arrays([doc_id, held_out, *cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                release()

    return both.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
