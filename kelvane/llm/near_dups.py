"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles (of one shingle, where it has fewer words); the k-th occurrence of
a shingle is an element of its own with the shingle's inverse document frequency as weight, so the similarity of
two texts is the weighted Jaccard similarity of their TF-IDF vectors. Improved consistent weighted sampling draws
64 samples of each text; bands of four samples make buckets. In every bucket each text is verified against the
smallest. Where that leaves texts of one family (all that met one smallest text) in different components, a prefix
filter finds the texts that can still have a link to another component: with elements in one order, rarest first, two
texts of similarity t share an element among those that come before a share of 1 - t of either text's weight is
passed. These texts, but for the family's largest component, are compared with all such texts of the family, block by
block, inside tasks that return only the links that join components. A text is dealt to one block, and a block is one
row, so rows are made by text and by pair of blocks. So buckets have no cap, no pairs of a large group are written
out, and texts of a family that have nothing rare in common are not compared at all. Classes are the connected
components of verified links of 0.8 or more.

Document frequencies are counted over all documents in a table of 2**18 hashed counters, less the counters' median
(what rare shingles add by chance). The weight is (1 + ln((N + 1) / (df + 1)) / ln(N + 1)) / 2: from 1 for a rare
shingle to one half for one that all documents have, so that the shared parts of a large family of copies still
count.

Edge cases: a null or wordless text, or a null doc_id, is like nothing else (class: its own doc_id); repeated rows
and exact copies share a class; texts with equal doc_id are compared as separate texts, and the doc_id gets the
smallest class of its texts; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ._spark import cut, table
from ._text import Words, mix, pieces

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, BAND = 64, 4
COUNTERS = 18
#: Texts of a block or slice of a family when its texts are compared.
BLOCK = 140

_SALT = np.uint64(0x9E3779B97F4A7C15)


class Elements:
    """The elements of a run of texts: text index, key and counter of each, ordered by text and shingle; and each text's identity."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> None:
        words = Words(data, offsets)
        hashes = words.hashes()
        at, shingles = words.windows(hashes, k)
        doc = words.doc[at]
        n = len(offsets) - 1
        run = np.zeros((2, len(hashes) + 1), np.uint64)  # sums over words by place: the identity of a text's word sequence
        place = (np.arange(len(hashes)) - words.first[words.doc]).astype(np.uint64)
        for i, q in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
            np.cumsum(mix(hashes + mix(place + np.uint64(q))), out=run[i, 1:])
        total = run[:, words.first[1:]] - run[:, words.first[:-1]]
        self.counts = words.counts
        self.identity = np.ascontiguousarray(mix(total + words.counts.astype(np.uint64) * _SALT).T).view("S16").ravel() if n else np.zeros(0, "S16")
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):
            doc, shingles = np.concatenate([doc, short]), np.concatenate([shingles, mix(total[0, short])])
        order = np.lexsort((shingles, doc))
        doc, shingles = doc[order], shingles[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
        starts = np.flatnonzero(new)
        nth = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
        self.doc, self.new, self.counter = doc, new, (shingles >> np.uint64(64 - COUNTERS)).astype(np.int64)
        self.keys = mix(shingles + nth.astype(np.uint64) * _SALT)
        self.first = np.searchsorted(doc, np.arange(n + 1))

    @staticmethod
    def of(column: pa.Array) -> Elements:
        """Of a whole column, taken in pieces."""
        parts = [Elements(d, o) for _, _, d, o in pieces(column)]
        if len(parts) == 1:
            return parts[0]
        out, texts, elements = Elements.__new__(Elements), 0, 0
        joined: dict[str, list[np.ndarray]] = {k: [] for k in ("counts", "identity", "doc", "new", "counter", "keys", "first")}
        for e in parts:
            for k in joined:
                joined[k].append(e.doc + texts if k == "doc" else e.first[:-1] + elements if k == "first" else getattr(e, k))
            texts, elements = texts + len(e.counts), elements + len(e.doc)
        for k, v in joined.items():
            setattr(out, k, np.concatenate([*v, np.array([elements])] if k == "first" else v))
        return out


def identities(raw: np.ndarray) -> pa.Array:
    """The S16 values as binary; numpy drops trailing zero bytes of a value, Arrow's buffer keeps them."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary())


def _gamma2() -> np.ndarray:
    """65,536 equally likely values of a Gamma(2, 1) variable."""
    x = np.linspace(0, 40, 400_001)
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)


class Sampler:
    """Improved consistent weighted sampling: the least ln a of each sample stands for the sampled element and its quantised weight."""

    def __init__(self, samples: int = SAMPLES, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 2**63, samples, dtype=np.uint64)
        values = _gamma2()
        self.r, self.log_c = values.astype(np.float32), np.log(values).astype(np.float32)
        self.inverse_r = (1 / values).astype(np.float32)

    def sample(self, keys: np.ndarray, weights: np.ndarray, first: np.ndarray, tile: int = 4096) -> np.ndarray:
        """The samples of each text; texts without elements get infinity."""
        out = np.full((len(first) - 1, len(self.factor)), np.inf, np.float32)
        log_w = np.log(weights).astype(np.float32)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for i in range(0, len(keys), tile):
            bits = (keys[i : i + tile, None] * self.factor + self.shift).view(np.uint16).reshape(-1, len(self.factor), 4)
            at = bits[..., 3].astype(np.intp)
            beta = bits[..., 1].astype(np.float32) * np.float32(2**-16)
            steps = self.inverse_r.take(at)
            steps *= log_w[i : i + tile, None]
            steps += beta
            np.floor(steps, out=steps)
            steps -= beta
            steps += np.float32(1)
            steps *= self.r.take(at)
            value = self.log_c.take(bits[..., 2].astype(np.intp))
            value -= steps
            docs = doc[i : i + tile]
            begin = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            rows = docs[begin]
            out[rows] = np.minimum(out[rows], np.minimum.reduceat(value, begin, axis=0))
        return out


def bands_of(samples: np.ndarray, width: int = BAND) -> np.ndarray:
    """One 64-bit bucket for each band of samples."""
    bits = np.ascontiguousarray(samples).view(np.uint32).astype(np.uint64).reshape(len(samples), -1, width)
    out = np.arange(bits.shape[1], dtype=np.uint64) * _SALT + np.zeros((len(samples), 1), np.uint64)
    for i in range(width):
        out = mix(out ^ bits[..., i]) + _SALT
    return out.view(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed counts of documents by shingle, and the number of documents that have one."""
    size = 1 << COUNTERS
    part = size // 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, _, d, o in pieces(batch.column(0)):
                e = Elements(d, o)
                held += np.bincount(e.counter[e.new], minlength=size)
                n += int((e.counts > 0).sum())
        blobs = [held[i * part : (i + 1) * part].astype("<u4").tobytes() for i in range(16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n] + [0] * 15, pa.int64())], names=["slot", "blob", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for slot, blob, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = held.setdefault(slot, [np.zeros(part, np.int64), 0])
                old[0] += np.frombuffer(blob, "<u4")
                old[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0].astype("<i8").tobytes() for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())], names=["slot", "blob", "n"])

    schema = "slot int, blob binary, n long"
    found = docs.select("text").mapInArrow(count, schema)
    counts, n = np.zeros(size, np.int64), 0
    for r in found.repartition(16, "slot").mapInArrow(add, schema).collect():  # 16 blobs of a fixed size
        counts[r.slot * part : (r.slot + 1) * part] += np.frombuffer(r.blob, "<i8")
        n += r.n
    return counts, n


def inverse_frequencies(counts: np.ndarray, n: int) -> np.ndarray:
    df = np.maximum(1, counts - np.median(counts) + 1)
    return ((1 + np.maximum(0, np.log((n + 1) / (df + 1))) / np.log(n + 2)) / 2).astype(np.float32)


def intersections(a: Elements, b: Elements, idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of text i of ``a`` and text i of ``b``."""
    n = len(a.first) - 1
    keyed = [mix(e.keys + e.doc.astype(np.uint64) * _SALT) for e in (a, b)]
    weight = [np.bincount(e.doc, idf[e.counter], minlength=n) for e in (a, b)]
    _, at, _ = np.intersect1d(*keyed, assume_unique=True, return_indices=True)
    common = np.bincount(a.doc[at], idf[a.counter[at]], minlength=n)
    return common / np.maximum(weight[0] + weight[1] - common, 1e-12)


def similarities(e: Elements, idf: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of the texts of ``e`` that are not ``right`` (rows) with those that are (columns)."""
    n, weight = len(right), idf[e.counter].astype(np.float64)
    total, common = np.bincount(e.doc, weight, minlength=n), np.zeros((n - right.sum(), right.sum()))
    _, feature, times = np.unique(e.keys, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[feature] > 1)
    renamed, feature = np.unique(feature[shared], return_inverse=True)
    order = np.argsort(feature, kind="stable")
    shared, feature = shared[order], feature[order]
    for i in range(0, len(renamed), columns):
        a, b = np.searchsorted(feature, (i, i + columns))
        part = np.zeros((n, min(columns, len(renamed) - i)), np.float32)
        part[e.doc[shared[a:b]], feature[a:b] - i] = np.sqrt(weight[shared[a:b]])
        common += part[~right] @ part[right].T
    return common / np.maximum(total[~right][:, None] + total[right][None, :] - common, 1e-12)


def prefixes(e: Elements, idf: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the elements, rarest first, that no more than a share of 1 - ``threshold`` of the text's weight precedes.

    Texts of that similarity have the first of their common elements there: what precedes it is in one of them only.
    """
    weight = idf[e.counter].astype(np.float64)
    order = np.lexsort((e.keys, -weight, e.doc))
    doc, weight = e.doc[order], weight[order]
    passed = np.append(0.0, np.cumsum(weight))
    total = passed[e.first[1:]] - passed[e.first[:-1]]
    early = passed[:-1] - passed[e.first[doc]] <= (1 - threshold + 1e-6) * total[doc]  # with room for rounding
    return doc[early], e.keys[order][early]


def text_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tid) of each row with an id and words, tid being the identity of its word sequence; and (node, root) of the texts with links."""
    from .components import connected_components

    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    idf = inverse_frequencies(*document_frequencies(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared_idf = spark.sparkContext.broadcast(idf)
    sampler = Sampler()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared_idf.value
        for batch in batches:
            for i, j, d, o in pieces(batch.column(1)):
                e = Elements(d, o)
                bands = bands_of(sampler.sample(e.keys, idf[e.counter], e.first))
                rows = np.flatnonzero(e.counts > 0)
                kept = pa.array(rows)
                listed = pa.ListArray.from_arrays(np.arange(0, bands.shape[1] * len(rows) + 1, bands.shape[1], dtype=np.int32), pa.array(bands[rows].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(kept), identities(e.identity).take(kept), listed], names=["doc_id", "tid", "bands"])

    signed = cut(docs.mapInArrow(draw, f"doc_id {kind}, tid binary, bands array<long>"))
    texts = signed.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    buckets = cut(texts.select("tid", "doc_id", F.explode("bands").alias("bucket")))
    # aggregates are written before they are joined: a join of plain tables can be split where one key has many rows
    leaders = cut(buckets.groupBy("bucket").agg(F.min("tid").alias("leader"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    family = cut(buckets.join(leaders, "bucket").filter("tid <> leader").select("leader", "tid").distinct())

    wanted = family.select("tid").unionByName(family.select(F.col("leader").alias("tid"))).distinct()
    wanted = wanted.join(texts.select("tid", "doc_id"), "tid")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in pieces(batch.column(1)):
                got = identities(Elements(d, o).identity)
                hit = np.array([a == b for a, b in zip(got.to_pylist(), batch.column(0).slice(i, j - i).to_pylist(), strict=True)], bool)
                yield batch.slice(i, j - i).filter(pa.array(hit))

    # a doc_id may stand for several texts: only the one that the identity names is taken
    joined = docs.join(wanted, "doc_id").select("tid", "text").mapInArrow(same, "tid binary, text string")
    repeated = not signed.groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty()
    bodies = cut(joined.groupBy("tid").agg(F.first("text").alias("text")) if repeated else joined)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared_idf.value
        for batch in batches:
            for i, j, d, o in pieces(batch.column(2)):
                part = batch.slice(i, j - i)
                for k, m, d2, o2 in pieces(part.column(3)):
                    one = Elements(d[o[k] : o[m]], o[k : m + 1] - o[k])
                    hit = intersections(one, Elements(d2, o2), idf) >= threshold - 1e-9
                    yield part.slice(k, m - k).select([0, 1]).filter(pa.array(hit))

    pairs = family.join(bodies, "tid").join(bodies.select(F.col("tid").alias("leader"), F.col("text").alias("leader_text")), "leader")
    links = cut(pairs.select(F.col("tid").alias("a"), F.col("leader").alias("b"), "text", "leader_text").mapInArrow(verify, "a binary, b binary"))
    classes = cut(connected_components(links))

    # families whose texts, but for the smallest, are still in several components: their pairs were not all compared
    placed = cut(family.join(classes, family["tid"] == classes["node"], "left").select("leader", "tid", F.coalesce("root", "tid").alias("root")))
    open_ = cut(placed.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("leader"))
    dealt = deal(placed.join(open_, "leader"), bodies, shared_idf, threshold)

    def compare(rows: pa.Table) -> pa.Table:
        texts = rows.column("texts").combine_chunks()
        right = pa.array(np.repeat(rows.column("right").to_numpy(), np.diff(texts.offsets)))
        rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(texts.flatten())]).append_column("right", right).sort_by("tid")
        roots, right = rows.column("root").to_pylist(), rows.column("right").to_numpy()
        near = similarities(Elements.of(rows.column("text").combine_chunks()), shared_idf.value, right) >= threshold - 1e-9
        up = {r: r for r in roots}

        def top(x: bytes) -> bytes:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        a, b = [], []
        rows_, columns = np.flatnonzero(~right), np.flatnonzero(right)
        at = np.argwhere(near)
        for x, y in zip(rows_[at[:, 0]].tolist(), columns[at[:, 1]].tolist(), strict=True):
            if (p := top(roots[x])) != (q := top(roots[y])):
                up[p] = q
                a.append(roots[x])
                b.append(roots[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    more = cut(block_pairs(dealt).groupBy("leader", "i", "j").applyInArrow(compare, "a binary, b binary"))
    if not more.isEmpty():
        classes = cut(joined_classes(classes, cut(connected_components(more))))
    return signed.select("doc_id", "tid"), classes


def deal(members: DataFrame, bodies: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """Texts to compare in each family (leader): those outside its largest component, by block, each with all of the family (``right``), by slice; ``others`` is the number of slices for a block and of blocks for a slice.

    ``members`` (leader, tid, root) are the families, ``bodies`` (tid, text) their texts, ``idf`` the broadcast weights.
    Only texts stay that share an element of their prefixes with a text of another component.
    """

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in pieces(batch.column(2)):
                doc, keys = prefixes(Elements(d, o), idf.value, threshold)
                part = batch.slice(i, j - i).select([0, 1]).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys.view(np.int64))], names=["tid", "root", "key"])

    texts = members.select("tid", "root").distinct().join(bodies, "tid").select("tid", "root", "text")
    found = cut(texts.mapInArrow(early, "tid binary, root binary, key long"))
    across = cut(found.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key"))
    able = cut(found.join(across, "key").select("tid").distinct())
    members = cut(members.join(able, "tid"))
    sizes = members.groupBy("leader", "root").agg(F.count("*").alias("n")).groupBy("leader")
    sizes = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("largest")).filter("n > largest.n")
    blocks, slices = F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int"), F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = cut(sizes.select("leader", F.col("largest.root").alias("largest"), blocks.alias("blocks"), slices.alias("slices")))
    members = members.join(sizes, "leader")

    def one_of(count: str):
        return F.pmod(F.xxhash64("tid"), F.col(count)).cast("int")

    left = members.filter("root <> largest").select("leader", F.lit(False).alias("right"), one_of("blocks").alias("block"), F.col("slices").alias("others"), "tid", "root")
    right = members.select("leader", F.lit(True).alias("right"), one_of("slices").alias("block"), F.col("blocks").alias("others"), "tid", "root")
    return left.unionByName(right).join(bodies, "tid")


def block_pairs(dealt: DataFrame) -> DataFrame:
    """(leader, i, j, right, texts): block i and slice j of each family, as one row each of (tid, root, text), of what ``deal`` gives."""
    packed = dealt.groupBy("leader", "right", "block", "others").agg(F.collect_list(F.struct("tid", "root", "text")).alias("texts"))
    each = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    i, j = F.when(F.col("right"), F.col("other")).otherwise(F.col("block")), F.when(F.col("right"), F.col("block")).otherwise(F.col("other"))
    return each.select("leader", i.alias("i"), j.alias("j"), "right", "texts")


def joined_classes(classes: DataFrame, moved: DataFrame) -> DataFrame:
    """(node, root) after the classes of the roots ``moved.node`` became parts of those of ``moved.root``; a text without a class was its own root."""
    new = moved.select(F.col("node").alias("was"), F.col("root").alias("now"))
    alone = moved.join(classes.select("node"), "node", "left_anti").select("node", "root")
    return classes.join(new, classes["root"] == new["was"], "left").select("node", F.coalesce("now", "root").alias("root")).unionByName(alone)


def _rooted(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, tid, root) of each row with an id and words, written: the identity of its words, and of its class."""
    rows, classes = text_classes(docs, threshold)
    return cut(rows.join(classes, rows["tid"] == classes["node"], "left").select("doc_id", "tid", F.coalesce("root", "tid").alias("root")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of each row: the smallest doc_id of its class (of several texts with one doc_id, the smallest of all their classes)."""
    rooted = _rooted(docs, threshold)
    named = cut(rooted.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    found = rooted.join(named, "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and, as ``name``, the identity of each text's words (null for texts without words)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, d, o in pieces(batch.column(at)):
                e = Elements(d, o)
                tids = pa.array([t if n else None for t, n in zip(identities(e.identity).to_pylist(), e.counts.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, tids], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the row with the smallest doc_id (then by words), and all rows without an id or without words.

    Where a doc_id stands at several rows, rows are told apart by their words: different texts of one doc_id that are
    no near duplicates all stay; of rows with equal doc_id and words one stays, with the smallest text, and of wordless
    rows with equal doc_id and text one.
    """
    rooted = _rooted(docs, threshold)
    best = cut(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "tid")).alias("best")).select("best.doc_id", "best.tid"))
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).isEmpty():
        others = rooted.select("doc_id", "tid").join(best, ["doc_id", "tid"], "left_anti")
        return docs.join(others.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    tid = "tid"
    while tid in docs.columns:
        tid = f"_{tid}"
    named = cut(identified(docs, tid))
    c = lambda n: F.col("`" + n.replace("`", "``") + "`")
    apart = c("doc_id").isNull() | c(tid).isNull()
    best = best.select(F.col("doc_id").alias("_best_id"), F.col("tid").alias("_best_tid"))
    rows = named.filter(~apart).select("doc_id", c(tid).alias("_tid"), "text", F.struct(*[c(n) for n in docs.columns]).alias("_row"))
    rows = rows.join(best, (F.col("doc_id") == F.col("_best_id")) & (F.col("_tid") == F.col("_best_tid")), "left_semi")
    one = rows.groupBy("doc_id", "_tid").agg(F.min_by("_row", "text").alias("_row"))
    wordless = named.filter(c("doc_id").isNotNull() & c(tid).isNull()).dropDuplicates(["doc_id", "text"])
    nameless = named.filter(c("doc_id").isNull())
    out = one.select(*[F.col("_row")[n].alias(n) for n in docs.columns])
    for rest in (wordless, nameless):
        out = out.unionByName(rest.select(*[c(n) for n in docs.columns]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
