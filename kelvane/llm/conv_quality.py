"""Quality scores from a byte-level convolutional network in numpy.

Filters eight bytes wide move over the whole text four bytes at a time; their greatest responses over overlapping
chunks of 1,024 bytes (a new one every 512) are pooled, mean and maximum over the chunks of a text feed a small
dense layer, and a logistic unit gives one probability. A filter is a table of one value for each position and
byte value, so a response is a sum of eight table rows. The network is trained here, by back-propagation on the
driver, on a bounded sample of labelled rows; only bytes of the text are ever inputs.

Edge cases: a null text is empty; an empty text is all padding and gets the score of that; without labelled rows
of both kinds the untrained network's score is that of the share of good labels (one half if none); repeated rows
get equal scores; a null doc_id is not held out; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, share_of, table
from ._text import bytes_of, pieces

WIDTH, STRIDE, BLOCK, FILTERS, HIDDEN = 8, 4, 512, 24, 16
#: Zeros before each text: what a filter reaches beyond its block.
EDGE = WIDTH - STRIDE
#: Labelled texts and their bytes that training reads, about, at most: a share of them by the hash of doc_id. Texts
#: above MAX_TEXT bytes are scored, but not trained on.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_TEXT = 5000, 40_000_000, 1 << 20
THRESHOLD = 0.7


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text after EDGE zeros, padded with zeros to whole blocks (and WIDTH more at the very end), and the first block of each.

    A filter at the last place of a text's last block reaches into the next text's zeros only.
    """
    lengths = np.diff(offsets)
    count = -(-(lengths + EDGE) // BLOCK)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK + EDGE - offsets[:-1], lengths)] = data
    return out, first


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    dense: np.ndarray  # 2 FILTERS x HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @staticmethod
    def fresh(seed: int = 11, prior: float = 0.5) -> Network:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        filters[:, 0] = 0  # padding
        prior = min(max(prior, 0.02), 0.98)
        return Network(filters, rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), float(np.log(prior / (1 - prior))))

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Of each filter at each position: blocks x positions x FILTERS."""
        n = (len(padded) - WIDTH) // STRIDE
        total = self.filters[0][padded[0 : n * STRIDE : STRIDE]]
        part = np.empty_like(total)
        for k in range(1, WIDTH):
            np.take(self.filters[k], padded[k : k + n * STRIDE : STRIDE], axis=0, out=part, mode="clip")
            total += part
        return total.reshape(-1, BLOCK // STRIDE, FILTERS)

    def block_peaks(self, padded: np.ndarray) -> np.ndarray:
        """The greatest response in each block, at least 0; computed over runs of blocks, so that memory stays small."""
        found, step = [], 128 * BLOCK
        for i in range(0, len(padded) - WIDTH, step):
            found.append(self.responses(padded[i : min(i + step, len(padded) - WIDTH) + WIDTH]).max(axis=1))
        return np.maximum(np.concatenate(found), 0) if found else np.zeros((0, FILTERS), np.float32)

    def pooled(self, peaks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of two blocks each (of one, where a text has only one), their first index by text, and mean and maximum over them."""
        count = np.diff(first)
        last = np.zeros(len(peaks), bool)
        last[first[1:] - 1] = True
        alone = last.copy()
        alone[first[:-1][count == 1]] = False  # the last of several begins no chunk
        chunk = peaks.copy()
        chunk[:-1][~last[:-1]] = np.maximum(peaks[:-1], peaks[1:])[~last[:-1]]
        chunk, at = chunk[~alone], np.concatenate([[0], np.cumsum(np.maximum(count - 1, 1))])
        mean = np.add.reduceat(chunk, at[:-1], axis=0) / np.diff(at)[:, None]
        return chunk, at, np.hstack([mean, np.maximum.reduceat(chunk, at[:-1], axis=0)])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        padded, first = blocks_of(data, offsets)
        z = self.pooled(self.block_peaks(padded), first)[2]
        # einsum adds in one order whatever the number of texts, so equal texts get equal scores in any company
        z = np.einsum("ij,j->i", np.tanh(np.einsum("ij,jk->ik", z, self.dense.astype(np.float64)) + self.dense_bias), self.out.astype(np.float64)) + self.out_bias
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: pa.Array, good: np.ndarray, *, epochs: int = 14, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Fit a network by Adam on the logistic loss."""
    net, rng = Network.fresh(seed, good.mean() if len(good) else 0.5), np.random.default_rng(seed)
    if len(np.unique(good)) < 2:
        return net
    data, offsets = bytes_of(texts)
    names = ("filters", "dense", "dense_bias", "out", "out_bias")
    m, v, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    steps = epochs * -(-len(good) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(good))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            part = [data[offsets[r] : offsets[r + 1]] for r in rows]
            padded, first = blocks_of(np.concatenate(part), np.concatenate([[0], np.cumsum([len(p) for p in part])]))
            peaks, where = [], []
            for a in range(0, len(padded) - WIDTH, 256 * BLOCK):
                r = net.responses(padded[a : min(a + 256 * BLOCK, len(padded) - WIDTH) + WIDTH])
                w = r.argmax(axis=1)
                where.append(w)
                peaks.append(np.take_along_axis(r, w[:, None], 1)[:, 0])
            raw, where = np.concatenate(peaks), np.concatenate(where)
            peaks = np.maximum(raw, 0)
            chunk, at, x = net.pooled(peaks, first)
            h = np.tanh(x @ net.dense + net.dense_bias)
            p = 1 / (1 + np.exp(-(h @ net.out + net.out_bias)))
            d = ((p - good[rows]) / len(rows)).astype(np.float32)
            dh = np.outer(d, net.out) * (1 - h * h)
            dx, count = dh @ net.dense.T, np.diff(at)
            doc = np.repeat(np.arange(len(rows)), count)
            top = chunk == x[doc, FILTERS:]
            dchunk = dx[doc, :FILTERS] / count[doc][:, None] + dx[doc, FILTERS:] * top
            # a chunk's gradient goes to the greater of its two blocks
            n_blocks = np.diff(first)
            begin = np.concatenate([np.arange(a, max(b - 1, a + 1)) for a, b in zip(first[:-1], first[1:], strict=True)])
            second = np.minimum(begin + 1, np.repeat(first[1:] - 1, np.maximum(n_blocks - 1, 1)))
            left = peaks[begin] >= peaks[second]
            dpeak = np.zeros_like(peaks)
            np.add.at(dpeak, begin, dchunk * left)
            np.add.at(dpeak, second, dchunk * ~left)
            dpeak *= raw > 0
            base = (np.arange(len(peaks)) * BLOCK)[:, None] + where * STRIDE
            dfilters, f = np.zeros((WIDTH, 256, FILTERS), np.float32), np.broadcast_to(np.arange(FILTERS), base.shape)
            for k in range(WIDTH):
                dfilters[k] = np.bincount((padded[base + k].astype(np.int64) * FILTERS + f).ravel(), dpeak.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            dfilters[:, 0] = 0
            grads = {"filters": dfilters, "dense": x.T @ dh, "dense_bias": dh.sum(0), "out": h.T @ d, "out_bias": d.sum()}
            t += 1
            now = rate * min(1, 4 * (1 - (t - 1) / steps))
            for k in names:
                g = grads[k] + (decay * getattr(net, k) if k != "out_bias" else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                step = now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - (step if k == "out_bias" else np.float32(1) * step.astype(np.float32)))
    return net


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Network:
    """Train on labelled rows of ``docs`` that are not held out, about ``most`` of them at most."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = F.broadcast(share_of(known, "doc_id", most))  # about most rows at most
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    got = docs.filter("doc_id is not null").join(ids, "doc_id").filter(size <= MAX_TEXT).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = cut(got.withColumn("size", size))
    total = got.agg(F.sum("size")).first()[0] or 0
    if total > MAX_TRAIN_BYTES:
        got = got.filter(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 31)) < F.lit(int(MAX_TRAIN_BYTES / total * (1 << 31))))
    rows = got.toArrow().sort_by("doc_id")  # about MAX_TRAIN_BYTES at most
    return train(rows.column("text").combine_chunks(), np.asarray(rows.column("quality"), np.float32))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [net.score(d, o) for _, _, d, o in pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
