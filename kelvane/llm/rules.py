"""Quality rules learned as an ordered decision list.

Statistics of each whole text are counted in Arrow batches. Rules that reject are learned from labelled rows by
sequential covering: a conjunction of thresholds is grown on two thirds of the rows still uncovered, pruned on
the last third, and kept while it rejects precisely; the rows it covers then leave. The list is emitted as one
ordered Spark conditional expression over the statistics.

Edge cases: a null text counts as empty (no words, so it fails the base rule); an empty table gives an empty
result; without labels the list is empty and only the base rule rejects; rows are judged one by one, so repeated
rows get equal verdicts; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._spark import cut, share_of, table, wrapped
from ._text import Lines, Words, mix, per_doc, pieces, repeated, span_hashes

#: Counts per text. The first five are the query's; the rest only feed the learner.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_code_points", "n_lines", "n_upper", "n_digits", "n_bangs", "n_stops", "n_distinct")
#: Labelled documents that learning reads, about, at most: a share of them by the hash of doc_id.
MAX_LABELLED = 20_000

_KIND = np.zeros((6, 256), bool)
_KIND[0, list(b"#*$%&|<>")] = True
_KIND[1, 65:91] = True
_KIND[2, 48:58] = True
_KIND[3, list(b"!?")] = True
_KIND[4, list(b".,;:")] = True
_KIND[5] = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def count_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of each text, given the bytes of all and their offsets."""
    n = len(offsets) - 1
    words, lines = Words(data, offsets), Lines(data, offsets)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[offsets[1:]] - c[offsets[:-1]]

    begins, salt = _KIND[5][data], np.uint64(0x9E3779B97F4A7C15)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": total(begins & words.solid), "n_code_points": total(begins)}
    out |= {k: total(_KIND[i][data]) for i, k in enumerate(("n_symbols", "n_upper", "n_digits", "n_bangs", "n_stops"))}

    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.solid, out=filled[1:])
    full = filled[lines.ends] > filled[lines.starts]
    doc = lines.doc[full]
    keys = mix(span_hashes(data, lines.starts[full], lines.ends[full]) + doc.astype(np.uint64) * salt)
    out["n_lines"] = per_doc(doc, n)
    out["n_dup_lines"] = out["n_lines"] - per_doc(doc[np.unique(keys, return_index=True)[1]], n)

    hashes = words.hashes()
    at, windows = words.windows(hashes, 5)
    twice = at[repeated(mix(windows + words.doc[at].astype(np.uint64) * salt))]
    edge = np.zeros(len(hashes) + 6, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    out["n_repeat_words"] = per_doc(words.doc[np.cumsum(edge)[: len(hashes)] > 0], n)
    keys = mix(hashes + words.doc.astype(np.uint64) * salt)
    out["n_distinct"] = per_doc(words.doc[np.unique(keys, return_index=True)[1]], n)
    return out


def with_stats(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` and the STATS of its texts as long columns; ``df`` has none of those names. ``column`` holds the texts, or a struct with a field text."""
    at, inside = df.columns.index(column), isinstance(df.schema[column].dataType, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).field("text") if inside else batch.column(at)
            parts = [count_stats(d, o) for _, _, d, o in pieces(texts)]
            new = [pa.array(np.concatenate([p[s] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for s in STATS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *STATS])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(name, LongType()) for name in STATS)]))


def ratio_features() -> dict[str, Column]:
    """What the rules test: shares of the counts."""
    c = {s: F.col(s).cast("double") for s in STATS}
    share = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(F.lit(0.0))
    return {
        "symbols_per_char": share("n_symbols", "n_code_points"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_word_share": share("n_repeat_words", "n_words"), "mean_word_chars": share("word_chars", "n_words"),
        "upper_share": share("n_upper", "word_chars"), "digit_share": share("n_digits", "word_chars"),
        "bangs_per_word": share("n_bangs", "n_words"), "stops_per_word": share("n_stops", "n_words"),
        "distinct_share": share("n_distinct", "n_words"), "words_per_line": share("n_words", "n_lines"), "words": c["n_words"],
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


def _covered(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule])


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.95, max_rules: int = 12, max_tests: int = 4, cuts: int = 48, least: int = 3, seed: int = 7) -> list[list[Test]]:
    """Sequential covering of the bad rows: grow on two thirds, prune on one third, keep while precise on both."""
    rng, rules = np.random.default_rng(seed), []
    left = np.ones(len(bad), bool)
    grow = rng.random(len(bad)) < 2 / 3
    candidates = []
    for f, v in x.items():
        q = np.unique(np.quantile(v, np.linspace(0, 1, cuts))) if len(v) else []
        candidates += [Test(f, up, float(t)) for t in q for up in (True, False)]
    masks = [t.holds(x) for t in candidates]
    while len(rules) < max_rules and (left & bad).sum() >= least:
        now, rule, g = np.ones(len(bad), bool), [], left & grow
        while len(rule) < max_tests and (now & g & ~bad).any():
            p0, n0 = (now & g & bad).sum(), (now & g & ~bad).sum()
            base, best, chosen = np.log2(max(p0, 1) / max(p0 + n0, 1)), 0.0, None
            for i, m in enumerate(masks):
                c = now & g & m
                if p := (c & bad).sum():
                    gain = p * (np.log2(p / c.sum()) - base)
                    if gain > best + 1e-9:
                        best, chosen = gain, i
            if chosen is None:
                break
            rule.append(candidates[chosen])
            now &= masks[chosen]
        if not rule:
            break
        h = left & ~grow

        def worth(r: list[Test], h: np.ndarray = h) -> float:
            c = _covered(r, x) & h
            p = (c & bad).sum()
            return (2 * p - c.sum()) / max(c.sum(), 1) if p else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        c = _covered(rule, x) & left
        p = (c & bad).sum()
        if p < least or (p + 1) / (c.sum() + 2) < precision * (p + 1) / (p + 2) or worth(rule) < 2 * precision - 1 - 1e-9:
            break
        rules.append(rule)
        left &= ~c
    return rules


def verdict(rules: list[list[Test]], features: dict[str, Column]) -> Column:
    """True for a text that no rule rejects: WHEN rule THEN false ... ELSE true."""
    out = None
    for rule in rules:
        test = None
        for t in rule:
            one = features[t.feature] >= F.lit(t.threshold) if t.above else features[t.feature] < F.lit(t.threshold)
            test = one if test is None else test & one
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def known_labels(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id and quality of about ``most`` labelled documents at most."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return share_of(known, "doc_id", most)


def fit(stats: DataFrame) -> list[list[Test]]:
    """Learn the list from rows of doc_id, quality and the STATS, a bounded number."""
    got = stats.select("doc_id", "quality", *[v.alias(k) for k, v in ratio_features().items()]).toPandas().sort_values(["doc_id", *ratio_features()])
    x = {k: got[k].to_numpy(np.float64) for k in ratio_features()}
    return learn_list(x, got["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, the STATS, base_failed and kept for each row."""
    stats = cut(with_stats(docs.select("doc_id", "text")).drop("text"))
    rules = fit(stats.join(known_labels(labels, max_labelled), "doc_id"))
    failed = base_failed()
    return stats.select("*", failed.alias("base_failed"), (~failed & verdict(rules, ratio_features())).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs``, with all their columns, that neither the base rule nor the learned list rejects."""
    known = F.broadcast(known_labels(labels, max_labelled))  # about max_labelled rows at most
    rules = fit(with_stats(docs.select("doc_id", "text").join(known, "doc_id")))
    return with_stats(wrapped(docs), "row").filter(~base_failed() & verdict(rules, ratio_features())).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *STATS[:5], "base_failed", "kept")
