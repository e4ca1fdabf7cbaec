"""Declarative keyword rules: additive scores with their matches, and the family-business classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (category, score, keyword) of the family rules, and the thresholds; fixed values.
FAMILY_RULES = (
    ("explicit", 100, "družinsko podjetje"), ("explicit", 100, "družinsko vodeno podjetje"), ("explicit", 100, "family business"),
    ("explicit", 100, "family-owned"), ("explicit", 100, "family owned"), ("explicit", 100, "family-run"),
    ("generation", 70, "druga generacija"), ("generation", 70, "tretja generacija"), ("generation", 70, "second generation"), ("generation", 70, "third generation"),
    ("founder", 30, "ustanovil"), ("founder", 30, "ustanovila"), ("founder", 30, "founded by"), ("founder", 30, "our founder"),
    ("family_words", 50, "naša družina"), ("family_words", 50, "družinska tradicija"), ("family_words", 50, "our family"), ("family_words", 50, "family tradition"),
)
EXPLICIT, LIKELY = 100, 70


def matches(text: Column, rules: Sequence[tuple[str, int, str]]) -> Column:
    """array<struct<category, keyword, score>> of the rules whose keyword stands in the text. The rule list is a literal: no join."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda c, s, k: F.when(low.contains(k.lower()), F.struct(F.lit(c).alias("category"), F.lit(k).alias("keyword"), F.lit(s).alias("score")))
    return F.array_compact(F.array(*[hit(*r) for r in rules]))


def score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda t, m: t + m["score"])


def family_status(points: Column) -> Column:
    return F.when(points >= EXPLICIT, "EXPLICIT").when(points >= LIKELY, "LIKELY").otherwise("UNKNOWN")


def with_family(df: DataFrame, text: str) -> DataFrame:
    """``df`` with matches, score and family_status of a text."""
    return df.withColumn("matches", matches(F.col(text), FAMILY_RULES)).withColumn("score", score(F.col("matches"))).withColumn("family_status", family_status(F.col("score")))


#: Bytes of keywords that one automaton is made of (it takes some forty times as many), and so that a task holds; more
#: rules are taken in several passes.
AUTOMATON_BYTES = 4 << 20
#: Hits that a task holds before it hands them on, about.
HITS = 1 << 16


def rule_parts(rules: DataFrame, most: int = AUTOMATON_BYTES) -> list[DataFrame]:
    """The rules in parts of about ``most`` bytes of keywords, by hash; usually one."""
    size = rules.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    parts = -(-size // most) or 1
    return [rules] if parts == 1 else [rules.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == k) for k in range(parts)]


def rule_hits(df: DataFrame, key: str, text: str, rules: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, category, keyword, score) of the rules whose keyword stands in a text, whatever its case.

    The keywords of a part make one Aho-Corasick automaton, which reads a text once and meets all that stand in it: the
    cost of a text does not depend on the number of rules. Lower case is Spark's on both sides; blank keywords match
    every text, as an empty string stands in any.
    """
    low = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    kind = df.schema[key].dataType.simpleString()
    out = None
    for part in rule_parts(rules.select("category", "keyword", F.col("score").cast("int").alias("score")), most):
        held = df.sparkSession.sparkContext.broadcast(part.select("category", "keyword", "score", F.lower("keyword").alias("low")).toArrow().combine_chunks())  # bounded by ``most``

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            import ahocorasick

            rules_, first, same = held.value.select(["category", "keyword", "score"]), {}, {}
            for k, word in enumerate(held.value.column("low").to_pylist()):
                if first.setdefault(word, k) != k:
                    same.setdefault(first[word], []).append(k)
            blank, machine = first.pop("", None), ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for word, k in first.items():
                machine.add_word(word, k)
            del first
            machine.make_automaton()

            def hits_of(keys: pa.Array, at: list[int], hit: list[int]) -> Iterator[pa.RecordBatch]:
                found = rules_.take(pa.array(hit, pa.int64())).combine_chunks()
                columns = [found.column(c).combine_chunks() for c in range(3)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=[key, "category", "keyword", "score"])

            for batch in batches:
                at, hit = [], []
                for i, body in enumerate(batch.column(1)):
                    found = {k for _, k in machine.iter(body.as_py())} if len(machine) else set()
                    if blank is not None:
                        found.add(blank)
                    found |= {k for f in found if f in same for k in same[f]}
                    at += [i] * len(found)
                    hit += sorted(found)
                    if len(at) >= HITS:
                        yield from hits_of(batch.column(0), at, hit)
                        at, hit = [], []
                yield from hits_of(batch.column(0), at, hit)

        hits = low.mapInArrow(scan, f"`{key}` {kind}, category string, keyword string, score int")
        out = hits if out is None else out.unionByName(hits)
    return out


def score_by_rules(df: DataFrame, key: str, text: str, rules: DataFrame, most: int = AUTOMATON_BYTES) -> DataFrame:
    """One row for each key: the sum of the scores of the rules (category, score, keyword) that match, and how many do. ``key`` is unique."""
    found = rule_hits(df, key, text, rules, most).groupBy(key).agg(F.sum("score").alias("score"), F.count("*").alias("n_matches"))
    zero = F.lit(0).cast("long")
    return df.select(key).join(found, key, "left").select(key, F.coalesce("score", zero).alias("score"), F.coalesce("n_matches", zero).alias("n_matches"))


def load_rules(path: str | Path) -> list[tuple[str, int, str]]:
    """Rules of a YAML file: rules.<category>.score and .keywords."""
    import yaml

    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return [(name, int(rule["score"]), word) for name, rule in config["rules"].items() for word in rule["keywords"]]
