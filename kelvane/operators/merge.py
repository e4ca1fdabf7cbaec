"""Merges of a batch into a snapshot. Each returns the new snapshot; writing it (``sources.publish``) is the transaction.

Parquet tables have no MERGE, so a merge is one full outer join on the key, or a union with one aggregate. Where the
order of arrival decides, it is a column (``seq``): file and row order are not reproducible on a cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import top_per_key


def _both(target: DataFrame, source: DataFrame, key: Sequence[str]) -> tuple[DataFrame, Column, Column, list[Column]]:
    """Full outer join on null-safe keys; whether either side is there; the keys."""
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns], F.lit(True).alias("t__there"))
    s = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], F.lit(True).alias("s__there"))
    on = None
    for k in key:
        one = F.col(f"t_{k}").eqNullSafe(F.col(f"s_{k}"))
        on = one if on is None else on & one
    joined = t.join(s, on, "full_outer")
    there, here = F.col("t__there").isNotNull(), F.col("s__there").isNotNull()
    return joined, there, here, [F.when(here, F.col(f"s_{k}")).otherwise(F.col(f"t_{k}")).alias(k) for k in key]


def overwrite_upsert(target: DataFrame, source: DataFrame, key: Sequence[str], counters: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Source rows replace target rows; ``counters`` are added up, and ``keep`` columns stay as they first were."""
    joined, there, here, keys = _both(target, source, key)
    out = []
    for c in (c for c in target.columns if c not in key):
        t, s = F.col(f"t_{c}"), F.col(f"s_{c}")
        value = F.coalesce(t, F.lit(0)) + F.coalesce(s, F.lit(0)) if c in counters else F.when(there, t).otherwise(s) if c in keep else F.when(here, s).otherwise(t)
        out.append(value.alias(c))
    return joined.select(*keys, *out).select(*target.columns)


def coalescing_upsert(target: DataFrame, source: DataFrame, key: Sequence[str], first_wins: Sequence[str] = ()) -> DataFrame:
    """New values that are not null replace old ones; for ``first_wins`` columns old ones stay."""
    joined, _, _, keys = _both(target, source, key)
    pick = lambda c: F.coalesce(F.col(f"t_{c}"), F.col(f"s_{c}")) if c in first_wins else F.coalesce(F.col(f"s_{c}"), F.col(f"t_{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in target.columns if c not in key]).select(*target.columns)


def fill_blanks(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Only blank (null or '') target values are filled; ``conflicts`` lists the columns that differ and were not."""
    joined, _, _, keys = _both(target, source, key)
    out, clashes = [], []
    for c, kind in target.dtypes:
        if c in key:
            continue
        t, s = F.col(f"t_{c}"), F.col(f"s_{c}")
        if kind == "string":
            t, s = F.nullif(t, F.lit("")), F.nullif(s, F.lit(""))
        out.append(F.coalesce(t, s).alias(c))
        clashes.append(F.when(t != s, F.lit(c)))
    return joined.select(*keys, *out, F.array_compact(F.array(*clashes)).alias("conflicts")).select(*target.columns, "conflicts")


def insert_new(target: DataFrame, source: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Target and those source rows whose key it lacks, one for each key: insert or ignore. Without ``order`` the least row of a key is taken, by its columns in turn."""
    key = list(key)
    fresh = top_per_key(source, key, 1, *([F.col(order).asc()] if order else [F.col(c).asc() for c in source.columns if c not in key] or [F.lit(1)]))
    return target.unionByName(fresh.join(target.select(key), key, "left_anti").select(*target.columns))


def replace_rows(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Source rows, and target rows whose key they lack: insert or replace."""
    key = list(key)
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def insert_active(tasks: DataFrame, new: DataFrame, key: Sequence[str], active: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """Tasks with those new rows that have no active row of the same key (nulls equal nulls); and the new rows that were turned away."""
    joined = new.alias("n").join(tasks.filter(active).select(*[F.col(k).alias(f"a_{k}") for k in key]).distinct(), [F.col(f"n.{k}").eqNullSafe(F.col(f"a_{k}")) for k in key], "left_anti")
    first = top_per_key(joined.select("n.*"), list(key), 1, F.col(order).asc())
    return tasks.unionByName(first, allowMissingColumns=True), new.join(first.select(order), order, "left_anti")


def back_fill(records: DataFrame, found: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """``records`` with a null column filled from ``found`` (key, column)."""
    other = found.groupBy(*key).agg(F.min(column).alias("__found"))
    return records.join(other, list(key), "left").withColumn(column, F.coalesce(F.col(column), F.col("__found"))).drop("__found").select(*records.columns)


def archive(records: DataFrame, batch: DataFrame, coordinates: Sequence[str], hash_column: str) -> DataFrame:
    """Raw records with those of a batch that are new by coordinates and content hash."""
    return insert_new(records, batch, [*coordinates, hash_column])


def append_observations(observations: DataFrame, batch: DataFrame, with_record: Sequence[str], without_record: Sequence[str], record: str = "source_record_id", order: str = "seq") -> DataFrame:
    """Observations with new ones: those of a raw record are known by ``with_record``, others by their full value."""
    out = insert_null_safe(observations, batch.filter(F.col(record).isNotNull()), with_record, order)
    return insert_null_safe(out, batch.filter(F.col(record).isNull()), without_record, order)


def insert_null_safe(target: DataFrame, source: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """``insert_new`` with nulls in keys equal to one another. Both sides are ranked together, so each row is moved once."""
    new = source.select(*target.columns, F.lit(True).alias("__new"), F.col(order).alias("__order"))
    rows = target.withColumn("__new", F.lit(False)).unionByName(new, allowMissingColumns=True)
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy("__new", F.col("__order").asc())))
    return ranked.filter("not __new or __rank = 1").select(*target.columns)


def current_facts(observations: DataFrame, entity: str = "company_id", fact: str = "fact_key", year: str = "value_year", seq: str = "seq") -> DataFrame:
    """The fact ingested last for each (entity, fact, year), whatever it says was observed when; a re-observation counts as ingested again."""
    rest = [c for c in observations.columns if c not in (entity, fact, year)]
    latest = observations.groupBy(entity, fact, year).agg(F.max_by(F.struct(*rest), seq).alias("__last"))
    return latest.select(entity, fact, year, "__last.*").select(*observations.columns)


def pivot_facts(current: DataFrame, entity: str, fact: str, facts: Sequence[str], value: str) -> DataFrame:
    """One row for each entity with a column for each of the given facts."""
    return current.groupBy(entity).pivot(fact, list(facts)).agg(F.first(value))


def link_with_fallback(target: DataFrame, source: DataFrame, first: str, then: Sequence[str]) -> DataFrame:
    """Source rows with the id of the row they update: matched by ``first`` where both have it, else by the natural key ``then``."""
    a = target.filter(F.col(first).isNotNull()).groupBy(first).agg(F.min("id").alias("__a"))
    b = target.groupBy(*then).agg(F.min("id").alias("__b"))
    b = b.select(*[F.col(c).alias(f"b_{c}") for c in then], "__b")
    joined = source.join(a, first, "left").join(b, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in then], "left")
    return joined.withColumn("matched_id", F.coalesce("__a", "__b")).select(*source.columns, "matched_id")


def append_attempt(history: DataFrame, results: DataFrame, key: str, seq: str) -> DataFrame:
    """History with results appended, each counting one attempt more than its key's latest row."""
    from .relational import latest_per_key

    last = latest_per_key(history, key, seq).select(key, F.col("attempt_count").alias("__n"))
    rows = results.join(last, key, "left").withColumn("attempt_count", F.coalesce("__n", F.lit(0)) + 1).drop("__n")
    return history.unionByName(rows, allowMissingColumns=True)


def demote(rows: DataFrame, ids: DataFrame, key: str, status: str, to: str, cap: int = 60) -> DataFrame:
    """Rows of the given ids get another status and a confidence of ``cap`` at most; null stays null."""
    from ..functions.ids import at_most

    hit = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    out = rows.join(hit, key, "left")
    there = F.coalesce("__hit", F.lit(False))
    return out.withColumns({status: F.when(there, to).otherwise(F.col(status)), "confidence": F.when(there, at_most(F.col("confidence"), cap)).otherwise(F.col("confidence"))}).select(*rows.columns)


def changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Audit rows: (key, action, before, after) as JSON for what was added, removed or changed."""
    pack = lambda df, p: df.select(*[F.col(k) for k in key], F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(p))
    both = pack(before, "before").join(pack(after, "after"), list(key), "full_outer").filter("not before <=> after")
    return both.withColumn("action", F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE"))


def add_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two schema versions; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)
