"""Latest rows, first rows, coverage, islands, quotas and other relational shapes.

All are one shuffle on their key or less: Spark pushes the ``row_number() <= n`` filters below the exchange
(WindowGroupLimit), and counts are combined before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def latest_per_key(df: DataFrame, key: str | Sequence[str], *order: str | Column) -> DataFrame:
    """The row with the greatest order in each key; ties need a further order column to be decided."""
    return top_per_key(df, key, 1, *[F.col(o).desc_nulls_last() if isinstance(o, str) else o for o in order])


def top_per_key(df: DataFrame, key: str | Sequence[str], n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each key in the given order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def keep_first(df: DataFrame, key: str | Sequence[str], ordinal: str) -> DataFrame:
    """The row of each key that came first; unlike dropDuplicates the choice is fixed."""
    return top_per_key(df, key, 1, F.col(ordinal).asc())


def latest_join(entities: DataFrame, history: DataFrame, key: str, history_key: str, *order: str, how: str = "left") -> DataFrame:
    """Each entity with its latest history row."""
    return entities.join(latest_per_key(history, history_key, *order), entities[key] == history[history_key], how)


def latest_semi(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose order is the greatest of their key, by a semi join on the aggregate: ties all stay."""
    newest = df.groupBy(key).agg(F.max(order).alias(order))
    return df.join(newest, [key, order], "left_semi")


def not_yet(df: DataFrame, done: DataFrame, on: str | Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows without a partner in ``done``."""
    left = df.join(done, on if isinstance(on, str) else list(on), "left_anti")
    return left if limit is None else left.limit(limit)


def orphans(df: DataFrame, parents: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not null and has no parent: violations of a foreign key."""
    keys = [on] if isinstance(on, str) else list(on)
    condition = None
    for k in keys:
        condition = F.col(k).isNotNull() if condition is None else condition & F.col(k).isNotNull()
    return df.filter(condition).join(parents, keys, "left_anti")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys without nulls that occur more than once, and how often: violations of a unique index."""
    present = None
    for k in key:
        present = F.col(k).isNotNull() if present is None else present & F.col(k).isNotNull()
    return df.filter(present).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def status_counts(df: DataFrame, status: str, known: Sequence[str]) -> DataFrame:
    """One row: a count for each known status, zero if absent, and one for all others."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in known]
    return df.agg(*counts, F.count_if(~F.coalesce(F.col(status).isin(*known), F.lit(False))).alias("other_statuses"))


def coverage(total: Column, processed: Column) -> list[Column]:
    """remaining and percent of a processed count."""
    return [F.greatest(total - processed, F.lit(0)).alias("remaining"), F.when(total > 0, F.round(100.0 * processed / total, 1)).otherwise(F.lit(0.0)).alias("percent")]


def interleave(df: DataFrame, source: str, *order: str | Column, limit: int = 10) -> DataFrame:
    """The first of each source in turn, then the second of each, and so on."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(source).orderBy(*order)))
    return ranked.orderBy("turn", source).limit(limit)


def failure_runs(df: DataFrame, key: str, failed: Column, *order: str) -> DataFrame:
    """``df`` with run_length: how many rows in a row have failed, this one included; 0 where it did not."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("__failed", failed.cast("int")).withColumn("__island", F.sum(1 - F.col("__failed")).over(w))
    inside = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn("run_length", F.sum("__failed").over(inside)).drop("__failed", "__island")


def before_trip(df: DataFrame, key: str, failed: Column, threshold: int, *order: str) -> DataFrame:
    """Rows that a circuit breaker lets through: those before the first run of ``threshold`` failures is complete, and the row that completes it marked as interrupted."""
    runs = failure_runs(df, key, failed, *order)
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tripped = runs.withColumn("__before", F.coalesce(F.max((F.col("run_length") >= threshold).cast("int")).over(w), F.lit(0)))
    return tripped.filter("__before = 0").withColumn("interrupted", F.col("run_length") >= threshold).drop("__before")


def within_quota(df: DataFrame, source: str, day: Column, limit: int, *order: str) -> DataFrame:
    """``df`` with used (how many of its source came that day, this one included) and allowed."""
    w = Window.partitionBy(source, day).orderBy(*order)
    return df.withColumn("used", F.row_number().over(w)).withColumn("allowed", F.col("used") <= limit)


def local_day(ts: Column, zone: Column, zones: Sequence[str]) -> Column:
    """The calendar day of a UTC time in a zone; UTC for zones that are not known."""
    return F.to_date(F.from_utc_timestamp(ts, F.when(zone.isin(*zones), zone).otherwise(F.lit("UTC"))))


def reserved_then_rest(df: DataFrame, key: str, reserved: Column, distinct_on: str, slots: int, *order: str) -> DataFrame:
    """``df`` with slot: up to ``slots`` reserved rows with distinct ``distinct_on`` come first, then all others in order."""
    first = F.row_number().over(Window.partitionBy(key, reserved, distinct_on).orderBy(*order))
    marked = df.withColumn("__head", reserved & (first == 1))
    nth = F.row_number().over(Window.partitionBy(key, "__head").orderBy(*order))
    marked = marked.withColumn("__seat", F.when(F.col("__head") & (nth <= slots), 0).otherwise(1))
    return marked.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("__seat", *order))).drop("__head", "__seat")


def delta(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """``df`` with the change of a value since the row before of its key."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def numbered(df: DataFrame, key: str | Sequence[str], name: str, *order: str) -> DataFrame:
    """``df`` with its rows numbered from 1 within each key: attempt numbers."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_total(df: DataFrame, region: str, *aggregates: Column) -> DataFrame:
    """Aggregates for each region and over all (region null)."""
    return df.groupingSets([[F.col(region)], []], region).agg(*aggregates)


def pending(selected: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Distinct selected keys that are not completed."""
    return selected.select(key).distinct().join(completed.select(key), key, "left_anti")


def manifest(ids: DataFrame, source: DataFrame, key: str, position: str) -> DataFrame:
    """Source rows of the wanted ids in their order; ``missing`` is true where there is none."""
    found = source.withColumn("__there", F.lit(True))
    return ids.join(found, key, "left").withColumn("missing", F.col("__there").isNull()).drop("__there").orderBy(position)


def active(df: DataFrame, current: str = "is_current", until: str = "valid_to") -> DataFrame:
    """Rows that are current and have no end."""
    return df.filter((F.col(current).cast("int") == 1) & F.col(until).isNull())


def page_after(df: DataFrame, key: str, after, n: int) -> DataFrame:
    """The next ``n`` rows by ``key`` after a given one: the key's bound is pushed to the scan, and no row before it is read again."""
    return df.filter(F.col(key) > F.lit(after)).orderBy(key).limit(n)


def home_first(link: Column, ending: str = ".si") -> list[Column]:
    """Sort keys that put links to hosts with an ending first; what follows them keeps its order."""
    return [urls.domain(link).endswith(ending).desc()]


def without_columns(df: DataFrame, *hidden: str) -> DataFrame:
    """All columns but the hidden ones; names that are not there do not matter."""
    return df.select(*[c for c in df.columns if c not in hidden])


def distinct_members(df: DataFrame, group: list[str], member: str, times: str, size: str) -> DataFrame:
    """A row for each distinct ``member`` of a group: how often it stands (``times``) and how many the group has (``size``).

    What a concatenation of distinct values says, without a cell that grows with its group.
    """
    each = df.groupBy(*group, member).agg(F.count("*").alias(times))
    sizes = each.groupBy(*[F.col(g).alias(f"of_{g}") for g in group]).agg(F.count(member).alias(size))
    same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in group]
    return each.join(sizes, same).drop(*[f"of_{g}" for g in group])
