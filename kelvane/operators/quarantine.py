"""Bad rows kept apart: one pass parses and checks every row, so one that fails stops no other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def checked(rows: DataFrame, parsed: Mapping[str, tuple[str, Column]], rules: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` with a column for each of ``parsed`` and ``errors``: array<struct<field, reason, raw>>, empty for good rows.

    ``parsed``: new column to (raw column, expression that is null where the raw value cannot be read). A raw value that
    is null or blank is missing, not wrong. ``rules``: reason to a test of parsed columns that must not be false.
    """
    out = rows.withColumns({name: F.when(F.trim(F.col(raw).cast("string")) != "", value) for name, (raw, value) in parsed.items()})
    error = lambda field, reason, raw: F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), raw.cast("string").alias("raw"))
    unread = [F.when(F.col(name).isNull() & (F.trim(F.col(raw).cast("string")) != ""), error(name, "UNREADABLE", F.col(raw))) for name, (raw, _) in parsed.items()]
    broken = [F.when(~test, error("", reason, F.lit(None))) for reason, test in (rules or {}).items()]
    return out.withColumn("errors", F.array_compact(F.array(*unread, *broken)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (without ``errors``) and the quarantine, of what ``checked`` gives: written once, read from two folders."""
    spark = rows.sparkSession
    path = shared_folder(spark, "quarantine")
    rows.withColumn("__bad", F.size("errors") > 0).write.partitionBy("__bad").parquet(path)
    kept = spark.read.schema(rows.withColumn("__bad", F.lit(True)).schema).parquet(path)
    return kept.filter("not __bad").drop("errors", "__bad"), kept.filter("__bad").drop("__bad")
