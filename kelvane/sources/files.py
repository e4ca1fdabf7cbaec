"""Delimited files and JSON reports, read and written by Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = T.StructType([
    T.StructField("selected_ids", T.ArrayType(T.LongType())), T.StructField("complete", T.BooleanType()), T.StructField("interrupted", T.BooleanType()),
    T.StructField("circuit_breaker", T.StructType([T.StructField("triggered", T.BooleanType())])), T.StructField("rule_version", T.StringType()),
    T.StructField("started_at", T.StringType()), T.StructField("finished_at", T.StringType()),
    T.StructField("companies", T.ArrayType(T.StructType([T.StructField("company_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("emails", T.LongType()), T.StructField("http_requests", T.LongType()), T.StructField("error", T.StringType())]))),
])


def column_for(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    """The column that the first matching alias names, whatever its case and blanks."""
    plain = lambda s: "".join(s.lower().split())
    by = {plain(c): c for c in reversed(columns)}
    return next((by[plain(a)] for a in aliases if plain(a) in by), None)


def read_delimited(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A delimited file with a header, all columns text, rows without any value dropped; ``aliases`` renames columns found by any of their names."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    for name, names in (aliases or {}).items():
        found = column_for(df.columns, [name, *names])
        if found and found != name:
            df = df.withColumnRenamed(found, name)
    return df.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in df.columns]).na.drop("all")


def read_reports(spark: SparkSession, paths: str | Sequence[str], most_bytes: int = 32_000_000) -> DataFrame:
    """One row per report file with its parsed content, its state and whether it is valid; oversize files are left out by their metadata."""
    from ..operators.jobs import report_state, report_valid

    df = spark.read.schema(REPORT).json(paths if isinstance(paths, str) else list(paths), multiLine=True)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("__size"), F.col("_metadata.file_modification_time").alias("modified")).filter(F.col("__size") <= most_bytes).drop("__size")
    completed = F.transform("companies", lambda c: c["company_id"])
    return df.withColumn("completed_ids", completed).withColumn("state", report_state(F.col("circuit_breaker.triggered"), F.col("complete"), F.col("interrupted"))).withColumn("valid", report_valid(F.col("selected_ids"), completed))


def newest(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.col("modified").desc(), "file").limit(n)


def snapshot_digest(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file under a path: equal before and after means that a frozen source did not change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def export_csv(df: DataFrame, path: str, single: bool = False, bom: bool = True) -> None:
    """CSV with a header; with ``bom`` the first column's name carries the byte-order mark that spreadsheet programs look for.

    Files are written in parallel; ``single`` is for reports that are small by nature.
    """
    out = df.coalesce(1) if single else df
    if bom and df.columns:
        out = out.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    out.write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def export_sheets(df: DataFrame, path: str, filled: str) -> None:
    """Three folders: all rows, those with a value in ``filled``, and those without."""
    there = F.col(filled).isNotNull() & (F.col(filled) != "")
    for name, part in (("all", df), ("with", df.filter(there)), ("without", df.filter(~there))):
        export_csv(part, f"{path}/{name}")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
