"""Aggregates that remember their files: partial results are kept by file and fingerprint, and only changed files are read again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


class Partials:
    """Aggregates over the Parquet files of a folder.

    ``group`` are the grouping columns; ``measures`` map a name to (partial aggregate of a file, how partials merge: sum,
    min or max). A file is known by its path, size and time of modification.
    """

    def __init__(self, spark: SparkSession, path: str, source: str, group: Sequence[str], measures: Mapping[str, tuple[Column, str]], buckets: int = 16) -> None:
        self.catalog, self.source, self.group, self.measures, self.buckets = Catalog(spark, path), source, list(group), dict(measures), buckets

    def files(self) -> DataFrame:
        """(file, print) of what is there now, from metadata alone."""
        rows = self.catalog.spark.read.format("binaryFile").load(self.source)
        meta = lambda n: F.col(f"_metadata.{n}")
        return rows.select(meta("file_path").alias("file"), F.concat_ws("/", meta("file_size").cast("string"), F.unix_micros(meta("file_modification_time")).cast("string")).alias("print"))

    def update(self) -> list[str]:
        """Read the files that are new or have changed, keep their partials, and give their names."""
        change, now = self.catalog.begin(), self.files()
        fresh = now if "partials" not in change.tables else now.join(change.read("partials").select("file", "print").distinct(), ["file", "print"], "left_anti")
        changed = {r.file: r.print for r in fresh.collect()}  # names of files to be read, which the driver lists in any case
        if changed:
            rows = self.catalog.spark.read.parquet(*changed)
            found = rows.groupBy(F.col("_metadata.file_path").alias("file"), *self.group).agg(*[a.alias(n) for n, (a, _) in self.measures.items()])
            prints = self.catalog.spark.createDataFrame(list(changed.items()), "file string, print string")
            found = prints.join(found, "file")
            if "partials" in change.tables:
                change.merge("partials", found, lambda old, new: old.join(prints.select("file"), "file", "left_anti").unionByName(new))
            else:
                change.replace("partials", found, ["file"], self.buckets)
            change.commit()
        return sorted(changed)

    def read(self) -> DataFrame:
        """The aggregates over the files that are there now; those of ``update`` before it."""
        kept = self.catalog.read("partials").join(self.files(), ["file", "print"], "left_semi")
        return kept.groupBy(*self.group).agg(*[MERGED[how](n).alias(n) for n, (_, how) in self.measures.items()])
