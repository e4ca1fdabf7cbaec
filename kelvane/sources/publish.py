"""Snapshots: a table is a folder of versions and a pointer to the current one.

A version is written whole into a folder of its own, checked, and then named by a marker file, which a store creates
atomically and which holds the folder's name; a reader takes the highest named version. So writers never touch one
another's files, and a failed one leaves an unnamed folder that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/{self._folder(known[-1] if version is None else version)}") if known else None

    def _folder(self, version: int) -> str:
        return self.spark.read.text(f"{self.path}/v{version}.done").first().value

    def publish(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Write the next version; ``check`` raises to reject what was written. Only one of two writers of a version wins."""
        n, folder = (self.versions() or [0])[-1] + 1, uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{folder}")
        if check:
            check(self.spark.read.parquet(f"{self.path}/{folder}"))
        fs, path = self._fs()
        marker = fs.create(path(f"{self.path}/v{n}.done"), False)  # fails where another writer was first
        marker.write(bytearray(folder.encode()))
        marker.close()
        return n
