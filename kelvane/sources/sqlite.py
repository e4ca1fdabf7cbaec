"""Reading SQLite files as a Spark data source, split by ranges of a row id and opened read-only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", "4")), schema

    def _open(self):  # noqa: ANN202
        import sqlite3
        from pathlib import Path

        return sqlite3.connect(Path(self.path).resolve().as_uri() + "?mode=ro", uri=True)

    def partitions(self) -> list[Range]:
        name = self.table.replace('"', '""')
        with self._open() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{name}"').fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        quoted = lambda n: '"' + n.replace('"', '""') + '"'
        columns = ", ".join(quoted(f.name) for f in self.schema)
        with self._open() as db:
            yield from db.execute(f"SELECT {columns} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteSource(DataSource):
    """``spark.dataSource.register(SqliteSource)``, then ``spark.read.format("kelvane_sqlite").option("path", ...).option("table", ...)`` with a schema."""

    @classmethod
    def name(cls) -> str:
        return "kelvane_sqlite"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)
