"""Session helpers shared by the operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset and all run in one process, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="kelvane-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_WRITTEN: list[str] = []  # tables of this process that no run owns
_OWNER: ContextVar[list[str]] = ContextVar("tables that are written now", default=_WRITTEN)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and sizes become known. The table goes when the process ends, or with its run."""
    path = f"{shared_dir(df.sparkSession)}/kelvane/{uuid.uuid4().hex}"
    if df.sparkSession not in _ENDING:
        _ENDING.append(df.sparkSession)
        atexit.register(_drop, df.sparkSession, _WRITTEN)
    _OWNER.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ENDING: list[SparkSession] = []


class Run:
    """A run of steps, each of which is written before the next one reads it. What a step writes on its way goes when the step is written, and the step's table when the next one is.

    Only tables that are written inside ``settled`` belong to the run: those of other runs, in other threads too, and of DataFrames that were made outside stay.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.last = spark, []

    def settled(self, make: Callable[[], DataFrame]) -> DataFrame:
        mine: list[str] = []
        token = _OWNER.set(mine)
        try:
            out = cut(make())
            kept = mine.pop()
            _drop(self.spark, mine + self.last)
            for path in self.last:
                _WRITTEN.remove(path)
            _WRITTEN.append(kept)
            self.last, mine = [kept], []
            return out
        finally:
            _OWNER.reset(token)
            _WRITTEN.extend(mine)  # of a step that failed


def _drop(spark: SparkSession, paths: list[str]) -> None:
    with contextlib.suppress(Exception):  # at the end of a process the session may be gone before its tables
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """All columns of ``docs`` as one, named row, and copies of ``columns``: no name of ours can meet one of theirs."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"), *columns)


def text_words(column: str = "text"):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def share_of(df: DataFrame, key, most: int, rows: int | None = None) -> DataFrame:
    """Rows whose hashed ``key`` is below a share that leaves about ``most`` of them (all, if there are fewer): the same ones each time."""
    rows = df.count() if rows is None else rows
    return df if rows <= most else df.filter(F.pmod(F.xxhash64(F.lit(23), key), F.lit(1 << 31)) < F.lit(int(most / rows * (1 << 31))))


def by_part(df: DataFrame, parts: int, func: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``func`` over all rows of each ``part`` (0 to parts - 1): a part is a task of its own, so none waits behind another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from func(pa.Table.from_batches(held)).to_batches()

    return df.repartitionById(parts, "part").mapInArrow(run, schema)
