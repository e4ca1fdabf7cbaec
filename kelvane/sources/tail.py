"""The ends of log files: the last bytes of each, by seek, of regular files inside a root folder only."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

LAST, NEWEST, PER_TASK = 64 * 1024, 500, 16


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


def confined(root: str, path: str) -> bool:
    """A regular file whose real place is inside the root's: no link leads out."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return os.path.isfile(real) and os.path.commonpath([real, base]) == base


def last_lines(path: str, size: int, most: int) -> tuple[int, list[tuple[int, str]]]:
    """Where reading began, and (offset, line) of the whole lines in the last ``most`` bytes of a file that had ``size``."""
    begin = max(0, size - most)
    with open(path, "rb") as f:
        f.seek(max(0, begin - 1))
        data = f.read(size - max(0, begin - 1))
    if begin:  # the byte before tells whether a line begins here
        cut = data.find(b"\n") + 1
        if not cut:
            return begin, []
        begin, data = begin - 1 + cut, data[cut:]
    out, at = [], begin
    for line in data.split(b"\n")[: None if data and not data.endswith(b"\n") else -1]:
        out.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return begin, out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options.get("root") or options["path"]
        self.at = options.get("path") or self.root
        self.most, self.newest, self.suffix = int(options.get("bytes", LAST)), int(options.get("newest", NEWEST)), options.get("suffix", "")
        if os.path.commonpath([os.path.realpath(self.at), os.path.realpath(self.root)]) != os.path.realpath(self.root):
            raise ValueError("path must lie inside root")

    def partitions(self) -> list[InputPartition]:
        """The newest files, by their metadata alone, some to a task."""
        found = []
        for folder, _, names in os.walk(self.at):
            for name in names:
                path = os.path.join(folder, name)
                if name.endswith(self.suffix) and confined(self.root, path):
                    s = os.stat(path)
                    found.append((-s.st_mtime_ns, path, s.st_size))
        files = [(p, n) for _, p, n in sorted(found)[: self.newest]]
        return [_Files(files[i : i + PER_TASK]) for i in range(0, len(files), PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size in partition.files:
            if confined(self.root, path):  # it may have become a link since
                for at, line in last_lines(path, size, self.most)[1]:
                    yield os.path.relpath(path, self.root), size, at, line


class TailSource(DataSource):
    """``spark.read.format("kelvane_tail").option("root", ...)``: options path (a folder inside root), bytes, newest, suffix."""

    @classmethod
    def name(cls) -> str:
        return "kelvane_tail"

    def schema(self) -> str:
        return "file string, size long, offset long, line string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)
