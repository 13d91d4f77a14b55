"""A streaming source for text files that grow: `spark.readStream.format("growing_lines")`.

The offset is how far each file has been read, in bytes. Files are told apart by identity (device and inode), so a log that is
rotated by renaming is read to its end under its new name, and the new file of the old name from its start. A last line without a line
end is held back until the rest has come. New bytes are cut into blocks read by tasks of their own; a line belongs to the block in
which it starts. The folder must be one that the driver and all executors mount."""

from __future__ import annotations

import os
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from alertloom.session import ship_package

BLOCK_BYTES, BATCH_LINES, READ_BYTES = 32 << 20, 8192, 1 << 16


class Block(InputPartition):
    def __init__(self, identity: str, start: int, stop: int, end: int):
        self.identity, self.start, self.stop, self.end = identity, start, stop, end


def identities(pattern: str) -> dict[str, tuple[str, int]]:
    """Path and size of each file that matches, by identity; of two names of one file the first."""
    found = {}
    for path in sorted(glob(pattern)):
        try:
            about = os.stat(path)
        except FileNotFoundError:  # renamed since it was listed: seen under its new name, now or next time
            continue
        if os.path.isfile(path):
            found.setdefault(f"{about.st_dev}:{about.st_ino}", (path, about.st_size))
    return found


def last_line_end(path: str, start: int, size: int) -> int:
    """Where the last whole line ends at or before `size`, or `start` if none does. Reads backwards in small pieces."""
    with open(path, "rb") as f:
        high = size
        while high > start:
            low = max(start, high - READ_BYTES)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.from_end = options.get("startingposition", "start") == "end"
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        files = identities(self.pattern) if self.from_end else {}
        return {i: last_line_end(path, 0, size) for i, (path, size) in files.items()}

    def latestOffset(self) -> dict:
        """Ends of whole lines. A file that has become shorter has been emptied and is read from its start; one that is gone keeps its offset
        for as long as this reader runs, in case it comes back under another name."""
        for identity, (path, size) in identities(self.pattern).items():
            done = self.seen.get(identity, 0)
            self.seen[identity] = last_line_end(path, 0 if size < done else done, size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Block]:
        self.seen = {**end, **{i: max(n, end.get(i, 0)) for i, n in self.seen.items() if i not in end}}
        blocks = []
        for identity, stop in end.items():
            begin = start.get(identity, 0)
            begin = 0 if stop < begin else begin
            blocks += [Block(identity, at, min(at + self.block, stop), stop) for at in range(begin, stop, self.block)]
        return blocks

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        found = identities(self.pattern).get(partition.identity)
        if found is None:
            raise FileNotFoundError(f"file {partition.identity} of {self.pattern} is gone before it was read")
        path = found[0]
        with open(path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:  # a line that starts before the block belongs to the block before
                f.readline()
            lines, at, places = [], f.tell(), []
            while at < partition.stop:
                line = f.readline()
                places.append(at)
                lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                at += len(line)
                if len(lines) >= BATCH_LINES:
                    yield self.batch(path, lines, places)
                    lines, places = [], []
            if lines:
                yield self.batch(path, lines, places)

    def batch(self, path: str, lines: list[str], places: list[int]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([path] * n, pa.string()), pa.array(places, pa.int64())], ["value", "path", "offset"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, path string, offset bigint"

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader({k.lower(): v for k, v in self.options.items()})


def follow_files(spark: SparkSession, pattern: str, block_bytes: int = BLOCK_BYTES, from_end: bool = False) -> DataFrame:
    """value, path, offset (where the line starts) of the lines of all files that match, as they are completed."""
    ship_package(spark)
    spark.dataSource.register(GrowingLines)
    position = "end" if from_end else "start"
    return spark.readStream.format("growing_lines").option("path", pattern).option("blockBytes", block_bytes).option("startingPosition", position).load()
