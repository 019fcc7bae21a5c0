"""Replay of line files in the order of their names, as a streaming source with real offsets.

An offset is (file, byte): all files before it by name, and of that file all lines that start before that byte, were
read. A micro-batch takes at most `bytes_per_batch` from there on, known from file sizes alone, and is cut into partitions of
`bytes_per_partition`; a line belongs to the partition in which it starts. File times play no part, and nothing but names and sizes comes
to the driver. After a restart the source goes on from the last offset in the query's own log.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "line_replay"
SCHEMA = "file string, position long, line string"
BYTES_PER_BATCH = 1 << 30
BYTES_PER_PARTITION = 1 << 26
READ_BYTES = 1 << 20


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """A path or URI as Spark takes it, for pyarrow."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return arrow_fs.FileSystem.from_uri(quote(path, safe=":/@%=+,~"))
    return arrow_fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(name below the folder, size) of its files by name; hidden ones and those in hidden folders are left out."""
    system, root = file_system(path)
    found = system.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
    root = root.rstrip("/") + "/"
    files = [(info.path.removeprefix(root), info.size) for info in found if info.type == arrow_fs.FileType.File and info.size]
    return sorted((name, size) for name, size in files if not any(part[0] in "._" for part in name.split("/")))


def advanced(files: list[tuple[str, int]], start: dict, most: int, whole: bool = False) -> dict:
    """The offset at most `most` bytes behind `start`; with `whole`, files are not divided, and the last one may pass `most`."""
    at = start
    for name, size in files:
        begun = start["byte"] if name == start["file"] else 0
        if name < start["file"] or begun >= size:
            continue
        if most <= 0:
            break
        taken = size - begun if whole else min(size - begun, most)
        at, most = {"file": name, "byte": begun + taken}, most - taken
    return at


class _Part(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__((name, start, end))
        self.name, self.start, self.end = name, start, end


def lines_from(path: str, name: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in [start, end) of a file."""
    system, root = file_system(path)
    with system.open_input_file(f"{root.rstrip('/')}/{name}") as file:
        at = max(0, start - 1)
        file.seek(at)
        held = b""
        # the byte before tells whether a line starts at `start`; else its rest belongs to the partition before
        skip = start > 0
        while True:
            more = file.read(READ_BYTES)
            held += more
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif at < end:
                    yield at, line
                at += len(line) + 1
                if at >= end:
                    return
            if not more:
                if held and not skip and at < end:
                    yield at, held
                return


class LineReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.batch_bytes = int(options.get("bytes_per_batch", BYTES_PER_BATCH))
        self.whole = options.get("whole_files", "False") == "True"
        self.part_bytes = int(options.get("bytes_per_partition", BYTES_PER_PARTITION))
        self.at = self._logged(options.get("checkpoint")) or self.initialOffset()

    @staticmethod
    def _logged(checkpoint: str | None) -> dict | None:
        """The newest offset that the query has planned; one that was not committed is run again by Spark itself."""
        if checkpoint is None:
            return None
        system, root = file_system(checkpoint)
        folder = arrow_fs.FileSelector(f"{root.rstrip('/')}/offsets", allow_not_found=True)
        planned = [info.path for info in system.get_file_info(folder) if info.base_name.isdigit()]
        if not planned:
            return None
        with system.open_input_stream(max(planned, key=lambda p: int(p.rsplit("/", 1)[1]))) as file:
            return json.loads(file.read().decode().split("\n")[2])

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        self.at = advanced(listed(self.path), self.at, self.batch_bytes, self.whole)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, size in listed(self.path):
            if name < start["file"] or name > end["file"]:
                continue
            low = start["byte"] if name == start["file"] else 0
            high = end["byte"] if name == end["file"] else size
            cuts = [*range(low, high, self.part_bytes), high]
            out += [_Part(name, a, b) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        positions, lines, size = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([partition.name] * len(lines), pa.string()), pa.array(positions, pa.int64()), pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["file", "position", "line"])

        for position, line in lines_from(self.path, partition.name, partition.start, partition.end):
            positions.append(position)
            lines.append(line.removesuffix(b"\r").decode("utf-8"))
            size += len(line)
            if size >= READ_BYTES or len(lines) >= 10_000:
                yield batch()
                positions, lines, size = [], [], 0
        if lines:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class LineReplay(DataSource):
    """spark.readStream.format("line_replay") with path, bytes_per_batch, bytes_per_partition, checkpoint."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineReplayReader:
        return LineReplayReader(self.options)


def stream_lines(spark: SparkSession, path: str, checkpoint: str, *, bytes_per_batch: int = BYTES_PER_BATCH, bytes_per_partition: int = BYTES_PER_PARTITION, whole_files: bool = False) -> DataFrame:
    """`file, position, line` of a growing folder; `checkpoint` is the one of the query that will read it, and its only source.

    `whole_files` ends batches at the ends of files only. Files are replayed by name, so a file that comes later must have a later name, and written files do not change.
    """
    spark.dataSource.register(LineReplay)
    options = {"path": path, "checkpoint": checkpoint, "bytes_per_batch": bytes_per_batch, "bytes_per_partition": bytes_per_partition, "whole_files": whole_files}
    return spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load()
