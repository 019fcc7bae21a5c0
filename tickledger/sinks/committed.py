"""A streaming sink of text lines with a commit in two phases.

Tasks write files of their own that no reader looks at; when all have succeeded, one manifest per batch names them, and it appears under
its name at once. Readers go by manifests alone, so a batch that fails leaves nothing that can be read, and one that is
run again replaces its own manifest. Files of failed batches are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

from tickledger.sources.lines import file_system

FORMAT = "committed_lines"


@dataclass
class _Written(WriterCommitMessage):
    file: str
    lines: int


class CommittedLinesWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = file_system(self.path)
        name, lines = f"data/{uuid.uuid4().hex}.txt", 0
        system.create_dir(f"{root}/data", recursive=True)
        with system.open_output_stream(f"{root}/{name}") as file:
            for batch in iterator:
                for line in batch.column("line").to_pylist():
                    file.write(line.encode("utf-8") + b"\n")
                lines += batch.num_rows
        return _Written(name, lines)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        system, root = file_system(self.path)
        files = [m.file for m in messages if m is not None and m.lines]
        system.create_dir(f"{root}/manifests", recursive=True)
        path = f"{root}/manifests/{batchId:012d}.json"
        with system.open_output_stream(f"{path}.writing") as file:
            file.write(json.dumps(files).encode())
        system.move(f"{path}.writing", path)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        system, root = file_system(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(f"{root}/{message.file}")


class CommittedLines(DataSource):
    """writeStream.format("committed_lines") of one column `line`, option path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "line string"

    def streamWriter(self, schema, overwrite: bool) -> CommittedLinesWriter:
        return CommittedLinesWriter(self.options["path"])


def write_stream(lines: DataFrame, path: str):
    """A writer of the column `line`; null lines are not allowed."""
    lines.sparkSession.dataSource.register(CommittedLines)
    return lines.select("line").writeStream.format(FORMAT).option("path", path).outputMode("append")


def committed(path: str) -> dict[int, list[str]]:
    """Files of each committed batch."""
    system, root = file_system(path)
    found = system.get_file_info(arrow_fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    out = {}
    for info in found:
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as file:
                out[int(info.base_name.removesuffix(".json"))] = json.loads(file.read())
    return dict(sorted(out.items()))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all committed batches."""
    files = [f"{path}/{name}" for names in committed(path).values() for name in names]
    if not files:
        return spark.createDataFrame([], "line string")
    return spark.read.text(files).select(F.col("value").alias("line"))
