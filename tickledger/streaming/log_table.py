"""A keyed table in the shared folder that grows by micro-batches: hash-partitioned base, delta runs, compaction.

A batch writes one run, and of it only the partitions its keys fall into. A key's state is what `combine` makes of its rows in the
partition's base and the runs after it. A partition with `most_runs` runs is rewritten as a new base by the batch that reaches that number;
all others stay as they are. The manifest of a batch, written last, names what belongs to each partition, so a batch that is
run again starts from the manifest before its own and overwrites only its own files, and readers never see half a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.sources.lines import file_system

PART = "table_part"


@dataclass(frozen=True)
class LogTable:
    """`schema` holds the keys and what `combine` gives for them: one row per key from any rows of that schema."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    schema: T.StructType
    combine: Callable[[DataFrame], DataFrame]
    partitions: int = 64
    most_runs: int = 8

    # ------------------------------------------------------------ manifests

    def batches(self) -> list[int]:
        """Batches that are committed."""
        system, root = file_system(self.root)
        found = system.get_file_info(arrow_fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        return sorted(int(info.base_name.removesuffix(".json")) for info in found if info.base_name.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict[int, list[str]]:
        """Folders of each partition, the base first, as of the newest batch (before the given one)."""
        known = [b for b in self.batches() if before is None or b < before]
        if not known:
            return {}
        system, root = file_system(self.root)
        with system.open_input_stream(f"{root}/manifests/{max(known):012d}.json") as file:
            return {int(part): folders for part, folders in json.loads(file.read()).items()}

    def _commit(self, batch: int, manifest: dict[int, list[str]]) -> None:
        system, root = file_system(self.root)
        system.create_dir(f"{root}/manifests", recursive=True)
        path = f"{root}/manifests/{batch:012d}.json"
        with system.open_output_stream(f"{path}.writing") as file:
            file.write(json.dumps(manifest).encode())
        system.move(f"{path}.writing", path)

    # ------------------------------------------------------------ reading

    def part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.partitions)).cast("int")

    def parts_of(self, rows: DataFrame) -> list[int]:
        """Partitions that the keys of `rows` fall into: at most `partitions` numbers."""
        return sorted(r[0] for r in rows.select(self.part()).distinct().collect())

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{folder}" for folder in folders])

    def state(self, keys: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """One row per key, of the `keys` only where given; then only their partitions are read."""
        manifest = self.manifest(before)
        if keys is None:
            return self.combine(self._rows([f for folders in manifest.values() for f in folders]))
        rows = self._rows([f for part in self.parts_of(keys) for f in manifest.get(part, [])])
        return self.combine(rows.join(keys.select(*self.keys).distinct(), list(self.keys), "left_semi"))

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = rows.withColumn(PART, self.part()).repartition(PART)
        placed.write.mode("overwrite").partitionBy(PART).parquet(f"{self.root}/{folder}")

    def write(self, batch: int, rows: DataFrame) -> list[int]:
        """Commit a run of `rows`, compact partitions that have enough of them; returns the partitions written to."""
        manifest = self.manifest(before=batch)
        touched = self.parts_of(rows)
        run = f"runs/batch={batch:012d}"
        if touched:
            self._write(self.combine(rows.select(*self.schema.fieldNames())), run)
        for part in touched:
            manifest.setdefault(part, []).append(f"{run}/{PART}={part}")
        full = [part for part in touched if len(manifest[part]) > self.most_runs]
        if full:
            base = f"base/batch={batch:012d}"
            self._write(self.combine(self._rows([f for part in full for f in manifest[part]])), base)
            manifest |= {part: [f"{base}/{PART}={part}"] for part in full}
        self._commit(batch, manifest)
        return touched

    def unused(self, keep: int = 2) -> list[str]:
        """Folders of partitions that none of the last `keep` manifests names."""
        system, root = file_system(self.root)
        last = self.batches()[-keep:]
        used = {f for b in last for folders in self.manifest(before=b + 1).values() for f in folders}
        found = []
        for kind in ("runs", "base"):
            infos = system.get_file_info(arrow_fs.FileSelector(f"{root}/{kind}", allow_not_found=True, recursive=True))
            found += [info.path.removeprefix(root.rstrip("/") + "/") for info in infos if info.type == arrow_fs.FileType.Directory and f"/{PART}=" in info.path]
        return sorted(set(found) - used)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove what `unused` names; readers of older manifests must have finished."""
        system, root = file_system(self.root)
        gone = self.unused(keep)
        for folder in gone:
            system.delete_dir(f"{root}/{folder}")
        return gone


def summing(keys: Sequence[str], sums: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def newest(keys: Sequence[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """The row with the highest `order` of each key."""

    def combine(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*[F.max_by(c, order).alias(c) for c in rows.columns])
        return found.select(*rows.columns)

    return combine
