"""A changelog kept for reads as of any tick: runs of rising ticks, and snapshots of the view between them.

A run holds the changelog rows of a range of ticks; the manifest has its first and last tick and its number of rows. A snapshot
is the view after all runs up to some tick. One is written when the runs since the one before hold as many rows as it does
(and `least_rows` at least), so snapshots take no more space than the runs, and a read as of any tick takes the newest snapshot
that is not later and less than about twice as many rows of runs. Which files those are follows from the manifest alone.

The manifest of a batch is written last. A batch that is run again starts from the manifest before its own and
overwrites only its own files.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.sources.lines import file_system
from tickledger.workspace import pin

RUN = "__run"


@dataclass(frozen=True)
class Run:
    folder: str
    first: int
    last: int
    rows: int


@dataclass(frozen=True)
class Snapshot:
    folder: str
    upto: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    runs: tuple[Run, ...] = ()
    snapshots: tuple[Snapshot, ...] = ()

    def files_as_of(self, tick: int) -> tuple[Snapshot | None, list[Run]]:
        """The snapshot to start from and the runs to add for the view at `tick`."""
        start = max((s for s in self.snapshots if s.upto <= tick), key=lambda s: s.upto, default=None)
        return start, [r for r in self.runs if r.first <= tick and (start is None or r.first > start.upto)]


@dataclass(frozen=True)
class SnapshotIndex:
    """`schema` is that of the changelog: `tick` (long), the view's columns, `diff` (long). Other columns are not stored."""

    spark: SparkSession
    root: str
    schema: T.StructType
    least_rows: int = 1_000_000
    columns: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(c for c in self.schema.fieldNames() if c not in ("tick", "diff")))

    # ------------------------------------------------------------ manifests

    def manifest(self, before: int | None = None) -> Manifest:
        """The newest manifest (of the batches before the given one)."""
        system, root = file_system(self.root)
        found = system.get_file_info(arrow_fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        known = [int(info.base_name.removesuffix(".json")) for info in found if info.base_name.endswith(".json")]
        known = [batch for batch in known if before is None or batch < before]
        if not known:
            return Manifest()
        with system.open_input_stream(f"{root}/manifests/{max(known):012d}.json") as file:
            stored = json.loads(file.read())
        return Manifest(tuple(Run(**r) for r in stored["runs"]), tuple(Snapshot(**s) for s in stored["snapshots"]))

    def _commit(self, batch: int, manifest: Manifest) -> None:
        system, root = file_system(self.root)
        system.create_dir(f"{root}/manifests", recursive=True)
        path = f"{root}/manifests/{batch:012d}.json"
        with system.open_output_stream(f"{path}.writing") as file:
            file.write(json.dumps(asdict(manifest)).encode())
        system.move(f"{path}.writing", path)

    # ------------------------------------------------------------ writing

    def append(self, batch: int, changelog: DataFrame, runs: int = 1) -> Manifest:
        """Commit the rows of a batch as up to `runs` runs of about equal size, and the snapshots that are due.

        All ticks must be later than those of earlier batches; a batch with an earlier one is refused and leaves
        nothing readable. Rows of one tick stay in one run. An empty batch changes nothing. Null ticks are an error.
        """
        known = self.manifest(before=batch)
        folder = f"runs/batch={batch:012d}"
        rows = changelog.select(*self.schema.fieldNames())
        if runs > 1:
            rows = pin(rows, "changelog")  # read twice, for the cuts and for the runs
        cuts = sorted(set(map(int, rows.approxQuantile("tick", [k / runs for k in range(1, runs)], 0.25 / runs)))) if runs > 1 else []
        passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("tick"))) if cuts else F.lit(0)
        checked = F.when(F.col("tick").isNull(), F.raise_error(F.lit("a changelog row without a tick"))).otherwise(passed)
        placed = rows.withColumn(RUN, checked.cast("int"))
        # by range of ticks, so that a run is written by few tasks and a large one by several
        placed = placed.repartitionByRange(RUN, "tick") if cuts else placed
        placed.write.mode("overwrite").partitionBy(RUN).parquet(f"{self.root}/{folder}")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(RUN, T.IntegerType())])).parquet(f"{self.root}/{folder}")
        # one row for each run, `runs` at most
        sizes = written.groupBy(RUN).agg(F.min("tick").alias("first"), F.max("tick").alias("last"), F.count("*").alias("rows")).orderBy("first").collect()
        if sizes and known.runs and sizes[0]["first"] <= known.runs[-1].last:
            raise ValueError(f"batch {batch} begins at tick {sizes[0]['first']}, which an earlier batch has passed")
        manifest = known
        for size in sizes:
            run = Run(f"{folder}/{RUN}={size[RUN]}", size["first"], size["last"], size["rows"])
            manifest = Manifest((*manifest.runs, run), manifest.snapshots)
            manifest = self._with_snapshot(batch, manifest)
        self._commit(batch, manifest)
        return manifest

    def _with_snapshot(self, batch: int, manifest: Manifest) -> Manifest:
        """The manifest with a snapshot after its last run, if one is due."""
        upto = manifest.runs[-1].last
        start, since = manifest.files_as_of(upto)
        if sum(r.rows for r in since) < max(self.least_rows, start.rows if start else 0):
            return manifest
        folder = f"snapshots/batch={batch:012d}/upto={upto}"
        self._summed(start, since, upto).write.mode("overwrite").parquet(f"{self.root}/{folder}")
        made = Snapshot(folder, upto, self._read([folder]).count())
        return Manifest(manifest.runs, (*manifest.snapshots, made))

    # ------------------------------------------------------------ reading

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{folder}" for folder in folders])

    def _summed(self, start: Snapshot | None, runs: Sequence[Run], tick: int) -> DataFrame:
        """`tick`, the view's columns and `diff`, the copies of each row at `tick`; what cancels out is gone."""
        parts = [self._read([r.folder for r in runs]).where(F.col("tick") <= tick)] if runs else []
        parts += [self._read([start.folder])] if start else []
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        summed = rows.groupBy(*self.columns).agg(F.sum("diff").alias("diff")).where("diff <> 0")
        return summed.select(*[F.lit(tick).cast("long").alias("tick") if c == "tick" else F.col(c) for c in self.schema.fieldNames()])

    def as_of(self, tick: int) -> DataFrame:
        """The view's rows at a tick, with how many `copies` of each there are."""
        start, runs = self.manifest().files_as_of(tick)
        return self._summed(start, runs, tick).where("diff > 0").select(*self.columns, F.col("diff").alias("copies"))

    def changes(self, after: int, upto: int) -> DataFrame:
        """Changelog rows with `after < tick <= upto`, from the runs that have such ticks only."""
        runs = [r for r in self.manifest().runs if r.last > after and r.first <= upto]
        rows = self._read([r.folder for r in runs]) if runs else self.spark.createDataFrame([], self.schema)
        return rows.where((F.col("tick") > after) & (F.col("tick") <= upto))
