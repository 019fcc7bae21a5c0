"""Running values over ordered rows, without putting a hot group into one task.

A plain `sum() OVER (PARTITION BY k ORDER BY t)` sorts all rows of one key in one task.
Here the order axis of every hot key (and of the unkeyed, global case) is cut into buckets
of about equal row count:

1. rows are shuffled once by (key, bucket) and folded inside their bucket;
2. each bucket's total, a tiny aggregate, is folded along the buckets of its key, in levels where there are many;
3. what came before a bucket is joined back on (key, bucket), the partitioning step 1 left.

Keys below half a bucket's worth of rows stay whole.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
POSITION = "__position"
HOT = "__hot"
COLD_BUCKET = -1

#: A bucket holds this many rows at most, and fewer while that leaves cores idle, down to the least number.
ROWS_PER_BUCKET = 250_000
LEAST_ROWS_PER_BUCKET = 512
BUCKETS_PER_CORE = 2
SAMPLES_PER_BUCKET = 32
#: Bounds what the driver holds of a sample, two numbers a row; with more buckets than an eighth of it, buckets are less even.
MOST_SAMPLES = 4_000_000
FEWEST_SAMPLES_OF_HOT_KEY = 8
#: Buckets whose totals one window task folds; more of them are folded in several levels.
FOLD_WIDTH = 4096


@dataclass(frozen=True)
class Fold:
    """One running value. `exclusive` leaves the current row out ("before this row")."""

    op: str
    value: str
    exclusive: bool = False


@dataclass(frozen=True)
class Layout:
    """Where to cut: `splits` for the hot keys (known by hash), `overall` for a scan over all rows."""

    column: str
    keys: tuple[str, ...] = ()
    hot: tuple[int, ...] = ()
    splits: tuple[float, ...] = ()
    overall: tuple[float, ...] = ()

    def unkeyed(self) -> Layout:
        return Layout(self.column, splits=self.overall)


def plan_layout(
    stats: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int | None = None,
    buckets: int | None = None,
) -> Layout:
    """Choose hot keys and bucket boundaries from a count and a bounded sample of `stats`.

    `stats` only has to be distributed like the rows to scan. Rows are cut into BUCKETS_PER_CORE buckets for
    each core, and into more where a bucket would hold over ROWS_PER_BUCKET; the scan takes the same path
    at every size. A key is hot
    when it fills half a bucket. The sample holds a hash of the keys and the position. It moves
    boundaries only: every row is scanned and results do not depend on the layout, nor on two keys
    of one hash.
    """
    keys = tuple(keys)
    total = stats.count()
    buckets = buckets or _bucket_count(total, rows_per_bucket, stats.sparkSession.sparkContext.defaultParallelism)
    if not total or buckets == 1:
        return Layout(column, keys)
    share = min(1.0, min(SAMPLES_PER_BUCKET * buckets, MOST_SAMPLES) / total)
    narrow = stats.select(F.col(column).cast("double").alias(POSITION), *[F.xxhash64(*keys).alias(HOT)] * bool(keys))
    sample = (narrow.sample(share, seed=7) if share < 1.0 else narrow).toArrow().to_pandas()
    overall = _boundaries(sample[POSITION], buckets)
    if not keys:
        return Layout(column, splits=overall)
    counts = sample[HOT].value_counts()
    hot = counts.index[counts >= max(FEWEST_SAMPLES_OF_HOT_KEY, len(sample) / (2 * buckets))]
    splits = _boundaries(sample[POSITION][sample[HOT].isin(hot)], buckets)
    return Layout(column, keys, tuple(sorted(map(int, hot))), splits, overall)


def _bucket_count(total: int, rows_per_bucket: int | None, cores: int) -> int:
    if rows_per_bucket:
        return math.ceil(total / rows_per_bucket)
    spread = min(BUCKETS_PER_CORE * cores, total // LEAST_ROWS_PER_BUCKET)
    return max(1, spread, math.ceil(total / ROWS_PER_BUCKET))


def _boundaries(sample: pd.Series, buckets: int) -> tuple[float, ...]:
    if sample.empty:
        return ()
    cuts = np.unique(np.quantile(sample.to_numpy(dtype="float64"), np.arange(1, buckets) / buckets, method="lower"))
    return tuple(float(cut) for cut in cuts)


def _bucketed(df: DataFrame, layout: Layout) -> DataFrame:
    cut = Bucketizer(
        splits=[-math.inf, *layout.splits, math.inf], inputCol=POSITION, outputCol=BUCKET, handleInvalid="error"
    )
    placed = cut.transform(df.withColumn(POSITION, F.col(layout.column).cast("double")))
    bucket = F.col(BUCKET).cast("int")
    if layout.keys:
        listed = df.sparkSession.createDataFrame([(key,) for key in layout.hot], f"{HOT} long")
        placed = placed.join(listed, F.xxhash64(*layout.keys) == F.col(HOT), "left")
        bucket = F.when(F.col(HOT).isNotNull(), bucket).otherwise(F.lit(COLD_BUCKET))
    return placed.select(*df.columns, bucket.alias(BUCKET))


def _local(fold: Fold, window) -> Column:
    over = window.rowsBetween(Window.unboundedPreceding, -1 if fold.exclusive else Window.currentRow)
    value = F.col(fold.value)
    if fold.op == "last":
        return F.last(value, ignorenulls=True).over(over)
    return {"sum": F.sum, "max": F.max, "min": F.min}[fold.op](value).over(over)


def _total(fold: Fold, order: Sequence[str], descending: bool) -> Column:
    value = F.col(fold.value)
    if fold.op == "last":
        place = F.when(value.isNotNull(), F.struct(*order) if len(order) > 1 else F.col(order[0]))
        return F.min_by(value, place) if descending else F.max_by(value, place)
    return {"sum": F.sum, "max": F.max, "min": F.min}[fold.op](value)


def _merge(op: str, here: Column, before: Column | None) -> Column:
    if op == "sum":
        known = F.coalesce(here, F.lit(0))
        return known if before is None else known + F.coalesce(before, F.lit(0))
    if before is None:
        return here
    if op == "last":
        return F.coalesce(here, before)
    return (F.greatest if op == "max" else F.least)(here, before)


def _before(totals: DataFrame, folds: Mapping[str, Fold], keys: Sequence[str], step: str, descending: bool, steps: int) -> DataFrame:
    """For each row of `totals` (one per keys and `step`) the fold of the rows before it.

    Up to FOLD_WIDTH steps are folded by one window; of more, each run of that width is folded on its own,
    and what came before a run is found in the same way from the runs' totals.
    """
    exclusive = {name: Fold(fold.op, name, True) for name, fold in folds.items()}
    axis = F.col(step).desc() if descending else F.col(step).asc()
    if steps <= FOLD_WIDTH:
        window = Window.partitionBy(*keys).orderBy(axis)
        return totals.select(*keys, step, *[_local(fold, window).alias(name) for name, fold in exclusive.items()])
    run = f"{step}_run"
    placed = totals.withColumn(run, F.floor(F.col(step) / FOLD_WIDTH))
    window = Window.partitionBy(*keys, run).orderBy(axis)
    inside = placed.select(*keys, run, step, *[_local(fold, window).alias(name) for name, fold in exclusive.items()])
    sums = placed.groupBy(*keys, run).agg(*[_total(fold, [step], descending).alias(name) for name, fold in exclusive.items()])
    ahead = _before(sums, folds, keys, run, descending, math.ceil(steps / FOLD_WIDTH) + 1)
    ahead = ahead.select(*keys, run, *[F.col(name).alias(f"{name}_ahead") for name in folds])
    merged = [_merge(fold.op, F.col(name), F.col(f"{name}_ahead")).alias(name) for name, fold in folds.items()]
    return inside.join(ahead, [*keys, run], "left").select(*keys, step, *merged)


def prefix_scan(
    df: DataFrame,
    folds: Mapping[str, Fold],
    *,
    order: Sequence[str],
    layout: Layout,
    keys: Sequence[str] = (),
    descending: bool = False,
    combine: Mapping[str, Column] | None = None,
    costly: bool = False,
) -> DataFrame:
    """One running column per fold, per `keys` (none = over everything) by `order`.

    Without `combine` the rows of `df` are kept as they are. With it, rows equal in keys and
    order are first aggregated to these columns, on the partitioning the scan needs anyway.
    `costly` rows (of keys, order and fold columns only) are computed once: the bucket totals
    are then read back from the shuffle and not summed ahead of it in a second pass. `keys`
    must not be NULL; the layout column must be one of `order`.
    """
    axis = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    split = bool(layout.splits)
    source = _bucketed(df, layout) if split else df.withColumn(BUCKET, F.lit(COLD_BUCKET))
    place = [*keys, BUCKET] if split or not keys else list(keys)
    columns = df.columns
    if combine is not None or (costly and split):
        source = source.repartition(*[F.col(c) for c in place])
    if combine is not None:
        source = source.groupBy(BUCKET, *keys, *order).agg(*[c.alias(name) for name, c in combine.items()])
        columns = [*keys, *order, *combine]
    window = Window.partitionBy(*place).orderBy(*axis)

    local = source.select("*", *[_local(fold, window).alias(name) for name, fold in folds.items()])
    if not split:
        whole = [_merge(fold.op, F.col(name), None).alias(name) for name, fold in folds.items()]
        return local.select(*columns, *whole)

    divided = source.where(F.col(BUCKET) != COLD_BUCKET) if keys else source
    totals = divided.groupBy(*place).agg(
        *[_total(fold, order, descending).alias(name) for name, fold in folds.items()],
        F.max(order[0]).alias(POSITION),
    )
    if costly:
        # Asking for the position keeps it in this branch, so that both read one shuffle.
        totals = totals.where(F.col(POSITION).isNotNull())
    carry = _before(totals.select(*place, *folds), folds, keys, BUCKET, descending, len(layout.splits) + 1)
    carry = carry.select(*place, *[F.col(name).alias(f"__before_{name}") for name in folds])
    joined = local.join(carry, place, "left")
    return joined.select(
        *columns,
        *[_merge(fold.op, F.col(name), F.col(f"__before_{name}")).alias(name) for name, fold in folds.items()],
    )
