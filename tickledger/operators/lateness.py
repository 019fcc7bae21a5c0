"""Per-row late-data rules, exact in batch.

The input position `arrival` is unique and orders the stream. A row is late when it is
older than the watermark that the rows up to and including it have already pushed up:
`ts < max(ts so far) - delay`.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.functions.legs import signed_legs
from tickledger.operators.scan import Fold, Layout, plan_layout, prefix_scan
from tickledger.schema import event_tick, micros
from tickledger.workspace import pin

END_OF_INPUT = 2**63 - 1


def late_split(tx: DataFrame, delay: timedelta, layout: Layout | None = None) -> DataFrame:
    """Every row with the watermark it met and whether it was kept (equality is kept)."""
    layout = layout or plan_layout(tx, "arrival")
    scanned = prefix_scan(
        tx.select("id", "ts", "arrival"), {"high": Fold("max", "ts")}, order=["arrival", "id"], layout=layout
    )
    watermark = F.timestamp_micros(event_tick("high") - micros(delay))
    return scanned.select("id", "ts", watermark.alias("watermark"), (F.col("ts") >= watermark).alias("kept"))


def first_arrivals(tx: DataFrame) -> DataFrame:
    """Per distinct event time, the earliest input position that carries it."""
    return tx.groupBy(event_tick().alias("tick")).agg(F.min("arrival").alias("first_arrival"))


def least_at_or_after(marks: DataFrame, probes: DataFrame, value: str, *, strict: bool) -> DataFrame:
    """For each probe position `at`, the least `value` of the marks at or after it.

    Marks are (at, value), probes have (at). Both are swept once from the far end; `strict`
    leaves out marks exactly at the probe.
    """
    empty = F.lit(None).cast(marks.schema[value].dataType)
    mark_rank, probe_rank = (0, 1) if strict else (1, 0)
    swept = marks.select("at", F.lit(mark_rank).alias("rank"), F.col(value).alias(value)).unionByName(
        probes.select("at", F.lit(probe_rank).alias("rank"), empty.alias(value))
    )
    scanned = prefix_scan(
        swept,
        {"least": Fold("min", value)},
        order=["at", "rank"],
        layout=plan_layout(swept, "at"),
        descending=True,
    )
    return scanned.where(F.col("rank") == probe_rank).select("at", F.col("least").alias(value))


def accepted(tx: DataFrame, delay: timedelta, *, fine_ticks: bool = False) -> DataFrame:
    """The rows `late_split` keeps, whole.

    A row is late exactly when some row with `ts' > ts + delay` arrived before it. The
    earliest such arrival depends on `ts` alone, so it is worked out per distinct event
    time and looked up by `ts`: the input itself is only scanned, not sorted. Where almost
    every row has its own event time that table is as long as the input; `fine_ticks`
    takes the running maximum over the rows themselves instead.
    """
    if fine_ticks:
        layout = plan_layout(tx, "arrival")
        scanned = prefix_scan(tx, {"__high": Fold("max", "ts")}, order=["arrival", "id"], layout=layout)
        return scanned.where(event_tick() >= event_tick("__high") - micros(delay)).select(*tx.columns)
    firsts = pin(first_arrivals(tx), "first-arrivals")
    cutoffs = least_at_or_after(
        firsts.select(F.col("tick").alias("at"), "first_arrival"),
        firsts.select((F.col("tick") + micros(delay)).alias("at")),
        "first_arrival",
        strict=True,
    ).select(
        F.timestamp_micros(F.col("at") - micros(delay)).alias("ts"),
        F.col("first_arrival").alias("cutoff"),
    )
    known = pin(cutoffs, "late-cutoffs")
    kept = tx.join(known, "ts").where(F.col("cutoff").isNull() | (F.col("arrival") < F.col("cutoff")))
    return kept.select(*tx.columns)


def progress_rows(tx: DataFrame, delay: timedelta) -> DataFrame:
    """The distinct watermarks: one per event time that arrived before every later one."""
    firsts = pin(first_arrivals(tx), "first-arrivals")
    scanned = prefix_scan(
        firsts,
        {"later": Fold("min", "first_arrival", exclusive=True)},
        order=["tick"],
        layout=plan_layout(firsts, "tick"),
        descending=True,
    )
    advanced = scanned.where(F.col("later").isNull() | (F.col("first_arrival") < F.col("later")))
    return advanced.select((F.col("tick") - micros(delay)).alias("watermark"))


def numbered(tx: DataFrame, layout: Layout | None = None, per: str | None = None) -> DataFrame:
    """Input rows with their 1-based line number, counted over all input or `per` file."""
    keys = [] if per is None else [per]
    layout = layout or plan_layout(tx, "arrival", keys)
    one = tx.withColumn("__one", F.lit(1).cast("bigint"))
    folds = {"row_no": Fold("sum", "__one")}
    return prefix_scan(one, folds, keys=keys, order=["arrival", "id"], layout=layout).drop("__one")


def periodic_watermark(tx: DataFrame, every: int, delay: timedelta, layout: Layout | None = None) -> DataFrame:
    """A watermark after each `every` rows, from the last row seen; it never steps back."""
    marks = _marks(numbered(tx.select("id", "ts", "arrival"), layout), every, delay)
    return _never_back(marks, "row_no").select("row_no", "wm")


def periodic_watermark_per_file(tx: DataFrame, every: int, delay: timedelta, file: str) -> DataFrame:
    """The same over several files read one after the other: the row count starts anew in each."""
    lines = numbered(tx.select("id", "ts", "arrival", file), per=file)
    return _never_back(_marks(lines, every, delay), "arrival").select(file, "row_no", "wm")


def _marks(lines: DataFrame, every: int, delay: timedelta) -> DataFrame:
    mark = (event_tick() - micros(delay)).alias("mark")
    return pin(lines.where(F.col("row_no") % every == 0).drop("id").select("*", mark).drop("ts"), "watermark-rows")


def _never_back(marks: DataFrame, order: str) -> DataFrame:
    return prefix_scan(marks, {"wm": Fold("max", "mark")}, order=[order], layout=plan_layout(marks, order))


def late_refinements(tx: DataFrame, every: int, delay: timedelta) -> DataFrame:
    """Per (tick, account), one partial net for each firing of its timer.

    A row fires at the first periodic watermark that comes after it and has passed its
    event time, or at the end of the input. Part 1 is on time; later parts are the extras
    caused by late rows.
    """
    layout = plan_layout(tx, "arrival")
    marks = periodic_watermark(tx, every, delay, layout)
    by_wm = pin(marks.groupBy(F.col("wm").alias("at")).agg(F.min("row_no").alias("passed_no")), "watermark-firsts")
    ticks = tx.select(event_tick().alias("at")).distinct()
    passed = pin(least_at_or_after(by_wm, pin(ticks, "ticks"), "passed_no", strict=False), "tick-passed")

    last_mark = marks.agg(F.max("row_no")).first()[0] or 0
    lines = numbered(tx, layout).withColumn("tick", event_tick())
    own_no = F.ceil(F.col("row_no") / every) * every
    fired_at = F.greatest(own_no, F.col("passed_no"))
    fire_no = F.when(F.col("passed_no").isNotNull() & (fired_at <= last_mark), fired_at).otherwise(END_OF_INPUT)
    fired = lines.join(passed.withColumnRenamed("at", "tick"), "tick").withColumn("fire_no", fire_no)
    nets = pin(
        signed_legs(fired, "tick", "fire_no").groupBy("tick", "account", "fire_no").agg(F.sum("delta").alias("net")),
        "firings",
    ).withColumn("one", F.lit(1).cast("bigint"))
    keys = ["tick", "account"]
    parts = prefix_scan(
        nets,
        {"part": Fold("sum", "one")},
        keys=keys,
        order=["fire_no"],
        layout=plan_layout(nets, "fire_no", keys),
    )
    return parts.select("tick", "account", "part", "net")
