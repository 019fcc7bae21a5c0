"""Joins and keyed tables with state of their own, fed by micro-batches and giving out changelogs.

State is Spark's keyed state (RocksDB), one entry per key; keys are buckets of ids or accounts, and a changelog has at most one entry pair per
account, side and tick, so an account's rows are bounded by the ticks of a batch however busy it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickledger.schema import micros
from tickledger.streaming.log_table import LogTable, summing
from tickledger.streaming.publish import END_OF_TIME, run_available
from tickledger.workspace import pin

KEPT_FOR = timedelta(days=7)


# ---------------------------------------------------------------- untimed left join


#: Rows of one frame that a bucket gives out, so that many matches of one key are not held at once.
PAIRS_PER_FRAME = 1 << 18
IS_LEFT, NO_VALUE = 1, 2
NULL_KEYS = -1


def _matches(mine: pd.DataFrame, other: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of equal keys, a bounded number at a time; `other` is in the order of its keys."""
    low = np.searchsorted(other["key"], mine["key"], "left")
    number = np.searchsorted(other["key"], mine["key"], "right") - low
    behind = np.cumsum(number)
    piece = (behind - number) // PAIRS_PER_FRAME
    for at in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(piece)) + 1):
        if pairs := int(number[at].sum()):
            place = np.arange(pairs) - np.repeat(behind[at] - number[at] - (behind[at[0]] - number[at[0]]), number[at])
            yield np.repeat(at, number[at]), np.repeat(low[at], number[at]) + place


class _RetractingLeftJoin(StatefulProcessor):
    """Key: a bucket of join keys. A left row comes out unmatched at first; the first right row of its join key takes that back.

    What a bucket holds is one value, so a batch costs it a few state calls however many of its keys it touches. Its one
    timer is the first time at which one of its keys may go.
    """

    HELD = {"key": "<i8", "value": "<i8", "flags": "<i1", "until": "<i8"}

    def __init__(self, kept_for: timedelta):
        self.kept_ms = kept_for // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sides = handle.getValueState("sides", ", ".join(f"{c} binary" for c in self.HELD) + ", timer long")

    def _held(self, state: tuple) -> pd.DataFrame:
        return pd.DataFrame({c: np.frombuffer(x, form) for (c, form), x in zip(self.HELD.items(), state, strict=False)})

    def _hold(self, rows: pd.DataFrame, timer: int | None) -> None:
        """Keep the rows, with one timer not behind the first time at which a key goes."""
        due = int(rows["until"].min())
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.sides.update((*[rows[c].to_numpy(form).tobytes() for c, form in self.HELD.items()], timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.sides.get()
        new = pd.concat([r[["key", "tick", "value", "flags", "millis"]] for r in rows], ignore_index=True).astype("int64")
        new["until"] = np.maximum(new.pop("millis"), 0) + self.kept_ms
        new["right"] = new["flags"] & IS_LEFT == 0
        new = new.sort_values(["tick", "right"], kind="stable", ignore_index=True)
        new["place"] = np.arange(len(new))
        held = self._held(state) if state else self._held((b"",) * len(self.HELD))
        held = held.assign(tick=0, right=held["flags"] & IS_LEFT == 0, place=-1)
        every = pd.concat([held, new], ignore_index=True).sort_values("key", kind="stable", ignore_index=True)
        every["until"] = every.groupby("key")["until"].transform("max")
        lefts, rights = (every[every["right"] == side].reset_index(drop=True) for side in (False, True))

        def out(tick: np.ndarray, left: pd.DataFrame, right: pd.DataFrame | None, diff: int) -> pd.DataFrame:
            def values(x: pd.DataFrame) -> pd.arrays.IntegerArray:
                return pd.arrays.IntegerArray(x["value"].to_numpy("int64"), (x["flags"].to_numpy() & NO_VALUE) != 0)

            keys = pd.arrays.IntegerArray(left["key"].to_numpy("int64"), np.full(len(left), key[0] == NULL_KEYS))
            matched = pd.array([None] * len(left), "Int64") if right is None else values(right)
            made = {"tick": np.asarray(tick, "int64"), "key": keys, "left": values(left), "right": matched, "diff": np.full(len(left), diff, "int32")}
            return pd.DataFrame(made)

        # every left row's first right one: before it the row is unmatched
        first = rights.loc[rights.groupby("key")["place"].idxmin(), ["key", "place", "tick"]]
        met = lefts[["key"]].merge(first, "left", "key")
        alone = (met["place"].isna() | (lefts["place"] < met["place"])).to_numpy()
        fresh = (lefts["place"] >= 0).to_numpy()
        if (told := alone & fresh).any():
            yield out(lefts["tick"][told], lefts[told], None, 1)
        if (back := alone & (met["place"] >= 0).to_numpy()).any():
            yield out(np.asarray(first.set_index("key")["tick"].loc[lefts["key"][back]]), lefts[back], None, -1)
        newer = rights[rights["place"] >= 0].reset_index(drop=True)
        for mine, other in ((lefts[fresh], rights), (lefts[~fresh], newer)):
            for a, b in _matches(mine, other):
                left, right = mine.iloc[a], other.iloc[b]
                last = np.where(left["place"].to_numpy() > right["place"].to_numpy(), left["tick"].to_numpy(), right["tick"].to_numpy())
                yield out(last, left, right, 1)
        self._hold(every, state[-1] if state else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held(self.sides.get())
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        later = held[held["until"] > passed]
        if len(later):
            self._hold(later, None)
        else:
            self.sides.clear()
        return iter(())

    def close(self) -> None:
        pass


def outer_join_changelog(left: DataFrame, right: DataFrame, delay: timedelta, kept_for: timedelta = KEPT_FOR, buckets: int = 256) -> DataFrame:
    """Left join of two streams (key, tick, value, ts) that is not bound to times, as (tick, key, left, right, diff), append.

    A left row without a match is published with NULL at once and taken back by the first match. Rows are joined in
    the order of their ticks within a micro-batch, batches as they come. A key's state goes when the watermark, `delay` behind the newest
    `ts`, has passed its newest row by `kept_for`: a match that comes later than that is not found, which bounds the state.

    Keys are dealt by hash to `buckets`, each of them one group with one state value: of a batch a task holds a bucket's rows and what the
    bucket keeps. It must stay the same for a checkpoint, and should follow the rows that are kept (some 10,000 in a bucket).
    """
    key, value = F.col("key").cast("long"), F.col("value").cast("long")
    bucket = F.when(key.isNull(), F.lit(NULL_KEYS)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    nothing = F.lit(0).cast("long")
    columns = [F.coalesce(key, nothing).alias("key"), F.col("tick").cast("long"), F.coalesce(value, nothing).alias("value"), F.col("ts"), F.unix_millis("ts").alias("millis")]

    def side(rows: DataFrame, is_left: bool) -> DataFrame:
        flags = F.lit(int(is_left) * IS_LEFT) + F.when(value.isNull(), F.lit(NO_VALUE)).otherwise(F.lit(0))
        return rows.select(bucket.alias("bucket"), *columns, flags.alias("flags")).withWatermark("ts", f"{micros(delay)} microseconds")

    both = side(left, True).unionByName(side(right, False)).where(F.col("ts") < F.lit(END_OF_TIME))
    form = "tick long, key long, left long, right long, diff int"
    return both.groupBy("bucket").transformWithStateInPandas(_RetractingLeftJoin(kept_for), form, "append", "eventTime")


# ---------------------------------------------------------------- join of two changelogs


#: Rows of one frame that an account gives out, and what stands for the account that is NULL (others are ints).
ROWS_PER_FRAME = 10_000
NO_ACCOUNT = -(2**62)


def delta_join(left: dict, right: dict, new_left: dict, new_right: dict, combine: Callable[[int, int], int]) -> dict:
    """What changes in the join of two multisets (value -> copies): new with old, old with new, new with new."""
    out: dict[int, int] = {}
    for mine, other in ((new_left, right), (left, new_right), (new_left, new_right)):
        for a, n in mine.items():
            for b, m in other.items():
                value = combine(a, b)
                out[value] = out.get(value, 0) + n * m
    return {value: n for value, n in out.items() if n}


class _ChangelogJoin(StatefulProcessor):
    """Key: account. Entries wait for the watermark, so that both sides of a tick are there; then ticks are joined in order.

    Rows come and go as frames. All that waits is one value, as is each multiset, so a batch costs a key a few state calls however many ticks close.
    """

    def __init__(self, combine: Callable[[int, int], int]):
        self.combine = combine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "ticks array<long>, sides array<int>, values array<long>, diffs array<long>, timer long")
        self.multisets = [handle.getValueState(name, "values array<long>, copies array<long>") for name in ("left", "right")]

    def _frame(self, key, made: list[tuple[int, int, int]]) -> pd.DataFrame:
        ticks, values, diffs = zip(*made, strict=True)
        account = pd.array([None if key[0] == NO_ACCOUNT else key[0]], "Int32")
        return pd.DataFrame({"tick": ticks, "account": account.repeat(len(made)), "value": values, "diff": np.array(diffs, "int32")})

    def _wait(self, entries: list[tuple], timer: int | None) -> None:
        """Keep the entries, with one timer at the first of their ticks."""
        due = -(-min(e[0] for e in entries) // 1000)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.waiting.update((*[list(column) for column in zip(*entries, strict=True)], timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.waiting.get()
        entries = [] if held is None else list(zip(*held[:4], strict=True))
        for new in rows:
            ticks, sides, values, diffs = (new[c].astype("int64").tolist() for c in ("tick", "side", "value", "diff"))
            entries += zip(ticks, sides, [v if known else None for v, known in zip(values, new["known"], strict=True)], diffs, strict=True)
        self._wait(entries, None if held is None else held[4])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        entries = list(zip(*self.waiting.get()[:4], strict=True))
        old = [dict(zip(*(state.get() or ([], [])), strict=True)) for state in self.multisets]
        ticks: dict[int, list[dict[int, int]]] = {}
        for tick, side, value, diff in entries:
            if tick <= passed:
                new = ticks.setdefault(tick, [{}, {}])[side]
                new[value] = new.get(value, 0) + diff
        made: list[tuple[int, int, int]] = []
        for tick in sorted(ticks):
            made += [(tick, value, diff) for value, diff in sorted(delta_join(*old, *ticks[tick], self.combine).items())]
            if len(made) >= ROWS_PER_FRAME:
                yield self._frame(key, made)
                made = []
            for before, changes in zip(old, ticks[tick], strict=True):
                for value, diff in changes.items():
                    before[value] = before.get(value, 0) + diff
                    if not before[value]:
                        del before[value]
        if made:
            yield self._frame(key, made)
        for state, now in zip(self.multisets, old, strict=True):
            state.update((list(now), list(now.values())))
        later = [e for e in entries if e[0] > passed]
        if later:
            self._wait(later, None)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


#: An entry of two changelogs in one stream: side 0 is the left one.
ENTRY = T.StructType([T.StructField(c, T.IntegerType() if c in ("account", "side") else T.LongType()) for c in ("tick", "account", "side", "value", "diff")])


def join_changelogs(entries: DataFrame, combine: Callable[[int, int], int], name: str) -> DataFrame:
    """Changelog (tick, account, `name`, diff) of the join of two keyed changelogs, tick by closed tick (append).

    `entries` (ENTRY) come in the order of ticks. What is joined at a tick are the changes of that tick with the multisets
    that both sides had before it, never whole histories.
    """
    timed = entries.withColumn("at", F.timestamp_micros("tick")).withWatermark("at", "0 seconds").where(F.col("at") < F.lit(END_OF_TIME))
    # frames have no NULL among integers
    account, value = F.coalesce(F.col("account").cast("long"), F.lit(NO_ACCOUNT)), F.coalesce("value", F.lit(0).cast("long"))
    plain = timed.select(account.alias("account"), "tick", "side", value.alias("value"), F.col("value").isNotNull().alias("known"), "diff", "at")
    form = "tick long, account int, value long, diff int"
    return plain.groupBy("account").transformWithStateInPandas(_ChangelogJoin(combine), form, "append", "eventTime").withColumnRenamed("value", name)


# ---------------------------------------------------------------- retractable aggregate


class _Replaced(StatefulProcessor):
    """Key: the table's key. Each row takes back the one before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "grouped int, amount long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r.tick):
            if last is not None:
                yield Row(tick=row.tick, key=key[0], grouped=last[0], amount=last[1], diff=-1)
            last = (row.grouped, row.amount)
            yield Row(tick=row.tick, key=key[0], grouped=last[0], amount=last[1], diff=1)
        self.last.update(tuple(last))

    def close(self) -> None:
        pass


def retractions(upserts: DataFrame, key: str, order: str, group: str, amount: str) -> DataFrame:
    """Upserts of a stream as the changelog (tick, key, grouped, amount, diff) of the keyed table, append.

    The replaced row is in the state of its key; a batch looks up the keys it touches and no others.
    """
    rows = upserts.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("tick"), F.col(group).cast("int").alias("grouped"), F.col(amount).cast("long").alias("amount"))
    form = "tick long, key long, grouped int, amount long, diff int"
    return rows.groupBy("key").transformWithState(_Replaced(), form, "append", "none")


def sums_table(spark: SparkSession, root: str, group: str, total: str, **options) -> LogTable:
    """Sum and number of rows per group."""
    schema = T.StructType([T.StructField(group, T.IntegerType()), T.StructField(total, T.LongType()), T.StructField("copies", T.LongType())])
    return LogTable(spark, root, (group,), schema, summing([group], [total, "copies"]), **options)


def publish_retractable_sums(changes: DataFrame, table: LogTable, checkpoint: str) -> StreamingQuery:
    """Add what changed to the sums of the groups it concerns: what a row replaces is subtracted in the step that adds it."""
    group, total = table.keys[0], table.schema.fieldNames()[1]
    delta: Column = F.sum(F.col("amount") * F.col("diff")).cast("long")

    def write(entries: DataFrame, batch: int) -> None:
        moved = entries.groupBy(F.col("grouped").alias(group)).agg(delta.alias(total), F.sum("diff").cast("long").alias("copies"))
        # the batch itself must run once only
        table.write(batch, pin(moved.where((F.col(total) != 0) | (F.col("copies") != 0)), "moved-sums"))

    return run_available(changes.writeStream.outputMode("append").foreachBatch(write), checkpoint)
