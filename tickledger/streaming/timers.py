"""Keyed process functions: state and event-time timers per key.

`timer_nets` keeps the running net of each account and tick, sets a timer at the tick, and gives the net out when the
watermark passes it. `late_refinements` does the same under the periodic watermark of the replay source: a row behind it meets
a timer in the past, which fires at once and makes a further, numbered part. A key is one account at one tick, or with the ticks of a
day, and rows are added up per tick before the shuffle, so a busy account is spread over its keys and a busy tick sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickledger.functions.legs import signed_legs
from tickledger.operators.scan import Fold, plan_layout, prefix_scan
from tickledger.schema import event_tick, micros
from tickledger.streaming.publish import END_OF_TIME, published_batches, run_available
from tickledger.workspace import pin

OPENING_MARK = -(2**62)
#: Stands for the account that is NULL; others are ints.
NO_ACCOUNT = -(2**62)
#: The ticks of an account that `late_refinements` keeps together.
SPAN = timedelta(days=1)
#: What `publish_marked` writes of a row, one JSON line each; times are epoch microseconds.
MARKED = T.StructType([T.StructField(c, T.IntegerType() if c.endswith("account") else T.LongType()) for c in ("ts", "from_account", "to_account", "amount", "block", "met")])


def added_up(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key and Arrow batch: a stream's partial sums before the shuffle, where Spark has no partial aggregate."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(keys).aggregate([(value, "sum")])
            yield from sums.rename_columns({f"{value}_sum": value}).select([*keys, value]).cast(batch.select([*keys, value]).schema).to_batches()

    return rows.select(*keys, value).mapInArrow(run, rows.select(*keys, value).schema)


def _fires_at(tick: int) -> int:
    """Timers have milliseconds: the first one not before a tick in microseconds."""
    return -(-tick // 1000)


class _NetAtTick(StatefulProcessor):
    """Key (tick, account): the net so far, given out and cleared by the timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.net = handle.getValueState("net", "net long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        net = sum(row.delta for row in rows)
        if self.net.exists():
            net += self.net.get()[0]
        else:
            self.handle.registerTimer(_fires_at(key[0]))
        self.net.update((net,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(tick=key[0], account=key[1], net=self.net.get()[0])
        self.net.clear()

    def close(self) -> None:
        pass


def timer_nets(tx: DataFrame, delay: timedelta) -> DataFrame:
    """Net change of each account at each closed tick, by timers (append). A closing row opens no tick."""
    sums = added_up(signed_legs(tx, "ts"), ["ts", "account"], "delta")
    # the closing row is taken out behind the watermark that it moves
    timed = sums.withWatermark("ts", f"{micros(delay)} microseconds").where(F.col("ts") < F.lit(END_OF_TIME))
    keyed = timed.withColumn("tick", event_tick()).groupBy("tick", "account")
    return keyed.transformWithState(_NetAtTick(), "tick long, account int, net long", "append", "eventTime")


# ---------------------------------------------------------------- the periodic watermark


def publish_marked(tx: DataFrame, every: int, delay: timedelta, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream in the order of `arrival` with the periodic watermark that they meet, as lines under rows/batch=N.

    The names of the files follow that order, and a file holds whole runs of `every` rows, so they can be replayed by
    name, file by file. After each `every` rows the watermark is the last row's time less `delay` if that is
    later; `met` is the watermark when a row comes in, `block` the number of its run. A batch goes on from the row count, the watermark and
    the rows of an unfinished run that the batch before it left; the closing row ends the last run.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = [b for b in published_batches(spark, f"{path}/left") if b < batch]
        left = spark.read.parquet(f"{path}/left/batch={max(before)}").first() if before else None
        count, high = (left["row_no"], left["high"]) if left else (0, OPENING_MARK)
        if before:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/tail/batch={max(before)}"))
        stored = pin(rows, "batch-rows")
        done = count + stored.count()
        if stored.where(F.col("ts") >= F.lit(END_OF_TIME)).isEmpty():
            done -= done % every
        layout = plan_layout(stored, "arrival")
        one = stored.withColumn("one", F.lit(1).cast("bigint"))
        lines = prefix_scan(one, {"row_no": Fold("sum", "one")}, order=["arrival", "id"], layout=layout).drop("one")
        lines = lines.withColumn("row_no", F.col("row_no") + count)
        marks = lines.withColumn("mark", F.when(F.col("row_no") % every == 0, event_tick() - micros(delay)))
        met = prefix_scan(marks, {"met": Fold("max", "mark", exclusive=True)}, order=["arrival", "id"], layout=layout)
        met = met.withColumn("met", F.greatest(F.col("met"), F.lit(high).cast("bigint")))
        met = met.withColumn("block", F.floor((F.col("row_no") - 1) / every))
        placed = met.where(F.col("row_no") <= done).repartitionByRange("block").sortWithinPartitions("arrival", "id")
        record = F.to_json(F.struct(*MARKED.fieldNames())).alias("line")
        placed.withColumn("ts", event_tick()).select(record).write.mode("overwrite").text(f"{path}/rows/batch={batch:012d}")
        lines.where(F.col("row_no") > done).select(*rows.columns).write.mode("overwrite").parquet(f"{path}/tail/batch={batch}")
        last = marks.agg(F.lit(done).cast("bigint").alias("row_no"), F.greatest(F.max("mark"), F.lit(high).cast("bigint")).alias("high"))
        last.write.mode("overwrite").parquet(f"{path}/left/batch={batch}")

    return run_available(tx.writeStream.outputMode("append").foreachBatch(write), checkpoint)


def marked_rows(lines: DataFrame) -> DataFrame:
    """The rows that `publish_marked` wrote, from their lines."""
    rows = lines.select(F.from_json("line", MARKED, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    return rows.withColumn("ts", F.timestamp_micros("ts"))


class _Refinements(StatefulProcessor):
    """Key (account, span of ticks): the nets of its ticks that wait for the watermark, and how many parts of each were given out.

    Each of the two is one value, and one timer stands at the first tick that waits, so a batch costs a key a few state calls however
    many ticks there are. Parts leave as frames, so a task holds those of one key and not of all that fire.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.net = handle.getValueState("net", "ticks array<long>, nets array<long>, timer long")
        self.parts = handle.getValueState("parts", "ticks array<long>, parts array<long>")

    def _frames(self, key, fired: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """Numbered parts of the nets (tick, net) in the order in which they fire."""
        if not fired:
            return
        held = self.parts.get()
        parts = dict(zip(*held, strict=True)) if held else {}
        numbers = []
        for tick, _ in fired:
            parts[tick] = parts.get(tick, 0) + 1
            numbers.append(parts[tick])
        self.parts.update((list(parts), list(parts.values())))
        ticks, nets = zip(*fired, strict=True)
        account = pd.array([None if key[0] == NO_ACCOUNT else key[0]], "Int32")
        yield pd.DataFrame({"tick": ticks, "account": account.repeat(len(fired)), "part": numbers, "net": nets})

    def _wait(self, nets: dict[int, int], timer: int | None) -> None:
        """Keep the nets with one timer at the first tick; `timer` is the one that is set."""
        due = _fires_at(min(nets)) if nets else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if nets:
            self.net.update((list(nets), list(nets.values()), due))
        else:
            self.net.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.net.get()
        nets, timer = (dict(zip(*held[:2], strict=True)), held[2]) if held else ({}, None)
        late: dict[tuple[int, int], int] = {}
        for frame in rows:
            for tick, block, met, delta in zip(*(frame[c].astype("int64").tolist() for c in ("tick", "block", "met_mark", "delta")), strict=True):
                if met < tick:
                    nets[tick] = nets.get(tick, 0) + delta
                else:
                    late[tick, block] = late.get((tick, block), 0) + delta
        fired = []
        for tick, block in sorted(late):
            if tick in nets:
                # the watermark has passed within this batch, so what waits is due before the late rows
                fired.append((tick, nets.pop(tick)))
            fired.append((tick, late[tick, block]))
        if held or nets:
            self._wait(nets, timer)
        return self._frames(key, fired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.net.get()
        nets = dict(zip(*held[:2], strict=True))
        passed = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        fired = [(tick, nets.pop(tick)) for tick in sorted(nets) if _fires_at(tick) <= passed]
        self._wait(nets, None)  # Spark takes away the timer that fired
        return self._frames(key, fired)

    def close(self) -> None:
        pass


def late_refinements(marked: DataFrame, span: timedelta = SPAN) -> DataFrame:
    """Per (tick, account) numbered partial nets as they fire (append), from the rows of `publish_marked`.

    Spark's watermark follows the one that rows met, one millisecond behind it so that no row of the same
    watermark is late. The counts of parts stay in state, one number per tick and account; the nets go as they fire.
    The ticks of an account within a `span` share a state value, as do their counts; it must stay the same for a checkpoint, and a
    shorter one suits times that are finer than hours.
    """
    legs = signed_legs(marked, "ts", "met", "block").where(F.col("ts") < F.lit(END_OF_TIME))
    closing = marked.where(F.col("ts") >= F.lit(END_OF_TIME)).select("ts", F.unix_micros("ts").alias("met"), "block", F.col("to_account").alias("account"), F.lit(0).cast("bigint").alias("delta"))
    sums = added_up(legs.unionByName(closing), ["ts", "met", "block", "account"], "delta")
    # Spark's watermark begins at the epoch and drops what is not behind it
    met_at = F.timestamp_micros(F.greatest("met", F.lit(1000)))
    timed = sums.select("*", met_at.alias("met_at")).withWatermark("met_at", "1 millisecond").where(F.col("met_at") < F.lit(END_OF_TIME))
    account = F.coalesce(F.col("account").cast("long"), F.lit(NO_ACCOUNT))  # frames have no NULL among integers
    placed = timed.select(account.alias("account"), event_tick().alias("tick"), "block", F.col("met").alias("met_mark"), "delta", "met_at")
    keyed = placed.withColumn("span", F.floor(F.col("tick") / F.lit(micros(span)))).groupBy("account", "span")
    return keyed.transformWithStateInPandas(_Refinements(), "tick long, account int, part long, net long", "append", "eventTime")
