"""Running streaming queries and publishing what they produce.

Every published folder is partitioned by micro-batch and a batch overwrites its own
partition only, so a batch that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickledger.functions.render import json_messages
from tickledger.operators import changelog as C
from tickledger.operators.scan import Fold, plan_layout, prefix_scan
from tickledger.schema import TX_COLUMNS, micros
from tickledger.streaming.log_table import LogTable, summing
from tickledger.streaming.progress import write_audited
from tickledger.workspace import fresh_path, pin

END_OF_TIME = datetime(9000, 1, 1, tzinfo=timezone.utc)
OPENING_TICK = -(2**63)
VIEWS = {
    "credits": C.credits_changelog,
    "debits": C.debits_changelog,
    "balance": C.balance_changelog,
    "total": C.total_changelog,
}


def run_available(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; a later run continues from the checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_until_read(writer: DataStreamWriter, checkpoint: str) -> StreamingQuery:
    """Process what is there batch by batch and stop; for sources that bound their batches themselves."""
    query = writer.option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def unread_sources(query: StreamingQuery) -> list[str]:
    """The sources of a finished query that gave it no row."""
    read: dict[str, int] = {}
    for report in query.recentProgress:
        for source in report["sources"]:
            read[source["description"]] = read.get(source["description"], 0) + source["numInputRows"]
    return [name for name, rows in read.items() if not rows]


def append_to(view: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """An append-mode view as a growing folder of files."""
    return run_available(view.writeStream.format(form).outputMode("append").option("path", path), checkpoint)


def append_messages(view: DataFrame, key: str | None, path: str, checkpoint: str) -> StreamingQuery:
    """An append-mode view as keyed JSON messages."""
    return append_to(json_messages(view, key), path, checkpoint)


def closing_row(spark: SparkSession) -> DataFrame:
    """One transfer far in the future: its arrival closes every open tick."""
    row = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("id"),
        F.lit(-1).cast("int").alias("from_account"),
        F.lit(-1).cast("int").alias("to_account"),
        F.lit(0).cast("bigint").alias("amount"),
        F.lit(END_OF_TIME).cast("timestamp").alias("ts"),
        F.lit(2**62).cast("bigint").alias("arrival"),
    )
    return row.select(*TX_COLUMNS)


def closed_stream(tx: DataFrame) -> DataFrame:
    """A finite stream that reads its input as one batch, with the closing row in that batch."""
    spark = tx.sparkSession
    path = fresh_path(spark, "closing-row")
    closing_row(spark).write.parquet(path)
    closing = spark.readStream.schema(closing_row(spark).schema).parquet(path)
    return tx.unionByName(closing.select(*tx.columns))


def publish_states(view: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An update-mode view: each batch writes the states it touched under batch=N."""

    def write(states: DataFrame, batch: int) -> None:
        states.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return run_available(view.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def publish_table(view: DataFrame, table: LogTable, checkpoint: str) -> StreamingQuery:
    """An update-mode view as a `LogTable`: each batch writes the partitions of the states it touched."""

    def write(states: DataFrame, batch: int) -> None:
        table.write(batch, pin(states, "states"))

    return run_available(view.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def publish_accepted(tx: DataFrame, delay: timedelta, path: str, checkpoint: str) -> StreamingQuery:
    """The rows of a stream that are on time, by the exact rule per row, each batch under rows/batch=N.

    Rows must stream in the order of `arrival`. A batch takes the running maximum of its event times on from
    the one value that the batch before it left under high/batch=N-1, and leaves its own.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        stored = pin(rows, "batch-rows")
        before = spark.read.parquet(f"{path}/high/batch={batch - 1}").first()[0] if batch else None
        layout = plan_layout(stored, "arrival")
        scanned = prefix_scan(stored, {"__high": Fold("max", "ts")}, order=["arrival", "id"], layout=layout)
        high = F.greatest(F.unix_micros("__high"), F.lit(before).cast("bigint"))
        kept = scanned.where(F.unix_micros("ts") >= high - micros(delay)).select(*rows.columns)
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        left = stored.agg(F.greatest(F.max(F.unix_micros("ts")), F.lit(before).cast("bigint")).alias("high"))
        left.write.mode("overwrite").parquet(f"{path}/high/batch={batch}")

    return run_available(tx.writeStream.outputMode("append").foreachBatch(write), checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What completely written batches published under batch=N, with the batch number as a column."""
    batches = [f"{path}/batch={b}" for b in published_batches(spark, path)]
    rows = spark.read.option("basePath", path).parquet(*batches)
    return rows.withColumn("batch", F.col("batch").cast("bigint"))


ACCOUNTS = T.StructType([T.StructField("account", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in C.SIDES]])


def accounts_table(spark: SparkSession, path: str, **options) -> LogTable:
    """The sides of all accounts so far, as `publish_changelogs` keeps them."""
    return LogTable(spark, f"{path}/accounts", ("account",), ACCOUNTS, summing(["account"], C.SIDES), **options)


def publish_changelogs(steps: DataFrame, path: str, checkpoint: str, *, entries: bool = False, audit: bool = False, names: Sequence[str] = tuple(VIEWS), **options) -> StreamingQuery:
    """Changelogs of credits, debits, balance and total, each batch adding its closed ticks.

    `steps` is the append-mode `account_steps`. One query writes all four views from the same rows, so they agree at
    every tick. The account sides so far are a `LogTable` (`options` go to it): a batch reads and writes only the partitions of its own
    accounts; of all others it needs their total and their number, one row that the batch before it left. With `entries`
    the credit and debit entries are also written as lines in the order of ticks, under entries/batch=N, with `audit` the total
    after each tick, and the zero-sum audit of these from the pass that writes them, under audit/batch=N.
    """

    def write(closed: DataFrame, batch: int) -> None:
        spark = closed.sparkSession
        stored = pin(closed, "closed-steps")  # the batch itself must run once only
        if stored.isEmpty():
            return
        table = accounts_table(spark, path, **options)
        opening = pin(table.state(stored.select("account"), before=batch), "opening-sides")
        rest = _rest(spark, opening, f"{path}/totals", batch)
        rows = stored.unionByName(opening.withColumn("tick", F.lit(OPENING_TICK).cast("bigint")))
        current = C.scanned_once(C.Steps(rows, plan_layout(rows, "tick", ["account"])))
        for name in names:
            made = VIEWS[name](current, rest) if name == "total" else VIEWS[name](current)
            made.where(F.col("tick") > OPENING_TICK).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
        if audit:
            totals = C.total_by_tick(current, rest[0]).where(F.col("tick") > OPENING_TICK)
            write_audited(totals, f"{path}/totals_by_tick/batch={batch}", f"{path}/audit/batch={batch}")
        if entries:
            ordered_lines(_entries_of(spark, path, batch), "tick", f"{path}/entries/batch={batch:012d}")
        moves = C.balance_moves(current).agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("total"), F.coalesce(F.sum("accounts"), F.lit(0)).alias("accounts"))
        left = moves.select((F.col("total") + rest[0]).alias("total"), (F.col("accounts") + rest[1]).alias("accounts"))
        left.write.mode("overwrite").parquet(f"{path}/totals/batch={batch}")
        table.write(batch, stored)

    return run_available(steps.writeStream.outputMode("append").foreachBatch(write), checkpoint)


def _rest(spark: SparkSession, opening: DataFrame, totals: str, batch: int) -> tuple[int, int]:
    """Sum and number of the balances before this batch that it does not touch."""
    known = [b for b in published_batches(spark, totals) if b < batch]
    if not known:
        return 0, 0
    before = spark.read.parquet(f"{totals}/batch={max(known)}").first()
    two_sided = opening.where((F.col("credit_rows") > 0) & (F.col("debit_rows") > 0))
    own = two_sided.agg(F.coalesce(F.sum(F.col("credit") - F.col("debit")), F.lit(0)).alias("total"), F.count("*").alias("accounts")).first()
    return before["total"] - own["total"], before["accounts"] - own["accounts"]


def _entries_of(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """Credit (side 0) and debit (side 1) entries of a batch."""

    def side(name: str, number: int) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{name}/batch={batch}")
        return rows.select("tick", "account", F.lit(number).alias("side"), F.col(name).alias("value"), F.col("diff").cast("long").alias("diff"))

    return side("credits", 0).unionByName(side("debits", 1))


def close_lines(spark: SparkSession, path: str) -> None:
    """One entry at the end of time behind all lines of `path`, which closes the ticks before it."""
    last = max(published_batches(spark, path), default=0) + 1
    end = spark.range(1).select(F.unix_micros(F.lit(END_OF_TIME)).alias("tick"), F.lit(0).alias("account"), F.lit(0).alias("side"), F.lit(0).alias("value"), F.lit(0).alias("diff"))
    ordered_lines(end, "tick", f"{path}/batch={last:012d}")


def ordered_lines(rows: DataFrame, by: str, path: str) -> None:
    """Rows as JSON lines whose files, by name, follow the order of `by`; rows equal in it share a file."""
    placed = rows.repartitionByRange(by).sortWithinPartitions(by)
    placed.select(F.to_json(F.struct(*rows.columns)).alias("line")).write.mode("overwrite").text(path)


def published_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written batches of a folder (names only)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done if n.startswith("batch="))


def watermark_progress(query: StreamingQuery) -> list[tuple[int, str]]:
    """(batch, watermark) of the query's recent batches, from its progress reports."""
    reports = query.recentProgress
    return [(p["batchId"], p["eventTime"]["watermark"]) for p in reports if "watermark" in p["eventTime"]]
