"""Progress of running queries: watermark lines from a listener, audits observed while publishing, state read back."""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickledger.operators.changelog import SIDES


class ProgressLines(StreamingQueryListener):
    """Notes each advance of a query's watermark as (batch, watermark in epoch microseconds), in order.

    What is held per query is one pair for each advance; `on_line` gets every line as it comes, for a sink of one's own.
    """

    def __init__(self, on_line=None):
        self.on_line = on_line
        self._seen: dict[str, list[tuple[int, int]]] = {}
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def _event(self, query: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(query, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._event(str(event.runId))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        mark = (progress.eventTime or {}).get("watermark")
        if mark is None:
            return
        at = round(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp() * 1000) * 1000
        with self._lock:
            marks = self._seen.setdefault(str(progress.runId), [])
            if at <= 0 or (marks and at <= marks[-1][1]):
                return
            marks.append((progress.batchId, at))
        if self.on_line is not None:
            self.on_line(line_of(at))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._event(str(event.runId)).set()

    def marks(self, query, wait_seconds: float = 60.0) -> list[tuple[int, int]]:
        """(batch, watermark) of a query that has ended; its last report comes before its end is told."""
        self._event(str(query.runId)).wait(wait_seconds)
        with self._lock:
            return list(self._seen.get(str(query.runId), []))


def line_of(watermark: int) -> str:
    return f"no more updates with timestamp < {watermark}"


# ---------------------------------------------------------------- audits in the publishing pass


def write_audited(totals: DataFrame, path: str, audit: str) -> None:
    """Write totals (tick, total) and, from the same pass, what `zero_sum` counts of them as one row."""
    off = F.col("total") != 0
    seen = Observation()
    metrics = [
        F.count(F.lit(1)).alias("outputs"),
        F.count_if(off).alias("nonzero"),
        F.min(F.when(off, F.col("tick"))).alias("first_nonzero"),
        F.max(F.when(off, F.col("tick"))).alias("last_nonzero"),
        F.max(F.abs("total")).alias("max_abs"),
    ]
    totals.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    found = seen.get
    row = totals.sparkSession.range(1).select(*[F.lit(found[c]).cast("bigint").alias(c) for c in ("outputs", "nonzero", "first_nonzero", "last_nonzero", "max_abs")])
    row.write.mode("overwrite").parquet(audit)


def zero_sum_of(audits: DataFrame) -> DataFrame:
    """The rows that batches left, as one audit over all of them."""
    return audits.agg(
        F.coalesce(F.sum("outputs"), F.lit(0)).cast("bigint").alias("outputs"),
        F.coalesce(F.sum("nonzero"), F.lit(0)).cast("bigint").alias("nonzero"),
        F.min("first_nonzero").alias("first_nonzero"),
        F.max("last_nonzero").alias("last_nonzero"),
        F.max("max_abs").alias("max_abs"),
    )


# ---------------------------------------------------------------- state


def account_sides(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(account, sides) as the state of an `eager_accounts` query holds them after its last committed batch."""
    state = spark.read.format("statestore").load(checkpoint)
    # the sums carry one name in state, so they are told apart by their places
    named = F.col("value").cast("struct<" + ",".join(f"{c}:bigint" for c in SIDES) + ">")
    return state.select("key.account", named.alias("sides")).select("account", "sides.*")
