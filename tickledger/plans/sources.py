"""Decoding, keyed tables and generated data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickledger.operators import changelog as C
from tickledger.plans.inputs import TX, UPSERTS, sql, transfers, upserts
from tickledger.plans.registry import plan
from tickledger.schema import TIMESTAMP_FORMAT
from tickledger.sources import generate
from tickledger.sources import transactions as S
from tickledger.sources.tables import table

JSON_TEXT = """'{"id":' || id || ',"from_account":' || from_account || ',"to_account":' || to_account
       || ',"amount":' || amount || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000"}'"""
WIRE_OUT = "SELECT id, from_account, to_account, amount, ts FROM tx"


@plan("tx_from_bytes", sql(TX, WIRE_OUT))
def tx_from_bytes(spark, folder):
    """Every transfer to UTF-8 JSON bytes and strictly back."""
    messages = transfers(spark, folder).select(F.encode(S.json_document(), "UTF-8").alias("value"))
    return S.decode_json(messages)


@plan("tx_keyed_lines", sql(TX, f"SELECT CAST(id AS VARCHAR) AS key, {JSON_TEXT} AS value FROM tx"))
def tx_keyed_lines(spark, folder):
    return S.split_keyed_lines(S.keyed_lines(transfers(spark, folder)))


@plan("tx_keyed_records", sql(TX, "SELECT CAST(id AS VARCHAR) AS key, id, from_account, to_account, amount, ts FROM tx"))
def tx_keyed_records(spark, folder):
    """Keyed lines all the way to typed rows."""
    return S.decode_json(S.split_keyed_lines(S.keyed_lines(transfers(spark, folder))))


@plan(
    "tx_upsert",
    sql(
        TX,
        UPSERTS,
        """SELECT key, id, from_account, to_account, amount, ts, arrival FROM upserts
QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC, id DESC) = 1""",
    ),
)
def tx_upsert(spark, folder):
    return C.latest(upserts(spark, folder), "key", "arrival")


@plan(
    "tx_event_time",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, date_trunc('millisecond', ts) AS event_time FROM events",
)
def tx_event_time(spark, folder):
    """Event time from the record's text field, by its declared format."""
    events = table(spark, folder, "events")
    text = events.select("event_id", F.date_format("ts", TIMESTAMP_FORMAT).alias("ts_text"))
    return text.withColumn("event_time", S.event_time("ts_text"))


@plan("event_epoch", "SELECT event_id, epoch_us(ts) AS tick FROM events")
def event_epoch(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"))


@plan(
    "json_fields",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_dynamic FROM events""",
)
def json_fields(spark, folder):
    """A field of a JSON document by schema, by path, and from a document of unknown shape."""
    parsed = F.from_json("props", "k BIGINT", {"mode": "FAILFAST"})
    return table(spark, folder, "events").select(
        "event_id",
        parsed["k"].alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k_dynamic"),
    )


@plan(
    "casts",
    """SELECT event_id, CAST(event_id AS INTEGER) AS as_int, CAST(event_id AS VARCHAR) AS as_text,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_double,
       CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS as_timestamp,
       epoch_us(ts) // 100 AS scaled,
       TRY_CAST(event_type AS INTEGER) AS lenient FROM events""",
)
def casts(spark, folder):
    """Strict casts raise on bad input; `lenient` shows the NULL of a tolerant one."""
    events = table(spark, folder, "events")
    at = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        F.col("event_id").cast("int").alias("as_int"),
        F.col("event_id").cast("string").alias("as_text"),
        F.get_json_object("props", "$.k").cast("double").alias("as_double"),
        at.cast("string").cast("timestamp").alias("as_timestamp"),
        F.floor(F.unix_micros(at).cast("decimal(20,0)") / 1_000_000 * 10_000).cast("bigint").alias("scaled"),
        F.col("event_type").try_cast("int").alias("lenient"),
    )


@plan("arrival_order", sql(TX, "SELECT arrival, id, ts FROM tx ORDER BY arrival, id"))
def arrival_order(spark, folder):
    return transfers(spark, folder).select("arrival", "id", "ts").orderBy("arrival", "id")


GENERATED_SECOND = "60 * event_id // (SELECT count(*) FROM events)"


@plan(
    "gen_simplified",
    f"""SELECT event_id AS id, CAST(event_id % 10 AS INTEGER) AS from_account,
       CAST((event_id % 10 + 1) % 10 AS INTEGER) AS to_account, CAST(1 AS BIGINT) AS amount,
       TIMESTAMP '2021-01-01 00:00:00' + to_seconds({GENERATED_SECOND}) AS ts, event_id AS arrival FROM events""",
)
def gen_simplified(spark, folder):
    """One in-order transfer per event."""
    events = table(spark, folder, "events")
    return generate.simplified(events.select(F.col("event_id").alias("id")), F.lit(events.count()))


def _drawn(bound: int, part: int) -> str:
    x = f"(event_id + {part + 1} * 1000003) % 2147483647"
    for step in range(4):
        x = f"list_transform([{x}], lambda x: (x * (x + 40503) + 12345 * {step + 1}) % 2147483647)[1]"
    return f"{x} * {bound} // 2147483647"


@plan(
    "gen_original",
    f"""WITH sent AS (
  SELECT event_id AS id, CAST({_drawn(10, 0)} AS INTEGER) AS from_account,
         CAST({_drawn(10, 1)} AS INTEGER) AS to_account, CAST(1 AS BIGINT) AS amount,
         TIMESTAMP '2021-01-01 00:00:00' + to_seconds({GENERATED_SECOND}) AS ts,
         {GENERATED_SECOND} * 1000000 + ({_drawn(10_000_000, 2)}) AS arrives_at FROM events)
SELECT id, from_account, to_account, amount, ts, row_number() OVER (ORDER BY arrives_at, id) - 1 AS arrival FROM sent""",
)
def gen_original(spark, folder):
    """One randomly delayed transfer per event."""
    events = table(spark, folder, "events")
    return generate.original(events.select(F.col("event_id").alias("id")), F.lit(events.count()))
