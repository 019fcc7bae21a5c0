"""The one input record and the logical-time helpers every view shares.

Logical times ("ticks") are BIGINTs: epoch microseconds for event time, the input
position for arrival time. Amounts are whole minor units, so sums are exact and do not
depend on the order in which a shuffle delivers rows.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"

# What travels on the wire (JSON). `arrival` is the position in the input, not a field of it.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("from_account", T.IntegerType()),
        T.StructField("to_account", T.IntegerType()),
        T.StructField("amount", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
WIRE_COLUMNS = tuple(WIRE_SCHEMA.fieldNames())
ARRIVAL = T.StructField("arrival", T.LongType())
TX_SCHEMA = T.StructType([*WIRE_SCHEMA.fields, ARRIVAL])
TX_COLUMNS = tuple(TX_SCHEMA.fieldNames())


def micros(delay: timedelta) -> int:
    return delay // timedelta(microseconds=1)


def event_tick(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts))
