"""The list of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.workspace import prepare

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Plan:
    run: Query
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        if name in PLANS:
            raise ValueError(f"two plans named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _without_zone(query(prepare(spark), folder))

        PLANS[name] = Plan(run, sql)
        return query

    return register


def _without_zone(df: DataFrame) -> DataFrame:
    """Timestamps leave as wall-clock UTC, the way the stored tables hold them."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    if not zoned:
        return df
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns])
