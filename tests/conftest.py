from __future__ import annotations

import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tickledger.schema import TX_SCHEMA  # noqa: E402
from tickledger.workspace import prepare  # noqa: E402

BASE = datetime(2021, 1, 1, tzinfo=timezone.utc)
BASE_MICROS = int(BASE.timestamp()) * 1_000_000


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tickledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


def at(second: int) -> datetime:
    return BASE + timedelta(seconds=second)


def tick(second: int) -> int:
    return BASE_MICROS + second * 1_000_000


# (id, from, to, amount, second, arrival): the six hand-checked transfers.
SIX = [(0, 0, 1, 10, 0, 0), (1, 1, 2, 5, 1, 1), (2, 2, 0, 7, 8, 2), (3, 0, 2, 1, 3, 3), (4, 1, 0, 2, 2, 4), (5, 2, 1, 4, 9, 5)]


def ledger(spark, rows):
    return spark.createDataFrame([(i, f, t, a, at(s), p) for i, f, t, a, s, p in rows], TX_SCHEMA)


@pytest.fixture
def six(spark):
    return ledger(spark, SIX)


def rows(df):
    return sorted(tuple(r) for r in df.collect())
