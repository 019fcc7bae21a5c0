"""Run registered queries and their SQL side by side: python tests/check_against_sql.py FOLDER [NAME ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def bag(columns: list[str], rows) -> Counter:
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(
        tuple(int(v) if isinstance(v, Decimal) and v == int(v) else v for v in (row[i] for i in places)) for row in rows
    )


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    df = entry.queries()[name](spark, folder)
    ours = bag(df.columns, df.collect())
    text = entry.oracle_sql().get(name)
    if text is None:
        return None if ours else "no rows"
    result = con.execute(text)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    theirs = bag(columns, result.fetchall())
    if ours == theirs:
        return None
    extra, missing = ours - theirs, theirs - ours
    return f"{ours.total()} / {theirs.total()} rows; extra {list(extra)[:2]}; missing {list(missing)[:2]}"


def main(folder: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wrong = 0
    for name in names or list(entry.queries()):
        started = time.time()
        try:
            found = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += found is not None
        print(f"{'ok' if found is None else 'DIFF':4} {time.time() - started:6.1f}s {name} {found or ''}", flush=True)
    print(f"{wrong} differ")
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
