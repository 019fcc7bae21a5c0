"""Rows and changelog entries as text and as JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed output forms, matched by the readers of these lines.
INSERT, DELETE, MISSING = "insert", "delete", "null"


def _texts(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns]


def _verb() -> Column:
    return F.when(F.col("diff") > 0, F.lit(INSERT)).otherwise(F.lit(DELETE))


def retract_lines(changelog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`insert 3,17` / `delete 3,17`: one line per changelog row."""
    row = F.concat_ws(",", *_texts(columns))
    return changelog.select("tick", "diff", F.concat_ws(" ", _verb(), row).alias("line"))


def multiset_lines(changelog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`insert 2x (3, 17) at 1609459200000000`: one line per row, copies counted."""
    row = F.concat(F.lit("("), F.concat_ws(", ", *_texts(columns)), F.lit(")"))
    copies = F.concat(F.abs("diff").cast("string"), F.lit("x"))
    line = F.concat_ws(" ", _verb(), copies, row, F.lit("at"), F.col("tick").cast("string"))
    return changelog.select("tick", "diff", line.alias("line"))


def progress_lines(progress: DataFrame, watermark: str = "watermark") -> DataFrame:
    text = F.concat(F.lit("no more updates with timestamp < "), F.col(watermark).cast("string"))
    return progress.select(watermark, text.alias("line"))


def json_messages(view: DataFrame, key: str | None = None) -> DataFrame:
    """A view as keyed messages: the key as text, the row as one JSON object."""
    name = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    return view.select(name.alias("key"), F.to_json(F.struct(*view.columns), {"ignoreNullFields": "false"}).alias("value"))


def parse_totals(lines: DataFrame, line: str = "line") -> DataFrame:
    """Totals out of rendered output: `insert N` lines, deletes skipped."""
    number = F.regexp_extract(F.col(line), rf"^{INSERT} (-?\d+)$", 1)
    keep = [c for c in lines.columns if c != line]
    return lines.where(F.col(line).startswith(INSERT)).select(*keep, number.try_cast("bigint").alias("total"))


def parse_json_totals(messages: DataFrame, field: str, value: str = "value") -> DataFrame:
    keep = [c for c in messages.columns if c != value]
    return messages.select(*keep, F.get_json_object(F.col(value), f"$.{field}").cast("bigint").alias("total"))
