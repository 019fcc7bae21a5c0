"""Late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickledger.functions import render
from tickledger.operators import lateness
from tickledger.plans.inputs import DELAY, KEPT, MARKED, TX, WATERMARK_EVERY, kept_transfers, sql, transfers
from tickledger.plans.registry import plan
from tickledger.sources import transactions as S
from tickledger.workspace import fresh_path

NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY arrival, id) AS row_no FROM tx)"
PERIODIC = f"""periodic AS (
  SELECT row_no, max(epoch_us(ts - INTERVAL 4 HOUR)) OVER (ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS wm
  FROM numbered WHERE row_no % {WATERMARK_EVERY} = 0)"""
PROGRESS = "SELECT DISTINCT epoch_us(watermark) AS watermark FROM marked"


@plan("late_split", sql(TX, MARKED, "SELECT id, ts, watermark, ts >= watermark AS kept FROM marked"))
def late_split(spark, folder):
    return lateness.late_split(transfers(spark, folder), DELAY)


@plan("accepted_on_time", sql(TX, MARKED, KEPT, "SELECT * FROM kept"))
def accepted_on_time(spark, folder):
    return kept_transfers(spark, folder)


@plan("progress_rows", sql(TX, MARKED, PROGRESS))
def progress_rows(spark, folder):
    return lateness.progress_rows(transfers(spark, folder), DELAY)


@plan(
    "progress_lines",
    sql(
        TX,
        MARKED,
        f"SELECT watermark, 'no more updates with timestamp < ' || watermark AS line FROM ({PROGRESS}) AS p",
    ),
)
def progress_lines(spark, folder):
    return render.progress_lines(lateness.progress_rows(transfers(spark, folder), DELAY))


@plan("input_lines", sql(TX, NUMBERED, "SELECT id, row_no FROM numbered"))
def input_lines(spark, folder):
    tx = transfers(spark, folder).select("id", "arrival")
    return lateness.numbered(tx).select("id", "row_no")


@plan("periodic_watermark", sql(TX, NUMBERED, PERIODIC, "SELECT row_no, wm FROM periodic"))
def periodic_watermark(spark, folder):
    return lateness.periodic_watermark(transfers(spark, folder), WATERMARK_EVERY, DELAY)


LATE_REFINEMENTS = sql(
    TX,
    NUMBERED,
    PERIODIC,
    "first_wm AS (SELECT wm, min(row_no) AS row_no FROM periodic GROUP BY wm)",
    """passed AS (
  SELECT t.ts, min(f.row_no) AS passed_no FROM (SELECT DISTINCT ts FROM tx) AS t
  LEFT JOIN first_wm AS f ON f.wm >= epoch_us(t.ts) GROUP BY t.ts)""",
    f"""fired AS (
  SELECT n.*, CASE WHEN passed_no IS NOT NULL
         AND greatest(passed_no, ((row_no + {WATERMARK_EVERY - 1}) // {WATERMARK_EVERY}) * {WATERMARK_EVERY})
             <= (SELECT max(row_no) FROM periodic)
         THEN greatest(passed_no, ((row_no + {WATERMARK_EVERY - 1}) // {WATERMARK_EVERY}) * {WATERMARK_EVERY}) END AS fire_no
  FROM numbered AS n JOIN passed USING (ts))""",
    """nets AS (
  SELECT epoch_us(ts) AS tick, account, fire_no, sum(delta) AS net FROM (
    SELECT ts, fire_no, to_account AS account, amount AS delta FROM fired
    UNION ALL SELECT ts, fire_no, from_account, -amount FROM fired) AS l
  GROUP BY ts, account, fire_no)""",
    """SELECT tick, account, row_number() OVER (PARTITION BY tick, account ORDER BY fire_no NULLS LAST) AS part,
       CAST(net AS BIGINT) AS net FROM nets""",
)


@plan("late_refinements", LATE_REFINEMENTS)
def late_refinements(spark, folder):
    return lateness.late_refinements(transfers(spark, folder), WATERMARK_EVERY, DELAY)


# Positions that one file of lines covers.
LINES_PER_FILE = 5000


def stored_lines(spark, folder):
    """The transfers as JSON lines in files by arrival, read back by the position of the line alone."""
    path = fresh_path(spark, "lines")
    number = F.lpad(F.floor(F.col("arrival") / LINES_PER_FILE).cast("string"), 12, "0").alias("number")
    rows = transfers(spark, folder).select(number, "arrival", "id", S.json_document().alias("line"))
    ordered = rows.repartition("number").sortWithinPartitions("number", "arrival", "id")
    ordered.select("number", "line").write.partitionBy("number").text(path)
    return S.read_numbered_json_lines(spark, path)


@plan("lines_late_split", sql(TX, MARKED, "SELECT id, ts, watermark, ts >= watermark AS kept FROM marked"))
def lines_late_split(spark, folder):
    return lateness.late_split(stored_lines(spark, folder), DELAY)


PER_FILE = f"""lines AS (
  SELECT *, arrival // {LINES_PER_FILE} AS file_no, row_number() OVER (PARTITION BY arrival // {LINES_PER_FILE} ORDER BY arrival, id) AS row_no
  FROM tx)"""


@plan(
    "files_periodic_watermark",
    sql(
        TX,
        PER_FILE,
        f"""SELECT file_no, row_no, max(epoch_us(ts - INTERVAL 4 HOUR)) OVER (ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS wm
FROM lines WHERE row_no % {WATERMARK_EVERY} = 0""",
    ),
)
def files_periodic_watermark(spark, folder):
    """The row count starts anew in each file, the watermark goes on."""
    marks = lateness.periodic_watermark_per_file(stored_lines(spark, folder), WATERMARK_EVERY, DELAY, "file")
    return marks.select(F.regexp_extract("file", "number=([0-9]+)", 1).cast("bigint").alias("file_no"), "row_no", "wm")
