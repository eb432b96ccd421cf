"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clock, intervals, loglines
from tidemark.plans import reference
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _unparsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_lines").where(F.col("parse_status") == "UNPARSED")


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    return loglines.entries(_unparsed(spark, d), "file_id", "line_no", "raw_line")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = loglines.entries(_unparsed(spark, d), "file_id", "line_no", "raw_line", message=False)
    return found.select("file_id", "line_no", "line_span", "level_norm", "logger")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = clock.candidates(*[table(spark, d, t) for t in ("parse_results", "files", "packages", "clock_anchors")])
    return clock.resolve(found)


def _phase_runs(spark: SparkSession, d: str) -> DataFrame:
    spans = intervals.spans(table(spark, d, "log_lines"), ["run_id", "component", "file_id", "ota_phase"], "ts_utc")
    return intervals.run_bitmaps(spans, ["run_id", "component"], "start_us", "end_us")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = intervals.clear_runs(_phase_runs(spark, d), ["run_id", "component"])
    return gaps.where(F.col("gap_to_us") - F.col("gap_from_us") >= 30_000_000)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.set_runs(_phase_runs(spark, d), ["run_id", "component"])


QUERIES: dict[str, Query] = {**reference.QUERIES, "p1_found": p1_found, "p1_entries": p1_entries, "p4_found": p4_found, "p6_found": p6_found, "p6_periods": p6_periods}

_SPANS = """
WITH s AS (SELECT run_id, component, epoch_us(min(ts_utc)) AS a, epoch_us(max(ts_utc)) AS b FROM log_lines
  WHERE ts_utc IS NOT NULL AND run_id IS NOT NULL AND component IS NOT NULL AND file_id IS NOT NULL AND ota_phase IS NOT NULL
  GROUP BY run_id, component, file_id, ota_phase),
m AS (SELECT *, max(b) OVER (PARTITION BY run_id, component ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
p AS (SELECT *, sum(CASE WHEN a <= before THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, component ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS period FROM m)"""
ORACLE: dict[str, str] = {
    **reference.ORACLE,
    "p6_found": _SPANS + " SELECT run_id, component, before AS gap_from_us, a AS gap_to_us FROM m WHERE a - before >= 30000000",
    "p6_periods": _SPANS + " SELECT run_id, component, min(a) AS start_us, max(b) AS end_us FROM p GROUP BY run_id, component, period",
}
