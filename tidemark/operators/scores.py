"""Quality and evaluation figures as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: thresholds of the quality checks
MAX_UNPARSED, MIN_CONFIDENT, CONFIDENT = 0.05, 0.80, 0.6


def quality(lines: DataFrame) -> DataFrame:
    """One row of counts and shares over a whole build."""
    n = F.count(F.lit(1))
    return lines.agg(
        n.alias("rows"),
        F.count_if(F.col("parse_status") == "UNPARSED").alias("unparsed"),
        F.count_if(F.col("ts_confidence") >= CONFIDENT).alias("confident"),
        F.count_if(F.col("ts_utc").isNull()).alias("without_time"),
        F.count_if(F.coalesce(F.col("row_hash"), F.lit("")) == "").alias("without_hash"),
        F.countDistinct("line_id").alias("distinct_ids"),
        F.countDistinct("template_id").alias("templates"),
        F.count_if(F.array_contains("anomaly_flags", "OUT_OF_ORDER")).alias("out_of_order"),
        F.count_if(F.array_contains("anomaly_flags", "MULTILINE")).alias("multiline"),
        F.count_if(F.array_contains("anomaly_flags", "CLOCK_JUMP")).alias("clock_jumps"),
        F.count_if(F.array_contains("anomaly_flags", "STORM")).alias("storm_lines"),
        F.count_if(F.col("line_span") > 1).alias("spanning"),
        F.min(F.unix_micros("ts_utc")).alias("first_us"),
        F.max(F.unix_micros("ts_utc")).alias("last_us"),
        F.max("dup_count").alias("most_copies"),
    )


def checks(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """check, passed: one row for each quality check; with files also whether their records are as many as the lines."""
    q = quality(lines)
    share = lambda a: F.col(a) / F.greatest(F.col("rows"), F.lit(1))
    tests = {
        "unparsed": share("unparsed") <= MAX_UNPARSED,
        "confident": share("confident") >= MIN_CONFIDENT,
        "time": F.col("without_time") == 0,
        "templates": F.col("templates") > 0,
        "ids": F.col("distinct_ids") == F.col("rows"),
        "hashes": F.col("without_hash") == 0,
    }
    if files is not None:
        counted = files.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("n"))
        tests["records"] = counted.scalar() == F.col("rows")
    return q.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in tests.items()])).alias("x")).select("x.*")


def distributions(lines: DataFrame) -> DataFrame:
    """of (component, ts_kind, level_norm, parser_name, ota_phase), value, n, errors: lines by each of these, in one pass."""
    of = ["component", "ts_kind", "level_norm", "parser_name", "ota_phase"]
    by = lines.select(*of, (F.col("level_num") >= 40).alias("_bad")).groupingSets([[c] for c in of], *of)
    name = F.lit(of[-1])
    for c in of[:-1]:
        name = F.when(F.grouping(c) == 0, c).otherwise(name)
    out = by.agg(name.alias("of"), F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("errors"))
    return out.select("of", F.coalesce(*of).alias("value"), "n", "errors")


def report(lines: DataFrame, files: DataFrame | None = None) -> dict:
    """Figures, checks and distributions of a build as one document; some hundred rows at most come to the driver."""
    by: dict[str, dict] = {}
    for r in distributions(lines).orderBy("of", F.desc("n"), "value").collect():
        by.setdefault(r.of, {})[r.value] = {"n": r.n, "errors": r.errors}
    passed = {r.check: r.passed for r in checks(lines, files).collect()}
    return {**quality(lines).first().asDict(), "checks": passed, "passed": all(passed.values()), "by": by}


def report_text(found: dict) -> str:
    """The document for reading, in Markdown."""
    lines = ["# Quality of the evidence", "", *[f"- {k}: {v}" for k, v in found.items() if k not in ("checks", "passed", "by")], "", "| check | passed |", "|-|-|"]
    lines += [f"| {k} | {'yes' if v else 'no'} |" for k, v in found["checks"].items()]
    for of, values in found["by"].items():
        lines += ["", f"| {of} | lines | errors |", "|-|-|-|", *[f"| {k} | {v['n']} | {v['errors']} |" for k, v in values.items()]]
    return "\n".join([*lines, "", f"All checks passed: {'yes' if found['passed'] else 'no'}", ""])


def nearest_rank(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each share: the value at position round((n - 1) * share) of the sorted values, without nulls.

    The position is found by counting equal values, so no group's values are collected into a row.
    """
    from pyspark.sql import Window

    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))

    def at(share: float) -> Column:
        position = F.bround((F.col("_all") - 1) * F.lit(share))
        return F.min(F.when(F.col("_to") > position, F.col(value)))

    return placed.groupBy(*by).agg(*[at(s).alias(name) for name, s in shares.items()])


def repeat_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, std (sample) of repeated measurements."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("std")
    )


def confidence_interval(mean: float, std: float, n: int, share: float = 0.95) -> tuple[float, float]:
    """Of a mean, by Student's t; the quantile by bisection of the density's integral."""
    import math

    if n < 2:
        return mean, mean
    v = n - 1
    c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)

    def cdf(x: float, steps: int = 2000) -> float:
        h = x / steps
        f = lambda t: c * (1 + t * t / v) ** (-(v + 1) / 2)
        return 0.5 + h / 3 * (f(0) + f(x) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps)))

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < (1 + share) / 2 else (lo, mid)
    half = lo * std / math.sqrt(n)
    return mean - half, mean + half


def template_stats(lines: DataFrame) -> DataFrame:
    """template_id, occurrences, components (sorted, joined), level_mode (most frequent, ties by name), first_us, last_us, error_like."""
    by_level = lines.where(F.col("template_id").isNotNull()).groupBy("template_id", "level_norm").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("component").alias("components"),
        F.min(F.unix_micros("ts_utc")).alias("first_us"), F.max(F.unix_micros("ts_utc")).alias("last_us"),
    )
    return by_level.groupBy("template_id").agg(
        F.sum("n").alias("occurrences"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("components")))), ",").alias("components"),
        F.max_by("level_norm", F.struct("n", "level_norm")).alias("level_mode"),
        F.min("first_us").alias("first_us"),
        F.max("last_us").alias("last_us"),
    ).withColumn("error_like", F.col("level_mode").isin("ERROR", "FATAL"))


def file_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("records"), F.max(F.col("line_no") + F.col("line_span") - 1).alias("lines"),
        F.min(F.unix_micros("ts_utc")).alias("first_us"), F.max(F.unix_micros("ts_utc")).alias("last_us"),
    )
