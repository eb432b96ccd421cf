"""Evidence rows cut down to a budget: tiers, quotas, folds, block summaries, and all of them in turn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import estimated_tokens
from tidemark.operators.sequence import SHARD_US, with_before
from tidemark.session import materialize

# fixed values: words that keep a row, rows of a template kept, rows of a rare template, quota, rows folded into a list
KEEP_WORDS = [
    "error", "fail", "failed", "failure", "exception", "abort", "aborted", "crash", "panic", "denied", "timeout", "timed out",
    "fatal", "nrc", "reject", "corrupt", "insufficient", "unavailable", "错误", "失败", "异常", "中止", "超时", "拒绝",
]
CAP, RARE, QUOTA = 50, 5, 3
# fixed values: folds, and of a window components and templates, that are listed; length of samples
FOLDS, WINDOW_COMPONENTS, WINDOW_TEMPLATES, FOLD_SAMPLE, WINDOW_SAMPLE = 40, 8, 12, 160, 120
#: parts in which a template's rows are ranked first, as lines without a template are one hot group
SHARDS = 64


def kept(level: Column, text: Column) -> Column:
    out = level.isin("ERROR", "FATAL")
    for word in KEEP_WORDS:
        out = out | F.lower(text).contains(word)
    return F.coalesce(out, F.lit(False))


def tiers(rows: DataFrame, cap: int = CAP, rare: int = RARE, quota: int = QUOTA) -> DataFrame:
    """Adds tier (3 kept by level or word, 2 rare template, 1 other) and keep, of rows with template_id, occurrences, level_norm,
    raw_line, ts_utc and line_id.

    Of a template, tier 3 keeps the first cap - 1 rows and the last, tier 2 all, tier 1 the first `quota`. Rows without template_id
    are a group of their own. A group is ranked within shards first; only the head and the last row of each shard can be the
    group's, so the second ranking sees at most SHARDS times as many rows as are kept, whatever the size of the group.
    """
    tier = F.when(kept(F.col("level_norm"), F.col("raw_line")), 3).when(F.col("occurrences").between(1, rare), 2).otherwise(1)
    order = [F.asc_nulls_last("ts_utc"), F.asc("line_id")]
    part = F.pmod(F.xxhash64("line_id"), F.lit(SHARDS)).cast("int")

    def ranked(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy("template_id", "tier", *by).orderBy(*order)
        return df.withColumn("_first", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())

    sharded = ranked(rows.withColumn("tier", tier).withColumn("_part", part), "_part")
    # -1: the rows that the second ranking is about; the others stay in their shards
    edge = (F.col("_first") <= max(cap - 1, quota)) | F.col("_last")
    whole = ranked(sharded.withColumn("_part", F.when(edge, -1).otherwise(F.col("_part"))), "_part")
    keep = F.when(F.col("tier") == 3, (F.col("_first") < cap) | F.col("_last")).otherwise(F.col("_first") <= quota)
    return whole.withColumn("keep", (F.col("tier") == 2) | (F.col("_part") == -1) & keep).drop("_part", "_first", "_last")


def folds(tiered: DataFrame) -> DataFrame:
    """tier, template_id, folded, first_us, last_us, components and sample (the first one's text) of the rows that are not kept."""
    first = F.min_by(F.substring("raw_line", 1, FOLD_SAMPLE), F.struct(F.col("ts_utc").isNull(), "ts_utc", "line_id"))
    return tiered.where(~F.col("keep")).groupBy("tier", "template_id").agg(
        F.count(F.lit(1)).alias("folded"),
        F.min(F.unix_micros("ts_utc")).alias("first_us"),
        F.max(F.unix_micros("ts_utc")).alias("last_us"),
        F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"),
        first.alias("sample"),
    )


def within_budget(rows: DataFrame, by: list[str], text: str, budget: int, shard_us: int = SHARD_US) -> DataFrame:
    """The rows of each group, in time order, whose tokens together stay within the budget; tokens and spent are added.

    Sums run within days (rows without time are last); days that begin beyond the budget are left out before they are sorted.
    """
    last = F.lit(2**62).cast("bigint")
    counted = rows.withColumn("tokens", estimated_tokens(F.col(text))).withColumn("_block", F.coalesce(F.floor(F.unix_micros("ts_utc") / shard_us), last))
    begun = with_before(counted, by, F.sum("tokens"), F.sum("_s"), "_spent").withColumn("_spent", F.coalesce("_spent", F.lit(0)))
    order = Window.partitionBy(*by, "_block").orderBy(F.asc_nulls_last("ts_utc"), "line_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        begun.where(F.col("_spent") <= budget)
        .withColumn("spent", F.col("_spent") + F.sum("tokens").over(order))
        .where(F.col("spent") <= budget)
        .drop("_block", "_spent")
    )


def block_summaries(rows: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """by, block (epoch seconds), lines, errors, components and templates (counts of distinct ones)."""
    return (
        rows.where(F.col("ts_utc").isNotNull())
        .groupBy(*by, (F.floor(F.unix_micros("ts_utc") / (seconds * 1_000_000)) * seconds).alias("block"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("level_num") >= 40).alias("errors"),
            F.countDistinct("component").alias("components"),
            F.countDistinct("template_id").alias("templates"),
        )
    )


def window_summaries(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """window (epoch seconds, null for rows without time), lines, components and templates (the first few in order), levels
    (array of level, n by level), sample (the first one's text)."""
    window = (F.floor(F.unix_micros("ts_utc") / (seconds * 1_000_000)) * seconds).alias("window")
    first = F.min_by(F.substring("raw_line", 1, WINDOW_SAMPLE), F.struct("ts_utc", "line_id"))
    by_level = rows.groupBy(window, F.coalesce("level_norm", F.lit("")).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("component").alias("components"), F.collect_set("template_id").alias("templates"),
        F.min(F.struct("ts_utc", "line_id")).alias("at"), first.alias("text"),
    )
    few = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, n)
    return by_level.groupBy("window").agg(
        F.sum("n").alias("lines"), few("components", WINDOW_COMPONENTS).alias("components"), few("templates", WINDOW_TEMPLATES).alias("templates"),
        F.array_sort(F.collect_list(F.struct("level", "n"))).alias("levels"), F.min_by("text", "at").alias("sample"),
    )


def row_text(preview: int = 200) -> Column:
    """What a row is for a reader, and is counted as."""
    parts = ["ts_utc", "component", "level_norm", "ota_phase", F.substring("raw_line", 1, preview), "raw_line"]
    return F.concat_ws(" | ", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


@dataclass
class Compressed:
    """Kept rows, folds, summaries of what neither holds (no rows if the budget does), and the figures of it all."""

    kept: DataFrame
    folded: DataFrame
    windows: DataFrame
    trace: dict


def compress(rows: DataFrame, budget: int, seconds: int = 60, cap: int = CAP, rare: int = RARE, quota: int = QUOTA) -> Compressed:
    """rows (as for tiers, with ota_phase) cut down to a budget of estimated tokens.

    First by tiers. If what they keep is still too much, only errors are kept, in time order as far as the budget goes, and the
    others are summed up by window. The trace has one row's worth of figures; the FOLDS largest folds are listed.
    """
    tiered = materialize(tiers(rows, cap, rare, quota).withColumn("_text", row_text()))
    tokens = estimated_tokens(F.col("_text"))
    kept = tiered.where("keep")
    figures = tiered.agg(
        F.count(F.lit(1)).alias("input_rows"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens_before"), F.count_if("keep").alias("kept_rows"),
        F.coalesce(F.sum(F.when(F.col("keep"), tokens)), F.lit(0)).alias("tokens_after"),
    ).first().asDict()
    over = figures["tokens_after"] > budget
    windows = window_summaries(kept.where(F.lit(False)), seconds)
    if over:
        errors = materialize(within_budget(kept.where(F.col("level_norm").isin("ERROR", "FATAL")).withColumn("_all", F.lit(1)), ["_all"], "_text", budget).drop("_all"))
        windows = window_summaries(kept.join(errors.select("line_id"), "line_id", "left_anti"), seconds)
        left = errors.agg(F.count(F.lit(1)).alias("kept_rows"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_after")).first()
        kept, figures = errors.drop("tokens", "spent"), figures | left.asDict()
    folded = folds(tiered)
    before = figures["tokens_before"]
    trace = figures | {
        "budget_tokens": budget, "compression_ratio": round(figures["tokens_after"] / before, 4) if before else 1.0, "slide_window_applied": over,
        "folded_total": folded.agg(F.coalesce(F.sum("folded"), F.lit(0))).first()[0],
    }
    listed = folded.orderBy(F.desc("folded"), "tier", "template_id").limit(FOLDS)
    return Compressed(kept.drop("_text", "keep"), listed, windows, trace)
