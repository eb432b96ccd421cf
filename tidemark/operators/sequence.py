"""Operators along an order: dense ids, forward fill, gaps, clock steps, duplicates, storms.

A window over a whole table runs in one task. Where the order is global, rows are range-partitioned by the sort keys and
written to the shared folder; each partition then needs only a count or a last value of the partitions before it, one
small row each. Orders within a file, component or key are cut into blocks of lines or days in the same way, so that a
file or key with a third of all rows is many tasks: windows hold a block, and one row a block is chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

CLOCK_STEP_MS = 5000
STORM_LINES = 100
#: lines of a file, and microseconds, that a window holds
BLOCK_LINES = 50_000
SHARD_US = 24 * 3600 * 1_000_000


def _ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows in ranges of the order, written down, with the number of their part.

    The number of the part is written, because a partition number isn't stable over a second sampling.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()))


def dense_ids(df: DataFrame, order: list[Column], name: str = "line_id") -> DataFrame:
    """Adds 0, 1, 2 ... in the given order, which must be total for the ids to be repeatable."""
    rows = _ranged(df, order)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row a partition
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("bigint")
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + within - 1).drop("_part", "_before")


def forward_fill(df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """Adds the last value of a column that is not null, up to and with each row, in a global order."""
    rows = _ranged(df, order)
    in_part = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_own", F.last(column, ignorenulls=True).over(in_part))
    by_part = Window.partitionBy("_part").orderBy(*order)
    last = filled.withColumn("_next", F.lead(F.lit(1)).over(by_part)).where(F.col("_next").isNull())
    ends = last.select("_part", F.col("_own").alias("_end"))
    carry = ends.withColumn(
        "_carry", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_end")
    return (
        filled.join(F.broadcast(carry), "_part").withColumn(name, F.coalesce("_own", "_carry")).drop("_part", "_own", "_carry")
    )


def _same(*pairs: tuple[str, str]) -> Column:
    """Equality of columns, nulls included."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def with_before(rows: DataFrame, by: list[str], summary: Column, before: Column, name: str) -> DataFrame:
    """Adds to rows with a `_block` what `before` (over `_s`, an aggregate of each block) gives of the earlier blocks of the same `by`."""
    along = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "_block").agg(summary.alias("_s")).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), before.over(along).alias(name)
    )
    on = _same(*[(c, f"_k{i}") for i, c in enumerate(by)], ("_block", "_b"))
    return rows.join(carried, on).drop("_b", *[f"_k{i}" for i in range(len(by))])


def gaps(df: DataFrame, by: list[str], ts: str, row_id: str, min_gap_s: float = 30, shard_us: int = SHARD_US) -> DataFrame:
    """by, gap_from_us, gap_to_us, gap_s, prev_id, next_id: pauses of at least min_gap_s between neighbours in time."""
    rows = df.where(F.col(ts).isNotNull()).select(*by, F.col(row_id).alias("_id"), F.unix_micros(ts).alias("_us")).withColumn("_block", F.floor(F.col("_us") / shard_us))
    order = Window.partitionBy(*by, "_block").orderBy("_us", "_id")
    inside = rows.select(*by, F.lag("_us").over(order).alias("gap_from_us"), F.col("_us").alias("gap_to_us"), F.lag("_id").over(order).alias("prev_id"), F.col("_id").alias("next_id"))
    row = F.struct("_us", "_id")
    ends = rows.groupBy(*by, "_block").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    last = F.lag("last").over(Window.partitionBy(*by).orderBy("_block"))
    between = ends.withColumn("last", last).select(
        *by, F.col("last._us").alias("gap_from_us"), F.col("first._us").alias("gap_to_us"), F.col("last._id").alias("prev_id"), F.col("first._id").alias("next_id")
    )
    long = F.col("gap_to_us") - F.col("gap_from_us")
    return inside.union(between).where(long >= min_gap_s * 1_000_000).select(
        *by, "gap_from_us", "gap_to_us", F.round(long / 1_000_000, 3).alias("gap_s"), "prev_id", "next_id"
    )


def clock_steps(df: DataFrame, file: str, line_no: str, us: str, step_ms: int = CLOCK_STEP_MS, tie: str | None = None, block: int = BLOCK_LINES) -> DataFrame:
    """Adds resolved_us (own or inherited), derived, gap_ms, clock_epoch and flags, along the lines (then `tie`) of each file.

    A line without time inherits the last one before it in its file. gap_ms is cut towards zero. A step back of more
    than step_ms begins a new epoch (CLOCK_JUMP); any step back is OUT_OF_ORDER.
    """
    place = [line_no, *([tie] if tie else [])]
    order = Window.partitionBy(file, "_block").orderBy(*place)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_block", F.floor(F.col(line_no) / block))
    last_known = F.max_by(us, F.when(F.col(us).isNotNull(), F.struct(*place)))
    rows = with_before(rows, [file], last_known, F.last("_s", ignorenulls=True), "_carry")
    stepped = materialize(
        rows.withColumn("resolved_us", F.coalesce(F.last(us, ignorenulls=True).over(so_far), "_carry"))
        .withColumn("derived", F.col(us).isNull() & F.col("resolved_us").isNotNull())
        .withColumn("_delta", F.col("resolved_us") - F.coalesce(F.lag("resolved_us").over(order), "_carry"))
        .withColumn("gap_ms", F.when(F.col("_delta").isNotNull(), F.sign("_delta").cast("bigint") * F.floor(F.abs("_delta") / 1000)))
        .withColumn("_jump", F.coalesce(F.col("_delta") < -step_ms * 1000, F.lit(False)).cast("int"))
        .drop("_carry")
    )
    return (
        with_before(stepped, [file], F.sum("_jump"), F.sum("_s"), "_jumps")
        .withColumn("clock_epoch", (F.coalesce("_jumps", F.lit(0)) + F.sum("_jump").over(so_far)).cast("int"))
        .withColumn(
            "flags",
            F.array_compact(F.array(F.when(F.col("_jump") == 1, "CLOCK_JUMP"), F.when(F.col("_delta") < 0, "OUT_OF_ORDER"))),
        )
        .drop("_delta", "_jump", "_jumps", "_block")
    )


def time_confidence(kind: Column, has_tz: Column, has_year: Column, digits: Column, monotone: Column, anchored: Column) -> Column:
    """0 to 1: a base by kind, less for each missing part, times 0.85 without a wall clock or anchor."""
    # fixed values: bases and deductions
    base = F.when(kind == "WALL", 0.95).when(kind.isin("MONOTONIC", "BOOT_RELATIVE"), 0.80).when(kind == "DERIVED", 0.60).otherwise(0.0)
    less = (
        F.when(has_tz, 0.0).otherwise(0.05)
        + F.when(has_year, 0.0).otherwise(0.08)
        + F.when(digits > 0, 0.0).otherwise(0.05)
        + F.when(monotone, 0.0).otherwise(0.20)
    )
    factor = F.when((kind == "WALL") | anchored, 1.0).otherwise(0.85)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base - less) * factor)), 3)


def inferred_year(df: DataFrame, file: str, line_no: str, month: str, day: str, start_year: str, block: int = BLOCK_LINES, tie: str | None = None) -> DataFrame:
    """Adds year to stamps without one: it grows where, in a file, the date steps back by six months or more.

    Rows with a null month take no part and have a null year.
    """
    dated = df.where(F.col(month).isNotNull()).withColumn("_block", F.floor(F.col(line_no) / block))
    place = [line_no, *([tie] if tie else [])]
    order = Window.partitionBy(file, "_block").orderBy(*place)
    carried = with_before(dated, [file], F.max_by(month, F.struct(*place)), F.last("_s"), "_carry")
    before = F.coalesce(F.lag(month).over(order), "_carry")
    rolled = materialize(carried.withColumn("_roll", F.coalesce((before - F.col(month) >= 6), F.lit(False)).cast("int")).drop("_carry"))
    rolls = F.coalesce("_rolls", F.lit(0)) + F.sum("_roll").over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = with_before(rolled, [file], F.sum("_roll"), F.sum("_s"), "_rolls").withColumn("year", (F.col(start_year) + rolls).cast("int"))
    return out.drop("_roll", "_rolls", "_block").unionByName(df.where(F.col(month).isNull()).withColumn("year", F.lit(None).cast("int")))


def duplicates(df: DataFrame, key: str, order: list[str], block: int = BLOCK_LINES) -> DataFrame:
    """Adds dup_rank (0, 1 ... in the given order) and dup_count of each key; the second column of the order, if any, is a number.

    A key is ranked within blocks (the first column of the order and lines of the second) and by the counts of the blocks before.
    """
    part = F.struct(F.col(order[0]).alias("a"), *([F.floor(F.col(order[1]) / block).alias("b")] if len(order) > 1 else []))
    rows = df.withColumn("_block", part)
    by = Window.partitionBy("_key")
    counts = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_key", "_b", F.sum("_n").over(by).alias("_all"),
        F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    place = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order)) - 1
    return (
        rows.join(counts, _same((key, "_key"), ("_block", "_b")))
        .withColumn("dup_rank", (F.col("_before") + place).cast("int"))
        .withColumn("dup_count", F.col("_all").cast("int"))
        .drop("_key", "_b", "_all", "_before", "_block")
    )


def storms(df: DataFrame, template: str, ts: str, component: str, least: int = STORM_LINES) -> DataFrame:
    """template, second (epoch), component (smallest), n: at least so many lines of one template in one second."""
    return (
        df.where(F.col(ts).isNotNull() & F.col(template).isNotNull())
        .groupBy(template, F.floor(F.unix_micros(ts) / 1_000_000).alias("second"))
        .agg(F.min(component).alias("component"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def flag_storms(df: DataFrame, template: str, ts: str, component: str, least: int = STORM_LINES, known: DataFrame | None = None) -> DataFrame:
    """Adds STORM to anomaly_flags of lines in a storm (of those known, if given). The storms are aggregated, far fewer than the lines."""
    found = storms(df, template, ts, component, least) if known is None else known
    marks = found.select(F.col(template).alias("_t"), F.col("second").alias("_s"))
    second = F.floor(F.unix_micros(ts) / 1_000_000)
    flags = F.coalesce("anomaly_flags", F.array().cast("array<string>"))
    return (
        df.join(marks, (F.col(template) == F.col("_t")) & (second == F.col("_s")), "left")
        .withColumn("anomaly_flags", F.when(F.col("_t").isNotNull(), F.array_distinct(F.array_append(flags, F.lit("STORM")))).otherwise(flags))
        .drop("_t", "_s")
    )


def context_band(df: DataFrame, anchors: DataFrame, group: str, position: str, anchor_id: str, before: int = 10, after: int = 10) -> DataFrame:
    """anchor_id and the rows of the anchor's group within a band of positions; is_anchor marks the anchor's own.

    The band becomes an equality: positions are cut into buckets as wide as the band, and each anchor is sent to the two
    or three buckets that its band meets.
    """
    width = before + after + 1
    wanted = anchors.select(F.col(anchor_id).alias("anchor_id"), F.col(group).alias("_g"), F.col(position).alias("_p")).withColumn(
        "_b", F.explode(F.sequence(F.floor((F.col("_p") - before) / F.lit(width)), F.floor((F.col("_p") + after) / F.lit(width))))
    )
    rows = df.withColumn("_bucket", F.floor(F.col(position) / F.lit(width)))
    return (
        rows.join(wanted, (F.col(group) == F.col("_g")) & (F.col("_bucket") == F.col("_b")))
        .where(F.col(position).between(F.col("_p") - before, F.col("_p") + after))
        .withColumn("is_anchor", F.col(position) == F.col("_p"))
        .drop("_g", "_p", "_b", "_bucket")
    )
