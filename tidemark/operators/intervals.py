"""Continuous periods and gaps of overlapping, nested or touching intervals, from run bitmaps.

Time is discretised exactly: of a shard's bits, bit 2t is the microsecond t and bit 2t + 1 the step from t to t + 1, so that
the interval from a to b sets the bits 2a to 2b: intervals that share a microsecond are one set run, and neighbours that
don't have a clear bit between them. The bitmap of an entity and time shard is kept run-length compressed, as the first and
last bits of its set runs. Tasks union what they hold before it is shuffled, then the bitmaps of an entity and shard are
united; set runs and clear runs are read off them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHARD_US = 24 * 3600 * 1_000_000
#: intervals that a task unites before it passes bitmaps on
HELD = 200_000


def spans(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """First and last microsecond of each group; rows with a null in `by` or `ts` are left out."""
    return (
        df.dropna(subset=[*by, ts])
        .groupBy(*by)
        .agg(F.unix_micros(F.min(ts)).alias("start_us"), F.unix_micros(F.max(ts)).alias("end_us"))
    )


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Set runs of the union of bit runs, in order; adjacent ones are one."""
    out: list[tuple[int, int]] = []
    end = None
    for first, last in sorted(runs):
        if end is None or first > end + 1:
            out.append((first, last))
            end = last
        elif last > end:
            out[-1] = (out[-1][0], last)
            end = last
    return out


def _pairs(bits: list[int]) -> list[tuple[int, int]]:
    return list(zip(bits[::2], bits[1::2]))


def _flat(runs: list[tuple[int, int]]) -> list[int]:
    return [bit for run in runs for bit in run]


def run_bitmaps(intervals: DataFrame, entity: list[str], start: str, end: str, shard_us: int = SHARD_US) -> DataFrame:
    """entity, _shard, _bits: one run bitmap for each entity and time shard, as first and last bits of its set runs in turn.

    Bits count from the shard's begin. Intervals are closed; their parts meet at the border of two shards. Rows with a null
    entity or bound, or with end before start, are left out. A task holds HELD intervals, or the set runs of one bitmap.
    """
    width = F.lit(shard_us)
    at = F.col("_shard") * width
    parts = (
        intervals.select(*entity, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
        .dropna()
        .where(F.col("_s") <= F.col("_e"))
        .withColumn("_shard", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
        .select(*entity, "_shard", F.array(2 * (F.greatest("_s", at) - at), 2 * (F.least("_e", at + width) - at)).alias("_bits"))
    )
    keys = [*entity, "_shard"]
    schema = T.StructType([*[parts.schema[k] for k in keys], T.StructField("_bits", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            *key, bits = [c.to_pylist() for c in batch.columns]
            yield from zip(zip(*key), bits)

    def made(united: list[tuple[tuple, list[tuple[int, int]]]]) -> pa.RecordBatch:
        cols = list(zip(*[(*key, _flat(runs)) for key, runs in united])) if united else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[tuple[int, int]]] = {}
        n = 0
        for key, bits in rows(batches):
            held.setdefault(key, []).extend(_pairs(bits))
            n += 1
            if n == HELD:
                yield made([(k, union(v)) for k, v in held.items()])
                held, n = {}, 0
        yield made([(k, union(v)) for k, v in held.items()])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[tuple, list[tuple[int, int]]]] = []
        for key, own in groupby(rows(batches), key=lambda r: r[0]):
            runs: list[tuple[int, int]] = []
            new = 0
            for _, bits in own:
                runs += _pairs(bits)
                new += len(bits)
                if new > max(HELD, 2 * len(runs)):
                    runs, new = union(runs), 0
            out.append((key, union(runs)))
            if len(out) == 5_000:
                yield made(out)
                out = []
        yield made(out)

    return parts.mapInArrow(build, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)


def _instant(bit: Column, shard_us: int) -> Column:
    return F.shiftright(bit, 1) + F.col("_shard") * shard_us


def clear_runs(bitmaps: DataFrame, entity: list[str], shard_us: int = SHARD_US) -> DataFrame:
    """entity, gap_from_us, gap_to_us: each stretch between two successive set runs of an entity.

    Inside a bitmap a gap is between neighbouring runs; between shards only each bitmap's first and last set bits are needed.
    """
    bits = F.col("_bits")
    within = F.transform(
        F.slice(bits, 2, F.greatest(F.size(bits) - 2, F.lit(0))),
        lambda bit, i: F.struct(_instant(bit, shard_us).alias("gap_from_us"), _instant(F.get(bits, i + 2), shard_us).alias("gap_to_us"), (i % 2 == 0).alias("_clear")),
    )
    inside = bitmaps.select(*entity, F.inline(F.filter(within, lambda x: x["_clear"]))).drop("_clear")
    along = Window.partitionBy(*entity).orderBy("_shard")
    last = _instant(F.element_at(bits, -1), shard_us)
    between = bitmaps.select(*entity, F.lag(last).over(along).alias("gap_from_us"), _instant(bits[0], shard_us).alias("gap_to_us"))
    return inside.union(between).where(F.col("gap_from_us") < F.col("gap_to_us"))


def set_runs(bitmaps: DataFrame, entity: list[str], shard_us: int = SHARD_US) -> DataFrame:
    """entity, start_us, end_us: continuous periods. Only runs that reach a border of their shard are chained."""
    bits = F.col("_bits")
    each = F.transform(bits, lambda bit, i: F.struct(_instant(bit, shard_us).alias("_a"), _instant(F.get(bits, i + 1), shard_us).alias("_b"), (i % 2 == 0).alias("_set")))
    runs = bitmaps.select(*entity, "_shard", F.inline(F.filter(each, lambda x: x["_set"]))).drop("_set")
    low, high = F.col("_shard") * shard_us, (F.col("_shard") + 1) * shard_us
    edge = (F.col("_a") == low) | (F.col("_b") == high)
    along = Window.partitionBy(*entity).orderBy("_a", "_b")
    chained = (
        runs.where(edge)
        .withColumn("_chain", F.sum(F.coalesce(F.col("_a") > F.lag("_b").over(along), F.lit(True)).cast("int")).over(along))
        .groupBy(*entity, "_chain")
        .agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return (
        runs.where(~edge)
        .select(*entity, "_a", "_b")
        .union(chained.select(*entity, "_a", "_b"))
        .select(*entity, F.col("_a").alias("start_us"), F.col("_b").alias("end_us"))
    )
