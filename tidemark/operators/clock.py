"""One UTC instant for every stamp: all valid interpretations as candidates, then the cheapest path through each source's records.

A stamp's candidates are its readings by every layout that fits. Along the records of a source (in line order) a path
costs one for each switch of format and one for each step back in time of more than a minute; of equal paths the one
with the earlier layouts wins (Viterbi). The recursion is distributed: a block of lines gives the least costs from each
candidate of its first record to each of its last, the blocks of a source are chained by these small matrices, and
each block is then traced back between its settled ends. Sources whose stamps have one reading each have one path.

Two rules of a single stamp bound its candidates beforehand: a stamp without year is of the latest year that collection
allows, so that other years cost more than any path can gain; and a local time that occurs twice is settled by its
predecessor on the path: the later instant is taken only if the earlier lies before the predecessor's by more
than the tolerance. As a map from the predecessor's choice to its own, each record is therefore constant 0, constant 1
or the identity; these maps compose associatively, so this too runs in blocks that need only one value from those before.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.instants import epoch_instant, stamp_readings, trimmed, with_interpretations
from tidemark.session import materialize

BLOCK_LINES = 20_000
STEP_BACK_US = 60_000_000
#: what a path pays for a change of format and for a step back
SWITCH, JUMP = 1, 1


def best_anchors(anchors: DataFrame) -> DataFrame:
    """boot_id, wall_us, monotonic_ns of the anchor with the greatest weight, then the smallest anchor_id."""
    usable = anchors.where(F.col("wall_utc").isNotNull() & F.col("monotonic_ns").isNotNull() & F.col("boot_id").isNotNull())
    pick = F.struct(
        F.coalesce(-F.nanvl("weight", F.lit(float("-inf"))), F.lit(float("inf"))).alias("w"),
        "anchor_id",
        F.unix_micros("wall_utc").alias("wall_us"),
        "monotonic_ns",
    )
    return usable.groupBy("boot_id").agg(F.min(pick).alias("a")).select("boot_id", "a.wall_us", "a.monotonic_ns")


def candidates(stamps: DataFrame, files: DataFrame, packages: DataFrame, anchors: DataFrame) -> DataFrame:
    """rec_id, file_id, line_no, ways, format, early, late: a row for each candidate of every stamp that denotes an instant.

    ways is the number of layouts that fit; format is -1 for pure digits and -2 for monotonic stamps.
    """
    where = files.select("file_id", F.col("archive_path").alias("archive")).join(
        packages.select("archive", "timezone", F.col("collected_at").try_cast("timestamp").alias("collected")), "archive", "left"
    )
    rows = (
        stamps.select("rec_id", "file_id", "line_no", "boot_id", "ts_raw", F.nanvl("mono_s", F.lit(None).cast("double")).alias("mono_s"))
        .withColumn("stamp", F.when(F.col("mono_s").isNull(), trimmed(F.col("ts_raw"))))
        .withColumn("digits", epoch_instant(F.col("stamp")))
        .drop("ts_raw")
        .join(where.drop("archive"), "file_id", "left")
        .join(best_anchors(anchors), "boot_id", "left")
    )
    mono = F.col("wall_us") + F.round(F.col("mono_s") * 1_000_000).cast("bigint") - F.ceil(F.col("monotonic_ns") / F.lit(1000))
    one = lambda us: F.array(F.struct(us.alias("early"), us.alias("late")))
    kind = F.when(F.col("mono_s").isNotNull(), -2).when(F.col("digits").isNotNull(), -1)
    read = (
        rows.withColumn("readings", F.when(kind.isNull(), stamp_readings(F.col("stamp"))))
        .withColumn("ways", F.greatest(F.size(F.coalesce("readings", F.array())), F.lit(1)))
        .withColumn("reading", F.explode_outer("readings"))
        .withColumn("format", F.coalesce(kind, F.col("reading.format")))
        .drop("readings")
    )
    dated = with_interpretations(read, F.col("reading.parts"), "timezone", "collected")
    # the array is ordered by year, the only thing that a format leaves open: the latest is the only one that can win
    best = F.when(F.col("format") == -2, one(mono)).when(F.col("format") == -1, one(F.col("digits"))).otherwise(F.slice("instants", 1, 1))
    return dated.select(
        "rec_id", "file_id", F.coalesce("line_no", F.lit(-1).cast("bigint")).alias("line_no"), "ways", "format", F.inline_outer(best)
    ).where(F.col("rec_id").isNotNull() & F.col("early").isNotNull())


#: a record: its key in the order of its source, and its candidates (format, early)
Record = tuple[tuple, list[tuple[int, int]]]


def _step(a: tuple[int, int], b: tuple[int, int], tolerance: int) -> int:
    return SWITCH * (a[0] != b[0]) + JUMP * (b[1] < a[1] - tolerance)


def _forward(records: list[Record], costs: list[float], tolerance: int) -> tuple[list[float], list[list[int]]]:
    """Least costs at the candidates of the last record, given those at the first's; for each record but the first, each candidate's predecessor."""
    back = []
    for (_, before), (_, now) in zip(records, records[1:]):
        came, new = [], []
        for b in now:
            cost, j = min((costs[j] + _step(a, b, tolerance), j) for j, a in enumerate(before))
            new.append(cost)
            came.append(j)
        costs = new
        back.append(came)
    return costs, back


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[Record], tuple]]:
    """(source, block), its records and what else its first row holds, of rows in order: source, block, line_no, rec_id, format, early, ..."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    for key, own in groupby(rows, key=lambda r: r[:2]):
        own = list(own)
        yield key, [(k, list(dict.fromkeys((r[4], r[5]) for r in same))) for k, same in groupby(own, key=lambda r: r[2:4])], own[0][6:]


def choose_formats(rows: DataFrame, source: str, tolerance: int) -> DataFrame:
    """source, line_no, rec_id, format of each record on the cheapest path of its source; rows: a row a candidate, with its block.

    Blocks are taken in one task each, the chain of a source's blocks (a few numbers a block) in another.
    """
    name = rows.schema[source]
    key = [T.StructField("source", name.dataType), T.StructField("block", T.LongType())]
    ordered = (
        rows.select(F.col(source).alias("source"), "block", "line_no", "rec_id", "format", "early")
        .repartition("source", "block")
        .sortWithinPartitions("source", "block", "line_no", "rec_id", "format", "early")
    )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for where, records, _ in _blocks(batches):
            first = records[0][1]
            matrix = [_forward(records, [0.0 if j == i else float("inf") for j in range(len(first))], tolerance)[0] for i in range(len(first))]
            out.append((*where, pickle.dumps((first, records[-1][1], matrix))))
        yield _batch(out, _arrow(T.StructType([*key, T.StructField("ends", T.BinaryType())])))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        rows_ = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns]))
        for where, own in groupby(rows_, key=lambda r: r[0]):
            blocks = [(r[1], *pickle.loads(r[2])) for r in own]
            # the ends of all blocks as records in a row: within a block the matrix holds, between blocks a step
            costs, back = [0.0] * len(blocks[0][1]), []
            for k, (_, first, last, matrix) in enumerate(blocks):
                if k:
                    costs, came = _forward([((), blocks[k - 1][2]), ((), first)], costs, tolerance)
                    back.append(came[0])
                inside = [min((costs[i] + matrix[i][j], i) for i in range(len(first))) for j in range(len(last))]
                costs = [c for c, _ in inside]
                back.append([i for _, i in inside])
            at = min(range(len(costs)), key=lambda j: (costs[j], j))
            for k in range(len(blocks) - 1, -1, -1):
                begin = back[2 * k][at]
                out.append((where, blocks[k][0], begin, at))
                at = back[2 * k - 1][begin] if k else at
        yield _batch(out, _arrow(settled))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, records, (begin, at) in _blocks(batches):
            _, back = _forward(records, [0.0 if j == begin else float("inf") for j in range(len(records[0][1]))], tolerance)
            out = []
            for k in range(len(records) - 1, -1, -1):
                (line_no, rec_id), options = records[k]
                out.append((where[0], line_no, rec_id, options[at][0]))
                at = back[k - 1][at] if k else at
            yield _batch(out, _arrow(chosen))

    settled = T.StructType([*key, T.StructField("begin", T.IntegerType()), T.StructField("finish", T.IntegerType())])
    chosen = T.StructType([key[0], rows.schema["line_no"], rows.schema["rec_id"], T.StructField("format", T.IntegerType())])
    summary = ordered.mapInArrow(ends, T.StructType([*key, T.StructField("ends", T.BinaryType())]))
    path = summary.repartition("source").sortWithinPartitions("source", "block").mapInArrow(chain, settled)
    other = path.select(F.col("source").alias("s"), F.col("block").alias("b"), "begin", "finish")
    joined = (
        ordered.join(other, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .drop("s", "b")
        .repartition("source", "block")
        .sortWithinPartitions("source", "block", "line_no", "rec_id", "format", "early")
    )
    return joined.mapInArrow(trace, chosen).withColumnRenamed("source", source)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def settled_formats(rows: DataFrame, source: str, tolerance: int) -> DataFrame:
    """rows (a row a candidate) with one candidate a record: the one on its source's cheapest path. Without `ways`, records have one each."""
    if "ways" not in rows.columns:
        return rows
    several = rows.where(F.col("ways") > 1)
    if several.isEmpty():  # each record has one candidate, so each source one path
        return rows
    sources = several.select(F.col(source).alias("s")).distinct()
    same = F.col(source).eqNullSafe(F.col("s"))
    path = choose_formats(rows.join(sources, same, "left_semi"), source, tolerance)
    path = path.select(F.col(source).alias("s"), F.col("line_no").alias("l"), F.col("rec_id").alias("r"), F.col("format").alias("f"))
    on = F.col(source).eqNullSafe(F.col("s")) & (F.col("line_no") == F.col("l")) & (F.col("rec_id") == F.col("r")) & (F.col("format") == F.col("f"))
    return materialize(rows.join(sources, same, "left_anti").union(rows.join(path, on, "left_semi")))


def _map(prev_early: Column, prev_late: Column, tolerance: int) -> Column:
    """This record's choice as a function of its predecessor's: 0, 1, or null for the same."""
    after_early = (F.col("early") < prev_early - tolerance).cast("int")
    after_late = (F.col("early") < prev_late - tolerance).cast("int")
    return (
        F.when((F.col("early") == F.col("late")) | prev_early.isNull(), 0)
        .when(after_early == after_late, after_early)
    )


def resolve(found: DataFrame, source: str = "file_id", tolerance_us: int = STEP_BACK_US, block: int = BLOCK_LINES) -> DataFrame:
    """rec_id, utc_us of every record: the cheapest path through each source. Records given twice come out once."""
    rows = settled_formats(materialize(found.withColumn("block", F.floor(F.col("line_no") / F.lit(block)))), source, tolerance_us)
    order = Window.partitionBy(source, "block").orderBy("line_no", "rec_id")
    along = Window.partitionBy(source).orderBy("block")
    last = rows.groupBy(source, "block").agg(
        F.max_by(F.struct("early", "late"), F.struct("line_no", "rec_id")).alias("last")
    )
    before = last.select(source, "block", F.lag("last").over(along).alias("before"))
    mapped = (
        rows.join(before.withColumnRenamed(source, "s").withColumnRenamed("block", "b"), F.col(source).eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        .drop("s", "b")
        .withColumn("p_early", F.coalesce(F.lag("early").over(order), F.col("before.early")))
        .withColumn("p_late", F.coalesce(F.lag("late").over(order), F.col("before.late")))
        .withColumn("choice", F.last(_map(F.col("p_early"), F.col("p_late"), tolerance_us), ignorenulls=True).over(order))
        .drop("p_early", "p_late", "before")
    )
    # only blocks that begin with undecided records need the choice at the end of the blocks before
    open_ = mapped.where(F.col("choice").isNull())
    ends = mapped.groupBy(source, "block").agg(F.max_by("choice", F.struct("line_no", "rec_id")).alias("end"))
    carried = ends.select(
        F.col(source).alias("s"), F.col("block").alias("b"),
        F.last("end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
    )
    settled = open_.join(carried, F.col(source).eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("choice", F.coalesce("carry", F.lit(0)))
    both = mapped.where(F.col("choice").isNotNull()).select("rec_id", "early", "late", "choice").union(
        settled.select("rec_id", "early", "late", "choice")
    )
    return both.select("rec_id", F.when(F.col("choice") == 1, F.col("late")).otherwise(F.col("early")).alias("utc_us")).distinct()
