"""Runs of the same or nearly the same event collapsed into one row with count and duration.

Each entity's sequence is cut into runs so that the sum of what its rows differ by from their run's representative, plus
a penalty for each run, is least. A pause of more than the longest gap always ends a run. A representative is any event
of the stretch. With V(i, r) the least cost of the first i rows whose last run has the representative r, F(i) the least
over r, and d the dissimilarity (a metric of at most 1),

    V(i, r) = min(V(i - 1, r), F(i - 1) + penalty) + d(r, event i).

Pruning: a representative with V(i, r) >= F(i) + penalty is dropped, as a new run with it costs no more; of those that
are dropped, only those with d(r, event i) < penalty can come back. Hence a representative is kept only while it differs
from the row by less than twice the penalty, and neighbours that differ by four times the penalty or more are never in
one run, whatever comes before them: such a cut is certain. The recursion starts anew at certain cuts, so that a task
keeps one stretch between two of them. Equal events (dissimilarity 0 or 1) are the case in which one candidate is left.

Neighbours that are equal and no further apart than the gap are never in two runs, so that the longest stretches of one
event are parts of the runs, whatever the penalty and the dissimilarity; they come out with `parts`.

Entities are sharded by time, so that no task holds the whole of a long one. A stretch that may go on beyond its shard
is passed on as blocks of equal rows (never worth cutting) and solved with the stretches that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize

#: below a quarter, so that neighbours without anything in common are cut for certain
PENALTY = 0.25
SHARD_S = 6 * 3600
#: distances between events that a task remembers
REMEMBERED = 100_000


def event_key(text: Column) -> Column:
    """A template text without parameter values, letter case and punctuation."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"([=:：])\s*[^\s,;|，；]+", "$1 ")
    t = F.regexp_replace(t, r"<\*>|(?<![\p{L}\p{N}_])\p{N}[\p{L}\p{N}.%]*", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def different(a: str, b: str) -> float:
    """0 for equal events, 1 for others."""
    return 0.0 if a == b else 1.0


def jaccard_distance(a: str, b: str) -> float:
    """Of the word sets of two event keys; 0 for two empty ones."""
    x, y = set(a.split(" ")), set(b.split(" "))
    return 1.0 - len(x & y) / len(x | y)


class Segmenter:
    """The pruned recursion over one stretch."""

    def __init__(self, dissimilarity: Callable[[str, str], float], penalty: float):
        self.dissimilarity, self.penalty = dissimilarity, penalty
        self.known: dict[tuple[str, str], float] = {}

    def distance(self, a: str, b: str) -> float:
        if a == b:
            return 0.0
        pair = (a, b) if a < b else (b, a)
        if (d := self.known.get(pair)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[pair] = d = self.dissimilarity(*pair)
        return d

    def certain(self, a: str, b: str) -> bool:
        """Whether no run holds both neighbours."""
        return self.distance(a, b) >= 4 * self.penalty

    def cuts(self, events: list[str], weights: list[int]) -> list[int]:
        """Starts of the runs of least cost; of equal ones, those with the later last cut."""
        vocabulary = list(dict.fromkeys(events))
        if len(vocabulary) == 1:
            return [0]
        least, live, back = 0.0, {}, []
        near: dict[str, list[str]] = {}
        for i, (event, weight) in enumerate(zip(events, weights)):
            costs: dict[str, tuple[float, int]] = {}
            if event not in near:
                near[event] = [r for r in vocabulary if self.distance(r, event) < self.penalty]
            for r in dict.fromkeys([*live, *near[event]]):
                d = self.distance(r, event)
                kept = live.get(r)
                # (cost, minus the run's start): of equal costs the later start holds
                begun = (least + self.penalty, -i)
                before = begun if kept is None else min(kept, begun)
                costs[r] = (before[0] + d * weight, before[1])
            least, start = min(costs.values())
            live = {r: c for r, c in costs.items() if c[0] < least + self.penalty}
            back.append(-start)
        out, i = [], len(events) - 1
        while i >= 0:
            out.append(back[i])
            i = back[i] - 1
        return out[::-1]


#: a run or block of a stretch: event, rows, first_us, last_us, min_id, max_id
Block = list


def _joined(blocks: list[Block], starts: list[int], parts: bool) -> Iterator[list]:
    """The runs, or the blocks that they consist of, with the rows of the whole run."""
    for a, b in zip(starts, [*starts[1:], len(blocks)]):
        part = blocks[a:b]
        rows = sum(x[1] for x in part)
        if parts:
            yield from ([*x, rows] for x in part)
        else:
            yield [part[0][0], rows, part[0][2], max(x[3] for x in part), min(x[4] for x in part), max(x[5] for x in part), rows]


def _stretches(rows: Iterator[tuple], segmenter: Segmenter, gap_us: int) -> Iterator[tuple[tuple, list[Block], bool, bool]]:
    """Group, blocks of equal rows, whether it is the group's first and its last stretch; rows in order: group, whether it begins a stretch, a block."""
    group, blocks, first, before = None, [], True, None
    for key, fresh, *row in rows:
        if key != group:
            if blocks:
                yield group, blocks, first, True
            group, blocks, first, before = key, [], True, None
        elif row == before:
            continue  # delivered twice
        before = list(row)
        if blocks:
            last = blocks[-1]
            if fresh or row[2] - last[3] > gap_us or segmenter.certain(last[0], row[0]):
                yield group, blocks, first, False
                blocks, first = [], False
            elif row[0] == last[0]:
                last[1] += row[1]
                last[3] = max(last[3], row[3])
                last[4], last[5] = min(last[4], row[4]), max(last[5], row[5])
                continue
        blocks.append(list(row))
    if blocks:
        yield group, blocks, first, True


def _solver(keys: list[str], schema: T.StructType, dissimilarity, penalty: float, gap_us: int, shard_us: int | None, parts: bool):
    names = [*keys, *schema.names[len(keys):]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(dissimilarity, penalty)
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                types[:] = types or [batch.schema.field(k).type for k in range(len(keys))]
                types[len(keys):] = [batch.schema.field("min_id").type]
                cols = [c.to_pylist() for c in batch.columns]
                group = zip(*cols[: len(keys) + 1])
                yield from zip(group, *cols[len(keys) + 1 :])

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = [*types[: len(keys)], pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), *[pa.int64()] * 3, *types[-1:] * 2, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        out: list[tuple] = []
        seq = 0
        for group, blocks, first, last in _stretches(rows(), segmenter, gap_us):
            shard = group[-1]
            open_ = shard_us is not None and (
                first and blocks[0][2] - shard * shard_us <= gap_us or last and (shard + 1) * shard_us - blocks[-1][3] <= gap_us
            )
            starts = [0] if open_ else segmenter.cuts([b[0] for b in blocks], [b[1] for b in blocks])
            for k, b in enumerate(_joined(blocks, starts, open_ or parts)):
                out.append((*group, seq := seq + 1, open_, not first and k == 0, *b))
                if len(out) >= 10_000:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return run


def collapse_runs(
    df: DataFrame,
    entity: list[str],
    ts: str,
    row_id: str,
    event: str,
    max_gap_s: float = 60,
    penalty: float = PENALTY,
    dissimilarity: Callable[[str, str], float] = different,
    shard_s: int = SHARD_S,
    order: str | None = None,
    parts: bool = False,
) -> DataFrame:
    """entity, event (of the first row), rows, first_us, last_us, duration_us, min_id, max_id: one row per run.

    With parts: one row per longest stretch of one event in a run, and run_rows, the rows of the whole run.

    Order is ts, then `order` (nulls first), then row_id. Rows with a null ts, row_id or event are left out; null entities are
    entities of their own. A row delivered twice (same entity, ts, order, row_id and event) counts once.
    """
    gap_us, shard_us = int(max_gap_s * 1_000_000), shard_s * 1_000_000
    keys = [f"k{i}" for i in range(len(entity))]
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(entity, keys, strict=True)],
        F.floor(at / F.lit(shard_us)).alias("shard"),
        F.lit(False).alias("fresh"),
        F.col(event).alias("event"),
        F.lit(1).cast("bigint").alias("rows"),
        at.alias("first_us"),
        at.alias("last_us"),
        F.col(row_id).alias("min_id"),
        F.col(row_id).alias("max_id"),
        F.col(order or row_id).alias("place"),
    ).dropna(subset=["first_us", "min_id", "event"])
    run = ["event", "rows", "first_us", "last_us", "min_id", "max_id"]
    place = [rows.schema["shard"], T.StructField("seq", T.LongType()), *[T.StructField(c, T.BooleanType()) for c in ("open", "fresh")]]
    fields = [*place, *[T.StructField(c, rows.schema[c].dataType) for c in run], T.StructField("run_rows", T.LongType())]
    schema = T.StructType([*[rows.schema[k] for k in keys], *fields])
    in_order = rows.repartition(*keys, "shard").sortWithinPartitions(*keys, "shard", "first_us", "place", "min_id", "event")
    solved = in_order.drop("place").mapInArrow(_solver(keys, schema, dissimilarity, penalty, gap_us, shard_us, parts), schema)
    done = materialize(solved)
    met = (
        done.where("open")
        .repartition(*keys)
        .sortWithinPartitions(*keys, "shard", "seq")
        .select(*keys, F.lit(0).cast("bigint").alias("shard"), "fresh", *run)
        .mapInArrow(_solver(keys, schema, dissimilarity, penalty, gap_us, None, parts), schema)
    )
    return done.where("NOT open").union(met).select(
        *[F.col(k).alias(c) for c, k in zip(entity, keys, strict=True)],
        "event", "rows", "first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("duration_us"), "min_id", "max_id",
        *["run_rows"] * parts,
    )
