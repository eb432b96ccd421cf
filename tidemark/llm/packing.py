"""Documents into containers of fixed capacity, by linear grouping within independent shards.

Documents are dealt to shards by a hash, so that a shard holds a bounded number whatever the corpus holds. Each shard is
a bin packing of its own: large items (above a quarter of the capacity or more) are sorted and cut into groups of
equal cardinality, each rounded up to its largest. All configurations (multisets of the few sizes that fit, at most three items) are
enumerated, and the linear program for the fewest containers over them is solved exactly; its whole parts are applied
with actual documents in the slots. What is left, large ones first, goes into the container with the least room that still
holds it. An item over the capacity is cut into full containers and a rest, which is packed like others.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.tokenizer import TOKENIZER_DIR, encode_corpus
from tidemark.session import materialize

#: items in a shard, about; the loss is a fraction of a container for each shard
SHARD_ITEMS = 20_000
#: items above this share of the capacity are large; each share is tried, the fewest containers win
LARGE = (0.25, 0.34, 0.5)
#: groups of large items
GROUPS = 24
#: of reduced costs and of whole numbers
EPSILON = 1e-7


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every multiset of the sizes (descending) that fits, as counts; the sizes are large, so that three items at most do."""
    out: list[list[int]] = []

    def extend(counts: list[int], k: int, room: int) -> None:
        for j in range(k, len(sizes)):
            if sizes[j] <= room:
                counts[j] += 1
                out.append(counts.copy())
                extend(counts, j, room - sizes[j])
                counts[j] -= 1

    extend([0] * len(sizes), 0, capacity)
    return np.array(out, dtype=np.float64).reshape(-1, len(sizes))


def fewest(columns: np.ndarray, demand: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """The configurations of an optimal basis and how often each is used, fractions included: minimise the containers
    that hold the demand of each size exactly. Simplex over all columns, begun with containers of one item each."""
    m = len(demand)
    basis, use = np.eye(m), demand + np.arange(1, m + 1) * 1e-9  # a little apart, against cycling
    for _ in range(50 * m + len(columns)):
        price = np.linalg.solve(basis.T, np.ones(m))
        worth = columns @ price
        enter = columns[int(np.argmax(worth))]
        if worth.max() <= 1 + EPSILON:
            break
        way = np.linalg.solve(basis, enter)
        ratio = np.where(way > EPSILON, use / np.where(way > EPSILON, way, 1.0), np.inf)
        leave = int(np.argmin(ratio))
        use = np.maximum(use - ratio[leave] * way, 0.0)
        use[leave] = ratio[leave]
        basis[:, leave] = enter
    return [(basis[:, k].astype(int), float(use[k])) for k in range(m)]


def pack(items: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Container number of each item (all at most the capacity, in any order), and the number of containers."""
    return min((_pack(items, capacity, large) for large in LARGE), key=lambda x: x[1])


def _pack(items: np.ndarray, capacity: int, share: float) -> tuple[np.ndarray, int]:
    at = np.full(len(items), -1, np.int64)
    order = np.argsort(-items, kind="stable")
    n_large = int(np.searchsorted(-items[order], -share * capacity))
    large = order[:n_large]
    rooms: list[int] = []
    rest = order[n_large:].tolist()
    if n_large:
        cuts = np.unique(np.linspace(0, n_large, min(GROUPS, n_large) + 1).astype(int))
        queues = [large[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
        sizes = [int(items[q[0]]) for q in queues]
        demand = np.array([len(q) for q in queues], dtype=np.float64)
        for config, times in fewest(configurations(sizes, capacity), demand):
            for _ in range(int(times + 1e-6)):
                room = capacity
                for k in np.flatnonzero(config).tolist():
                    for _ in range(int(config[k])):
                        item = queues[k].pop()
                        at[item] = len(rooms)
                        room -= int(items[item])
                rooms.append(room)
        rest = [item for q in queues for item in q] + rest
    # best fit of what is left: rooms in ascending order
    free = sorted((room, k) for k, room in enumerate(rooms))
    for item in rest:
        size = int(items[item])
        i = bisect.bisect_left(free, (size, -1))
        if i == len(free):
            rooms.append(capacity)
            entry = (capacity, len(rooms) - 1)
        else:
            entry = free.pop(i)
        at[item] = entry[1]
        room = entry[0] - size
        if room > 0:
            bisect.insort(free, (room, entry[1]))
    return at, len(rooms)


def pack_shard(ids: np.ndarray, tokens: np.ndarray, tiers: list[tuple[str, int]]) -> pd.DataFrame:
    """tier, id, part, container (within the shard), tokens of every part of every item."""
    out = []
    for tier, capacity in tiers:
        whole = tokens // capacity * (tokens > capacity)
        rest = tokens - whole * capacity
        at, n = pack(rest, capacity)
        keep = (rest > 0) | (whole == 0)
        full = int(whole.sum())
        first = np.cumsum(whole) - whole
        out.append(
            pd.DataFrame({
                "tier": tier,
                "id": np.concatenate([np.repeat(ids, whole), ids[keep]]),
                "part": np.concatenate([np.arange(full) - np.repeat(first, whole), whole[keep]]),
                "container": np.concatenate([n + np.arange(full), at[keep]]),
                "tokens": np.concatenate([np.full(full, capacity), rest[keep]]),
            })
        )
    return pd.concat(out, ignore_index=True)


def _packer(row_id: str, tiers: list[tuple[str, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([row_id, "n_tokens"])
        out = pack_shard(pdf[row_id].to_numpy(), pdf["n_tokens"].to_numpy(), tiers)
        out["shard"] = int(pdf["shard"].iloc[0])
        return out

    return run


def pack_documents(
    df: DataFrame, budgets: DataFrame, row_id: str, text: str, tokenizer_dir: str = TOKENIZER_DIR, shard_items: int = SHARD_ITEMS
) -> DataFrame:
    """tier, capacity, doc (row_id), part, container, tokens: each document in one container of each tier.

    Only a document over a tier's capacity has several parts; all but the last fill a container. Null and empty texts
    have no tokens and lie in some container. Rows with a null id are left out; a repeated id is an item each time.
    budgets is a small fixed table: tier, capacity_tokens, tokenizer; tiers without a positive capacity are left out.
    """
    tiers = [(r.tier, int(r.capacity_tokens), r.tokenizer) for r in budgets.collect() if r.capacity_tokens and r.capacity_tokens > 0]
    docs = df.where(F.col(row_id).isNotNull())
    key = df.schema[row_id]
    schema = T.StructType([
        T.StructField("tier", T.StringType()), T.StructField("id", key.dataType), T.StructField("part", T.LongType()),
        T.StructField("container", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("shard", T.LongType()),
    ])
    packed = None
    for name in sorted({t[2] for t in tiers}):
        own = [(t, c) for t, c, n in tiers if n == name]
        # copies of an id counted, then numbered: the same containers whatever the layout, and a repeated id is spread too
        sizes = materialize(encode_corpus(docs, row_id, text, name, tokenizer_dir, counts_only=True).groupBy(row_id, "n_tokens").agg(F.count(F.lit(1)).alias("_copies")))
        shards = max(1, round((sizes.agg(F.sum("_copies")).first()[0] or 0) / shard_items))
        each = sizes.select(row_id, "n_tokens", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
        dealt = each.select(row_id, "n_tokens", F.pmod(F.xxhash64(row_id, "n_tokens", "_copy"), F.lit(shards)).alias("shard"))
        part = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(_packer(row_id, own), schema)
        packed = part if packed is None else packed.union(part)
    if packed is None:
        packed = df.sparkSession.createDataFrame([], schema)
    capacity = F.create_map(*chain.from_iterable((F.lit(t), F.lit(c)) for t, c, _ in tiers)) if tiers else F.lit(None)
    return packed.select(
        "tier",
        (F.try_element_at(capacity, F.col("tier")) if tiers else F.lit(None).cast("int")).alias("capacity"),
        F.col("id").alias(row_id),
        "part",
        F.concat_ws("-", "tier", "shard", "container").alias("container"),
        "tokens",
    )


def fill(packed: DataFrame) -> DataFrame:
    """tier, containers, tokens, unused (share of the containers' space)."""
    return (
        packed.groupBy("tier", "capacity", "container")
        .agg(F.sum("tokens").alias("tokens"))
        .groupBy("tier", "capacity")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
        .withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    )
