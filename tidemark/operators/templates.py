"""Message templates by a tree of fixed depth, the same in whatever order partitions run.

Tokens are words between blanks. A message's path is its token count and its first three tokens, with parameters as
wildcards; clusters never cross paths, so a path is the unit of work. A node takes its first hundred distinct
children (by first appearance); later ones share the wildcard. That rewriting is done level by level on the distinct
paths, before the miner runs. Within a path messages come in order; one joins the first most similar cluster at or
above the threshold, whose differing positions become wildcards, or founds its own, with its parameters as wildcards.
Ids follow first appearance.

Only distinct messages are mined. A repeat changes no cluster, since the one that its first joined covers it; but it
belongs to an earlier cluster if that has come to cover it meanwhile. These moves are found from the clusters' history.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

# fixed values: similarity, tokens in a path, children of a node, clusters (the reference's limit, to be asked for)
SIMILAR, DEPTH, CHILDREN, CLUSTERS = 0.4, 3, 100, 5000
WILD = "<*>"
PATH = ["t_size", "t0", "t1", "t2"]
# fixed values: tokens that are parameters: digits and their marks, hexadecimal numbers
PARAMETER = r"^(?:(?=[^{d}]*[{d}])[{d}.:,\-+/]+|0x[0-9a-fA-F]+|[0-9a-fA-F]{{8,}})$"
JAVA_PARAMETER, PYTHON_PARAMETER = PARAMETER.format(d=r"\p{Nd}"), re.compile(PARAMETER.format(d=r"\d"))
BLANK = r"(?U)[\s\x1c-\x1f]+"
MINED = "message string, since bigint, founded bigint, template string"


def mine_path(messages: list[str], places: list[int]) -> list[tuple[str, int | None, int, str]]:
    """Distinct messages of one path and length, in order of first appearance, to clusters.

    message, since, founded, template: where since is none, the cluster that the message joins or founds; else an earlier
    one that covers it after the message of that place. Clusters are named by their founder's place.
    """
    texts = [m.split() or [""] for m in messages]
    masked = [WILD if PYTHON_PARAMETER.match(t) else t for t in texts[0]]
    if len(texts) == 1:
        return [(messages[0], None, places[0], " ".join(masked))]
    codes: dict[str, int] = {WILD: 0}
    size = len(texts[0])
    words = np.array([[codes.setdefault(t, len(codes)) for t in text] for text in texts], np.int64)
    patterns = np.zeros((16, size), np.int64)
    history: list[list[tuple[int, np.ndarray]]] = []
    founder: list[int] = []
    member = np.zeros(len(texts), np.int64)
    for i, own in enumerate(words):
        k = -1
        if founder:
            known = patterns[: len(founder)]
            same = ((known == own) | (known == 0)).sum(axis=1)
            k = int(same.argmax())
            if same[k] / size < SIMILAR:
                k = -1
        if k < 0:
            if len(founder) == len(patterns):
                patterns = np.vstack([patterns, np.zeros_like(patterns)])
            k = len(founder)
            patterns[k] = [0 if PYTHON_PARAMETER.match(t) else code for t, code in zip(texts[i], own)]
            founder.append(i)
            history.append([])
        else:
            differs = (patterns[k] != own) & (patterns[k] != 0)
            if differs.any():
                patterns[k][differs] = 0
                history[k].append((i, patterns[k].copy()))
        member[i] = k
    names = list(codes)
    templates = [" ".join(names[c] for c in p) for p in patterns[: len(founder)].tolist()]
    out = [(m, None, places[founder[k]], templates[k]) for m, k in zip(messages, member.tolist())]
    for k, changes in enumerate(history):
        if not changes or k == len(founder) - 1:
            continue
        later = np.flatnonzero(member > k)
        for i in later[((words[later] == patterns[k]) | (patterns[k] == 0)).all(axis=1)].tolist():
            since = next(at for at, p in changes if ((p == words[i]) | (p == 0)).all())
            out.append((messages[i], places[since], places[founder[k]], templates[k]))
    return out


def mine_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths, one after the other, of rows in order: PATH, size, first, message."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    out: list[tuple] = []
    for _, own in groupby(rows, key=lambda r: r[:5]):
        *_, places, messages = zip(*own)
        out += mine_path(list(messages), list(places))
        if len(out) >= 10_000:
            yield _mined(out)
            out = []
    yield _mined(out)


def _mined(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["message", "since", "founded", "template"])


def _paths(messages: DataFrame) -> DataFrame:
    """Adds size and PATH, the keys on a message's way through the tree: children beyond a node's first hundred are wildcards."""
    words = F.split(F.trim(F.regexp_replace("message", BLANK, " ")), " ")
    key = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    keys = {"size": F.size(words)} | {f"w{i}": F.when(key(i).rlike(JAVA_PARAMETER), WILD).otherwise(key(i)) for i in range(DEPTH)}
    keyed = messages.withColumns(keys)
    # the way of each distinct run of keys, of which there are far fewer than messages
    ways = materialize(keyed.groupBy(*keys).agg(F.min("first").alias("first")))
    node: list[str] = []
    for name, child in zip(PATH, keys):
        seen = ways.groupBy(*node, F.col(child).cast("string").alias("child")).agg(F.min("first").alias("since"))
        place = F.row_number().over(Window.partitionBy(*node).orderBy("since"))
        kept = seen.withColumn("place", place).where(F.col("place") <= CHILDREN).select(*[F.col(c).alias(f"k_{c}") for c in node], "child")
        on = [F.col(c) == F.col(f"k_{c}") for c in node] + [F.col(child).cast("string") == F.col("child")]
        ways = ways.join(kept, on, "left").withColumn(name, F.coalesce("child", F.lit(WILD))).drop("child", *[f"k_{c}" for c in node])
        node.append(name)
    return keyed.join(ways.drop("first"), list(keys))


def mine(rows: DataFrame, message: str, order: list[str], clusters: int | None = None) -> DataFrame:
    """Adds template_id (1, 2 ... by first appearance; 0 beyond `clusters`, such as CLUSTERS, if given) and template to rows.

    Equal messages are one item, placed where they first appear. Null messages get null. A path's distinct messages are
    mined in one task, as each depends on those before it.
    """
    from tidemark.operators.sequence import dense_ids

    distinct = rows.where(F.col(message).isNotNull()).groupBy(F.col(message).alias("message")).agg(F.min(F.struct(*order)).alias("place"))
    placed = materialize(dense_ids(distinct, [F.asc("place"), F.asc("message")], "first"))
    # a task takes whole paths, one after the other, since a call for each of many small paths costs more than their work
    keys = [*PATH, "size"]
    dealt = _paths(placed.select("message", "first")).select(*keys, "first", "message")
    # as many tasks as any shuffle has: the work is in the messages, not in their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mined = materialize(dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "first").mapInArrow(mine_paths, MINED))
    number = F.col("n") + 1
    if clusters is not None:
        number = F.when(F.col("n") < clusters, number).otherwise(0)
    founders = mined.groupBy("founded").agg(F.first("template").alias("template"))
    numbered = dense_ids(founders, [F.asc("founded")], "n").select("founded", "template", number.cast("int").alias("template_id"))
    first = mined.where("since IS NULL").select(F.col("message").alias("_message"), F.col("founded").alias("_founded"))
    out = rows.join(first, F.col(message) == F.col("_message"), "left").drop("_message")
    moves = mined.where("since IS NOT NULL")
    if not moves.isEmpty():
        since = moves.join(placed.select(F.col("first").alias("since"), "place"), "since")
        moved = since.groupBy(F.col("message").alias("_message")).agg(F.collect_list(F.struct("place", "founded")).alias("_moves"))
        reached = F.filter("_moves", lambda x: x["place"] < F.struct(*order))
        out = out.join(moved, F.col(message) == F.col("_message"), "left").drop("_message")
        out = out.withColumn("_founded", F.least("_founded", F.array_min(F.transform(reached, lambda x: x["founded"])))).drop("_moves")
    return out.join(numbered, F.col("_founded") == F.col("founded"), "left").drop("_founded", "founded")


def template_hash(template: Column) -> Column:
    return F.xxhash64(template)
