"""Evidence packs with digests on three levels, citations, and what they leave unexplained."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.sequence import context_band

ROLES = {"SUPPORT", "REFUTE", "CONTEXT", "ROOT_CAUSE", "TRIGGER", "CONSEQUENCE"}
# fixed values: citations, a report's list of them at its end, headings and rules, the mark of a citation that fails
CITATION = r"\[\[EV:([0-9a-fA-F]{8,32})\]\]"
TRAILER = r"<!--\s*citations:\s*(\[[^\]]*\])\s*-->"
NO_SENTENCE = r"^\s*#{1,6}\s|^\s*[-*_]{3,}\s*$"
FAILED = "｜⚠引用校验失败:"


def merkle_roots(df: DataFrame, by: list[str], digest: str, salt: str = "") -> DataFrame:
    """by, root, leaves: sha256 over a group's distinct digests, sorted and joined, and the salt.

    The order of rows doesn't matter. The root is defined over all leaves of a group in a row, so one task reads them,
    one after the other as they come sorted; it holds none of them.
    """
    leaves = df.where(F.col(digest).isNotNull()).select(*by, F.col(digest).alias("_leaf")).distinct()
    schema = T.StructType([*[leaves.schema[c] for c in by], T.StructField("root", T.StringType()), T.StructField("leaves", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(zip(*[c.to_pylist() for c in batch.columns[:-1]]), batch.column(len(by)).to_pylist()))
        out = []
        for key, own in groupby(rows, key=lambda r: r[0]):
            state, n = hashlib.sha256(), 0
            for _, leaf in own:
                state.update(leaf.encode())
                n += 1
            state.update(f"|{salt}".encode())
            out.append((*key, state.hexdigest(), n))
        cols = list(zip(*out)) if out else [()] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return leaves.repartition(*by).sortWithinPartitions(*by, "_leaf").mapInArrow(run, schema)


def verify_l1(items: DataFrame, lines: DataFrame) -> DataFrame:
    """row_hash, status of items (row_hash, raw_hash): OK, CHANGED (another raw_hash) or MISSING."""
    now = lines.groupBy("row_hash").agg(F.min("raw_hash").alias("now"))
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("raw_hash"), "OK").otherwise("CHANGED")
    return items.join(now, "row_hash", "left").select("row_hash", status.alias("status"))


def verify_l2(items: DataFrame, contents: DataFrame) -> DataFrame:
    """row_hash, status of items (row_hash, raw_hash, file_sha256, byte_offset, byte_len) against file contents (content)."""
    from tidemark.functions.text import raw_hash

    files = contents.select(F.sha2("content", 256).alias("file_sha256"), "content")
    part = F.substring(F.col("content"), F.col("byte_offset").cast("int") + 1, F.col("byte_len").cast("int"))  # a row's bytes end at 2 GB
    joined = items.join(files, "file_sha256", "left").withColumn("now", raw_hash(part))
    status = F.when(F.col("content").isNull(), "MISSING").when(F.col("now") == F.col("raw_hash"), "OK").otherwise("CHANGED")
    return joined.select("row_hash", status.alias("status"))


def citations(text: Column) -> Column:
    """Hashes cited in a report, each once in order of appearance, then those that only its list at the end names."""
    listed = F.coalesce(F.from_json(F.nullif(F.regexp_extract(text, TRAILER, 1), F.lit("")), "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), F.array_compact(listed)))


def sentences(text: Column) -> Column:
    """What stands between full stops, question and exclamation marks and line feeds, without headings and rules."""
    parts = F.transform(F.split(text, r"[。！？.!?\n]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda s: (s != "") & ~s.rlike(NO_SENTENCE))


def citation_coverage(text: Column) -> Column:
    """Share of sentences with a citation; 1 for a text without sentences."""
    all_ = sentences(text)
    cited = F.filter(all_, lambda s: s.rlike(CITATION))
    return F.when(F.size(all_) == 0, 1.0).otherwise(F.round(F.size(cited) / F.size(all_), 4))


def cites_enough(text: Column, chain: Column, least: float) -> Column:
    """Whether a report cites at least this share of its evidence chain's length, rounded up; true for an empty chain."""
    return (chain <= 0) | (F.size(citations(text)) >= F.ceil(chain * F.lit(least)))


def dangling(cited: DataFrame, pool: DataFrame, lines: DataFrame, key: str = "row_hash") -> DataFrame:
    """key, reason of cited keys that fail: outside the evidence (known in the data or not), or in the evidence but not in the data."""
    marked = (
        cited.where(F.col(key).isNotNull()).select(key).distinct()
        .join(pool.select(key, F.lit(True).alias("_chosen")).distinct(), key, "left")
        .join(lines.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    )
    chosen, known = F.col("_chosen").isNotNull(), F.col("_known").isNotNull()
    reason = F.when(~chosen & known, "NOT_IN_EVIDENCE_SET").when(~chosen, "NOT_IN_DB_AND_NOT_IN_EVIDENCE").when(~known, "NOT_FOUND_IN_DB")
    return marked.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def mark_dangling(text: str, reasons: dict[str, str]) -> str:
    """Citations that fail stay visible, with the reason."""
    return re.sub(CITATION, lambda m: f"[[EV:{m[1]}{FAILED}{reasons[m[1]]}]]" if m[1] in reasons else m[0], text)


#: columns of a line that a snapshot keeps
KEPT = ["line_id", "ts_utc", "ts_kind", "ts_confidence", "component", "level_norm", "ota_phase", "file_path", "line_no", "raw_hash", "byte_offset", "byte_len"]


def freeze(lines: DataFrame, cited: DataFrame, context: int = 5) -> DataFrame:
    """A snapshot of cited rows (row_hash): row_hash, resolvable, KEPT and context, the lines of the file around it.

    context is an array of line_no, raw_line and is_anchor in line order. Hashes that no line has are kept as not resolvable; of
    lines with one hash, that with the smallest line_id is meant.
    """
    wanted = cited.select("row_hash").where(F.col("row_hash").isNotNull()).distinct()
    rows = lines.join(wanted, "row_hash", "left_semi")
    anchors = rows.groupBy("row_hash").agg(F.min_by(F.struct("file_id", *KEPT), "line_id").alias("a")).select("row_hash", "a.*")
    band = context_band(lines.dropDuplicates(["line_id"]).select("file_id", "line_no", "line_id", "raw_line"), anchors, "file_id", "line_no", "line_id", context, context)
    around = band.groupBy(F.col("anchor_id").alias("line_id")).agg(F.array_sort(F.collect_set(F.struct("line_no", "raw_line", "is_anchor"))).alias("context"))
    found = anchors.drop("file_id").join(around, "line_id", "left").withColumn("resolvable", F.lit(True))
    return wanted.join(found, "row_hash", "left").withColumn("resolvable", F.coalesce("resolvable", F.lit(False))).select("row_hash", "resolvable", *KEPT, "context")


def resolve_citations(cited: DataFrame, lines: DataFrame, snapshot: DataFrame, context: int = 50) -> DataFrame:
    """As freeze, with source: live if a line has the hash, else snapshot if that could resolve it, else none."""
    live = freeze(lines, cited, context).withColumn("source", F.lit("live"))
    kept = snapshot.where("resolvable").join(live.where("NOT resolvable").select("row_hash"), "row_hash", "left_semi").withColumn("source", F.lit("snapshot"))
    none = live.where("NOT resolvable").join(kept.select("row_hash"), "row_hash", "left_anti").withColumn("source", F.lit("none"))
    return live.where("resolvable").unionByName(kept.select(live.columns)).unionByName(none)


def unseen(batch: DataFrame, seen: DataFrame, key: str = "row_hash") -> DataFrame:
    """The rows of a round whose key no earlier round had, each key once."""
    return batch.where(F.col(key).isNotNull()).dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)


def item_digest(item: dict) -> str:
    bare = {k: v for k, v in item.items() if k not in ("raw_line", "context")}
    return hashlib.sha256(f"{canonical_json(bare)}|{item.get('raw_hash') or ''}".encode()).hexdigest()


def build_pack(lines: DataFrame, files: DataFrame | None, claim: str, items: list[dict], context: int = 5, salt: str = "") -> dict:
    """A pack of at most 200 items with their lines, file hashes, context and Merkle root; a bounded driver-side document."""
    ids = [i["line_id"] for i in items[:200] if i.get("line_id") is not None]
    hashes = [i["row_hash"] for i in items[:200] if i.get("row_hash")]
    role = {i.get("line_id") or i.get("row_hash"): i.get("role") if i.get("role") in ROLES else "CONTEXT" for i in items}
    hit = lines.where(F.col("line_id").isin(ids) | F.col("row_hash").isin(hashes)).dropDuplicates(["line_id"])
    rows = hit.select("line_id", "row_hash", "raw_hash", "raw_line", "file_id", "line_no", "byte_offset", "byte_len")
    if files is not None:
        rows = rows.join(files.select("file_id", "file_sha256"), "file_id", "left")
    around: dict[int, list[str]] = {}
    if context:
        band = context_band(lines.dropDuplicates(["line_id"]), hit, "file_id", "line_no", "line_id", context, context)
        for r in band.select("anchor_id", "line_no", F.substring("raw_line", 1, 400).alias("t")).orderBy("anchor_id", "line_no").collect():
            around.setdefault(r.anchor_id, []).append(r.t)
    out = []
    for seq, r in enumerate(rows.orderBy("line_id").collect()):
        item = {**r.asDict(), "seq": seq, "role": role.get(r.line_id) or role.get(r.row_hash), "context": around.get(r.line_id, [])}
        out.append({**item, "digest": item_digest(item)})
    digests = sorted(i["digest"] for i in out)
    root = hashlib.sha256(("".join(digests) + "|" + salt).encode()).hexdigest()
    name = hashlib.sha256(canonical_json([claim, sorted(i["row_hash"] or "" for i in out)]).encode()).hexdigest()[:16]
    return {"pack_id": f"EP-{name}", "claim": claim, "items": out, "merkle_root": root, "salt": salt}


def verify_l0(pack: dict) -> bool:
    """Whether a pack agrees with itself."""
    digests = [item_digest({k: v for k, v in i.items() if k != "digest"}) for i in pack["items"]]
    root = hashlib.sha256(("".join(sorted(digests)) + "|" + pack["salt"]).encode()).hexdigest()
    return digests == [i["digest"] for i in pack["items"]] and root == pack["merkle_root"]
