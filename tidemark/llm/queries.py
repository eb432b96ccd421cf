"""The pN_ queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import copies, encoding, packing, runs, spam, term_stats, tokenizer
from tidemark.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every affected record with the chain that restores it ('' where nothing is left to restore it from)."""
    done = encoding.repair(table(spark, d, "raw_records"), "rec_id", "text", "raw_bytes")
    return done.where("affected").drop("affected").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_restored(spark, d).select("rec_id").where(F.col("rec_id").isNotNull()).distinct()


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    stats = term_stats.term_frequencies(table(spark, d, "log_lines"), "template_id", "file_id", "line_id")
    return term_stats.mark_terms(stats).select(
        F.col("term").alias("template_id"), F.col("occurrences").alias("lines"), F.col("records").alias("files"), "mark"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_terms(spark, d).where(F.col("mark").isNotNull()).select("template_id", "mark")


def _events(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "log_lines").select("file_id", "component", "ts_utc", "line_no", "line_id", "template_id")
    events = table(spark, d, "templates").select("template_id", runs.event_key(F.col("template_text")).alias("event"))
    return lines.where(F.col("ts_utc").isNotNull() & F.col("template_id").isNotNull()).join(events, "template_id", "left").withColumn(
        "event", F.coalesce("event", F.concat(F.lit("template "), F.col("template_id").cast("string")))
    )


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    """Near-identical events too: word sets that differ little from those of their run."""
    return runs.collapse_runs(
        _events(spark, d), ["file_id", "component"], "ts_utc", "line_id", "event", penalty=0.1, dissimilarity=runs.jaccard_distance, order="line_no"
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of one event in the runs of near-identical ones."""
    found = runs.collapse_runs(
        _events(spark, d), ["file_id", "component"], "ts_utc", "line_id", "event", 60, dissimilarity=runs.jaccard_distance, order="line_no", parts=True
    )
    return found.where(F.col("rows") >= 3).select(F.col("min_id").alias("line_id_a"), F.col("max_id").alias("line_id_b"))


def _ok_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_lines").where(F.col("parse_status") == "OK").select("line_id", "raw_line")


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each record once with its copies; rows delivered twice count once."""
    return copies.copy_groups(_ok_lines(spark, d).distinct(), "line_id", "raw_line")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = copies.copy_pairs(_ok_lines(spark, d), "line_id", "raw_line")
    return pairs.select(F.col("id_a").alias("line_id_a"), F.col("id_b").alias("line_id_b"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of every tier."""
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_budgets"), "doc_id", "text")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and share of space unused by tier."""
    return packing.fill(p9_pack(spark, d))


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_pages(spark, d).select("doc_id")


QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p7_found": p7_found,
    "p7_copies": p7_copies,
    "p8_ids": p8_ids,
    "p9_pack": p9_pack,
    "p9_fill": p9_fill,
    "p10_found": p10_found,
    "p10_pages": p10_pages,
}

_P3 = """
WITH l AS (SELECT DISTINCT line_id, template_id, file_id FROM log_lines WHERE template_id IS NOT NULL AND line_id IS NOT NULL),
n AS (SELECT count(DISTINCT file_id) AS n FROM l),
t AS (SELECT template_id, count(*) AS lines, count(DISTINCT file_id) AS files FROM l GROUP BY template_id)
SELECT template_id, lines, files,
  CASE WHEN files < 3 THEN 'rare' WHEN files > n.n * CAST(0.15 AS DOUBLE) THEN 'common' END AS mark
FROM t, n"""
_EVENTS = r"""
WITH tk AS (SELECT template_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(template_text),
    '([=:：])\s*[^\s,;|，；]+', '\1 ', 'g'), '<\*>|\b\d[\w.%]*', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS event FROM templates),
l AS (SELECT DISTINCT l.line_id, l.line_no, l.file_id, l.component, epoch_us(l.ts_utc) AS us, coalesce(event, 'template ' || l.template_id) AS event
  FROM log_lines l LEFT JOIN tk USING (template_id) WHERE l.ts_utc IS NOT NULL AND l.template_id IS NOT NULL AND l.line_id IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(event) OVER w = event AND us - lag(us) OVER w <= 60000000 THEN 0 ELSE 1 END AS cut
  FROM l WINDOW w AS (PARTITION BY file_id, component ORDER BY us, line_no NULLS FIRST, line_id)),
r AS (SELECT *, sum(cut) OVER (PARTITION BY file_id, component ORDER BY us, line_no NULLS FIRST, line_id ROWS UNBOUNDED PRECEDING) AS run FROM c)"""

ORACLE: dict[str, str] = {
    "p3_terms": _P3,
    "p3_found": f"SELECT template_id, mark FROM ({_P3}) WHERE mark IS NOT NULL",
    "p5_found": _EVENTS + " SELECT min(line_id) AS line_id_a, max(line_id) AS line_id_b FROM r GROUP BY file_id, component, run HAVING count(*) >= 3",
}
