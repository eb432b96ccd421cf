"""From archives to the evidence table: read, parse, time, fingerprint, number, write."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parsers, text
from tidemark.functions.instants import trimmed, with_interpretations
from tidemark.operators import clock, scores, sequence, templates
from tidemark.rules import Rules
from tidemark.session import materialize
from tidemark.sources import archives

VERSION = "1.0"

RULES = Rules()
META = "task_id string, campaign_id string, vin string, model string, region string, timezone string, collected_at string"
ZONE = "Asia/Shanghai"
#: what names a record while it is built
KEY = ["file_id", "line_no"]
# fixed value: words of a template that speaks of an error
ERROR_LIKE = "(?i)fail|error|exception|timeout|abort|panic|denied|nrc|invalid|insufficient|错误|失败|异常|超时|中止"
RUNS = (
    "run_id string, started_at_utc timestamp, finished_at_utc timestamp, pipeline_version string, schema_version int, input_archive string, input_sha256 string, "
    "config_hash string, total_files int, total_bytes bigint, total_lines bigint, total_records bigint, unparsed_records bigint, merkle_root string, tenant_id string"
)


def package_meta(found: DataFrame) -> DataFrame:
    """archive, task_id ... collected_at from each archive's package_meta.json."""
    doc = F.from_json(F.col("content").cast("string"), META)
    return found.where((F.col("status") == "OK") & (F.col("member") == "package_meta.json")).select("archive", doc.alias("m")).select("archive", "m.*")


def _boot_start() -> Column:
    """Without an anchor a monotonic clock is taken to have started an hour before the file's last change."""
    return F.unix_micros("mtime_utc") - 3_600_000_000


def evidence_rows(recs: DataFrame, files: DataFrame, meta: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The parsed and timed rows of records; no ids across files yet."""
    around = files.select(
        "file_id", "file_seq", "archive_path", "rel_path", "component", "source_rank", "mtime_utc", "encoding"
    ).join(meta.withColumnRenamed("archive", "archive_path"), "archive_path", "left")
    rows = recs.join(around, "file_id")
    rows = rows.withColumn("_line", parsers.first_line(F.col("text"))).withColumn("_json", parsers.json_object(F.col("_line")))
    rows = rows.withColumn("parser_name", parsers.parser_name(F.col("_line"), F.col("_json"), rules.formats))
    rows = parsers.with_parsed(rows, "_line", "parser_name", "_json", rules.formats).drop("_line", "_json")
    rows = rows.withColumn("p", F.struct(*parsers.FIELDS)).drop(*parsers.FIELDS)
    # all that a record's own text and bytes give is computed where it is read
    business = text.business(F.col("text"))
    own = {
        "_zone": F.coalesce("timezone", F.lit(ZONE)),
        "_collected": F.coalesce(F.col("collected_at").try_cast("timestamp"), F.col("mtime_utc")),
        "_level": text.inferred_level(F.col("p.level_norm"), F.coalesce("p.message", "text")),
        "_tokens": text.search_tokens(F.coalesce("p.message", "text")),
        "_raw_hash": text.raw_hash("raw_bytes"),
        "_norm_hash": text.norm_hash(text.canonical(F.col("text"))),
        "_row_hash": text.row_hash(F.col("text"), F.col("rel_path"), F.col("line_no")),
        "_phase": text.phase(F.col("text"), rules.phases),
        "_vin": text.mask_vin("vin"),
        **{f"_{name}": business[name] for name in ("ota_task_id", "campaign_id", "ecu_id")},
    }
    rows = materialize(rows.withColumns(own).drop("raw_bytes"))
    # times are found from the few columns that they need, and joined to the rows once
    mono = F.when(F.col("p.mono").isNotNull(), _boot_start() + F.round(F.col("p.mono") * 1_000_000).cast("bigint"))
    stamps = with_interpretations(rows.select(*KEY, "_zone", "_collected", trimmed(F.col("p.ts")).alias("_stamp"), mono.alias("_mono")), "_stamp", "_zone", "_collected")
    one = F.array(F.struct(F.col("_mono").alias("early"), F.col("_mono").alias("late")))
    keyed = materialize(stamps.select(*KEY, F.inline_outer(F.when(F.col("_mono").isNotNull(), one).otherwise(F.slice("instants", 1, 1)))))
    # a repeated hour resolves along the file, as for every stamp
    solved = clock.resolve(keyed.where(F.col("early").isNotNull()).select(F.struct(*KEY).alias("rec_id"), *KEY, "early", "late"))
    times = keyed.select(*KEY).join(solved.select("rec_id.*", "utc_us"), KEY, "left")
    timed = rows.join(sequence.clock_steps(times, "file_id", "line_no", "utc_us"), KEY)
    kind = F.when(F.col("utc_us").isNotNull(), F.col("p.ts_kind")).when(F.col("derived"), "DERIVED").otherwise("NONE")
    has_tz = F.coalesce(F.col("p.ts").rlike(r"(Z|[+-]\d{2}:?\d{2})$") & F.col("p.ts").rlike(r"\d{4}-\d{2}-\d{2}T"), F.lit(False))
    has_year = F.coalesce(F.col("p.ts").rlike(r"^\d{4}[-/]"), F.lit(False))
    digits = F.length(F.regexp_extract(F.coalesce("p.ts", F.col("p.mono").cast("string"), F.lit("")), r"[.,](\d+)", 1))
    monotone = ~F.array_contains("flags", "OUT_OF_ORDER")
    level = F.col("_level")
    return timed.select(
        "file_seq", "file_id", F.col("rel_path").alias("file_path"), "line_no", "byte_offset", "byte_len", "line_span", "source_rank", "component",
        F.timestamp_micros("resolved_us").alias("ts_utc"),
        F.from_utc_timestamp(F.timestamp_micros("resolved_us"), F.col("_zone")).cast("timestamp_ntz").alias("ts_local"),
        F.concat(F.lit("boot-"), "component").alias("boot_id"), F.coalesce("p.ts", F.col("p.mono").cast("string")).alias("ts_raw"), kind.alias("ts_kind"),
        sequence.time_confidence(kind, has_tz, has_year, digits, monotone, F.lit(False)).cast("float").alias("ts_confidence"),
        F.round(F.col("p.mono") * 1_000_000_000).cast("bigint").alias("monotonic_ns"), "clock_epoch", F.col("gap_ms").alias("ts_gap_ms"),
        F.col("p.process").alias("process"), F.col("p.pid").alias("pid"), F.col("p.tid").alias("tid"), F.col("p.logger").alias("logger"), F.col("p.src_loc").alias("src_loc"),
        F.col("p.level_raw").alias("level_raw"), level.alias("level_norm"), text.level_number(level).cast("smallint").alias("level_num"),
        F.col("p.message").alias("message"), F.col("text").alias("raw_line"), F.col("_tokens").alias("msg_tokens"),
        F.col("p.fields").alias("fields"), F.col("_raw_hash").alias("raw_hash"), F.col("_norm_hash").alias("norm_hash"),
        F.col("_row_hash").alias("row_hash"),
        F.coalesce("_ota_task_id", "task_id").alias("ota_task_id"), F.coalesce("_campaign_id", "campaign_id").alias("campaign_id"),
        F.col("_ecu_id").alias("ecu_id"), F.col("_phase").alias("own_phase"), F.col("_vin").alias("vin_masked"),
        F.when(F.col("decode_error"), "ENCODING_ERROR").when(F.col("truncated"), "TRUNCATED").otherwise(F.col("p.status")).alias("parse_status"),
        "parser_name", F.lit(VERSION).alias("parser_version"), "encoding",
        F.array_sort(F.concat("flags", F.array_compact(F.array(
            F.when(F.col("decode_error"), "DECODE_ERROR"), F.when(F.col("truncated"), "GIANT_LINE"), F.when(F.col("line_span") > 1, "MULTILINE"),
        )))).alias("anomaly_flags"),
        F.date_format(F.coalesce(F.timestamp_micros("resolved_us"), "_collected"), "yyyy-MM-dd").alias("dt"),
    )


def finish(rows: DataFrame, run_id: str, storm_lines: int = sequence.STORM_LINES) -> tuple[DataFrame, DataFrame]:
    """Ids, templates, duplicate marks, filled phases and storms over all rows; and the templates' texts (template_id, template).

    Each of these is found from the few columns that it needs; the rows are shuffled once, to be joined with all of them.
    """
    rows = materialize(rows)
    text = F.coalesce("message", "raw_line").alias("_text")
    mined = materialize(templates.mine(rows.select(*KEY, "file_seq", "component", "ts_utc", text), "_text", ["file_seq", "line_no"]).drop("_text", "file_seq"))
    marked = sequence.duplicates(rows.select(*KEY, "file_seq", "norm_hash"), "norm_hash", ["file_seq", "line_no"]).select(*KEY, "dup_rank", "dup_count")
    order = [F.asc_nulls_last("ts_utc"), F.asc("source_rank"), F.asc("file_id"), F.asc("line_no")]
    numbered = sequence.dense_ids(rows.select(*KEY, "ts_utc", "source_rank", "own_phase"), order, "line_id")
    filled = sequence.forward_fill(numbered, [F.asc("line_id")], "own_phase", "ota_phase").select(*KEY, "line_id", "ota_phase")
    joined = rows.drop("own_phase").join(mined.select(*KEY, "template_id"), KEY).join(marked, KEY).join(filled, KEY)
    storms = sequence.storms(mined, "template_id", "ts_utc", "component", storm_lines)
    flagged = sequence.flag_storms(joined, "template_id", "ts_utc", "component", storm_lines, storms)
    return flagged.withColumn("run_id", F.lit(run_id)).withColumn("schema_version", F.lit(1)), mined.select("template_id", "template")


def write_lines(lines: DataFrame, path: str) -> None:
    """Parquet by component and day, sorted by time inside files so that row groups can be skipped; bloom filter on row_hash."""
    (
        lines.repartition("component", "dt")
        .sortWithinPartitions("component", "dt", "ts_utc", "line_id")
        .write.mode("overwrite")
        .partitionBy("component", "dt")
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#row_hash", "true")
        .parquet(path)
    )


def template_rows(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """The templates table; texts are template_id and template of the mined rows."""
    texts = texts.where(F.col("template_id").isNotNull()).groupBy("template_id").agg(F.min("template").alias("template_text"))
    return scores.template_stats(lines).join(texts, "template_id").select(
        "template_id", "template_text", F.abs(templates.template_hash(F.col("template_text"))).cast("decimal(20,0)").alias("template_hash"),
        F.regexp_count("template_text", F.lit(r"<\*>")).alias("param_count"), "occurrences",
        F.timestamp_micros("first_us").alias("first_seen_utc"), F.timestamp_micros("last_us").alias("last_seen_utc"),
        F.split("components", ",").alias("components"), "level_mode",
        F.col("template_text").rlike(ERROR_LIKE).alias("is_error_like"),
    )


def parse_error_rows(lines: DataFrame) -> DataFrame:
    """Every line that no format matches."""
    return lines.where(F.col("parse_status") == "UNPARSED").select(
        "file_id", "line_no", "byte_offset", F.lit("NO_PARSER_MATCH").alias("reason"), F.substring("raw_line", 1, 512).alias("raw_snippet")
    )


def build(spark: SparkSession, archive_path: str, workspace: str, run_id: str = "R0", tenant: str | None = None, rules: Rules = RULES) -> dict:
    """Builds log_lines, files, templates, parse_errors and runs below the workspace; gives the counts and checks."""
    started = datetime.now(timezone.utc)
    found = materialize(archives.read_members(spark, archive_path))
    files = materialize(archives.parse_order(archives.inventory(found, rules.components)))
    rows = evidence_rows(archives.read_records(files, found), files, package_meta(found), rules)
    finished, texts = finish(rows, run_id)
    write_lines(finished, f"{workspace}/log_lines")
    lines = spark.read.parquet(f"{workspace}/log_lines")
    template_rows(lines, texts).write.mode("overwrite").parquet(f"{workspace}/templates")
    stats = scores.file_stats(lines)
    named = stats.withColumnsRenamed({"records": "record_count", "lines": "line_count"})
    named.join(files.drop("component"), "file_id").write.mode("overwrite").parquet(f"{workspace}/files")
    parse_error_rows(lines).write.mode("overwrite").parquet(f"{workspace}/parse_errors")
    quality = scores.quality(lines).first().asDict()
    sizes = files.agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")).first()
    total_lines = stats.agg(F.sum("lines")).first()[0]
    run = (
        run_id, started, datetime.now(timezone.utc), VERSION, 1, archive_path, None, None, sizes["n"], sizes["bytes"], total_lines,
        quality["rows"], quality["unparsed"], "", tenant,
    )
    spark.createDataFrame([run], RUNS).write.mode("overwrite").parquet(f"{workspace}/runs")
    return {"run_id": run_id, **quality, "checks": {r.check: r.passed for r in scores.checks(lines, spark.read.parquet(f"{workspace}/files")).collect()}}


def write_manifest(manifest: dict, path: str) -> None:
    """Written beside, then moved into place."""
    with open(f"{path}.tmp", "w") as f:
        json.dump(manifest, f, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)
