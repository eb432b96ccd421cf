"""Queries of the evidence operators over the whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import parsers, text
from tidemark.operators import compress, evidence, guard, index, scores, sequence, templates, tools
from tidemark.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "log_lines")


def _once(s: SparkSession, d: str) -> DataFrame:
    """Lines without second deliveries: rows of one line_id are equal, so any of them will do."""
    return _lines(s, d).dropDuplicates(["line_id"])


_ONCE = "(SELECT DISTINCT ON (line_id) * FROM log_lines)"
_ERR = "CAST(count(*) FILTER (level_num >= 40) AS BIGINT) AS errors"


# ---- overviews

@query(f"""SELECT CAST(floor(epoch_us(ts_utc) / 60000000) * 60 AS BIGINT) AS bucket, component, count(*) AS n, {_ERR},
count(*) FILTER (level_num = 30) AS warns FROM log_lines GROUP BY ALL""")
def timeline(s, d):
    return tools.timeline(_lines(s, d), "1m")


@query(f"""SELECT CAST(floor(epoch_us(ts_utc) / 3600000000) * 3600 AS BIGINT) AS bucket, component, count(*) AS n, {_ERR},
count(*) FILTER (level_num = 30) AS warns FROM log_lines
WHERE component IN ('kernel', 'ota_master') AND level_num >= 30 AND ts_utc >= '2024-01-01 00:00:00+00' AND ts_utc <= '2025-12-31 00:00:00+00' GROUP BY ALL""")
def timeline_filtered(s, d):
    return tools.timeline(_lines(s, d), "1h", components=["kernel", "ota_master"], min_level="WARN", time_from="2024-01-01T00:00:00Z", time_to="2025-12-31T00:00:00Z")


@query(f"""SELECT component, level_norm, count(*) AS n, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us, {_ERR}
FROM log_lines GROUP BY ALL""")
def aggregate_dims(s, d):
    return tools.aggregate(_lines(s, d), ["component", "level_norm"])


@query(f"""SELECT ota_phase, ecu_id, parse_status, count(*) AS n, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us, {_ERR}
FROM log_lines WHERE ts_confidence >= 0.6 GROUP BY ALL""")
def aggregate_confident(s, d):
    return tools.aggregate(_lines(s, d), ["ota_phase", "ecu_id", "parse_status"], {"min_ts_confidence": 0.6})


@query("""SELECT CASE WHEN grouping(level_norm) = 0 THEN 'level' WHEN grouping(ts_kind) = 0 THEN 'ts_kind' ELSE 'all' END AS dim,
coalesce(level_norm, ts_kind) AS value, count(*) AS n, count(DISTINCT template_id) AS templates
FROM log_lines GROUP BY GROUPING SETS ((level_norm), (ts_kind), ())""")
def overview_grouping_sets(s, d):
    return tools.overview(_lines(s, d))


@query(f"""SELECT component, count(*) AS lines, {_ERR}, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us,
round(avg(CAST(ts_confidence AS DOUBLE)), 6) AS avg_confidence FROM log_lines GROUP BY component""")
def component_stats(s, d):
    return tools.component_stats(_lines(s, d))


@query(f"""SELECT ota_phase, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us, count(*) AS lines, {_ERR},
round((max(epoch_us(ts_utc)) - min(epoch_us(ts_utc))) / 1000000, 2) AS duration_s FROM log_lines WHERE ota_phase IS NOT NULL GROUP BY 1""")
def phase_timeline(s, d):
    return tools.phase_timeline(_lines(s, d))


@query("""SELECT line_id, row_hash, epoch_us(ts_utc) AS us, component, substr(raw_line, 1, 200) AS raw_line FROM (SELECT DISTINCT line_id, row_hash, component, raw_line, ts_utc FROM log_lines)
WHERE lower(raw_line) LIKE '%aborted%' ORDER BY ts_utc NULLS LAST, line_id LIMIT 5""")
def abort_markers(s, d):
    return tools.abort_markers(_once(s, d), ["aborted"])


@query("""SELECT component, gap_from_us, us AS gap_to_us, round((us - gap_from_us) / 1000000, 3) AS gap_s, prev_id, line_id AS next_id FROM (
SELECT component, line_id, epoch_us(ts_utc) AS us, lag(epoch_us(ts_utc)) OVER w AS gap_from_us, lag(line_id) OVER w AS prev_id
FROM log_lines WHERE ts_utc IS NOT NULL WINDOW w AS (PARTITION BY component ORDER BY epoch_us(ts_utc), line_id)) WHERE us - gap_from_us >= 30000000""")
def find_gaps(s, d):
    return tools.find_gaps(_lines(s, d), 30)


def _top(order: str, where: str = "TRUE") -> str:
    return f"""SELECT template_id, template_text, occurrences, level_mode, epoch_us(last_seen_utc) AS last_us FROM templates
WHERE {where} ORDER BY {order} NULLS LAST, template_id LIMIT 30"""


@query(_top("occurrences DESC"))
def top_templates_frequent(s, d):
    return tools.top_templates(table(s, d, "templates"), "frequent")


@query(_top("occurrences ASC"))
def top_templates_rare(s, d):
    return tools.top_templates(table(s, d, "templates"), "rare")


@query(_top("last_seen_utc DESC"))
def top_templates_newest(s, d):
    return tools.top_templates(table(s, d, "templates"), "newest")


@query(_top("occurrences DESC", "is_error_like AND coalesce(level_mode, '') NOT IN ('DEBUG', 'TRACE')"))
def top_templates_errors(s, d):
    return tools.top_templates(table(s, d, "templates"), "error_only")


@query(_top("occurrences DESC", "components[1] IN ('kernel', 'downloader')"))
def top_templates_of_components(s, d):
    return tools.top_templates(table(s, d, "templates"), "frequent", ["kernel", "downloader"])


# ---- search and context

_SUMMARY = "line_id, epoch_us(ts_utc) AS ts_us, component, level_norm, logger, template_id, ota_phase, ecu_id, dup_count, row_hash, file_id, substr(raw_line, 1, 220) AS preview"


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.unix_micros("ts_utc")).drop("ts_utc", "ts_confidence")


@query(f"SELECT {_SUMMARY} FROM log_lines WHERE contains(lower(raw_line), 'rolled over')")
def search_substring(s, d):
    return _plain(tools.search(_lines(s, d), "Rolled Over", "substring"))


@query(f"""SELECT {_SUMMARY} FROM log_lines WHERE level_num >= 40 AND (contains(lower(msg_tokens), 'watchdog') OR contains(lower(raw_line), 'watchdog')
OR contains(lower(msg_tokens), '磁盘') OR contains(lower(raw_line), '磁盘'))""")
def search_keyword(s, d):
    return _plain(tools.search(_lines(s, d), "watchdog 磁盘", "keyword", min_level="ERROR"))


@query(f"SELECT {_SUMMARY} FROM log_lines WHERE regexp_matches(raw_line, 'rc=-1[0-9]{{2}}.*(tok|req)=[0-9a-f]+')")
def search_regex(s, d):
    return _plain(tools.search(_lines(s, d), "rc=-1[0-9]{2}.*(tok|req)=[0-9a-f]+", "regex"))


@query(f"""SELECT {_SUMMARY} FROM {_ONCE} WHERE contains(lower(raw_line), 'timed out') ORDER BY level_num DESC, ts_utc NULLS LAST, line_id LIMIT 50""")
def search_severity_first(s, d):
    return _plain(tools.search(_once(s, d), "timed out", "substring", limit=50, order="severity"))


@query(f"SELECT {_SUMMARY} FROM {_ONCE} WHERE contains(lower(raw_line), 'timed out') AND line_id > 1000 ORDER BY line_id LIMIT 50")
def search_keyset_page(s, d):
    return _plain(tools.search(_once(s, d), "timed out", "substring", cursor=1000, limit=50, order="cursor"))


@query(f"SELECT {_SUMMARY} FROM log_lines WHERE dup_rank = 0")
def dedup_first_only(s, d):
    return _plain(tools.search(_lines(s, d), "", dedup="first_only"))


_FIRST = """(SELECT line_id, file_id, line_no, row_hash FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts_utc NULLS LAST, line_id) AS r
FROM log_lines WHERE level_num >= 40) WHERE r = 1)"""


@query(f"SELECT line_id, component, raw_line FROM log_lines WHERE line_id IN (SELECT line_id FROM {_FIRST})")
def get_lines(s, d):
    return tools.get_lines(_lines(s, d), tools.first_errors(_lines(s, d), "file_id")).select("line_id", "component", "raw_line")


@query(f"""SELECT a.line_id AS anchor_id, l.line_id, l.line_no, l.line_no = a.line_no AS is_anchor FROM {_FIRST} a
JOIN (SELECT DISTINCT line_id, file_id, line_no FROM log_lines) l ON l.file_id = a.file_id AND l.line_no BETWEEN a.line_no - 10 AND a.line_no + 10""")
def get_context_same_file(s, d):
    anchors = tools.first_errors(_lines(s, d), "file_id").select("line_id", "file_id", "line_no")
    rows = _lines(s, d).select("line_id", "file_id", "line_no").distinct()
    return sequence.context_band(rows, anchors, "file_id", "line_no", "line_id").select("anchor_id", "line_id", "line_no", "is_anchor")


@query(f"""SELECT a.line_id AS anchor_id, l.line_id, l.line_id = a.line_id AS is_anchor FROM {_FIRST} a
JOIN (SELECT DISTINCT line_id FROM log_lines) l ON l.line_id BETWEEN a.line_id - 5 AND a.line_id + 5""")
def get_context_all(s, d):
    one = F.lit(0).alias("all")
    anchors = tools.first_errors(_lines(s, d), "file_id").select(one, F.col("line_id").alias("a"), F.col("line_id"))
    rows = _lines(s, d).select("line_id").distinct().select(one, "line_id")
    return sequence.context_band(rows, anchors, "all", "line_id", "a", 5, 5).select("anchor_id", "line_id", "is_anchor")


_CODES = ", ".join(f"('{c}', '{n}')" for c, n in tools.RESPONSE_CODES.items())


@query(f"""SELECT k.code, k.name, count(l.raw_line) AS n, min(epoch_us(l.ts_utc)) AS first_us, max(epoch_us(l.ts_utc)) AS last_us
FROM (VALUES {_CODES}) k(code, name) LEFT JOIN log_lines l ON contains(lower(l.raw_line), k.code) GROUP BY ALL""")
def code_lookup(s, d):
    return tools.code_lookup(_lines(s, d))


# ---- order, duplicates, storms

@query(f"""SELECT line_id, row_number() OVER (ORDER BY ts_utc NULLS LAST, source_rank, file_id, line_no, line_id) - 1 AS dense_id FROM {_ONCE}""")
def dense_line_ids(s, d):
    rows = _once(s, d).select("line_id", "ts_utc", "source_rank", "file_id", "line_no")
    order = [F.asc_nulls_last("ts_utc"), F.asc_nulls_last("source_rank"), F.asc_nulls_last("file_id"), F.asc_nulls_last("line_no"), F.asc("line_id")]
    return sequence.dense_ids(rows, order, "dense_id").select("line_id", "dense_id")


@query(f"""SELECT line_id, last_value(ota_phase IGNORE NULLS) OVER (ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {_ONCE}""")
def phase_forward_fill(s, d):
    return sequence.forward_fill(_once(s, d).select("line_id", "ota_phase"), [F.asc("line_id")], "ota_phase", "filled").select("line_id", "filled")


_STEPS = f"""WITH a AS (SELECT line_id, file_id, line_no, epoch_us(ts_utc) AS us FROM {_ONCE}),
b AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resolved_us FROM a),
c AS (SELECT *, resolved_us - lag(resolved_us) OVER (PARTITION BY file_id ORDER BY line_no, line_id) AS delta FROM b)"""


@query(_STEPS + """ SELECT line_id, resolved_us, us IS NULL AND resolved_us IS NOT NULL AS derived, CAST(delta // 1000 + CASE WHEN delta < 0 AND delta % 1000 <> 0 AND delta // 1000 * 1000 > delta THEN 0 WHEN delta < 0 AND delta % 1000 <> 0 AND delta // 1000 * 1000 < delta THEN 1 ELSE 0 END AS BIGINT) AS gap_ms,
CAST(sum(CASE WHEN delta < -5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no, line_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS clock_epoch,
concat_ws(',', CASE WHEN delta < -5000000 THEN 'CLOCK_JUMP' END, CASE WHEN delta < 0 THEN 'OUT_OF_ORDER' END) AS flags FROM c""")
def clock_epochs(s, d):
    rows = _once(s, d).select("line_id", "file_id", "line_no", F.unix_micros("ts_utc").alias("us"))
    out = sequence.clock_steps(rows, "file_id", "line_no", "us", tie="line_id")
    return out.select("line_id", "resolved_us", "derived", "gap_ms", "clock_epoch", F.array_join("flags", ",").alias("flags"))


@query(f"""SELECT line_id, CAST(row_number() OVER (PARTITION BY norm_hash ORDER BY file_id, line_no, line_id) - 1 AS INTEGER) AS dup_rank,
CAST(count(*) OVER (PARTITION BY norm_hash) AS INTEGER) AS dup_count FROM {_ONCE} WHERE norm_hash IS NOT NULL""")
def dup_rank_count(s, d):
    rows = _once(s, d).where(F.col("norm_hash").isNotNull()).select("line_id", "norm_hash", "file_id", "line_no")
    return sequence.duplicates(rows, "norm_hash", ["file_id", "line_no", "line_id"]).select("line_id", "dup_rank", "dup_count")


_STORM = """SELECT template_id, CAST(floor(epoch_us(ts_utc) / 1000000) AS BIGINT) AS second, min(component) AS component, count(*) AS n
FROM log_lines WHERE ts_utc IS NOT NULL AND template_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2"""


@query(_STORM)
def storm_windows(s, d):
    return sequence.storms(_lines(s, d), "template_id", "ts_utc", "component", 2)


@query(f"""SELECT l.component, count(*) AS lines, count(*) FILTER (st.template_id IS NOT NULL) AS in_storm FROM log_lines l
LEFT JOIN ({_STORM}) st ON st.template_id = l.template_id AND st.second = CAST(floor(epoch_us(l.ts_utc) / 1000000) AS BIGINT) GROUP BY 1""")
def storm_flags(s, d):
    rows = sequence.flag_storms(_lines(s, d).select("component", "template_id", "ts_utc", "anomaly_flags"), "template_id", "ts_utc", "component", 2)
    return rows.groupBy("component").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.array_contains("anomaly_flags", "STORM")).alias("in_storm"))


@query("""SELECT rec_id, round(greatest(0, least(1, (base - less) * factor)), 3) AS confidence FROM (SELECT DISTINCT rec_id,
CASE WHEN ts_kind = 'WALL' THEN CAST(0.95 AS DOUBLE) WHEN ts_kind IN ('MONOTONIC', 'BOOT_RELATIVE') THEN 0.8 WHEN ts_kind = 'DERIVED' THEN 0.6 ELSE 0 END AS base,
CASE WHEN has_tz THEN CAST(0 AS DOUBLE) ELSE 0.05 END + CASE WHEN has_year THEN CAST(0 AS DOUBLE) ELSE 0.08 END + CASE WHEN precision_digits > 0 THEN CAST(0 AS DOUBLE) ELSE 0.05 END
+ CASE WHEN status = 'OK' THEN 0 ELSE 0.2 END AS less,
CASE WHEN ts_kind = 'WALL' OR boot_id IN (SELECT boot_id FROM clock_anchors WHERE boot_id IS NOT NULL) THEN CAST(1 AS DOUBLE) ELSE 0.85 END AS factor FROM parse_results)""")
def time_confidence(s, d):
    """A record counts as monotone if its status is OK, as anchored if its boot has an anchor."""
    anchored = table(s, d, "clock_anchors").where("boot_id IS NOT NULL").select("boot_id", F.lit(True).alias("anchored")).distinct()
    rows = table(s, d, "parse_results").select("rec_id", "boot_id", "status", "ts_kind", "has_tz", "has_year", "precision_digits").distinct()
    rows = rows.join(anchored, "boot_id", "left")
    monotone, anchor = F.coalesce(F.col("status") == "OK", F.lit(False)), F.col("anchored").isNotNull()
    score = sequence.time_confidence(F.col("ts_kind"), F.col("has_tz"), F.col("has_year"), F.col("precision_digits"), monotone, anchor)
    return rows.select("rec_id", score.alias("confidence"))


@query("""WITH d AS (SELECT DISTINCT rec_id, file_id, line_no, CAST(substr(ts_raw, 1, 2) AS INTEGER) AS month, CAST(substr(ts_raw, 4, 2) AS INTEGER) AS day FROM parse_results
WHERE regexp_matches(ts_raw, '^[0-9]{2}-[0-9]{2} ')),
b AS (SELECT *, CASE WHEN lag(month) OVER (PARTITION BY file_id ORDER BY line_no, rec_id) - month >= 6 THEN 1 ELSE 0 END AS roll FROM d)
SELECT rec_id, 2024 + CAST(sum(roll) OVER (PARTITION BY file_id ORDER BY line_no, rec_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS year FROM b""")
def inferred_years(s, d):
    """Of the stamps without year, had each file begun in 2024."""
    raw = F.col("ts_raw")
    rows = table(s, d, "parse_results").where(raw.rlike("^[0-9]{2}-[0-9]{2} ")).select(
        "rec_id", "file_id", "line_no", F.substring(raw, 1, 2).cast("int").alias("month"), F.substring(raw, 4, 2).cast("int").alias("day"), F.lit(2024).alias("begun")
    )
    return sequence.inferred_year(rows.distinct(), "file_id", "line_no", "month", "day", "begun", tie="rec_id").select("rec_id", "year")


@query("SELECT line_id, component FROM log_lines WHERE level_num >= 40")
def errors_view(s, d):
    return tools.views(_lines(s, d))["v_errors"].select("line_id", "component")


# ---- scalar operators

@query(r"""SELECT line_id, CASE WHEN level_norm IS NOT NULL AND level_norm <> 'UNKNOWN' THEN level_norm
WHEN regexp_matches(raw_line, '(?i)(?:^|[^a-z0-9_])(fatal|panic|corrupt)(?:[^a-z0-9_]|$)|严重') THEN 'FATAL'
WHEN regexp_matches(raw_line, '(?i)(?:^|[^a-z0-9_])(error|fail|failed|failure|exception|abort|denied|invalid|unreachable|enospc|nrc)(?:[^a-z0-9_]|$)|错误|失败|异常|中止') THEN 'ERROR'
WHEN regexp_matches(raw_line, '(?i)(?:^|[^a-z0-9_])(warn|warning|timeout|retry|degraded|below threshold|pending)(?:[^a-z0-9_]|$)|警告|超时') THEN 'WARN' ELSE 'INFO' END AS level FROM log_lines""")
def level_inference(s, d):
    return _lines(s, d).select("line_id", text.inferred_level(F.col("level_norm"), F.col("raw_line")).alias("level"))


def _phase_sql() -> str:
    whens = " ".join(f"WHEN regexp_matches(raw_line, '(?i){p}') THEN '{n}'" for n, p in text.PHASES)
    return f"SELECT line_id, CASE {whens} END AS phase FROM log_lines"


@query(_phase_sql())
def phase_tags(s, d):
    return _lines(s, d).select("line_id", text.phase(F.col("raw_line")).alias("phase"))


def _business_sql() -> str:
    fields = ", ".join(f"nullif(regexp_extract(message, '{pattern}', 1), '') AS {name}" for name, pattern in text.BUSINESS.items())
    return f"SELECT line_id, {fields} FROM log_lines WHERE message IS NOT NULL"


@query(_business_sql())
def business_fields(s, d):
    got = text.business(F.col("message"))
    return _lines(s, d).where(F.col("message").isNotNull()).select("line_id", *[c.alias(n) for n, c in got.items()])


@query(r"""SELECT line_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(message, '([A-Za-z_][\w.\-]{0,40})=("[^"]*"|''[^'']*''|[^\s,;]+)', 0),
lambda p: split_part(p, '=', 1) || '=' || trim(substr(p, strpos(p, '=') + 1), '"''')))), ' ') AS pairs FROM log_lines WHERE message IS NOT NULL""")
def key_values(s, d):
    pairs = F.transform(F.map_entries(text.key_values(F.col("message"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return _lines(s, d).where(F.col("message").isNotNull()).select("line_id", F.array_join(F.array_sort(pairs), " ").alias("pairs"))


@query("""SELECT doc_id, CAST(ceil(w / CAST(1.5 AS DOUBLE) + (n - w) / CAST(4 AS DOUBLE)) AS BIGINT) AS tokens FROM (SELECT doc_id, length(coalesce(text, '')) AS n,
len(regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}]')) AS w FROM documents)""".replace("\\\\", "\\"))
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", text.estimated_tokens(F.col("text")).alias("tokens"))


@query()
def redact_documents(s, d):
    return table(s, d, "documents").select("doc_id", text.redacted(F.col("text")).alias("text"), *[c.alias(f"{n}_hits") for n, c in text.redaction_hits(F.col("text")).items()])


@query()
def canonical_lines(s, d):
    rows = _once(s, d).select("line_id", text.canonical(F.col("raw_line")).alias("canonical"))
    return rows.withColumn("norm_hash", text.norm_hash("canonical"))


@query()
def line_hashes(s, d):
    return _once(s, d).select("line_id", text.raw_hash(F.col("raw_line").cast("binary")).alias("raw_hash"), text.row_hash(F.col("raw_line"), F.col("file_path"), F.col("line_no")).alias("row_hash"))


@query()
def search_tokens(s, d):
    return _once(s, d).select("line_id", text.search_tokens(F.coalesce("message", "raw_line")).alias("tokens"))


@query("""SELECT archive, CASE WHEN coalesce(model, '') = '' THEN '' WHEN length(model) < 12 THEN '****' ELSE left(model, 4) || '****' || right(model, 4) END AS short,
CASE WHEN coalesce(vin, '') = '' THEN '' WHEN length(vin) < 12 THEN '****' ELSE left(vin, 4) || '****' || right(vin, 4) END AS masked FROM packages""")
def masked_secrets(s, d):
    return table(s, d, "packages").select("archive", text.masked_secret(F.col("model")).alias("short"), text.masked_secret(F.col("vin")).alias("masked"))


def _parser_sql() -> str:
    whens = []
    for i, (name, _, pattern, _) in enumerate(parsers.FORMATS):
        if i == 7:
            whens.append("WHEN regexp_matches(line, '^\\s*\\{.*\\}\\s*$') AND json_valid(line) THEN 'json_line'")
        whens.append(f"WHEN regexp_matches(line, '{pattern}') THEN '{name}'")
    return f"SELECT line_id, CASE {' '.join(whens)} ELSE 'fallback_raw' END AS parser FROM (SELECT line_id, rtrim(split_part(raw_line, chr(10), 1), chr(13)) AS line FROM log_lines)"


def _parsed(s, d) -> DataFrame:
    rows = _lines(s, d).select("line_id", "raw_line", parsers.first_line(F.col("raw_line")).alias("line"))
    rows = rows.withColumn("json", parsers.json_object(F.col("line")))
    return rows.withColumn("parser", parsers.parser_name(F.col("line"), F.col("json")))


@query(_parser_sql())
def parser_registry(s, d):
    return _parsed(s, d).select("line_id", "parser")


@query()
def parsed_fields(s, d):
    return parsers.with_parsed(_parsed(s, d), "line", "parser", "json").select("line_id", "parser", *parsers.FIELDS)


@query("""SELECT level_raw, CASE WHEN upper(level_raw) IN ('V', 'VERBOSE', 'T', 'TRACE') THEN 'TRACE' WHEN upper(level_raw) IN ('D', 'DEBUG') OR level_raw = '调试' THEN 'DEBUG'
WHEN upper(level_raw) IN ('I', 'INFO') OR level_raw IN ('信息', '提示') THEN 'INFO' WHEN upper(level_raw) IN ('N', 'NOTICE') THEN 'NOTICE'
WHEN upper(level_raw) IN ('W', 'WARN', 'WARNING') OR level_raw = '警告' THEN 'WARN' WHEN upper(level_raw) IN ('E', 'ERR', 'ERROR') OR level_raw = '错误' THEN 'ERROR'
WHEN upper(level_raw) IN ('F', 'FATAL', 'CRIT', 'CRITICAL', 'S', 'PANIC') OR level_raw = '严重' THEN 'FATAL'
WHEN level_raw IN ('0', '1', '2') THEN 'FATAL' WHEN level_raw = '3' THEN 'ERROR' WHEN level_raw = '4' THEN 'WARN' WHEN level_raw = '5' THEN 'NOTICE' WHEN level_raw = '6' THEN 'INFO' WHEN level_raw = '7' THEN 'DEBUG'
ELSE 'UNKNOWN' END AS level, count(*) AS n FROM log_lines GROUP BY ALL""")
def level_names(s, d):
    return _lines(s, d).groupBy("level_raw").agg(F.count(F.lit(1)).alias("n")).withColumn("level", parsers.level_norm(F.col("level_raw")))


# ---- token index

_POSTINGS = f"(SELECT line_id, unnest(list_distinct(string_split(msg_tokens, ' '))) AS token FROM {_ONCE} WHERE msg_tokens IS NOT NULL)"


@query(f"SELECT token, count(*) AS lines FROM {_POSTINGS} WHERE token <> '' GROUP BY 1")
def token_frequencies(s, d):
    return index.postings(_once(s, d)).groupBy("token").agg(F.sum(F.bit_count("bits")).alias("lines"))


@query(f"SELECT line_id FROM {_POSTINGS} WHERE token IN ('timeout', 'rejected', 'block') GROUP BY 1 HAVING count(*) >= 1")
def index_any(s, d):
    return index.lookup(index.postings(_once(s, d)), ["timeout", "Rejected", "block"], every=False)


@query(f"SELECT line_id FROM {_POSTINGS} WHERE token IN ('zone', 'slot') GROUP BY 1 HAVING count(*) = 2")
def index_all(s, d):
    return index.lookup(index.postings(_once(s, d)), ["zone", "slot", "slot"], every=True)


# ---- statistics and quality

@query("""SELECT file_id, count(*) AS records, max(line_no + line_span - 1) AS lines, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us FROM log_lines GROUP BY 1""")
def file_stats(s, d):
    return scores.file_stats(_lines(s, d))


@query("""WITH n AS (SELECT template_id, level_norm, count(*) AS n FROM log_lines WHERE template_id IS NOT NULL GROUP BY ALL),
m AS (SELECT template_id, level_norm AS level_mode FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY n DESC, level_norm DESC) AS r FROM n) WHERE r = 1)
SELECT template_id, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT component)), ',') AS components, any_value(level_mode) AS level_mode,
min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us, any_value(level_mode) IN ('ERROR', 'FATAL') AS error_like FROM log_lines JOIN m USING (template_id) GROUP BY 1""")
def template_stats(s, d):
    return scores.template_stats(_lines(s, d))


_QUALITY = """SELECT count(*) AS rows, count(*) FILTER (parse_status = 'UNPARSED') AS unparsed, count(*) FILTER (ts_confidence >= 0.6) AS confident,
count(*) FILTER (ts_utc IS NULL) AS without_time, count(*) FILTER (coalesce(row_hash, '') = '') AS without_hash, count(DISTINCT line_id) AS distinct_ids,
count(DISTINCT template_id) AS templates, count(*) FILTER (list_contains(anomaly_flags, 'OUT_OF_ORDER')) AS out_of_order,
count(*) FILTER (list_contains(anomaly_flags, 'MULTILINE')) AS multiline, count(*) FILTER (list_contains(anomaly_flags, 'CLOCK_JUMP')) AS clock_jumps,
count(*) FILTER (list_contains(anomaly_flags, 'STORM')) AS storm_lines, count(*) FILTER (line_span > 1) AS spanning, min(epoch_us(ts_utc)) AS first_us,
max(epoch_us(ts_utc)) AS last_us, max(dup_count) AS most_copies FROM log_lines"""


@query(_QUALITY)
def quality_figures(s, d):
    return scores.quality(_lines(s, d))


@query(f"""WITH q AS ({_QUALITY}) SELECT 'unparsed' AS "check", unparsed / rows <= 0.05 AS passed FROM q UNION ALL SELECT 'confident', confident / rows >= 0.8 FROM q
UNION ALL SELECT 'time', without_time = 0 FROM q UNION ALL SELECT 'templates', templates > 0 FROM q UNION ALL SELECT 'ids', distinct_ids = rows FROM q UNION ALL SELECT 'hashes', without_hash = 0 FROM q
UNION ALL SELECT 'records', rows = (SELECT coalesce(sum(record_count), 0) FROM files) FROM q""")
def quality_checks(s, d):
    return scores.checks(_lines(s, d), table(s, d, "files"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS of, {c} AS value, count(*) AS n, {_ERR} FROM log_lines GROUP BY {c}" for c in ("component", "ts_kind", "level_norm", "parser_name", "ota_phase")))
def quality_distributions(s, d):
    return scores.distributions(_lines(s, d))


@query("""WITH c AS (SELECT pipeline_version, epoch_us(finished_at_utc) - epoch_us(started_at_utc) AS v FROM runs WHERE finished_at_utc IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY pipeline_version ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY pipeline_version) AS n FROM c)
SELECT pipeline_version, min(v) FILTER (i >= round_even((n - 1) * 0.5, 0)) AS p50, min(v) FILTER (i >= round_even((n - 1) * 0.95, 0)) AS p95 FROM r GROUP BY 1""")
def run_percentiles(s, d):
    rows = table(s, d, "runs").withColumn("v", F.unix_micros("finished_at_utc") - F.unix_micros("started_at_utc"))
    return scores.nearest_rank(rows, ["pipeline_version"], "v", {"p50": 0.5, "p95": 0.95})


@query("""SELECT pipeline_version, count(*) AS n, round(avg(v), 9) AS mean, round(coalesce(stddev_samp(v), 0), 9) AS std FROM
(SELECT pipeline_version, unparsed_records / total_records AS v FROM runs WHERE total_records > 0 AND unparsed_records IS NOT NULL) GROUP BY 1""")
def run_repeats(s, d):
    rows = table(s, d, "runs").where("total_records > 0").withColumn("v", F.col("unparsed_records") / F.col("total_records"))
    return scores.repeat_stats(rows, ["pipeline_version"], "v")


# ---- evidence

@query("""SELECT run_id, sha256(array_to_string(list_sort(list(DISTINCT row_hash)), '') || '|tm') AS root, count(DISTINCT row_hash) AS leaves
FROM log_lines WHERE row_hash IS NOT NULL GROUP BY 1""")
def merkle_per_run(s, d):
    return evidence.merkle_roots(_lines(s, d), ["run_id"], "row_hash", "tm")


@query("""SELECT f.file_sha256, l.component, count(*) AS n FROM log_lines l LEFT JOIN files f USING (file_id) WHERE l.level_num >= 40 GROUP BY ALL""")
def evidence_files(s, d):
    errors = _lines(s, d).where(F.col("level_num") >= 40).select("file_id", "component")
    return errors.join(table(s, d, "files").select("file_id", "file_sha256"), "file_id", "left").groupBy("file_sha256", "component").agg(F.count(F.lit(1)).alias("n"))


_CHAIN = f"""(SELECT run_id, line_id, role, row_hash FROM (SELECT *, row_number() OVER (PARTITION BY run_id, role ORDER BY ts_utc NULLS LAST, line_id) AS r FROM
(SELECT *, CASE WHEN level_num >= 40 THEN 'error' WHEN level_num = 30 THEN 'warn' ELSE 'context' END AS role FROM {_ONCE}))
WHERE r <= CASE role WHEN 'error' THEN 6 ELSE 3 END)"""


def _chain(s, d) -> DataFrame:
    role = F.when(F.col("level_num") >= 40, "error").when(F.col("level_num") == 30, "warn").otherwise("context")
    rows = _once(s, d).withColumn("role", role)
    place = F.row_number().over(Window.partitionBy("run_id", "role").orderBy(F.asc_nulls_last("ts_utc"), "line_id"))
    return rows.withColumn("place", place).where(F.col("place") <= F.when(F.col("role") == "error", 6).otherwise(3)).select("run_id", "line_id", "role", "row_hash")


@query(f"SELECT run_id, line_id, role FROM {_CHAIN}")
def evidence_chain(s, d):
    return _chain(s, d).drop("row_hash")


@query(f"SELECT component, count(*) AS n FROM log_lines WHERE level_num >= 40 AND row_hash NOT IN (SELECT row_hash FROM {_CHAIN} WHERE row_hash IS NOT NULL) GROUP BY 1")
def unexplained_errors(s, d):
    errors = _lines(s, d).where((F.col("level_num") >= 40) & F.col("row_hash").isNotNull())
    return errors.join(_chain(s, d).select("row_hash"), "row_hash", "left_anti").groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH now AS (SELECT row_hash, min(raw_hash) AS raw_hash FROM log_lines GROUP BY 1), i AS (SELECT row_hash, raw_hash FROM {_ONCE} WHERE level_num >= 50 AND row_hash IS NOT NULL)
SELECT i.row_hash, CASE WHEN now.raw_hash IS NULL THEN 'MISSING' WHEN now.raw_hash = i.raw_hash THEN 'OK' ELSE 'CHANGED' END AS status FROM i LEFT JOIN now USING (row_hash)""")
def verify_l1(s, d):
    items = _once(s, d).where((F.col("level_num") >= 50) & F.col("row_hash").isNotNull()).select("row_hash", "raw_hash")
    return evidence.verify_l1(items, _lines(s, d))


@query(f"""WITH cited AS (SELECT DISTINCT template_id AS k FROM log_lines WHERE template_id IS NOT NULL UNION SELECT template_id + 100000 FROM templates),
pool AS (SELECT DISTINCT template_id AS k FROM templates WHERE is_error_like)
SELECT k, CASE WHEN k IN (SELECT template_id FROM templates) THEN 'NOT_IN_EVIDENCE_SET' ELSE 'NOT_IN_DB_AND_NOT_IN_EVIDENCE' END AS reason FROM cited WHERE k NOT IN (SELECT k FROM pool)""")
def dangling_keys(s, d):
    known = table(s, d, "templates")
    cited = _lines(s, d).where("template_id IS NOT NULL").select(F.col("template_id").alias("k")).union(known.select((F.col("template_id") + 100000).alias("k")))
    return evidence.dangling(cited, known.where("is_error_like").select(F.col("template_id").alias("k")), known.select(F.col("template_id").alias("k")), "k")


@query(r"""WITH t AS (SELECT doc_id, text, regexp_replace(text, '[0-9a-f]{8}', '[[EV:\0]]', 'g') AS cited FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, cited, trim(p, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS part FROM (SELECT doc_id, cited, unnest(regexp_split_to_array(cited, '[。！？.!?\n]+')) AS p FROM t))
SELECT doc_id, any_value(len(list_distinct(regexp_extract_all(cited, '\[\[EV:([0-9a-fA-F]{8,32})\]\]', 1)))) AS cited,
coalesce(round(avg(CASE WHEN regexp_matches(part, '\[\[EV:[0-9a-fA-F]{8,32}\]\]') THEN CAST(1 AS DOUBLE) ELSE 0 END) FILTER (regexp_replace(part, '[\s\p{Z}]', '', 'g') <> ''
AND NOT regexp_matches(part, '^\s*#{1,6}\s|^\s*[-*_]{3,}\s*$')), 4), 1) AS coverage FROM s GROUP BY 1""")
def citation_coverage(s, d):
    """Documents as reports: every run of eight hexadecimal digits is taken for a citation."""
    docs = table(s, d, "documents").where("text IS NOT NULL").withColumn("cited", F.regexp_replace("text", "([0-9a-f]{8})", "[[EV:$1]]"))
    return docs.select("doc_id", F.size(evidence.citations(F.col("cited"))).cast("bigint").alias("cited"), evidence.citation_coverage(F.col("cited")).alias("coverage"))


@query(f"""WITH e AS (SELECT row_hash, min(line_id) AS line_id FROM log_lines WHERE level_num >= 50 AND row_hash IS NOT NULL GROUP BY 1),
a AS (SELECT e.row_hash, l.file_id, l.line_no FROM e JOIN {_ONCE} l USING (line_id)),
c AS (SELECT a.row_hash, count(*) AS lines FROM a JOIN (SELECT DISTINCT file_id, line_no, raw_line FROM log_lines) l ON l.file_id = a.file_id AND l.line_no BETWEEN a.line_no - 5 AND a.line_no + 5 GROUP BY 1)
SELECT row_hash, line_no, coalesce(c.lines, 0) AS lines FROM a LEFT JOIN c USING (row_hash)""")
def evidence_snapshot(s, d):
    lines = _lines(s, d)
    kept = evidence.freeze(lines, lines.where("level_num >= 50"))
    return kept.select("row_hash", "line_no", F.coalesce(F.size("context"), F.lit(0)).cast("bigint").alias("lines"))


@query(f"""SELECT run_id, row_hash FROM (SELECT run_id, row_hash, min(run_id) OVER (PARTITION BY row_hash) AS first FROM (SELECT DISTINCT run_id, row_hash FROM log_lines
WHERE level_num >= 50 AND row_hash IS NOT NULL)) WHERE first = run_id AND run_id > (SELECT min(run_id) FROM log_lines)""")
def unseen_errors(s, d):
    """Fatal lines of all runs but the first that the runs before hadn't."""
    rows = _lines(s, d).where("level_num >= 50 AND row_hash IS NOT NULL").groupBy("row_hash").agg(F.min("run_id").alias("run_id"))
    first = _lines(s, d).agg(F.min("run_id").alias("first"))
    before = rows.join(F.broadcast(first), F.col("run_id") == F.col("first"), "left_semi")
    return evidence.unseen(rows, before).select("run_id", "row_hash")


# ---- compression

def _tiered(s, d) -> DataFrame:
    lines = _once(s, d).select("line_id", "run_id", "template_id", "level_norm", "level_num", "raw_line", "ts_utc", "component")
    return compress.tiers(lines.join(table(s, d, "templates").select("template_id", "occurrences"), "template_id", "left"))


_WORDS = " OR ".join(f"contains(lower(raw_line), '{w}')" for w in compress.KEEP_WORDS)
_TIERS = f"""(WITH a AS (SELECT l.*, t.occurrences, CASE WHEN coalesce(level_norm IN ('ERROR', 'FATAL') OR {_WORDS}, FALSE) THEN 3
WHEN t.occurrences BETWEEN 1 AND 5 THEN 2 ELSE 1 END AS tier FROM {_ONCE} l LEFT JOIN templates t USING (template_id)),
b AS (SELECT *, row_number() OVER w AS first, lead(1) OVER w IS NULL AS last FROM a WINDOW w AS (PARTITION BY template_id, tier ORDER BY ts_utc NULLS LAST, line_id))
SELECT *, CASE tier WHEN 3 THEN first < 50 OR last WHEN 2 THEN TRUE ELSE first <= 3 END AS keep FROM b)"""


@query(f"SELECT line_id, tier, keep FROM {_TIERS}")
def compress_tiers(s, d):
    return _tiered(s, d).select("line_id", "tier", "keep")


@query(f"""SELECT tier, template_id, count(*) AS folded, min(epoch_us(ts_utc)) AS first_us, max(epoch_us(ts_utc)) AS last_us,
coalesce(array_to_string(list_sort(list(DISTINCT component)), ','), '') AS components,
first(left(raw_line, 160) ORDER BY ts_utc NULLS LAST, line_id) AS sample FROM {_TIERS} WHERE NOT keep GROUP BY 1, 2""")
def compress_folds(s, d):
    return compress.folds(_tiered(s, d))


@query(f"""SELECT run_id, line_id, CAST(spent AS BIGINT) AS spent FROM (SELECT run_id, line_id, sum(ceil(w / CAST(1.5 AS DOUBLE) + (length(raw_line) - w) / CAST(4 AS DOUBLE))) OVER
(PARTITION BY run_id ORDER BY ts_utc NULLS LAST, line_id ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT *, len(regexp_extract_all(raw_line,
'[\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}]')) AS w FROM {_ONCE} WHERE level_num >= 40)) WHERE spent <= 2000""")
def budget_prefix(s, d):
    rows = _once(s, d).where(F.col("level_num") >= 40).select("run_id", "line_id", "ts_utc", "raw_line")
    return compress.within_budget(rows, ["run_id"], "raw_line", 2000).select("run_id", "line_id", "spent")


@query(f"""SELECT run_id, CAST(floor(epoch_us(ts_utc) / 60000000) * 60 AS BIGINT) AS block, count(*) AS lines, {_ERR}, count(DISTINCT component) AS components,
count(DISTINCT template_id) AS templates FROM log_lines WHERE ts_utc IS NOT NULL GROUP BY 1, 2""")
def block_summaries(s, d):
    return compress.block_summaries(_lines(s, d), ["run_id"])


@query(f"""WITH l AS (SELECT *, CAST(floor(epoch_us(ts_utc) / 60000000) * 60 AS BIGINT) AS w FROM {_ONCE})
SELECT w AS "window", count(*) AS lines, coalesce(array_to_string(list_sort(list(DISTINCT component) FILTER (component IS NOT NULL))[:8], ','), '') AS components,
coalesce(array_to_string(list_sort(list(DISTINCT template_id) FILTER (template_id IS NOT NULL))[:12], ','), '') AS templates,
first(left(raw_line, 120) ORDER BY ts_utc NULLS FIRST, line_id) AS sample FROM l GROUP BY 1""")
def window_summaries(s, d):
    out = compress.window_summaries(_once(s, d))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.select("window", "lines", joined("components"), joined("templates"), "sample")


@query(f"""SELECT CAST(floor(epoch_us(ts_utc) / 60000000) * 60 AS BIGINT) AS "window", coalesce(level_norm, '') AS level, count(*) AS n FROM {_ONCE} GROUP BY 1, 2""")
def window_levels(s, d):
    return compress.window_summaries(_once(s, d)).select("window", F.inline("levels"))


# ---- templates

@query()
def mined_templates(s, d):
    rows = _once(s, d).select("line_id", "file_id", "line_no", F.coalesce("message", "raw_line").alias("message"))
    return templates.mine(rows, "message", ["file_id", "line_no", "line_id"]).select("line_id", "template_id", "template")


# ---- guarded SQL

def _sql(s, d, text_: str) -> DataFrame:
    known = {n: table(s, d, n) for n in ("log_lines", "files", "templates", "runs", "clock_anchors")}
    return guard.run_sql(s, {**known, **tools.views(known["log_lines"])}, text_)


_CUBE = "SELECT component, level_norm, count(*) AS n, grouping(component) AS g1, grouping(level_norm) AS g2 FROM log_lines GROUP BY CUBE (component, level_norm)"
_ROLLUP = "SELECT run_id, ota_phase, count(DISTINCT file_id) AS files FROM log_lines GROUP BY ROLLUP (run_id, ota_phase)"
_SETS = "SELECT template_id FROM templates WHERE is_error_like INTERSECT SELECT template_id FROM log_lines WHERE level_num >= 40 EXCEPT SELECT template_id FROM templates WHERE level_mode = 'FATAL'"
_CTE = """WITH e AS (SELECT file_id, count(*) AS n FROM log_lines WHERE level_num >= 40 GROUP BY file_id),
r AS (SELECT file_id, n, rank() OVER (ORDER BY n DESC) AS place, CAST(percent_rank() OVER (ORDER BY n) AS DOUBLE) AS share FROM e)
SELECT r.file_id, f.component, r.n, r.place, round(r.share, 6) AS share FROM r JOIN files f ON f.file_id = r.file_id"""
_CORRELATED = "SELECT r.run_id, r.total_files FROM runs r WHERE EXISTS (SELECT 1 FROM log_lines l WHERE l.run_id = r.run_id AND l.level_num >= 50) AND r.total_files >= (SELECT avg(total_files) FROM runs)"
_FULL = "SELECT coalesce(f.archive_path, r.input_archive) AS archive, count(DISTINCT f.file_id) AS files, count(DISTINCT r.run_id) AS runs FROM files f FULL JOIN runs r ON f.archive_path = r.input_archive GROUP BY 1"


@query(_CUBE)
def sql_cube(s, d):
    return _sql(s, d, _CUBE)


@query(_ROLLUP)
def sql_rollup(s, d):
    return _sql(s, d, _ROLLUP)


@query(_SETS)
def sql_set_operations(s, d):
    return _sql(s, d, _SETS)


@query(_CTE)
def sql_cte_window(s, d):
    return _sql(s, d, _CTE)


@query(_CORRELATED)
def sql_correlated(s, d):
    return _sql(s, d, _CORRELATED)


@query(_FULL)
def sql_full_join(s, d):
    return _sql(s, d, _FULL)


@query(f"""SELECT component, CAST(sum(errors) AS BIGINT) AS errors, max(lines) AS lines FROM (SELECT component, count(*) AS lines, {_ERR} FROM log_lines GROUP BY 1) GROUP BY 1""")
def sql_views(s, d):
    return _sql(s, d, "SELECT c.component, sum(c.errors) AS errors, max(c.lines) AS lines FROM v_component_stats c GROUP BY 1")
