"""The analytic tools over the evidence tables: six overviews, six ways down, as DataFrame functions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import guard, sequence
from tidemark.schema import BUCKETS, LEVEL_NUM

# fixed values: dimensions of aggregate, columns of a line's summary, roles in evidence
DIMENSIONS = ["component", "level_norm", "template_id", "ota_phase", "ecu_id", "parser_name", "ts_kind", "parse_status", "dt", "logger"]
SUMMARY = ["line_id", "ts_utc", "component", "level_norm", "logger", "template_id", "ota_phase", "ecu_id", "ts_confidence", "dup_count", "row_hash", "file_id"]
# fixed values: codes of negative responses
RESPONSE_CODES = {
    "0x10": "generalReject", "0x11": "serviceNotSupported", "0x13": "incorrectMessageLength", "0x22": "conditionsNotCorrect",
    "0x24": "requestSequenceError", "0x31": "requestOutOfRange", "0x33": "securityAccessDenied", "0x36": "exceedNumberOfAttempts",
    "0x37": "requiredTimeDelayNotExpired", "0x71": "transferDataSuspended", "0x72": "generalProgrammingFailure",
    "0x73": "wrongBlockSequenceCounter", "0x78": "responsePending", "0x92": "voltageTooHigh", "0x93": "voltageTooLow",
}
# fixed values: words of an aborted campaign
BAD_WORDS = ["aborted at", "campaign aborted"]


def us(ts: str) -> Column:
    return F.unix_micros(ts)


def instant(text: str | None) -> datetime | None:
    """ISO text to a time; None for text that is none, which then filters nothing."""
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def where(
    df: DataFrame, components: list[str] | None = None, min_level: str | None = None, time_from: str | None = None, time_to: str | None = None,
    min_ts_confidence: float | None = None, ota_phase: str | None = None, ecu_id: str | None = None,
) -> DataFrame:
    """The filters that tools share; both ends of the time range are inside. An unknown level filters nothing."""
    if components:
        df = df.where(F.col("component").isin(components))
    if min_level:
        df = df.where(F.col("level_num") >= LEVEL_NUM.get(min_level.upper(), 0))
    if (t := instant(time_from)) is not None:
        df = df.where(F.col("ts_utc") >= F.lit(t))
    if (t := instant(time_to)) is not None:
        df = df.where(F.col("ts_utc") <= F.lit(t))
    if min_ts_confidence is not None:
        df = df.where(F.col("ts_confidence") >= min_ts_confidence)
    if ota_phase:
        df = df.where(F.col("ota_phase") == ota_phase)
    return df.where(F.col("ecu_id") == ecu_id) if ecu_id else df


def matching(query: str, mode: str = "keyword") -> Column:
    """keyword: any of the words, in msg_tokens or raw_line; substring: in raw_line; both without case. regex: Java's."""
    if mode == "regex":
        try:
            re.compile(query)
        except re.error as e:
            raise ValueError(f"not a regular expression: {e}") from None
        return F.col("raw_line").rlike(query)
    raw = F.lower("raw_line")
    if mode == "substring":
        return raw.contains(query.lower())
    out = F.lit(not query.split())
    for word in query.lower().split():
        out = out | F.coalesce(F.lower("msg_tokens").contains(word), F.lit(False)) | raw.contains(word)
    return out


def timeline(lines: DataFrame, bucket: str = "1m", **filters) -> DataFrame:
    """bucket (epoch seconds, null for lines without time), component, n, errors, warns."""
    seconds = BUCKETS.get(bucket, 60)
    return (
        where(lines, **filters)
        .groupBy((F.floor(us("ts_utc") / (seconds * 1_000_000)) * seconds).alias("bucket"), "component")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level_num") >= 40).alias("errors"), F.count_if(F.col("level_num") == 30).alias("warns"))
    )


def aggregate(lines: DataFrame, group_by: list[str], filters: dict | None = None) -> DataFrame:
    """The dimensions with n, first_us, last_us and errors."""
    if bad := [d for d in group_by if d not in DIMENSIONS]:
        raise ValueError(f"not a dimension: {bad}")
    return (
        where(lines, **(filters or {}))
        .groupBy(*group_by)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(us("ts_utc")).alias("first_us"), F.max(us("ts_utc")).alias("last_us"),
            F.count_if(F.col("level_num") >= 40).alias("errors"),
        )
    )


def overview(lines: DataFrame) -> DataFrame:
    """One pass: lines by level, by kind of time, and in all with the number of templates; dim says which."""
    lines.createOrReplaceTempView("tidemark_overview")
    return lines.sparkSession.sql(
        """SELECT CASE WHEN grouping(level_norm) = 0 THEN 'level' WHEN grouping(ts_kind) = 0 THEN 'ts_kind' ELSE 'all' END AS dim,
        coalesce(level_norm, ts_kind) AS value, count(*) AS n, count(DISTINCT template_id) AS templates
        FROM tidemark_overview GROUP BY GROUPING SETS ((level_norm), (ts_kind), ())"""
    )


def component_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("component").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level_num") >= 40).alias("errors"), F.min(us("ts_utc")).alias("first_us"),
        F.max(us("ts_utc")).alias("last_us"), F.round(F.avg(F.col("ts_confidence").cast("double")), 6).alias("avg_confidence"),
    )


def phase_timeline(lines: DataFrame, ecu_id: str | None = None) -> DataFrame:
    """ota_phase, first_us, last_us, lines, errors, duration_s."""
    return (
        where(lines, ecu_id=ecu_id)
        .where(F.col("ota_phase").isNotNull())
        .groupBy("ota_phase")
        .agg(F.min(us("ts_utc")).alias("first_us"), F.max(us("ts_utc")).alias("last_us"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col("level_num") >= 40).alias("errors"))
        .withColumn("duration_s", F.round((F.col("last_us") - F.col("first_us")) / 1_000_000, 2))
    )


def abort_markers(lines: DataFrame, words: list[str] = BAD_WORDS, top: int = 5) -> DataFrame:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("raw_line").contains(w)
    return lines.where(hit).orderBy(F.asc_nulls_last("ts_utc"), "line_id").limit(top).select(
        "line_id", "row_hash", us("ts_utc").alias("us"), "component", F.substring("raw_line", 1, 200).alias("raw_line")
    )


def find_gaps(lines: DataFrame, min_gap_seconds: float = 30, components: list[str] | None = None, top: int | None = None) -> DataFrame:
    out = sequence.gaps(where(lines, components=components), ["component"], "ts_utc", "line_id", min_gap_seconds)
    return out if top is None else out.orderBy(F.desc("gap_s"), "component", "next_id").limit(min(top, 200))


def top_templates(templates: DataFrame, sort: str = "error_only", components: list[str] | None = None, top: int = 30) -> DataFrame:
    """frequent, rare, newest or error_only; ties by template_id. Only a template's first component is looked at."""
    rows = templates
    if components:
        rows = rows.where(F.try_element_at("components", F.lit(1)).isin(components))
    if sort == "error_only":
        rows = rows.where(F.col("is_error_like") & ~F.coalesce("level_mode", F.lit("")).isin("DEBUG", "TRACE"))
    order = {"rare": F.asc_nulls_last("occurrences"), "newest": F.desc_nulls_last("last_seen_utc")}.get(sort, F.desc_nulls_last("occurrences"))
    return rows.orderBy(order, "template_id").limit(min(top, 200)).select("template_id", "template_text", "occurrences", "level_mode", us("last_seen_utc").alias("last_us"))


def search(
    lines: DataFrame, query: str, mode: str = "keyword", dedup: str | None = None, cursor: int | None = None, limit: int | None = None, order: str = "time", **filters
) -> DataFrame:
    """Matching lines' summaries. With a limit: by time and id, or severity first; cursor continues after a line_id."""
    rows = where(lines, **filters).where(matching(query, mode))
    if dedup == "first_only":
        rows = rows.where(F.col("dup_rank") == 0)
    if cursor is not None:
        rows = rows.where(F.col("line_id") > cursor)
    out = rows.select(*SUMMARY, F.substring("raw_line", 1, 220).alias("preview"), "level_num")
    if limit is not None:
        keys = [F.desc("level_num")] if order == "severity" else []
        if order == "cursor":
            out = out.orderBy("line_id").limit(min(limit, 500))
        else:
            out = out.orderBy(*keys, F.asc_nulls_last("ts_utc"), "line_id").limit(min(limit, 500))
    return out.drop("level_num")


def get_lines(lines: DataFrame, wanted: DataFrame, key: str = "line_id") -> DataFrame:
    """Lines whose key is in a table of keys (left semi join: the plan broadcasts the keys only if they are few)."""
    return lines.join(wanted.select(key).distinct(), key, "left_semi")


def missing_keys(lines: DataFrame, wanted: DataFrame, key: str = "row_hash") -> DataFrame:
    return wanted.select(key).distinct().join(lines.select(key), key, "left_anti")


def code_lookup(lines: DataFrame, code: str | None = None) -> DataFrame:
    """code, name, n, first_us, last_us of negative response codes in raw_line; the dictionary has 15 rows."""
    spark = lines.sparkSession
    if code is not None:
        c = code.lower()
        c = c if c.startswith("0x") else f"0x{c}"
        names = [(c, RESPONSE_CODES.get(f"0x{int(c, 16):02x}", "UNKNOWN"))]
    else:
        names = list(RESPONSE_CODES.items())
    known = spark.createDataFrame(names, "code string, name string")
    found = F.array_distinct(F.filter(F.array(*[F.when(F.lower("raw_line").contains(c), F.lit(c)) for c, _ in names]), lambda x: x.isNotNull()))
    hits = lines.select(F.explode(found).alias("code"), us("ts_utc").alias("us")).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    return F.broadcast(known).join(hits, "code", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def first_errors(lines: DataFrame, by: str, n: int = 1) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last("ts_utc"), "line_id")
    return lines.where(F.col("level_num") >= 40).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def views(lines: DataFrame, storm_lines: int = sequence.STORM_LINES) -> dict[str, DataFrame]:
    return {
        "v_errors": lines.where(F.col("level_num") >= 40),
        "v_storm_windows": sequence.storms(lines, "template_id", "ts_utc", "component", storm_lines),
        "v_phase_spans": phase_timeline(lines).drop("duration_s"),
        "v_component_stats": component_stats(lines),
    }


@dataclass
class ToolResult:
    tool: str
    ok: bool = True
    rows: list[dict] = field(default_factory=list)
    total: int = 0
    notes: list[str] = field(default_factory=list)
    next_cursor: int | None = None
    summary: dict = field(default_factory=dict)


class LogStore:
    """The tools behind one call, with clamps, notes and a tenant check. Results are bounded and collected."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], tenant: str | None = None):
        self.spark, self.tables, self.tenant = spark, tables, tenant
        self.lines = tables["log_lines"]
        self.calls: list[tuple[str, bool, int]] = []

    def call(self, tool: str, **kwargs) -> ToolResult:
        run = getattr(self, f"t_{tool}", None)
        if run is None:
            return ToolResult(tool, False, notes=[f"no such tool: {tool}"])
        if tool != "describe_dataset" and not self._tenant_ok():
            return ToolResult(tool, False, notes=["another tenant's data"])
        try:
            out = run(**kwargs)
        except TypeError as e:
            out = ToolResult(tool, False, notes=[f"wrong arguments: {e}"])
        except Exception as e:
            out = ToolResult(tool, False, notes=[str(e).splitlines()[0]])
        self.calls.append((tool, out.ok, len(out.rows)))
        return out

    def _tenant_ok(self) -> bool:
        if self.tenant is None or "runs" not in self.tables:
            return True
        return not self.tables["runs"].where(F.col("tenant_id") == guard.safe_tenant(self.tenant)).isEmpty()

    def _rows(self, tool: str, df: DataFrame, limit: int, notes: list[str] | None = None) -> ToolResult:
        limit, note = guard.clamp(limit)
        rows = [r.asDict(True) for r in df.limit(limit).collect()]
        return ToolResult(tool, True, rows, len(rows), [*(notes or []), *([note] if note else [])])

    def t_describe_dataset(self) -> ToolResult:
        """Rows by component; the summary has the run, totals, levels, kinds of time and phases."""
        out = self._rows("describe_dataset", component_stats(self.lines).orderBy(F.desc("lines"), "component"), 500)
        run = self.tables["runs"].limit(1).collect() if "runs" in self.tables else []
        first = run[0].asDict() if run else {}
        out.summary = {k: first.get(k) for k in ("run_id", "input_archive", "input_sha256", "config_hash", "unparsed_records")}
        by = {dim: [r for r in overview(self.lines).collect() if r.dim == dim] for dim in ("all", "level", "ts_kind")}
        span = self.lines.agg(F.min(us("ts_utc")).alias("first_us"), F.max(us("ts_utc")).alias("last_us")).first()
        out.summary |= {"total_records": by["all"][0].n, "templates": by["all"][0].templates, **span.asDict()}
        out.summary |= {name: {r.value: r.n for r in by[dim]} for name, dim in (("levels", "level"), ("ts_kinds", "ts_kind"))}
        out.summary["phases"] = [r.asDict() for r in phase_timeline(self.lines).orderBy("first_us").collect()]
        return out

    def t_timeline(self, bucket: str = "1m", limit: int = 5000, **filters) -> ToolResult:
        return self._rows("timeline", timeline(self.lines, bucket, **filters).orderBy("bucket", "component"), limit)

    def t_aggregate(self, group_by: list[str], filters: dict | None = None, order_by: str = "count_desc", limit: int = 50) -> ToolResult:
        key = {"errors_desc": F.desc("errors"), "first_seen": F.asc("first_us")}.get(order_by, F.desc("n"))
        return self._rows("aggregate", aggregate(self.lines, group_by, filters).orderBy(key, *group_by), min(limit, 500))

    def t_top_templates(self, sort: str = "error_only", components: list[str] | None = None, limit: int = 30) -> ToolResult:
        return self._rows("top_templates", top_templates(self.tables["templates"], sort, components, limit), 200)

    def t_phase_timeline(self, ecu_id: str | None = None) -> ToolResult:
        out = self._rows("phase_timeline", phase_timeline(self.lines, ecu_id).orderBy("first_us"), 500)
        markers = [r.asDict() for r in abort_markers(self.lines).collect()]
        out.summary = {"last_phase": out.rows[-1]["ota_phase"] if out.rows else None, "abort_markers": markers}
        if out.rows:
            out.notes.append(f"last phase: {out.rows[-1]['ota_phase']}")
        return out

    def t_find_gaps(self, min_gap_seconds: float = 30, components: list[str] | None = None, limit: int = 30) -> ToolResult:
        return self._rows("find_gaps", find_gaps(self.lines, min_gap_seconds, components, limit), 200)

    def t_search_logs(self, query: str = "", mode: str = "keyword", limit: int = 50, cursor: int | None = None, order: str = "auto", dedup: str | None = None, **filters) -> ToolResult:
        total = search(self.lines, query, mode, dedup, cursor, **filters).count()
        cut = total > min(limit, 500)
        chosen = "severity" if order == "severity" or order == "auto" and cut else "time"
        out = self._rows("search_logs", search(self.lines, query, mode, dedup, cursor, limit, chosen, **filters), 500)
        out.total = total
        if cut and chosen != "severity" and out.rows:
            out.next_cursor = out.rows[-1]["line_id"]
        if hint := guard.wide_result_hint(total):
            out.notes.append(hint)
        return out

    def t_get_lines(self, line_ids: list[int] | None = None, row_hashes: list[str] | None = None, include_raw: bool = True) -> ToolResult:
        line_ids, row_hashes = (line_ids or [])[:200], (row_hashes or [])[:200]
        rows = self.lines.where(F.col("line_id").isin(line_ids) | F.col("row_hash").isin(row_hashes))
        out = self._rows("get_lines", rows.select(*SUMMARY, *(["raw_line"] if include_raw else [])).orderBy(F.asc_nulls_last("ts_utc"), "line_id"), 400)
        if absent := sorted(set(row_hashes) - {r["row_hash"] for r in out.rows}):
            out.notes.append(f"not found: {', '.join(absent)}")
        return out

    def t_get_context(self, line_id: int, before: int = 10, after: int = 10, scope: str = "same_file") -> ToolResult:
        before, after, note = guard.clamp_context(before, after)
        anchor = self.lines.where(F.col("line_id") == line_id).limit(1).select("line_id", "file_id", "line_no")
        if scope == "same_file":
            rows = sequence.context_band(self.lines, anchor.select(F.col("line_id").alias("a"), "file_id", "line_no"), "file_id", "line_no", "a", before, after).drop("anchor_id")
        else:
            rows = self.lines.where(F.col("line_id").between(line_id - before, line_id + after)).withColumn("is_anchor", F.col("line_id") == line_id)
        return self._rows("get_context", rows.select("line_id", "file_id", "line_no", "is_anchor", F.substring("raw_line", 1, 400).alias("raw_line")).orderBy("line_no", "line_id"), 500, [note] if note else [])

    def t_error_code_lookup(self, code: str) -> ToolResult:
        return self._rows("error_code_lookup", code_lookup(self.lines, code), 1)

    def t_build_evidence(self, claim: str, items: list[dict], include_context: int = 5) -> ToolResult:
        from tidemark.operators.evidence import build_pack

        return ToolResult("build_evidence", True, [build_pack(self.lines, self.tables.get("files"), claim, items, include_context)], 1)

    def t_run_sql(self, sql: str, max_rows: int = 200) -> ToolResult:
        known = {**{k: v for k, v in self.tables.items() if k in guard.RELATIONS}, **views(self.lines)}
        return self._rows("run_sql", guard.run_sql(self.spark, known, sql, max_rows), guard.SQL_LIMIT)
