"""The registered line formats as column expressions: the first that matches a record's first line holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import key_values

_ISO = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{1,6})"
# fixed values: name, kind of time, pattern and what its groups hold, by priority (JSON comes between the 7th and 8th)
FORMATS = [
    ("iso_bracket_comp", "WALL", rf"^{_ISO}\s+\[([^\]]+)\]\s+([A-Z]{{1,5}})\s+(.*)$", ["ts", "logger", "level", "message"]),
    ("iso_pid_tid", "WALL", rf"^{_ISO}\s+(\d+)\s+(\d+)\s+([A-Z]{{1,5}})\s+([\w.\-]+):\s+(.*)$", ["ts", "pid", "tid", "level", "logger", "message"]),
    ("logcat_threadtime", "WALL", r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEFS])\s+([^:]+):\s?(.*)$", ["ts", "pid", "tid", "level", "logger", "message"]),
    ("dmesg_monotonic", "MONOTONIC", r"^\[\s*(\d+\.\d{6})\]\s*(?:<(\d)>)?\s*(.*)$", ["mono", "klevel", "message"]),
    ("syslog_rfc3164", "WALL", r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w\-./]+)(?:\[(\d+)\])?:\s*(.*)$", ["ts", "host", "process", "pid", "message"]),
    ("dlt_verbose", "WALL", r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s+(\w{1,4})\s+(\w{1,4})\s+(\w{1,4})\s+log\s+(\w+)\s+(.*)$", ["ts", "ecu", "app", "ctx", "level", "message"]),
    ("glog_style", "WALL", r"^([IWEF])(\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{6})\s+(\d+)\s+([\w.\-]+:\d+)\]\s*(.*)$", ["level", "ts", "tid", "src_loc", "message"]),
    ("cn_bracket_level", "WALL", r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s*[【\[]([^】\]]+)[】\]]\s*(.*)$", ["ts", "level_cn", "message"]),
    ("kv_structured", "WALL", r"^ts=(\S+)\s+level=(\w+)\s+comp=(\S+)\s+(.*)$", ["ts", "level", "logger", "message"]),
    ("short_nodate", "WALL", r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+([A-Z]{1,5})\s+(.*)$", ["ts", "level", "message"]),
    ("uptime_relative", "BOOT_RELATIVE", r"^\+(\d+\.\d{3})s\s+([A-Z]+)\s+(.*)$", ["mono", "level", "message"]),
]
# fixed values: keys of a JSON line, in order of preference
JSON_KEYS = {
    "ts": ["ts", "timestamp", "time", "@timestamp"],
    "level": ["lvl", "level", "severity"],
    "logger": ["logger", "tag", "module"],
    "message": ["msg", "message", "event"],
    "pid": ["pid"],
    "tid": ["tid"],
}
# fixed values: level names
LEVELS = {
    "TRACE": ["V", "VERBOSE", "T", "TRACE"], "DEBUG": ["D", "DEBUG"], "INFO": ["I", "INFO"], "NOTICE": ["NOTICE", "N"], "WARN": ["W", "WARN", "WARNING"],
    "ERROR": ["E", "ERR", "ERROR"], "FATAL": ["F", "FATAL", "CRIT", "CRITICAL", "S", "PANIC"],
}
CN_LEVELS = {"调试": "DEBUG", "信息": "INFO", "提示": "INFO", "警告": "WARN", "错误": "ERROR", "严重": "FATAL"}
KERNEL_LEVELS = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
#: JSON lines are tried before this format
AFTER_JSON = "cn_bracket_level"
FIELDS = ["ts_kind", "ts", "mono", "level_raw", "level_norm", "logger", "process", "pid", "tid", "src_loc", "message", "fields", "status"]


#: only a line feed ends a line: the dot matches a carriage return inside a line
UNIX_LINES = "(?d)"


def first_line(raw: Column) -> Column:
    """Without the carriage returns at its end, which are no part of a line."""
    return F.rtrim(F.substring_index(raw, "\n", 1), F.lit("\r"))


def json_object(line: Column) -> Column:
    """The line as a map if it is a JSON object, else null."""
    return F.from_json(F.when(line.rlike(UNIX_LINES + r"^\s*\{.*\}\s*$"), line), "map<string,string>")


def parser_name(line: Column, json: Column, formats: list = FORMATS) -> Column:
    """Name of the first format that matches a first line; json is json_object(line)."""
    out = None
    for name, _, pattern, _ in formats:
        if name == AFTER_JSON:
            out = out.when(json.isNotNull(), "json_line")
        out = (F if out is None else out).when(line.rlike(UNIX_LINES + pattern), name)
    return out.otherwise("fallback_raw")


def level_norm(raw: Column) -> Column:
    """Chinese names, then kernel digits, then other names in any case; UNKNOWN else."""
    out = F.lit("UNKNOWN")
    for name, words in LEVELS.items():
        out = F.when(F.upper(raw).isin(words), name).otherwise(out)
    for i, name in enumerate(KERNEL_LEVELS):
        out = F.when(raw == str(i), name).otherwise(out)
    for word, name in CN_LEVELS.items():
        out = F.when(raw == word, name).otherwise(out)
    return out


def groups(line: Column, name: Column, formats: list = FORMATS) -> Column:
    """The groups of the matching format's pattern as an array of texts: each line goes through its own pattern once."""
    out = None
    for fmt, _, pattern, names in formats:
        order = "\x01".join(f"${i}" for i in range(1, len(names) + 1))
        out = (F if out is None else out).when(name == fmt, F.regexp_replace(line, UNIX_LINES + pattern, order))
    return F.split(out, "\x01")


def with_parsed(df: DataFrame, line: str, name: str, json: str, formats: list = FORMATS) -> DataFrame:
    """Adds FIELDS; line, name and json are columns as of the functions above.

    Each step is a projection of its own, so that no pattern is matched twice.
    """
    got, fmt = F.col("_tm_groups"), F.col(name)

    def pick(*wanted: str) -> Column:
        out = F.when(fmt.isNull(), None)
        for w in wanted:
            for f, _, _, names in formats:
                if w in names:
                    out = out.when(fmt == f, F.nullif(got[names.index(w)], F.lit("")))
        keys = next((JSON_KEYS[w] for w in wanted if w in JSON_KEYS), None)
        return out.when(fmt == "json_line", F.coalesce(*[F.try_element_at(json, F.lit(k)) for k in keys])) if keys else out

    kind = F.lit("NONE")
    for f, k, _, _ in [*formats, ("json_line", "WALL", "", [])]:
        kind = F.when(fmt == f, k).otherwise(kind)
    used = [k for ks in JSON_KEYS.values() for k in ks]
    return (
        df.withColumn("_tm_groups", groups(F.col(line), fmt, formats))
        .withColumns({
            "ts_kind": kind,
            "ts": pick("ts"),
            "mono": pick("mono").try_cast("double"),
            "level_raw": pick("level", "level_cn", "klevel"),
            "logger": pick("logger", "app"),
            "process": pick("process", "host"),
            "pid": pick("pid").try_cast("int"),
            "tid": pick("tid").try_cast("int"),
            "src_loc": pick("src_loc"),
            "message": F.when(fmt == "fallback_raw", F.col(line)).otherwise(F.coalesce(pick("message"), F.lit(""))),
            "status": F.when(fmt == "fallback_raw", "UNPARSED").otherwise("OK"),
        })
        .withColumn("level_norm", level_norm(F.col("level_raw")))
        .withColumn("fields", F.when(fmt == "json_line", F.map_filter(json, lambda k, _: ~k.isin(used))).otherwise(key_values(F.col("message"))))
        .drop("_tm_groups")
    )
