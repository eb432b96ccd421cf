"""Schemas and enumerations of the evidence tables."""

from __future__ import annotations

# fixed values: column names and types of the tables
LOG_LINES = (
    "line_id bigint, run_id string, schema_version int, "
    "ts_utc timestamp, ts_local timestamp_ntz, ts_raw string, ts_kind string, ts_confidence float, monotonic_ns bigint, "
    "boot_id string, clock_epoch int, ts_gap_ms bigint, "
    "file_id int, file_path string, line_no bigint, byte_offset bigint, byte_len int, line_span int, source_rank int, "
    "component string, sub_module string, process string, pid int, tid int, thread_name string, logger string, src_loc string, "
    "level_raw string, level_norm string, level_num smallint, message string, raw_line string, msg_tokens string, fields map<string,string>, "
    "raw_hash string, norm_hash decimal(20,0), row_hash string, template_id int, dup_rank int, dup_count int, "
    "ota_task_id string, campaign_id string, ecu_id string, ota_phase string, session_id string, trace_id string, vin_masked string, "
    "parse_status string, parser_name string, parser_version string, encoding string, anomaly_flags array<string>, dt string"
)
FILES = (
    "file_id int, archive_path string, rel_path string, file_name string, file_sha256 string, size_bytes bigint, mtime_utc timestamp, "
    "encoding string, encoding_conf float, component string, parser_name string, line_count bigint, record_count bigint, "
    "ts_min timestamp, ts_max timestamp, is_rotated boolean, rotation_group string, rotation_index int, alias_of int, is_binary boolean"
)
RECORDS = (
    "file_id int, line_no bigint, byte_offset bigint, byte_len int, line_span int, raw_bytes binary, text string, "
    "decode_error boolean, truncated boolean"
)
# fixed values: numbers of the levels
LEVEL_NUM = {"TRACE": 10, "DEBUG": 20, "INFO": 25, "NOTICE": 28, "WARN": 30, "ERROR": 40, "FATAL": 50, "UNKNOWN": 0}
# fixed values: time buckets in seconds; another name means a minute
BUCKETS = {"1s": 1, "10s": 10, "30s": 30, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86400}
