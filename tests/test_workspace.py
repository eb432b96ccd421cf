from pyspark.sql import functions as F

from tidemark.operators.build import build
from tidemark.operators.tools import LogStore
from tidemark.sources.simulate import bundle


def test_all_tools_on_a_built_workspace(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.zip").write_bytes(bundle(1, 25)[0])
    out = build(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ws", tenant="t-1")
    tables = {n: spark.read.parquet(f"file://{tmp_path}/ws/{n}") for n in ("log_lines", "files", "templates", "runs", "parse_errors")}
    store = LogStore(spark, tables, tenant="t-1")
    line = tables["log_lines"].first()["line_id"]
    calls = {
        "describe_dataset": {}, "timeline": {}, "aggregate": {"group_by": ["component"]}, "top_templates": {"sort": "newest"}, "phase_timeline": {},
        "find_gaps": {}, "search_logs": {"query": "a", "mode": "substring"}, "get_lines": {"line_ids": [line]}, "get_context": {"line_id": line},
        "error_code_lookup": {"code": "72"}, "build_evidence": {"claim": "c", "items": [{"line_id": line, "role": "CONTEXT"}]},
        "run_sql": {"sql": "SELECT count(*) AS n FROM parse_errors"},
    }
    assert len(calls) == 12
    for tool, args in calls.items():
        got = store.call(tool, **args)
        assert got.ok, (tool, got.notes)
    top = store.call("top_templates", sort="frequent").rows
    assert top and all(r["template_text"] and r["last_us"] for r in top) and sum(r["occurrences"] for r in top) <= out["rows"]
    assert tables["runs"].first()["total_records"] == out["rows"] and tables["parse_errors"].count() == out["unparsed"]
    assert "template" not in tables["log_lines"].columns
    lines = tables["log_lines"].where("ts_local IS NOT NULL AND boot_id IS NOT NULL AND parser_version IS NOT NULL")
    assert lines.count() == tables["log_lines"].where(F.col("ts_utc").isNotNull()).count()
