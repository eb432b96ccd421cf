import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compress, evidence, guard, scores, sequence, templates, tools
from tidemark.session import table


@pytest.fixture(scope="module")
def store(spark, small):
    names = ("log_lines", "files", "templates", "runs")
    return tools.LogStore(spark, {n: table(spark, small, n) for n in names}, tenant="tenant-3")


def test_tools_answer_and_clamp(store):
    for name, args in [
        ("describe_dataset", {}), ("timeline", {"bucket": "1h"}), ("aggregate", {"group_by": ["component"]}), ("top_templates", {"sort": "rare"}),
        ("phase_timeline", {}), ("find_gaps", {}), ("error_code_lookup", {"code": "72"}),
    ]:
        out = store.call(name, **args)
        assert out.ok, (name, out.notes)
    gaps = [r["gap_s"] for r in store.call("find_gaps").rows]
    assert gaps == sorted(gaps, reverse=True)
    assert not store.call("aggregate", group_by=["raw_line"]).ok
    assert not store.call("no_such").ok and not store.call("timeline", nothing=1).ok
    assert any("at most" in n for n in store.call("timeline", limit=10**6).notes)


def test_search_pages_meet_without_overlap(store):
    first = store.call("search_logs", query="rolled over", mode="substring", limit=3, order="time")
    assert first.ok and len(first.rows) == 3 and first.total >= 3
    assert store.call("search_logs", query="(", mode="regex").ok is False
    line = first.rows[0]
    got = store.call("get_lines", line_ids=[line["line_id"]], row_hashes=["0000"])
    assert got.rows[0]["row_hash"] == line["row_hash"] and "0000" in got.notes[0]
    around = store.call("get_context", line_id=line["line_id"], before=2, after=2)
    assert sum(r["is_anchor"] for r in around.rows) >= 1
    pack = store.call("build_evidence", claim="c", items=[{"line_id": line["line_id"], "role": "nonsense"}]).rows[0]
    assert evidence.verify_l0(pack) and pack["items"][0]["role"] == "CONTEXT"
    pack["items"][0]["line_no"] += 1
    assert not evidence.verify_l0(pack)


def test_wrong_tenant_is_refused(spark, small):
    store = tools.LogStore(spark, {n: table(spark, small, n) for n in ("log_lines", "runs")}, tenant="nobody")
    assert store.call("describe_dataset").ok and not store.call("timeline").ok


GOOD = [
    "SELECT component, count(*) FROM log_lines GROUP BY 1",
    "WITH x AS (SELECT * FROM files) SELECT * FROM x JOIN log_lines l ON x.file_id = l.file_id;",
    "SELECT extract(day FROM ts_utc) FROM log_lines WHERE raw_line LIKE '%drop table%'",
    "SELECT * FROM log_lines WHERE file_id IN (SELECT file_id FROM files)",
    "SELECT x FROM log_lines LATERAL VIEW explode(anomaly_flags) t AS x",
]
BAD = [
    "", "DROP TABLE log_lines", "INSERT INTO log_lines SELECT * FROM files", "SELECT 1; SELECT 2", "SELECT * FROM other", "SELECT * FROM log_lines, other",
    "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM log_lines WHERE file_id IN (SELECT a FROM hidden)", "SELECT reflect('java.lang.System', 'exit', 1)",
    "SELECT (SELECT max(a) FROM hidden) FROM log_lines", "SELECT * FROM read_files('/x')", "SET a = 1", "EXPLAIN SELECT 1",
    "CREATE VIEW v AS SELECT 1", "SELECT * FROM log_lines WHERE EXISTS (SELECT 1 FROM hidden)",
]


@pytest.mark.parametrize("sql", GOOD)
def test_guard_accepts(spark, sql):
    guard.check(spark, sql)


@pytest.mark.parametrize("sql", BAD)
def test_guard_refuses(spark, sql):
    with pytest.raises(guard.SqlGuardError):
        guard.check(spark, sql)


def test_sql_is_limited_whatever_the_statement_says(store):
    out = store.call("run_sql", sql="SELECT line_id, epoch(ts_utc) AS e, list_contains(anomaly_flags, 'X') AS x FROM log_lines LIMIT 100000", max_rows=7)
    assert out.ok and len(out.rows) == 7


def test_clamps():
    assert guard.clamp_context(10, 10) == (10, 10, None)
    assert guard.clamp_context(300, 100)[:2] == (150, 50)
    assert guard.wide_result_hint(5000) and not guard.wide_result_hint(5)


def test_merkle_roots_ignore_order_and_feel_the_salt(spark):
    a = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "x"), ("g", None)], "g string, h string")
    b = spark.createDataFrame([("g", "y"), ("g", "x")], "g string, h string")
    root = lambda d, salt: evidence.merkle_roots(d, ["g"], "h", salt).first()
    assert root(a, "s") == root(b, "s") != root(b, "t")


def test_citations(spark):
    report = "The sector failed at once. [[EV:00ff00ff]] Later it was retried without any luck. [[EV:deadbeef]][[EV:00ff00ff]]"
    r = spark.range(1).select(evidence.citations(F.lit(report)), evidence.citation_coverage(F.lit(report))).first()
    assert r[0] == ["00ff00ff", "deadbeef"] and 0 < r[1] <= 1
    marked = evidence.mark_dangling(report, {"deadbeef": "NOT_FOUND_IN_DB"})
    assert marked.count("[[EV:") == 3 and f"[[EV:deadbeef{evidence.FAILED}NOT_FOUND_IN_DB]]" in marked and marked.count("[[EV:00ff00ff]]") == 2
    listed = F.lit(report + '\n<!-- citations: ["00ff00ff", "0123456789abcdef"] -->')
    r = spark.range(1).select(evidence.citations(listed), evidence.cites_enough(listed, F.lit(6), 0.5), evidence.cites_enough(listed, F.lit(7), 0.5)).first()
    assert r[0] == ["00ff00ff", "deadbeef", "0123456789abcdef"] and r[1] and not r[2]
    heading = spark.range(1).select(evidence.citation_coverage(F.lit("# Title\n---\n"))).first()[0]
    assert heading == 1.0


def test_citations_resolve_live_then_from_the_snapshot(spark, small):
    lines = table(spark, small, "log_lines")
    hashes = [r.row_hash for r in lines.where("level_num >= 40 AND row_hash IS NOT NULL").select("row_hash").distinct().orderBy("row_hash").limit(6).collect()]
    cited = spark.createDataFrame([(h,) for h in [*hashes, "00000000"]], "row_hash string")
    kept = evidence.freeze(lines, cited, 2)
    assert kept.where("resolvable").count() == 6 and kept.where("NOT resolvable").count() == 1
    assert all(any(c.is_anchor for c in r.context) and len({c.line_no for c in r.context}) <= 5 for r in kept.where("resolvable").collect())
    left = lines.where(~F.col("row_hash").isin(hashes[:2]))
    got = {r.row_hash: (r.source, r.context is not None) for r in evidence.resolve_citations(cited, left, kept).collect()}
    assert got == {h: ("snapshot" if h in hashes[:2] else "live", True) for h in hashes} | {"00000000": ("none", False)}


def test_levels_of_verification(spark):
    from tidemark.functions.text import raw_hash

    files = spark.createDataFrame([(bytearray(b"first\nsecond\n"),)], "content binary")
    lines = spark.createDataFrame([("a", 0, 6), ("b", 6, 7), ("c", 6, 7)], "row_hash string, byte_offset int, byte_len int").crossJoin(files)
    items = lines.select("row_hash", "byte_offset", "byte_len", F.sha2("content", 256).alias("file_sha256"), raw_hash(F.expr("substring(content, byte_offset + 1, byte_len)")).alias("raw_hash"))
    items = items.withColumn("raw_hash", F.when(F.col("row_hash") == "b", "0").otherwise(F.col("raw_hash"))).withColumn("file_sha256", F.when(F.col("row_hash") == "c", "0").otherwise(F.col("file_sha256")))
    assert dict(map(tuple, evidence.verify_l2(items, files).collect())) == {"a": "OK", "b": "CHANGED", "c": "MISSING"}


def test_year_grows_once_over_new_year(spark):
    df = spark.createDataFrame([(1, 1, 12, 31, 2024), (1, 2, None, None, 2024), (1, 3, 1, 1, 2024), (1, 4, 12, 30, 2024)], "f int, n int, m int, d int, y int")
    got = {r.n: r.year for r in sequence.inferred_year(df, "f", "n", "m", "d", "y").collect()}
    assert got == {1: 2024, 2: None, 3: 2025, 4: 2025}


def test_dense_ids_and_fill_over_many_parts(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"), F.when(F.col("id") % 90 == 0, F.col("id")).alias("v"))
    rows = sequence.dense_ids(df, [F.asc("k")], "n").collect()
    assert all(r.n == r.k for r in rows)
    want, last = {}, None
    for k, v in sorted((r.k, r.v) for r in df.collect()):
        last = v if v is not None else last
        want[k] = last
    assert {r.k: r.filled for r in sequence.forward_fill(df, [F.asc("k")], "v", "filled").collect()} == want
    assert sequence.dense_ids(df.limit(0), [F.asc("k")], "n").count() == 0


def test_template_miner_follows_first_appearance(spark):
    texts = ["a b 1", "a b 2", "x y z q", "a b c", "x y z w", None, "", "a  b 3"] + [f"tok{chr(97 + i // 26)}{chr(97 + i % 26)} end" for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, m string")
    got = {r.i: (r.template_id, r.template) for r in templates.mine(df, "m", ["i"]).collect()}
    assert got[0] == got[1] == (1, "a b <*>") == got[7] and got[2][0] == 2 == got[4][0] and got[5] == (None, None)
    assert got[2][1] == "x y z <*>" and got[3][0] == 3
    assert len({got[i][0] for i in range(8, 128)}) <= 101


def test_compression_keeps_ends_and_quota(spark):
    df = spark.createDataFrame([(i, 1, 99, "ERROR", "m", None, "c") for i in range(10)] + [(i, 2, 99, "INFO", "m", None, "c") for i in range(10, 20)],
                               "line_id bigint, template_id int, occurrences bigint, level_norm string, raw_line string, ts_utc timestamp, component string")
    t = compress.tiers(df, cap=4)
    assert sorted(r.line_id for r in t.where("keep").collect()) == [0, 1, 2, 9, 10, 11, 12]
    assert {(r.tier, r.folded) for r in compress.folds(t).collect()} == {(3, 6), (1, 7)}


def test_percentiles_and_interval(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3)] + [("b", None)], "g string, v double")
    assert [tuple(r) for r in scores.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p100": 1.0}).collect()] == [("a", 3.0, 5.0)]
    lo, hi = scores.confidence_interval(10.0, 2.0, 5)
    assert abs(hi - 10 - 2.776445 * 2 / 5**0.5) < 1e-4 and abs(lo + hi - 20) < 1e-9


def test_blocks_of_a_hot_file_change_nothing(spark):
    rnd = random.Random(5)
    rows, us = [], 10**9
    for n in range(400):
        us += rnd.choice([10**6, 3 * 10**6, -10**6, -9 * 10**6, 40 * 10**6])
        rows.append((rnd.choice([1, 1, 1, 2, None]), n, n % 7, rnd.choice([us, us, None]), rnd.choice(["a", "b", None]), rnd.randint(1, 12), "x" * rnd.randint(0, 9)))
    df = spark.createDataFrame(rows, "f int, n int, line_id int, us bigint, k string, month int, t string").withColumn("ts_utc", F.timestamp_micros("us")).withColumn("y", F.lit(2024))
    result = lambda out: sorted(map(str, out.select(*sorted(out.columns)).collect()))
    for make in (
        lambda w: sequence.gaps(df, ["f"], "ts_utc", "n", 2, w * 10**6),
        lambda w: sequence.clock_steps(df, "f", "n", "us", block=w),
        lambda w: sequence.duplicates(df, "k", ["f", "n"], w),
        lambda w: sequence.inferred_year(df, "f", "n", "month", "t", "y", w),
        lambda w: compress.within_budget(df, ["f"], "t", 60, w * 10**6),
    ):
        whole = result(make(10**9))
        assert whole and all(result(make(w)) == whole for w in (3, 50))


def test_summaries_of_tools(store, spark, small):
    lines = table(spark, small, "log_lines")
    out = store.call("describe_dataset")
    assert out.ok and out.summary["total_records"] == lines.count() == sum(out.summary["levels"].values()) == sum(out.summary["ts_kinds"].values())
    assert {r["component"] for r in out.rows} == {r.component for r in lines.select("component").distinct().collect()} and out.summary["run_id"]
    assert [p["ota_phase"] for p in out.summary["phases"]] == [r["ota_phase"] for r in store.call("phase_timeline").rows]
    tool = store.call("phase_timeline")
    marked = tools.abort_markers(lines).collect()
    assert [m["line_id"] for m in tool.summary["abort_markers"]] == [r.line_id for r in marked] and tool.summary["last_phase"] == tool.rows[-1]["ota_phase"]


def test_quality_report_reads_and_adds_up(spark, small):
    lines, files = table(spark, small, "log_lines"), table(spark, small, "files")
    found = scores.report(lines, files)
    assert all(sum(v["n"] for v in values.values()) == found["rows"] for values in found["by"].values())
    assert set(found["checks"]) == {"unparsed", "confident", "time", "templates", "ids", "hashes", "records"} and found["passed"] == all(found["checks"].values())
    assert f"- rows: {found['rows']}" in scores.report_text(found)
