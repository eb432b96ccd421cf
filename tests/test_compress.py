import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import compress
from tidemark.plans import registry
from tidemark.session import table


def test_tiers_of_hot_and_missing_templates(spark):
    rnd = random.Random(5)
    at = lambda: rnd.choice([None, datetime(2025, 1, 1) + timedelta(seconds=rnd.randint(0, 500))])
    rows = [(i, rnd.choice([None, None, 1, 2]), rnd.choice(["INFO", "ERROR"]), "x", at(), "c") for i in range(12_000)] + [(12_000, 3, "INFO", "x", None, "c")]
    counts = {1: 4000, 2: None, 3: 1}
    df = spark.createDataFrame([(*r, counts.get(r[1])) for r in rows], "line_id int, template_id int, level_norm string, raw_line string, ts_utc timestamp, component string, occurrences int")
    groups, want = {}, {}
    for r in rows:
        tier = 3 if r[2] == "ERROR" else 2 if r[1] == 3 else 1
        groups.setdefault((r[1], tier), []).append(r)
    for (_, tier), g in groups.items():
        g.sort(key=lambda r: (r[4] is None, r[4] or 0, r[0]))
        for i, r in enumerate(g):
            want[r[0]] = (tier, tier == 2 or i < (49 if tier == 3 else 3) or tier == 3 and i == len(g) - 1)
    assert {r.line_id: (r.tier, r.keep) for r in compress.tiers(df).collect()} == want


def test_every_line_is_kept_or_folded(spark, small):
    lines = spark.read.parquet(f"{small}/log_lines.parquet").select("line_id", "template_id").distinct()
    tiers = registry.QUERIES["compress_tiers"](spark, small)
    folded = registry.QUERIES["compress_folds"](spark, small)
    assert tiers.count() == lines.count() > lines.where("template_id IS NOT NULL").count()
    assert tiers.where("keep").count() + folded.agg(F.sum("folded")).first()[0] == lines.count()
    assert folded.where("template_id IS NULL").count() > 0


def test_compress_by_tiers_then_by_windows(spark, small):
    lines = table(spark, small, "log_lines").dropDuplicates(["line_id"])
    rows = lines.join(table(spark, small, "templates").select("template_id", "occurrences"), "template_id", "left")
    wide = compress.compress(rows, 10**9)
    assert not wide.trace["slide_window_applied"] and wide.windows.count() == 0
    assert wide.kept.count() == wide.trace["kept_rows"] and wide.trace["kept_rows"] + wide.trace["folded_total"] == wide.trace["input_rows"] == lines.count()
    tight = compress.compress(rows, 400)
    assert tight.trace["slide_window_applied"] and tight.trace["tokens_after"] <= 400 and tight.trace["tokens_before"] == wide.trace["tokens_before"]
    kept = tight.kept.collect()
    assert kept and {r.level_norm for r in kept} <= {"ERROR", "FATAL"}
    assert len(kept) + tight.windows.agg(F.sum("lines")).first()[0] == wide.trace["kept_rows"]
    empty = compress.compress(rows.limit(0), 10)
    assert empty.kept.count() == 0 and empty.trace["compression_ratio"] == 1.0
