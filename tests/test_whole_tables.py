import json

import pytest
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import parsers
from tidemark.functions.text import phase
from tidemark.plans import registry
from tidemark.sources.archives import component

LINE = "I0123 08:32:22.647002  4875 bootloader.cc:715] ram test failed"


def test_carriage_returns_are_parsed(spark, small, tmp_path):
    df = spark.createDataFrame([(0, LINE), (1, f"{LINE}\r"), (2, f"{LINE}\r\r\n  x\r"), (3, f"{LINE} a\rb")], "i int, raw string")
    df = df.withColumn("line", parsers.first_line(F.col("raw"))).withColumn("json", parsers.json_object(F.col("line")))
    df = df.withColumn("parser", parsers.parser_name(F.col("line"), F.col("json")))
    out = [(r.parser, r.message) for r in parsers.with_parsed(df, "line", "parser", "json").orderBy("i").collect()]
    assert out == [("glog_style", "ram test failed")] * 3 + [("glog_style", "ram test failed a\rb")]
    lines = spark.read.parquet(f"{small}/log_lines.parquet").limit(20)
    lines.withColumn("raw_line", F.concat("raw_line", F.lit("\r"))).write.parquet(f"file://{tmp_path}/log_lines.parquet")
    for name in ("parsed_fields", "parser_registry"):
        assert registry.QUERIES[name](spark, f"file://{tmp_path}").count() == 20


def test_quoted_values(spark, tmp_path):
    messages = ['a="x, y" b=\'z w\' c=1', "d='9',e=\"q r\"; f=g", "h=2", None]
    df = spark.createDataFrame(list(enumerate(messages)), "line_id int, message string")
    df.write.parquet(f"file://{tmp_path}/log_lines.parquet")
    got = {r.line_id: r.pairs for r in registry.QUERIES["key_values"](spark, f"file://{tmp_path}").collect()}
    assert got == {0: "a=x, y b=z w c=1", 1: "d=9 e=q r f=g", 2: "h=2"}


def test_rules_from_a_file_go_first(spark, tmp_path):
    text = """
parsers:
  - name: ours
    regex: '^@(?P<level>[A-Z]+) (?P<logger>[\\w.]+) (?P<ts>\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d) (?P<message>.*)$'
phases:
  - {name: SELFTEST, regex: 'self test'}
components:
  - {directory: radar, name: radar_unit, rank: 5}
"""
    (tmp_path / "rules.yaml").write_text(text)
    found = rules.load_rules(str(tmp_path / "rules.yaml"))
    df = spark.createDataFrame([("@WARN a.b 2025-01-02 03:04:05 self test", "logs/radar/x.log"), (LINE, "logs/uds/x.log")], "line string, path string")
    df = df.withColumn("json", parsers.json_object(F.col("line")))
    df = df.withColumn("parser", parsers.parser_name(F.col("line"), F.col("json"), found.formats))
    got = parsers.with_parsed(df, "line", "parser", "json", found.formats).withColumn("phase", phase(F.col("line"), found.phases))
    rows = got.withColumn("c", component(F.col("path"), found.components)["component"]).collect()
    assert [(r.parser, r.level_norm, r.logger, r.message, r.phase, r.c) for r in rows] == [
        ("ours", "WARN", "a.b", "self test", "SELFTEST", "radar_unit"), ("glog_style", "INFO", None, "ram test failed", None, "uds_stack")
    ]
    for bad in ("(?P<x>.)", "(?P<ts>.)(.)", "(", "no groups"):
        (tmp_path / "bad.json").write_text(json.dumps({"parsers": [{"name": "bad", "regex": bad}]}))
        with pytest.raises(rules.RulesError):
            rules.load_rules(str(tmp_path / "bad.json"))
