from pyspark.sql import functions as F

from tidemark.operators import index
from tidemark.sources import jsonl


def test_lookup_in_a_written_index(spark, tmp_path):
    rows = [(i, " ".join(t for t, n in (("alpha", 2), ("beta", 3), ("hot", 1)) if i % n == 0)) for i in range(1000)] + [(1, None), (None, "alpha"), (6, "hot alpha beta")]
    df = spark.createDataFrame(rows, "line_id bigint, msg_tokens string").withColumn("word", F.lit(1))
    index.write_index(df, f"file://{tmp_path}/index")
    read = index.read_index(spark, f"file://{tmp_path}/index")
    ids = lambda words, every: sorted(r.line_id for r in index.lookup(read, words, every).collect())
    assert ids(["Alpha", "beta"], True) == [i for i in range(1000) if i % 6 == 0]
    assert ids(["alpha", "beta"], False) == [i for i in range(1000) if i % 2 == 0 or i % 3 == 0]
    assert ids(["hot"], True) == list(range(1000)) and ids(["none", "hot"], True) == [] and ids([], False) == []
    assert index.postings(df.limit(0)).count() == 0
    plan = index.lookup(read, ["alpha"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "token" in plan.split("PushedFilters")[1][:80]


def test_lines_of_json(spark, tmp_path):
    path = str(tmp_path / "a" / "events.jsonl")
    for i in range(3):
        jsonl.append_record(path, {"b": i, "a": "ü"})
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n  \nbroken {\n")
    rows = jsonl.read_jsonl(spark, f"file://{path}").collect()
    assert sorted(r.value["b"] for r in rows if r.value) == ["0", "1", "2"] and [r.line for r in rows if r.line] == ["broken {"]
    df = spark.createDataFrame([(1, None), (2, "x")], "b int, a string")
    jsonl.write_jsonl(df, f"file://{tmp_path}/t")
    jsonl.write_jsonl(df, f"file://{tmp_path}/t")
    texts = [r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()]
    assert sorted(texts) == sorted(['{"a":null,"b":1}', '{"a":"x","b":2}'] * 2)
