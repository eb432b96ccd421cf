import random

from pyspark.sql import functions as F

from tests import brute
from tidemark.operators import templates
from tidemark.plans import reference
from tidemark.session import table


def test_every_cluster_has_its_own_id(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(i, f"{word(i)} x{word(i)} y{word(i)}") for i in range(templates.CLUSTERS + 50)]
    df = spark.createDataFrame(rows, "n int, message string")
    mined = templates.mine(df, "message", ["n"])
    assert mined.select("template_id").distinct().count() == mined.select("template").distinct().count() > templates.CLUSTERS
    assert templates.mine(df, "message", ["n"], templates.CLUSTERS).where("template_id = 0").count() > 0


def solve(spark, messages):
    df = spark.createDataFrame(list(enumerate(messages)), "n int, message string").repartition(5)
    return {r.n: (r.template_id, r.template) for r in templates.mine(df, "message", ["n"]).collect()}


def test_parameters_of_founders_and_words_with_digits(spark):
    messages = ["x 1 2 3", "bank2 T-17 deadbeef01 0x1f 12:30", "", "  ", "a　b\x1cc 1.5"]
    got = solve(spark, messages)
    assert got == dict(enumerate(brute.mined_templates(messages)))
    assert got[0][1] == "x <*> <*> <*>" and got[1][1] == "bank2 T-17 <*> <*> <*>"


def test_repeats_move_to_a_cluster_that_has_come_to_cover_them(spark):
    # the second cluster's founder is covered by the first one after its third message
    messages = ["p q r a b c d e", "p q r v w x y z", "p q r a b c y z", "p q r v w x y z", "p q r v w c d e", "p q r v w x y z"]
    want = dict(enumerate(brute.mined_templates(messages)))
    assert solve(spark, messages) == want


def test_against_the_sequential_model_on_random_messages(spark):
    rnd = random.Random(11)
    for vocabulary, size in (("abcd", 5), ("ab", 9), ([f"w{i}" for i in range(150)], 3)):
        messages = [" ".join(rnd.choice([*vocabulary, "7", "0xff"]) for _ in range(rnd.randint(1, size))) for _ in range(1500)]
        assert solve(spark, messages) == dict(enumerate(brute.mined_templates(messages)))


def test_query_against_the_sequential_model(spark):
    """All lines of the middle test size."""
    d = "/root/testdata/sf0.01"
    lines = table(spark, d, "log_lines").dropDuplicates(["line_id"]).select("line_id", "file_id", "line_no", F.coalesce("message", "raw_line").alias("m"))
    rows = sorted(lines.where("m IS NOT NULL").collect(), key=lambda r: (r.file_id, r.line_no, r.line_id))
    assert len(rows) > 10_000
    want = dict(zip((r.line_id for r in rows), brute.mined_templates([r.m for r in rows])))
    got = {r.line_id: (r.template_id, r.template) for r in reference.mined_templates(spark, d).where("template_id IS NOT NULL").collect()}
    assert got == want
