import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidemark.llm import copies, queries, runs, term_stats
from tidemark.session import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    oracle.check(spark, small, queries.QUERIES[name], queries.ORACLE[name])


def test_results_of_one_problem_agree(spark, small):
    """What the queries of a problem without SQL have in common."""
    got = {name: queries.QUERIES[name](spark, small).collect() for name in queries.QUERIES}
    assert {r.rec_id for r in got["p2_found"]} == {r.rec_id for r in got["p2_restored"]} != set()
    lines = table(spark, small, "log_lines")
    usable = lines.where("ts_utc IS NOT NULL AND template_id IS NOT NULL AND line_id IS NOT NULL").select("line_id").distinct().count()
    assert sum(r.rows for r in got["p5_runs"]) == usable
    ok = lines.where("parse_status = 'OK' AND raw_line IS NOT NULL").select("line_id").distinct().count()
    assert sum(r.copies for r in got["p7_copies"]) == ok and len(got["p7_copies"]) == ok - len(got["p7_found"])
    docs = table(spark, small, "documents").count()
    assert len(got["p8_ids"]) == docs
    tokens = sum(len(r.ids) for r in got["p8_ids"])
    for fill in got["p9_fill"]:
        own = [r for r in got["p9_pack"] if r.tier == fill.tier]
        assert fill.tokens == sum(r.tokens for r in own) == tokens and len({r.doc_id for r in own}) == docs
        assert len({r.container for r in own}) == fill.containers >= -(-tokens // fill.capacity)
    assert {r.doc_id for r in got["p10_found"]} == {r.doc_id for r in got["p10_pages"]} != set()


def test_term_counts(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([5, 40_000, 70_000, 90, None]), rnd.randint(0, 60), 0) for _ in range(600)] + [(1, 5, None, 0)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "t int, r int, o int, term int")
    once = {r[:3] for r in rows if r[0] is not None and r[2] is not None}
    want = {(t, len([1 for r in once if r[0] == t]), len({r[1] for r in once if r[0] == t} - {None}), len({r[1] for r in once} - {None})) for t in (1, 2, 3)}
    assert {tuple(r) for r in term_stats.term_frequencies(df, "t", "r", "o").collect()} == want
    assert term_stats.mark_terms(term_stats.term_frequencies(df.limit(0), "t", "r", "o")).count() == 0
    every = term_stats.term_frequencies(df, "t", "r").agg(F.sum("occurrences")).first()[0]
    assert every == len([r for r in rows if r[0] is not None])


FORMS = [
    "07-23 02:38:57 INFO frame queue synced addr=0xda temp=57.9 ref=4f1e",
    "07-23 02:38:57 info frame queue　synced; Temp: 57.9; REF='4F1E'; addr=[0xDA] 。",
    "07-23 02:38:57 INFO FRAME QUEUE SYNCED | ref：4f1e | addr = 0xda | (temp=57.9)!",
]
OTHER = [
    "07-23 02:38:57 INFO frame queue synced addr=0xda temp=4f1e ref=57.9",
    "07-23 02:38:57 INFO queue frame synced addr=0xda temp=57.9 ref=4f1e",
    "07-23 02:38:58 INFO frame queue synced addr=0xda temp=57.9 ref=4f1e",
    "07-23 02:38:57 INFO frame queue synced addr=0xda temp=579 ref=4f1e",
    '{"a": "x y", "b": 1}', '{"b": 2, "a": "x y"}', "!!!", "???", "", "  ", "z" * 60_000,
]


def test_copies_in_any_format(spark):
    texts = FORMS + OTHER + ['{"b":1,"a" : "X  Y"}', FORMS[0], FORMS[0], None]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, FORMS[0], "x", 1), (None, FORMS[0], "x", 1)]
    df = spark.createDataFrame(rows, "line_id bigint, text string, raw string, lo int")
    n = len(FORMS)
    want = {(0, 1), (0, 2), (0, len(texts) - 3), (0, len(texts) - 2), (n + 4, len(texts) - 4), (n + 8, n + 9)}
    assert {tuple(r) for r in copies.copy_pairs(df, "line_id", "text").collect()} == want
    groups = {r.line_id: r.copies for r in copies.copy_groups(df.distinct(), "line_id", "text").collect()}
    assert groups[0] == 5 and groups[n] == 1 and sum(groups.values()) == len(texts) - 1
    assert copies.copy_pairs(df.limit(0), "line_id", "text").count() == 0


def test_copies_against_token_groups(spark, small):
    """In these lines, texts with the same tokens are copies; fields keep their values, as random ids show."""
    lines = {r.line_id: r.raw_line for r in table(spark, small, "log_lines").where("parse_status = 'OK'").collect()}
    groups = defaultdict(list)
    for i, t in lines.items():
        groups[tuple(sorted(x for x in re.split(r"[\W_]+", t.lower()) if x))].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in queries.p7_found(spark, small).collect()} == want


def run_model(rows, gap):
    out, by = [], defaultdict(set)
    for e, us, i, k in rows:
        if None not in (us, i, k):
            by[e].add((us, i, k))
    for e, v in by.items():
        last = None
        for us, i, k in sorted(v):
            if last and last[2] == k and us - last[1][-1] <= gap:
                last[1].append(us)
                last[3].append(i)
            else:
                last = [e, [us], k, [i]]
                out.append(last)
    return sorted((str(e), k, len(t), t[0], t[-1], min(i), max(i)) for e, t, k, i in out)


def test_runs_for_any_shard(spark):
    rnd = random.Random(5)
    rows, us = [], 0
    for i in range(700):
        us += rnd.choice([0, 1, 20, 59, 60, 61, 400]) * 10**6
        rows.append((rnd.choice(["f", "f", "f", None]), us, i, rnd.choice(["a", "a", "a", "b", None])))
    rows += rows[5:60] + [("f", None, 9000, "a")]
    df = spark.createDataFrame(rows, "file string, us bigint, id bigint, ev string").withColumn("ts", F.timestamp_micros("us")).withColumn("shard", F.lit(1))
    for shard_s in (70, 5000, 10**6):
        got = runs.collapse_runs(df, ["file"], "ts", "id", "ev", shard_s=shard_s).collect()
        assert sorted((str(r.file), r.event, r.rows, r.first_us, r.last_us, r.min_id, r.max_id) for r in got) == run_model(rows, 60 * 10**6)
    assert runs.collapse_runs(df.limit(0), ["file"], "ts", "id", "ev").count() == 0


def test_near_identical_events_cost_less_than_a_boundary(spark):
    rows = [(1, i, i, e) for i, e in enumerate(["a b c d e f", "a b c d e g", "x y", "a b c d e f"])]
    df = spark.createDataFrame(rows, "f int, s int, id int, ev string").withColumn("ts", F.timestamp_seconds("s"))
    got = runs.collapse_runs(df, ["f"], "ts", "id", "ev", penalty=0.3, dissimilarity=runs.jaccard_distance)
    assert sorted((r.min_id, r.rows, r.duration_us) for r in got.collect()) == [(0, 2, 10**6), (2, 1, 0), (3, 1, 0)]


def test_event_key_forgets_values_case_and_punctuation(spark):
    same = ["mirror pick failed blk=498751 span=<*>", "Mirror Pick failed; blk=<*>; span=<*>", "MIRROR PICK FAILED, blk=<*>, span=7a"]
    other = ["mirror pick failed slot=<*> span=<*>", "mirror pick opened blk=<*> span=<*>"]
    df = spark.createDataFrame([(t,) for t in same + other], "t string").select(runs.event_key(F.col("t")))
    keys = [r[0] for r in df.collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 3


def least_cost(events, distance, penalty):
    """Over all segmentations, with the best representative of each run among all events."""
    n, best = len(events), [0.0]
    for i in range(1, n + 1):
        best.append(min(best[j] + penalty + min(sum(distance(r, x) for x in events[j:i]) for r in set(events)) for j in range(i)))
    return best[n]


def test_pruned_recursion_reaches_the_least_cost():
    rnd = random.Random(7)
    words = "a b c d e f".split()
    for _ in range(300):
        vocabulary = [" ".join(sorted(rnd.sample(words, rnd.randint(2, 6)))) for _ in range(rnd.randint(1, 5))]
        events = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 14))]
        penalty = rnd.choice([0.1, 0.25, 0.3, 0.6])
        starts = runs.Segmenter(runs.jaccard_distance, penalty).cuts(events, [1] * len(events))
        cost = 0.0
        for a, b in zip(starts, [*starts[1:], len(events)]):
            cost += penalty + min(sum(runs.jaccard_distance(r, x) for x in events[a:b]) for r in set(events))
        assert starts[0] == 0 and abs(cost - least_cost(events, runs.jaccard_distance, penalty)) < 1e-9, (events, penalty, starts)


def test_a_chain_of_small_steps_is_cut(spark):
    words = "abcdefghijklmnopqrst"
    events = [" ".join(words[i : i + 8]) for i in range(12)]  # neighbours share 7 of 9 words, the first and the last none
    df = spark.createDataFrame([(1, i, i, e) for i, e in enumerate(events)], "f int, s int, id int, ev string").withColumn("ts", F.timestamp_seconds("s"))
    for shard_s in (5, 100):
        got = runs.collapse_runs(df, ["f"], "ts", "id", "ev", 4, 0.3, runs.jaccard_distance, shard_s).collect()
        assert len(got) > 2 and sum(r.rows for r in got) == 12
        cuts = runs.Segmenter(runs.jaccard_distance, 0.3).cuts(events, [1] * 12)
        assert sorted(r.min_id for r in got) == cuts


def test_parts_are_the_stretches_of_one_event_whatever_the_penalty(spark):
    rnd = random.Random(11)
    near = ["session opened by user", "session closed by user", "user by session opened", "session opened", "unit ready", ""]
    rows, us = [], 0
    for i in range(400):
        us += rnd.choice([0, 1, 5, 20, 59, 60, 61, 400]) * 10**6
        rows.append((rnd.choice(["f", "f", None]), us, i, rnd.choice(near[:2] if rnd.random() < 0.7 else near)))
    rows += rows[5:60]
    df = spark.createDataFrame(rows, "file string, us bigint, id bigint, ev string").withColumn("ts", F.timestamp_micros("us"))
    want = run_model(rows, 60 * 10**6)
    for penalty, shard_s in ((0.1, 5000), (0.25, 70), (0.25, 10**6), (0.6, 5000)):
        how = (df, ["file"], "ts", "id", "ev", 60, penalty, runs.jaccard_distance, shard_s)
        got = runs.collapse_runs(*how, parts=True).collect()
        assert sorted((str(r.file), r.event, r.rows, r.first_us, r.last_us, r.min_id, r.max_id) for r in got) == want
        whole = defaultdict(int)
        for r in got:
            whole[r.file, r.run_rows] += r.rows
        for r in runs.collapse_runs(*how).collect():
            whole[r.file, r.rows] -= r.rows
        assert set(whole.values()) == {0} and (penalty < 0.2 or any(r.run_rows > r.rows for r in got))


def test_p5_found_solves_runs_of_near_identical_events(spark, tmp_path, monkeypatch):
    """They are one run of the recursion, which holds cases of both events."""
    texts = ["session opened by user id=<*> now", "session closed by user id=<*> now", "Session opened, by user id=<*> now!"]
    templates = spark.createDataFrame(list(enumerate(texts)), "template_id int, template_text string")
    templates.toPandas().to_parquet(f"{tmp_path}/templates.parquet")
    rows = [(1, "c", i, i, i, t) for i, t in enumerate([0, 2, 0, 0, 1, 0, 0, 2, 0, 1, 0, 1, 1, 1])]
    lines = spark.createDataFrame(rows, "file_id int, component string, s bigint, line_no bigint, line_id bigint, template_id int")
    lines.withColumn("ts_utc", F.timestamp_seconds("s")).toPandas().to_parquet(f"{tmp_path}/log_lines.parquet", coerce_timestamps="us")
    seen, collapse = [], runs.collapse_runs
    monkeypatch.setattr(runs, "collapse_runs", lambda *a, **k: seen.append(collapse(*a, **k)) or seen[-1])
    oracle.check(spark, str(tmp_path), queries.p5_found, queries.ORACLE["p5_found"])
    got = queries.p5_found(spark, str(tmp_path)).collect()
    assert sorted((r.line_id_a, r.line_id_b) for r in got) == [(0, 3), (5, 8), (11, 13)]
    assert any("run_rows" in f.columns and f.agg(F.max(F.col("run_rows") - F.col("rows"))).first()[0] > 3 for f in seen)


def test_ties_in_time_go_by_the_given_order(spark):
    rows = [(1, 0, 3, 1, "a"), (1, 0, 2, 2, "b"), (1, 0, 1, 3, "a"), (1, 0, 0, 4, "a")]
    df = spark.createDataFrame(rows, "f int, s int, id int, n int, ev string").withColumn("ts", F.timestamp_seconds("s"))
    got = runs.collapse_runs(df, ["f"], "ts", "id", "ev", order="n").collect()
    assert sorted((r.min_id, r.max_id, r.event) for r in got) == [(0, 1, "a"), (2, 2, "b"), (3, 3, "a")]
