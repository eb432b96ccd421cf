import random

from tidemark.operators import intervals


def model(rows):
    out = {"gaps": [], "periods": []}
    by = {}
    for k, s, e in rows:
        if None not in (k, s, e) and s <= e:
            by.setdefault(k, []).append((s, e))
    for k, v in by.items():
        v.sort()
        periods = [list(v[0])]
        for s, e in v[1:]:
            if s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out["periods"] += [(k, *p) for p in periods]
        out["gaps"] += [(k, a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return {k: sorted(v) for k, v in out.items()}


def solve(spark, rows, shard):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "a string, s bigint, e bigint, shard int, run int")
    runs = intervals.run_bitmaps(df, ["a"], "s", "e", shard)
    return {
        "gaps": sorted(map(tuple, intervals.clear_runs(runs, ["a"], shard).collect())),
        "periods": sorted(map(tuple, intervals.set_runs(runs, ["a"], shard).collect())),
    }


def test_random_intervals_for_any_shard_width(spark):
    rnd = random.Random(1)
    rows = []
    for _ in range(400):
        s = rnd.randint(-300, 900)
        rows.append((rnd.choice("abc"), s, s + rnd.choice([0, 1, 5, 30, 250])))
    rows += rows[:50]
    for shard in (10, 64, 100_000):
        assert solve(spark, rows, shard) == model(rows)


def test_nulls_backward_touching_and_empty(spark):
    rows = [(None, 1, 2), ("a", None, 2), ("a", 5, 3), ("a", 0, 10), ("a", 10, 20), ("a", 21, 30), ("b", 7, 7)]
    assert solve(spark, rows, 10) == model(rows)
    assert solve(spark, rows, 10)["gaps"] == [("a", 20, 21)]
    assert solve(spark, [], 10) == {"gaps": [], "periods": []}


def test_one_entity_with_most_rows(spark):
    rows = [("hot", i * 7 % 5000, i * 7 % 5000 + 3) for i in range(5000)] + [("b", i, i) for i in range(20)]
    assert solve(spark, rows, 100) == model(rows)


def test_union_of_bit_runs():
    rnd = random.Random(3)
    for _ in range(300):
        runs = [(a, a + rnd.randint(0, 6)) for a in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 9)))]
        bits = {b for first, last in runs for b in range(first, last + 1)}
        united = intervals.union(runs)
        assert {b for first, last in united for b in range(first, last + 1)} == bits
        assert all(b[0] > a[1] + 1 for a, b in zip(united, united[1:]))


def test_one_bitmap_a_shard_however_many_tasks_hold_it(spark):
    df = spark.createDataFrame([("a", i % 50, i % 50 + 1) for i in range(1000)], "a string, s bigint, e bigint").repartition(8)
    assert [tuple(r) for r in intervals.run_bitmaps(df, ["a"], "s", "e", 1000).collect()] == [("a", 0, [0, 100])]
