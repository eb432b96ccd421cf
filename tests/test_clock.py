import random
from itertools import product
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.brute import instants, us, utc_of
from tidemark.functions.instants import epoch_instant, trimmed, with_interpretations
from tidemark.operators import clock
from tidemark.session import table

STAMPS = "rec_id bigint, file_id int, line_no bigint, boot_id string, ts_raw string, mono_s double, stamp string"
FILES = "file_id int, archive_path string, archive string"
PACKAGES = "archive string, timezone string, collected_at string, file_id int"
ANCHORS = "anchor_id int, boot_id string, monotonic_ns bigint, wall_utc timestamp, weight double"


def solve(spark, stamps, zone="Europe/Berlin", collected="2025-06-01T00:00:00Z", anchors=(), **kw):
    rows = spark.createDataFrame([(r, f, n, b, t, m, "x") for r, f, n, b, t, m in stamps], STAMPS)
    files = spark.createDataFrame([(1, "a", "z"), (2, "b", "z")], FILES)
    packages = spark.createDataFrame([("a", zone, collected, 9)], PACKAGES)
    found = clock.candidates(rows, files, packages, spark.createDataFrame(list(anchors), ANCHORS))
    return {r.rec_id: r.utc_us for r in clock.resolve(found, **kw).collect()}


def at(text):
    return us(datetime.fromisoformat(text))


def test_formats_zones_and_invalid_text(spark):
    texts = {
        "2025-01-02T03:04:05.1234567Z": at("2025-01-02T03:04:05.123456+00:00"),
        " 2025/01/02 03:04:05.5 ": at("2025-01-02T03:04:05.5+01:00"),
        "20250102T030405Z": at("2025-01-02T03:04:05+00:00"),
        "02.01.2025 03:04:05": at("2025-01-02T03:04:05+01:00"),
        "2025年01月02日 3时04分05秒": at("2025-01-02T03:04:05+01:00"),
        "Thu, 02 Jan 2025 03:04:05 -0230": at("2025-01-02T03:04:05-02:30"),
        "Jan 2, 2025 12:04:05 AM": at("2025-01-02T00:04:05+01:00"),
        "2025-01-02 03:04:05.500 [Asia/Tokyo]": at("2025-01-02T03:04:05.5+09:00"),
        "1735787045": 1735787045000000,
        "1735787045.25": 1735787045250000,
        "1735787045123": 1735787045123000,
        "1735787045123456": 1735787045123456,
        "06-02 00:30:00.000": at("2024-06-02T00:30:00+02:00").__add__(365 * 86400 * 10**6),  # at most a day after collection
        "06-03 00:30:00.000": at("2024-06-03T00:30:00+02:00"),
        "0229 01:02:03.000004": at("2024-02-29T01:02:03.000004+01:00"),
    }
    bad = ["0000-00-00 00:00:00", "2025-02-30 00:00:00", "2025-01-01 24:00:00", "2025-01-01 10:00:60", "unset", "", "--:--:--", None, "1:2", "x" * 100_000, "Jan 2, 2025 13:04:05 PM"]
    rows = [(i, 1, i, None, t, None) for i, t in enumerate([*texts, *bad])]
    got = solve(spark, rows)
    assert got == {i: v for i, v in enumerate(texts.values())}
    assert all(instants(t, "Europe/Berlin", datetime(2025, 6, 1, tzinfo=timezone.utc))[0] == v for t, v in texts.items())


def test_clock_changes(spark):
    # 27 October 2024: 02:30 occurs twice in Berlin; 31 March 2024: 02:30 is skipped
    rows = [(1, 1, 1, None, "2024-10-27 02:50:00", None), (2, 1, 2, None, "2024-10-27 02:10:00", None), (3, 1, 3, None, "2024-10-27 02:20:00", None),
            (4, 1, 4, None, "2024-03-31 02:30:00", None), (5, 2, 1, None, "2024-03-31 02:30:00", None), (5, 2, 1, None, "2024-03-31 02:30:00", None)]
    got = solve(spark, rows, block=2)
    assert got[1] == at("2024-10-27T02:50:00+02:00")
    assert got[2] == at("2024-10-27T02:10:00+01:00")
    assert got[3] == at("2024-10-27T02:20:00+01:00")
    assert got[4] == at("2024-03-31T02:30:00+01:00")
    assert 5 not in got  # its file's package is unknown


def test_monotonic_uses_the_heaviest_anchor(spark):
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)
    anchors = [(3, "b", 10**9, t, 0.5), (1, "b", 10**9, t + timedelta(seconds=5), 0.9), (2, "b", 10**9, t, 0.9), (4, None, 1, t, 1.0), (5, "c", None, t, 1.0)]
    got = solve(spark, [(1, 1, 1, "b", None, 2.000001), (2, 1, 2, "c", None, 1.0), (3, 1, 3, None, None, 1.0), (4, 1, 4, "b", None, float("nan"))], anchors=anchors)
    assert got == {1: us(t) + 6_000_001}


def test_empty_tables(spark):
    assert solve(spark, []) == {}


def test_blocks_do_not_change_the_result(spark):
    rnd = random.Random(4)
    rows = []
    for f in (1, 2):
        t = datetime(2024, 10, 27, 0, 30)
        for n in range(300):
            t += timedelta(seconds=rnd.choice([5, 30, 200, -90, -20]))
            rows.append((f * 1000 + n, 1 if f == 1 else 1, f * 1000 + n, None, t.strftime("%Y-%m-%d %H:%M:%S"), None))
    want = utc_of(
        [dict(zip(("rec_id", "file_id", "line_no", "boot_id", "ts_raw", "mono_s"), r)) for r in rows], [],
        {1: ("Europe/Berlin", datetime(2025, 6, 1, tzinfo=timezone.utc))},
    )
    assert solve(spark, rows, block=7) == want == solve(spark, rows)


def test_against_plain_model(spark, small):
    def read(n):
        return pq.read_table(f"{small}/{n}.parquet").to_pylist()

    packages = {p["archive"]: p for p in read("packages")}
    places = {f["file_id"]: (packages[f["archive_path"]]["timezone"], datetime.fromisoformat(packages[f["archive_path"]]["collected_at"])) for f in read("files")}
    got = clock.resolve(clock.candidates(*[table(spark, small, t) for t in ("parse_results", "files", "packages", "clock_anchors")]))
    assert {r.rec_id: r.utc_us for r in got.collect()} == utc_of(read("parse_results"), read("clock_anchors"), places)


def test_interpretations_keep_clashing_columns(spark):
    df = spark.createDataFrame([("2025-01-02T03:04:05Z", "UTC", None, 7)], "_collected string, _zone string, _year timestamp, _parts int")
    out = with_interpretations(df, "_collected", "_zone", "_year")
    assert out.columns == [*df.columns, "instants"]
    assert out.select(F.size("instants")).first()[0] == 1
    assert df.select(epoch_instant(trimmed(F.lit(" 12 ")))).first()[0] == 12_000_000


def path_cost(path, tolerance=60_000_000):
    return sum((a[0] != b[0]) + (b[1] < a[1] - tolerance) for a, b in zip(path, path[1:]))


def test_day_or_month_first_is_told_by_context(spark):
    day_first = ["03/04/2025 10:00:00", "04/04/2025 09:00:00", "25/04/2025 08:00:00", "03/05/2025 07:00:00", "05/05/2025 07:00:00", "99/99/2025 07:00:00"]
    month_first = ["04/03/2025 10:00:00", "04/04/2025 09:00:00", "04/25/2025 08:00:00", "05/03/2025 07:00:00", "05/05/2025 07:00:00", "99/99/2025 07:00:00"]
    want = ["2025-04-03T10:00:00+02:00", "2025-04-04T09:00:00+02:00", "2025-04-25T08:00:00+02:00", "2025-05-03T07:00:00+02:00", "2025-05-05T07:00:00+02:00"]
    for texts in (day_first, month_first):
        for block in (1, 2, 20):
            rows = [(i, 1, i, None, t, None) for i, t in enumerate(texts)]
            assert solve(spark, rows + rows[:2], block=block) == {i: at(t) for i, t in enumerate(want)}


def test_chained_blocks_reach_the_least_cost(spark):
    rnd = random.Random(9)
    minute = 60_000_000
    rows = []
    for f in (1, 2, 3, None):
        t = 0
        for n in range(9):
            t += rnd.choice([1, 5, -4, 30]) * minute
            for k in range(rnd.choice([1, 2, 2, 3])):
                early = t + rnd.choice([0, 7, -9, 40]) * minute * (k > 0)
                rows.append((n, f, n, 3, k if k else rnd.choice([0, 5]), early, early))
    df = spark.createDataFrame(rows, "rec_id bigint, file_id int, line_no bigint, ways int, format int, early bigint, late bigint")
    for block in (1, 2, 4, 100):
        chosen = clock.settled_formats(df.withColumn("block", F.floor(F.col("line_no") / block)), "file_id", minute).collect()
        for f in (1, 2, 3, None):
            path = [(r.format, r.early) for r in sorted((r for r in chosen if r.file_id == f), key=lambda r: r.line_no)]
            options = [[(r[4], r[5]) for r in rows if r[1] == f and r[2] == n] for n in range(9)]
            assert len(path) == 9 and path_cost(path) == min(map(path_cost, product(*options)))
