from datetime import datetime, timedelta

from tidemark.streaming import live

SCHEMA = "line_id bigint, file_id int, line_no bigint, component string, level_num int, ts_utc timestamp"
T0 = datetime(2025, 1, 1)


def run(spark, tmp_path, make, rows, name):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = live.read_lines(spark, str(tmp_path / "in"), SCHEMA, 1)
    q = live.write_table(make(lines), str(tmp_path / name), str(tmp_path / f"{name}-state"))
    q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name)).collect()


def line(i, s, component="c", level=40, file=1):
    return (i, file, i, component, level, T0 + timedelta(seconds=s))


def test_timeline_and_repeats(spark, tmp_path):
    rows = [[line(1, 0), line(2, 30), line(2, 30)], [line(3, 90)], [line(4, 1000)], [line(5, 2000)]]
    got = run(spark, tmp_path, lambda x: live.timeline(live.once(x), late=None), rows, "timeline")
    assert {(r.bucket, r.n, r.errors) for r in got} >= {(T0, 2, 2), (T0 + timedelta(minutes=1), 1, 1)}


def test_spans(spark, tmp_path):
    rows = [[line(1, 0), line(2, 20), line(3, 100)], [line(4, 1000)], [line(5, 2000)]]
    got = run(spark, tmp_path, live.active_spans, rows, "spans")
    assert {(r.start, r.n) for r in got} >= {(T0, 2), (T0 + timedelta(seconds=100), 1)}


def test_clock_epochs(spark, tmp_path):
    rows = [[line(1, 100), line(2, 98), line(3, 50)], [line(4, 60), line(5, 10)]]
    got = run(spark, tmp_path, live.clock_epochs, rows, "epochs")
    assert {r.line_no: r.clock_epoch for r in got} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
