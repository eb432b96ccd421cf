import io
import tarfile
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.build import build
from tidemark.sources import archives
from tidemark.sources.simulate import FILES, BundleSource, bundle


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_unpacking_refuses_paths_out_and_passes_limits():
    for name in ("../a", "/a", "x/../../a", "C:\\a"):
        with pytest.raises(archives.UnsafeArchiveError):
            list(archives.members("z", zipped({name: b"1"})))
    with pytest.raises(archives.UnsafeArchiveError):
        list(archives.members("z", zipped({"a": b"123"}), max_bytes=2))
    inner = zipped({"b.log": b"x"})
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        for name, data in {"in.zip": inner, "bad.zip": b"PK\x03\x04?"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    got = {m[1]: m[5] for m in archives.members("t", tar.getvalue())}
    assert got == {"in.zip.d/b.log": "OK", "bad.zip": "NESTED_UNREADABLE", "link": "LINK"}


def test_records_and_encodings():
    data = "一行\n  x\r\n    at a.b(C)\n#1 no\n\n".encode("gb18030")
    got = list(archives.records(data, "gb18030"))
    assert [(r[0], r[3]) for r in got] == [(1, 1), (2, 2), (4, 1), (5, 1)]
    assert b"".join(r[4] for r in got) == data and got[1][1] == len("一行\n".encode("gb18030"))
    assert list(archives.records(b"\xff\n", "utf-8"))[0][6] and list(archives.records(b"", "utf-8")) == []
    assert list(archives.records(b"a" * 300_000, "utf-8"))[0][7]
    assert archives.detect_encoding("日志缓冲区已满".encode("gb18030"))[0] == "gb18030"
    assert archives.detect_encoding("Größe ok".encode())[0] == "utf-8" and archives.detect_encoding(bytes(range(32)) * 9)[2]
    assert archives.detect_encoding("\ufeffab".encode("utf-16"))[0] == "utf-16" and archives.detect_encoding(b"")[0] == "utf-8"


@pytest.mark.parametrize("codec", ["utf-16", "utf-16-le", "utf-16-be"])
def test_utf16_records_keep_the_bytes_of_the_file(codec):
    text = "\u0a0aäü\r\n    at x\n第二行\n\u0d0a last"
    data = text.encode(codec)
    got = list(archives.records(data, codec))
    assert [(r[0], r[3], r[5]) for r in got] == [(1, 2, "\u0a0aäü\n    at x"), (3, 1, "第二行"), (4, 1, "\u0d0a last")]
    assert all(data[r[1] : r[1] + r[2]] == r[4] for r in got) and b"".join(r[4] for r in got) == data
    assert not any(r[6] or r[7] for r in got)


def test_files_of_all_archives_are_in_one_order(spark):
    rows = [(a, m, 0, None, bytearray(f"{a}{m}".encode()), "OK") for a in ("a.zip", "b.zip") for m in ("logs/uds/x.log", "logs/uds/x.log.1", "logs/flash/y.log")]
    found = spark.createDataFrame(rows, archives.MEMBERS)
    files = archives.parse_order(archives.inventory(found))
    got = [(r.archive_path, r.rel_path) for r in files.orderBy("file_seq").collect()]
    one = ["logs/flash/y.log", "logs/uds/x.log.1", "logs/uds/x.log"]
    assert got == [(a, m) for a in ("a.zip", "b.zip") for m in one] and "content" not in files.columns
    assert sorted(r.file_seq for r in files.collect()) == [1, 2, 3, 4, 5, 6]
    assert archives.read_records(files, found).count() == 6


def test_path_rules(spark):
    names = ["logs/uds/a.log.2.gz", "logs/x/y.json", "package_meta.json", "logs/q/a.log"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = df.select(archives.component(F.col("p"))["component"], archives.excluded(F.col("p")), archives.rotation(F.col("p"))["rotation_index"]).collect()
    assert [tuple(r) for r in got] == [("uds_stack", False, 2), ("unknown", True, 0), ("unknown", True, 0), ("unknown", False, 0)]


def test_bundles_are_the_same_each_time(spark):
    assert bundle(3) == bundle(3) != bundle(4)
    spark.dataSource.register(BundleSource)
    df = spark.read.format("made_up_bundles").option("bundles", 2).option("lines", 5).load()
    assert sorted(r.name for r in df.collect()) == ["bundle-0.zip", "bundle-1.zip"]


def test_build_from_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    truth = []
    for i in range(2):
        data, t = bundle(i, 25)
        truth.append(t)
        (tmp_path / "in" / f"b{i}.zip").write_bytes(data)
    (tmp_path / "in" / "bad.zip").write_bytes(b"PK\x03\x04 broken")
    out = build(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/ws")
    lines = spark.read.parquet(f"file://{tmp_path}/ws/log_lines")
    assert out["rows"] == 2 * 25 * len(FILES) and out["checks"]["ids"] and out["checks"]["hashes"] and out["without_time"] == 0
    assert out["multiline"] == sum(t["stacks"] for t in truth)
    ids = sorted(r.line_id for r in lines.select("line_id").collect())
    assert ids == list(range(out["rows"]))
    order = [r.ts_utc for r in lines.orderBy("line_id").select("ts_utc").collect()]
    assert order == sorted(order)
    first = lines.where("component = 'ota_master'").agg(F.min("ts_utc")).first()[0]
    assert timedelta(0) <= first.replace(tzinfo=timezone.utc) - datetime(2025, 3, 1, tzinfo=timezone.utc) < timedelta(seconds=10)
    assert lines.where("encoding = 'gb18030'").where(F.col("raw_line").contains("存储")).count() == 50
