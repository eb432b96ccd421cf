"""Log archives: safe unpacking, file inventory, encoding detection and record reading.

Archives are read as binary files, one row each, and opened in Arrow functions: members never touch a disk, and each
is bounded by the same limits a local unpacker would enforce. An archive is walked twice, first for its limits and names
and then member by member, so that a task holds the archive and one batch of members. Files are put in order by their
metadata alone; their bytes are joined back only where records are read.
"""

from __future__ import annotations

import fnmatch
import io
import posixpath
import re
import stat
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.schema import RECORDS

# fixed values: limits, excluded files, components by path, encodings tried, continuation lines
MAX_BYTES, MAX_FILES, MAX_DEPTH = 20 << 30, 200_000, 3
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")
EXCLUDED = ["package_meta.json", "**/*.json", "**/*.png", "**/*.jpg", "**/*.db", "**/*.sqlite*", "**/*.pcap", "**/*.dlt"]
COMPONENTS = [
    ("ota_master", "ota_master", 10), ("campaign", "campaign_client", 20), ("downloader", "downloader", 30), ("verify", "verify_svc", 40),
    ("uds", "uds_stack", 50), ("flash", "flash_agent", 60), ("diag", "diag_router", 70), ("power", "power_mgr", 80),
    ("storage", "storage_svc", 90), ("tbox", "tbox_comm", 100), ("ivi", "ivi_app", 110), ("kernel", "kernel", 120),
]
UNKNOWN_RANK = 999
ENCODINGS = ["utf-8", "gb18030", "utf-16", "latin-1"]
SAMPLE_BYTES, BINARY_SHARE = 65_536, 0.30
MAX_LINE_BYTES, MAX_SPAN = 262_144, 200
CONTINUED = re.compile(r"^\s+at\s|^\s*#\d+\s+0x|^\s*Caused by:|^\s{4,}\S")
#: bytes of members in a batch
BATCH_BYTES = 32 << 20
MEMBERS = "archive string, member string, depth int, mtime timestamp, content binary, status string"


class UnsafeArchiveError(ValueError):
    pass


def safe_name(name: str) -> str:
    """A member's path below the root; raises for absolute paths and such that leave it."""
    name = name.replace("\\", "/")
    clean = posixpath.normpath(name)
    if name.startswith("/") or re.match(r"^[A-Za-z]:", name) or clean.startswith("../") or clean == "..":
        raise UnsafeArchiveError(f"path leaves the archive: {name}")
    return clean


def _entries(data: bytes) -> Iterator[tuple[str, datetime | None, bool, bytes]]:
    """name, time, whether it is a link, bytes of each file in a zip or tar."""
    if data[:4] == b"PK\x03\x04" or data[:4] == b"PK\x05\x06":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                link = stat.S_ISLNK(info.external_attr >> 16)
                try:
                    at = datetime(*info.date_time, tzinfo=timezone.utc)
                except ValueError:
                    at = None
                yield info.filename, at, link, b"" if link else z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isdir():
                    continue
                body = t.extractfile(info) if info.isfile() else None
                yield info.name, datetime.fromtimestamp(info.mtime, timezone.utc), body is None, body.read() if body else b""


def members(archive: str, data: bytes, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES, max_depth: int = MAX_DEPTH) -> Iterator[tuple]:
    """Rows of MEMBERS. Links are reported, not followed; nested archives are opened as `<name>.d/` down to max_depth.

    Raises UnsafeArchiveError for an unsafe path or when a limit is passed.
    """
    total = count = 0

    def walk(prefix: str, blob: bytes, depth: int) -> Iterator[tuple]:
        nonlocal total, count
        for name, at, link, body in _entries(blob):
            path = prefix + safe_name(name)
            count, total = count + 1, total + len(body)
            if count > max_files or total > max_bytes:
                raise UnsafeArchiveError(f"more than {max_files} files or {max_bytes} bytes")
            if link:
                yield archive, path, depth, at, None, "LINK"
            elif path.lower().endswith(ARCHIVES) and depth < max_depth:
                try:
                    yield from walk(f"{path}.d/", body, depth + 1)
                except (zipfile.BadZipFile, tarfile.TarError):
                    yield archive, path, depth, at, None, "NESTED_UNREADABLE"
            else:
                yield archive, path, depth, at, body, "OK"

    yield from walk("", data, 0)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of all archives under a path. An unsafe or broken archive gives one row with its reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    names = ["archive", "member", "depth", "mtime", "content", "status"]

    def opened(name: str, content: bytes) -> Iterator[tuple]:
        try:
            for _ in members(name, content):
                pass
        except UnsafeArchiveError as e:
            yield name, "", 0, None, None, f"UNSAFE: {e}"
        except (zipfile.BadZipFile, tarfile.TarError, EOFError) as e:
            yield name, "", 0, None, None, f"BROKEN: {e}"
        else:
            yield from members(name, content)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                rows, held = [], 0
                for row in opened(name, bytes(content)):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInPandas(run, MEMBERS)


def glob_pattern(glob: str) -> str:
    """A glob whose * crosses directories as an anchored regular expression."""
    return "^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z") + "$"


def excluded(path: Column) -> Column:
    out = F.lit(False)
    for glob in EXCLUDED:
        for g in {glob, glob.removeprefix("**/")}:
            out = out | path.rlike(glob_pattern(g))
    return out


def component(path: Column, rules: list = COMPONENTS) -> Column:
    """struct<component, source_rank> by the first directory rule that the path matches."""
    out = F.struct(F.lit("unknown").alias("component"), F.lit(UNKNOWN_RANK).alias("source_rank"))
    for part, name, rank in reversed(rules):
        out = F.when(path.rlike(f"(^|/){part}/"), F.struct(F.lit(name).alias("component"), F.lit(rank).alias("source_rank"))).otherwise(out)
    return out


def rotation(file_name: Column) -> Column:
    """struct<rotation_group, rotation_index>: `base.N` or `base.N.gz` belongs to base as its N-th."""
    pattern = r"^(.*?)\.(\d+)(?:\.gz)?$"
    index = F.nullif(F.regexp_extract(file_name, pattern, 2), F.lit("")).try_cast("int")
    return F.struct(
        F.when(index.isNotNull(), F.regexp_extract(file_name, pattern, 1)).otherwise(F.regexp_replace(file_name, r"\.gz$", "")).alias("rotation_group"),
        F.coalesce(index, F.lit(0)).alias("rotation_index"),
    )


def detect_encoding(data: bytes) -> tuple[str | None, float, bool]:
    """Encoding, confidence, whether the data is binary, by the share of printable characters of each strict decoding."""
    sample = bytes(data[:SAMPLE_BYTES])
    if not sample:
        return "utf-8", 1.0, False
    if sample[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16", 1.0, False
    control = sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in sample)
    if control > BINARY_SHARE * len(sample):
        return None, 0.0, True
    best, share = "latin-1", -1.0
    for name in ENCODINGS:
        for cut in range(4 if len(data) > len(sample) else 1):  # the sample may end inside a character
            try:
                text = sample[: len(sample) - cut].decode(name)
                break
            except UnicodeError:
                text = None
        if text is None:
            continue
        score = sum(c.isprintable() or c in "\t\r\n\x1b\x0c" for c in text) / max(1, len(text)) + 0.02 * name.startswith("utf")
        if score > share:
            best, share = name, score
    return best, round(min(1.0, share), 3), False


def inventory(found: DataFrame, rules: list = COMPONENTS) -> DataFrame:
    """Files of readable members, without their bytes: ids in order of archive and path, hash, encoding, component, rotation, alias.

    alias_of is the first file with the same bytes in the same archive. The order is a global one, so ids are dense.
    """
    from tidemark.operators.sequence import dense_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [detect_encoding(bytes(c)) for c in pdf["sample"]]
            pdf["encoding"], pdf["encoding_conf"], pdf["is_binary"] = (list(x) for x in zip(*got)) if got else ([], [], [])
            yield pdf.drop(columns="sample")

    rows = found.where("status = 'OK'").select(
        F.col("archive").alias("archive_path"), F.col("member").alias("rel_path"), F.col("mtime").alias("mtime_utc"),
        F.sha2("content", 256).alias("file_sha256"), F.length("content").cast("bigint").alias("size_bytes"),
        F.substring("content", 1, SAMPLE_BYTES + 1).alias("sample"),
    )
    shape = "archive_path string, rel_path string, mtime_utc timestamp, file_sha256 string, size_bytes bigint, encoding string, encoding_conf float, is_binary boolean"
    named = rows.mapInPandas(run, shape).withColumn("file_name", F.element_at(F.split("rel_path", "/"), -1)).select(
        "*",
        component(F.col("rel_path"), rules)["component"].alias("component"), component(F.col("rel_path"), rules)["source_rank"].alias("source_rank"),
        rotation(F.col("file_name"))["rotation_group"].alias("rotation_group"), rotation(F.col("file_name"))["rotation_index"].alias("rotation_index"),
        excluded(F.col("rel_path")).alias("excluded"),
    )
    ids = dense_ids(named, [F.asc("archive_path"), F.asc("rel_path")], "file_id").withColumn("file_id", F.col("file_id").cast("int"))
    same = ids.groupBy("archive_path", "file_sha256").agg(F.min("file_id").alias("first"))
    out = ids.join(same, ["archive_path", "file_sha256"])
    return out.withColumn("alias_of", F.when(F.col("first") < F.col("file_id"), F.col("first"))).drop("first").withColumn("is_rotated", F.col("rotation_index") > 0)


def parse_order(files: DataFrame) -> DataFrame:
    """Files to parse, with file_seq 1, 2 ... over all archives: by archive, component, group, falling rotation index and path.

    Binaries, aliases and excluded files are left out.
    """
    from tidemark.operators.sequence import dense_ids

    kept = files.where(~F.col("is_binary") & F.col("alias_of").isNull() & ~F.col("excluded"))
    order = [F.asc("archive_path"), F.asc("component"), F.asc("rotation_group"), F.desc("rotation_index"), F.asc("rel_path")]
    return dense_ids(kept, order, "file_seq").withColumn("file_seq", (F.col("file_seq") + 1).cast("int"))


def line_ends(data: bytes, encoding: str) -> tuple[str, bytes]:
    """The codec that cuts of the data decode by, and its line feed; UTF-16 without a byte order mark is little-endian."""
    name = encoding.lower().replace("_", "-")
    if not name.startswith("utf-16"):
        return encoding, b"\n"
    big = name == "utf-16-be" or name == "utf-16" and data[:2] == b"\xfe\xff"
    return ("utf-16-be", b"\x00\n") if big else ("utf-16-le", b"\n\x00")


def _next_line(data: bytes, start: int, feed: bytes) -> int:
    """The end of the line from start on; a line feed of two bytes begins at an even place."""
    at = data.find(feed, start)
    while at >= 0 and at % len(feed):
        at = data.find(feed, at + 1)
    return at + len(feed) if at >= 0 else len(data)


def records(data: bytes, encoding: str) -> Iterator[tuple]:
    """line_no, byte_offset, byte_len, line_span, raw_bytes, text, decode_error, truncated of each record.

    Lines end with a line feed in the file's encoding; offsets, lengths and bytes are those of the file. A continuation line
    joins the record before it, up to MAX_SPAN lines. Texts are cut at MAX_LINE_BYTES, bytes never.
    """
    encoding, feed = line_ends(data, encoding)
    marks = [feed, feed.replace(b"\n", b"\r")]
    start, number, held = 0, 0, None
    while start < len(data):
        end = _next_line(data, start, feed)
        raw = line = data[start:end]
        number += 1
        if len(feed) == 2 and number == 1 and line[:2] in (b"\xff\xfe", b"\xfe\xff"):
            line = line[2:]
        stop = len(line)
        while line[max(0, stop - len(feed)) : stop] in marks:
            stop -= len(feed)
        line = line[:stop]
        cut = line[:MAX_LINE_BYTES]
        try:
            text, bad = cut.decode(encoding), False
        except UnicodeError:
            text, bad = cut.decode(encoding, "replace"), True
        if held is not None and held[3] < MAX_SPAN and CONTINUED.match(text):
            held[2], held[3], held[4] = held[2] + len(raw), held[3] + 1, held[4] + raw
            held[5], held[6], held[7] = held[5] + "\n" + text, held[6] or bad, held[7] or len(line) > len(cut)
        else:
            if held is not None:
                yield tuple(held)
            held = [number, start, len(raw), 1, raw, text, bad, len(line) > len(cut)]
        start = end
    if held is not None:
        yield tuple(held)


def read_records(files: DataFrame, found: DataFrame) -> DataFrame:
    """Records of files, whose bytes are those of the members found; a file is read by one task, in batches of 10,000 records."""
    names = ["line_no", "byte_offset", "byte_len", "line_span", "raw_bytes", "text", "decode_error", "truncated"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, content, encoding in zip(pdf["file_id"], pdf["content"], pdf["encoding"]):
                batch = []
                for r in records(bytes(content), encoding or "utf-8"):
                    batch.append((file_id, *r))
                    if len(batch) == 10_000:
                        yield pd.DataFrame(batch, columns=["file_id", *names])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["file_id", *names])

    wanted = files.select(F.col("archive_path").alias("archive"), F.col("rel_path").alias("member"), "file_id", "encoding")
    bodies = found.where("status = 'OK'").select("archive", "member", "content").join(wanted, ["archive", "member"])
    return bodies.select("file_id", "content", "encoding").mapInPandas(run, RECORDS)
