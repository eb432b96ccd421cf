"""Queries that SQL can't express, against plain Python over whole tables."""

import hashlib
import json
import re

import pytest
import xxhash

from tidemark.functions import parsers, text
from tidemark.plans import reference
from tidemark.session import table

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    rows = table(spark, MIDDLE, "log_lines").dropDuplicates(["line_id"]).select("line_id", "raw_line", "message", "file_path", "line_no").collect()
    return {r.line_id: r for r in rows}


def canonical(raw):
    for pattern, by in text.CANONICAL:
        raw = re.sub(pattern, by, raw, flags=re.M)
    return raw


def test_canonical_lines(spark, lines):
    got = {r.line_id: (r.canonical, r.norm_hash) for r in reference.canonical_lines(spark, MIDDLE).collect()}
    want = {i: canonical(r.raw_line) for i, r in lines.items()}
    assert {i: c for i, (c, _) in got.items()} == want
    assert all(int(h) == xxhash.xxh3_64_intdigest(c.encode()) for c, h in got.values())


def test_line_hashes(spark, lines):
    got = {r.line_id: (r.raw_hash, r.row_hash) for r in reference.line_hashes(spark, MIDDLE).collect()}
    for i, r in lines.items():
        raw = hashlib.blake2b(r.raw_line.encode().replace(b"\r\n", b"\n"), digest_size=16).hexdigest()
        parts = [r.raw_line, r.file_path, None if r.line_no is None else str(r.line_no)]
        assert got[i] == (raw, xxhash.xxh3_64_hexdigest("\x1f".join(p for p in parts if p is not None).encode()))


def test_search_tokens(spark, lines):
    def tokens(message):
        words = [w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]+|[0-9]+|0x[0-9a-fA-F]+", message)]
        han = re.findall("[一-鿿]", message)
        return " ".join(dict.fromkeys([*words, *(a + b for a, b in zip(han, han[1:])), *han]))

    got = {r.line_id: r.tokens for r in reference.search_tokens(spark, MIDDLE).collect()}
    assert got == {i: tokens(r.message if r.message is not None else r.raw_line) for i, r in lines.items()}


def read_json(line):
    """A line's object by its keys, or null; values other than texts as JSON writes them."""
    if not re.match(r"^\s*\{.*\}\s*$", line):
        return None
    try:
        found = json.loads(line)
    except ValueError:
        return None
    return {k: v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":")) for k, v in found.items()}


def parsed(raw):
    line = raw.split("\n")[0].rstrip("\r")
    out = dict.fromkeys(["ts", "level", "logger", "process", "pid", "tid", "src_loc", "mono"])
    for i, (name, _, pattern, names) in enumerate(parsers.FORMATS):
        if i == 7 and (found := read_json(line)) is not None:
            for field, keys in parsers.JSON_KEYS.items():
                out[field] = next((found[k] for k in keys if found.get(k) is not None), None)
            return "json_line", out | {"message": out["message"] or ""}
        if m := re.match(pattern, line):
            got = {k: v or None for k, v in zip(names, m.groups())}
            renamed = {"level_cn": "level", "klevel": "level", "app": "logger", "host": None}
            for k, v in got.items():
                if (to := renamed.get(k, k)) is not None:
                    out[to] = v
            if "host" in got and not out["process"]:
                out["process"] = got["host"]
            return name, out | {"message": got["message"] or ""}
    return "fallback_raw", out | {"message": line}


def test_parsed_fields(spark, lines):
    number = lambda v, kind: None if v is None else kind(v)
    rows = {r.line_id: r for r in reference.parsed_fields(spark, MIDDLE).collect()}
    seen = set()
    for i, r in lines.items():
        name, want = parsed(r.raw_line)
        got = rows[i]
        seen.add(name)
        assert got.parser == name and got.message == want["message"] and got.status == ("UNPARSED" if name == "fallback_raw" else "OK")
        assert (got.ts, got.level_raw, got.logger, got.process, got.src_loc) == tuple(want[k] for k in ("ts", "level", "logger", "process", "src_loc"))
        assert (got.mono, got.pid, got.tid) == (number(want["mono"], float), number(want["pid"], int), number(want["tid"], int))
    assert len(seen) >= 11


def test_redact_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, MIDDLE, "documents").collect()}
    hits = 0
    for r in reference.redact_documents(spark, MIDDLE).collect():
        t = docs[r.doc_id]
        if t is None:
            assert r.text is None
            continue
        found = re.findall(text.VIN, t, re.A)
        assert r.vin_hits == len(found)
        hits += len(found)
        t = re.sub(text.VIN, lambda m: text.vin_mask(m[0]), t, flags=re.A)
        counted = re.sub(text.VIN, "VIN_", docs[r.doc_id], flags=re.A)
        for name, pattern, by in text.PERSONAL:
            assert r[f"{name}_hits"] == len(re.findall(pattern, counted)), name
            counted, t = re.sub(pattern, by, counted), re.sub(pattern, by, t)
        assert r.text == t
