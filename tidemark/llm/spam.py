"""Keyword-stuffed pages, link lists and tag or product lists.

Each text, in lower case, is compressed block by block; the ratio is divided by what texts of its language, script and
length usually reach in this corpus. Texts that are more redundant than that are flagged. They are confirmed where
sentence ends are rare, and an exact check follows that tells lists (links, tags, products, keywords) from logs and
tables, which have few sentence ends as well. Pages that stuff keywords into short sentences have as many ends as
prose: they are confirmed by clauses that name the same word again and again, if they are extremely redundant.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: bytes in a block, and the compression level
BLOCK, LEVEL = 4096, 9
#: a text is flagged if its ratio is at most this multiple of the usual one; it is stuffed whatever its punctuation below the second
REDUNDANT, EXTREME = 0.95, 0.7
#: texts of a language, kind of script and length that a usual ratio takes
ENOUGH = 10
#: the least usual ratio: below it a text is redundant whatever its neighbours are
LEAST_USUAL = 0.45
#: a text with at least this share of either kind of script is left out of the usual ratios
MIXED = 0.2
#: sentence ends are rare if there are fewer than this in so many characters
SENTENCE_ENDS, SENTENCE_CHARS = 0.7, 100
#: confirmed if lists, or clauses that repeat a word, make up more than this share of the characters that are no white space
LIST_SHARE = 0.5
FRAME = len(zstandard.ZstdCompressor(level=3).compress(b""))

URL = regex.compile(r"(?:https?://|www\.)[^\s<>\"'，。；）)】]+", regex.I)
END = regex.compile(r"[.!?…](?=[\s\"'”»)\]|]|$)|[。！？]")
TAG = regex.compile(r"#[\p{L}\p{N}_]+")
LOG = regex.compile(
    r"^\W{0,3}(?:\d{2,4}[-/]\d{2}[-/ ]?\d{0,2}[T ]?\d{0,2}:?|\[ *\d+\.\d+\]|\+\d+\.\d+s|<\d+>|[A-Z]\d{4} \d\d:|[A-Z][a-z]{2} [ \d]\d \d\d:|\d{8} \d{6}"
    r"|\w+ +\d\d [A-Z][a-z]{2} \d{4} \d\d:|\[\w+\] \[\d{4}|\{\"|ts=\d|#\d+ 0x|at [\w.$]+\(|Caused by:|[0-9a-f]{4}: (?:[0-9a-f]{2} )+)"
)
PAIR = regex.compile(r"\w=\S")
WORD = regex.compile(r"[\p{L}\p{N}_'’-]+")
SEPARATOR = regex.compile(r"[,|;/、，；·•#\t]|\s[-–>»]\s")
CJK = regex.compile(r"[\p{Han}]")
# re, as it is much faster than regex on these two
CLAUSE = re.compile(r"[.!?…。！？，,;；]+")
#: words whose repetition counts: no articles and the like
NAME = re.compile(r"[\w'’-]{4,}|[\u3400-\u4dbf\u4e00-\u9fff]{2,}")
BLANKS = " \t\ufeff\u3000\xa0"


def ratio(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    """Compressed bytes per byte over blocks, without the frames' fixed size."""
    size = sum(len(compressor.compress(data[a : a + BLOCK])) - FRAME for a in range(0, len(data), BLOCK))
    return size / len(data)


def _listed(piece: str, ended: bool) -> bool:
    """Whether a piece of a line, without links, is keywords rather than (part of) a sentence."""
    words = WORD.findall(piece)
    han = len(CJK.findall(piece))
    marks = len(SEPARATOR.findall(piece))
    if not words:
        return False
    if TAG.search(piece) and len(TAG.findall(piece)) * 3 >= len(words):
        return True
    units = len(words) + han / 3
    if ended and max(len(WORD.findall(x)) + len(CJK.findall(x)) / 2 for x in SEPARATOR.split(piece)) >= 6:
        return False
    if marks >= 2 and units / (marks + 1) <= 5:
        return True
    if ended:
        return False
    return len(words) >= 12 and len({w.lower() for w in words}) < 0.6 * len(words)


def list_share(text: str) -> float:
    """Share of links, tags and keywords in the characters of a text that are no white space."""
    listed = total = 0
    pieces: list[tuple[str, int]] = []
    for line in text.splitlines():
        line = line.strip(" \t﻿　\xa0")
        if not line:
            continue
        size = len(line) - sum(map(str.isspace, line))
        total += size
        links = URL.findall(line)
        bare = URL.sub(" ", line) if links else line
        if not links and (LOG.match(line) or len(PAIR.findall(line)) >= 2):
            continue
        cuts = [m.end() for m in END.finditer(bare)]
        if links and not (cuts and len(WORD.findall(bare)) + len(CJK.findall(bare)) >= 5 * len(links)):
            listed += size
            continue
        start = 0
        for cut in [*cuts, len(bare)]:
            piece = bare[start:cut].strip()
            if piece:
                n = len(piece) - sum(map(str.isspace, piece))
                if _listed(piece, cut in cuts):
                    listed += n
                elif cut not in cuts or len(WORD.findall(piece)) < 4 and not CJK.search(piece):
                    pieces.append((piece.lower(), n))
            start = cut
    # short lines without an end that recur, or many of them, are keywords, one a line
    seen = Counter(p for p, _ in pieces)
    short = [(p, n) for p, n in pieces if len(WORD.findall(p)) + len(CJK.findall(p)) / 3 <= 6]
    words = [w for p, _ in short for w in WORD.findall(p)]
    if len(short) >= 5 and len(set(words)) < 0.7 * len(words):
        listed += sum(n for _, n in short)
    else:
        listed += sum(n for p, n in pieces if seen[p] >= 3)
    return listed / total if total else 0.0


def stuffed_share(text: str) -> float:
    """Share of clauses that name a word more than once in the characters of a text that are no white space."""
    stuffed = 0
    for line in text.splitlines():
        line = line.strip(BLANKS)
        low = line.lower()
        links = ("://" in low or "www." in low) and URL.search(low)
        if links:
            low = URL.sub(" ", low)
        names = NAME.findall(low)
        if len(set(names)) == len(names) or not links and (LOG.match(line) or len(PAIR.findall(line)) >= 2):
            continue
        for clause in CLAUSE.split(low):
            names = NAME.findall(clause)
            if len(set(names)) < len(names):
                stuffed += len("".join(clause.split()))
    return stuffed / max(1, len("".join(text.split())))


def sentence_ends(text: str) -> float:
    """Sentence ends outside links per SENTENCE_CHARS characters; a Han character counts as three."""
    bare = URL.sub("", text)
    n = len(text) + 2 * len(CJK.findall(text))
    return len(END.findall(bare)) * SENTENCE_CHARS / max(1, n)


def folded(text: str) -> tuple[bytes, float, float]:
    """A text's bytes in lower case, its length in half powers of two, and the share of bytes in scripts of three bytes a character."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    return data, 2 * math.log2(len(data)), min(1.0, 1.5 * (len(data) - len(low)) / len(data))


class Usual:
    """The usual ratio of a text of a language, script and length: median ratios by (language, kind, length), interpolated.

    A language has medians of its own in the kind of script that most of its texts are written in, other texts have those
    of all languages. Where a text mixes scripts, so does its usual ratio.
    """

    def __init__(self, medians: list[tuple[str | None, int, int, float, int]]):
        curves: dict[tuple[str | None, int], list[tuple[int, float]]] = {}
        texts: Counter[tuple[str | None, int]] = Counter()
        for language, kind, size, median, n in medians:
            texts[language, kind] += n
            if n >= ENOUGH:
                curves.setdefault((language, kind), []).append((size, median))
        self.curves = {
            key: tuple(zip(*sorted(points)))
            for key, points in curves.items()
            if key[0] is None or texts[key] > sum(n for (language, _), n in texts.items() if language == key[0]) / 2
        }

    def of_kind(self, language: str, kind: int, size: float) -> float:
        curve = self.curves.get((language, kind)) or self.curves.get((None, kind))
        return max(LEAST_USUAL, float(np.interp(size, *curve))) if curve else LEAST_USUAL

    def __call__(self, language: str, size: float, wide: float) -> float:
        return (1 - wide) * self.of_kind(language, 0, size) + wide * self.of_kind(language, 1, size)


def _rows(df: DataFrame, row_id: str, text: str, lang: str | None) -> DataFrame:
    language = F.lit("") if lang is None else F.coalesce(F.regexp_extract(F.lower(lang), "^[a-z]{2}", 0), F.lit(""))
    return df.select(row_id, F.col(text).alias("_text"), language.alias("_language")).where(F.col("_text").isNotNull())


def usual_ratios(df: DataFrame, text: str, lang: str | None = None) -> Usual:
    """Medians over the whole corpus. To the driver come at most 128 rows a language (of two letters or none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for value, language in zip(*[c.to_pylist() for c in batch.columns]):
                if value and not value.isspace():
                    data, size, wide = folded(value)
                    if wide < MIXED or wide > 1 - MIXED:
                        rows.append((language, round(wide), round(size), ratio(data, compressor)))
            cols = list(zip(*rows)) if rows else [()] * 4
            types = [pa.string(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["language", "kind", "size", "ratio"])

    rows = _rows(df, text, text, lang).select("_text", "_language").mapInArrow(run, "language string, kind int, size int, ratio double")
    of_all, own = ["kind", "size"], ["language", "kind", "size"]
    medians = rows.groupingSets([of_all, own], *own).agg(
        F.grouping("language").alias("every"), F.percentile_approx("ratio", 0.5, 1000).alias("median"), F.count(F.lit(1)).alias("n")
    )
    return Usual([(None if r.every else r.language, r.kind, r["size"], r.median, r.n) for r in medians.collect()])


def spam_pages(df: DataFrame, row_id: str, text: str, lang: str | None = None) -> DataFrame:
    """row_id, redundancy (ratio by the usual one), ends, share (of lists or of stuffed clauses) of each page found.

    Null, empty and blank texts are no pages; a page given twice comes out twice. Two passes over the texts, none of
    which shuffles them: one for the usual ratios, one that flags by them and confirms.
    """
    shared = df.sparkSession.sparkContext.broadcast(usual_ratios(df, text, lang))
    schema = T.StructType([df.schema[row_id], *[T.StructField(n, T.DoubleType()) for n in ("redundancy", "ends", "share")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, usual = zstandard.ZstdCompressor(level=LEVEL), shared.value
        for batch in batches:
            rows = []
            for key, value, language in zip(*[c.to_pylist() for c in batch.columns]):
                if not value or value.isspace():
                    continue
                data, size, wide = folded(value)
                redundancy = ratio(data, compressor) / usual(language, size, wide)
                if redundancy > REDUNDANT:
                    continue
                ends = sentence_ends(value)
                share = list_share(value) if ends < SENTENCE_ENDS else 0.0
                if share <= LIST_SHARE and redundancy <= EXTREME:
                    share = stuffed_share(value)
                if share > LIST_SHARE:
                    rows.append((key, redundancy, ends, share))
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            types = [batch.schema.field(0).type, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=schema.names)

    return _rows(df, row_id, text, lang).mapInArrow(run, schema)
