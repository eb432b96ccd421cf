"""Physical log lines of unknown programs into entries: time stamp, level, component, message and line span.

A line is lexed once into typed tokens (time stamps, level words, numbers, words, single marks): its variables are masked.
Lines are routed by their number of tokens and the types of their leading tokens to the leaves of a tree of fixed depth;
a leaf keeps how many lines it has and, for each leading position, a sketch of how many different words stand there. In the
tree, leaves merge into templates from the left as long as what their positions hold agrees: a position that holds level
words of several levels is kept apart from one that holds other words, a rare continuation is message. What a
template's positions hold says where its fields are:

* level: the first position whose words are levels (several different ones, if there are many lines), or single digits
  in delimiters;
* component: of the words that marks delimit, or that stand between the stamp and a later level or mark, the one
  with most different words, digits aside (hosts and threads have few); words in parentheses, keys and source positions
  aren't components. Of three four-letter ids in a row, as in DLT heads, it is the second;
* message: all after the last of these and its closing mark.

No layout is written down, so a program's layout needs some lines (FEW) to be told; below that the nearest delimited
word and level count. Leaves hold one row for many lines; only they pass through Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: fixed values: level words, and what they mean
LEVELS = {
    "TRACE": ["trace", "v", "t", "verbose"],
    "DEBUG": ["debug", "d", "调试"],
    "INFO": ["info", "i", "信息"],
    "NOTICE": ["notice", "n", "提示"],
    "WARN": ["warn", "w", "warning", "警告"],
    "ERROR": ["error", "e", "err", "错误"],
    "FATAL": ["fatal", "f", "s", "crit", "critical", "panic", "严重"],
}
#: fixed values: by numeric severity
SEVERITIES = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG"]
_WORDS = sorted((w for ws in LEVELS.values() for w in ws), key=len, reverse=True)

DAY = r"\d{4}[-/]\d{2}[-/]\d{2}"
CLOCK = r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?"
TYPES = [
    ("T", rf"{DAY}[T ]{CLOCK}(?:Z|[+-]\d{{2}}:?\d{{2}})?|\d{{8}} \d{{6}}(?:\.\d+)?|\d{{2}}-\d{{2}} {CLOCK}"
          rf"|[A-Z][a-z]{{2}} [ \d]\d {CLOCK}|\d{{1,2}} [A-Z][a-z]{{2}} \d{{4}} {CLOCK}"),
    ("G", r"[A-Z]\d{4} \d{2}:\d{2}:\d{2}\.\d+"),
    ("U", r"\+?\d+\.\d+s(?![\p{L}\p{N}])"),
    ("K", r"\[\s*\d+\.\d+\]"),
    ("P", r"<\d{1,3}>"),
    ("L", rf"(?i:{'|'.join(_WORDS)})(?![\p{{L}}\p{{N}}_./\-])"),
    ("S", r"[0-7](?![\p{L}\p{N}_])"),
    ("N", r"\d+(?![\p{L}\p{N}_])"),
    ("D", r"[A-Z][A-Z0-9_]{3}(?![\p{L}\p{N}_./\-])"),
    ("W", r"[\p{L}\p{N}_](?:[\p{L}\p{N}_./\-]*[\p{L}\p{N}_])?"),
    ("", r"\S"),
]
LEXER = "|".join(f"(?:{pattern})" for _, pattern in TYPES)
STAMPS = "TUKG"
#: what may stand before a head's own stamp: brackets, a level, a priority, a key
OWN_STAMP = r"^(?:[WLD][=:]|(?:[\[\](【】]|L|P[NS]?)*)[TUKG]"
#: depth of the tree: leading tokens that can hold fields
DEPTH = 12
#: lines below which statistics of a position say nothing
FEW = 12
#: share of lines for what holds in all of them, dirt aside; least share of a continuation that is part of a layout; of levels at a position
NEARLY_ALL, CONTINUES, LEVELS_SHARE = 0.9, 0.1, 0.05
#: different words (of 64 sketch bits) at a position beyond which undelimited words are message
NAMES = 40
#: a mark that ends a field
CLOSERS = "]】):|;-"
JSON_TIME = ["@timestamp", "timestamp", "time", "ts"]
JSON_LEVEL = ["level", "lvl", "severity"]
JSON_COMPONENT = ["logger", "module", "tag", "component", "app"]
JSON_MESSAGE = ["message", "msg", "event"]
BLOCK_LINES = 5_000


def level_of(word: Column) -> Column:
    """TRACE to FATAL for a level word in any case or a severity 0-7; UNKNOWN for others and null."""
    low = F.lower(word)
    out = F.lit("UNKNOWN")
    for name, words in LEVELS.items():
        out = F.when(low.isin(words), name).otherwise(out)
    return F.when(low.rlike("^[0-7]$"), severity(low)).otherwise(out)


def severity(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), number.try_cast("int") % 8 + 1)


def lexed(line: Column) -> Column:
    """All tokens of a line as an array of texts; blanks between tokens are left out."""
    return F.regexp_extract_all(line, F.lit(LEXER), F.lit(0))


def kinds(tokens: Column) -> Column:
    """One letter (or the mark itself) per token."""

    def kind(token: Column) -> Column:
        out = None
        for letter, pattern in TYPES[:-1]:
            hit = F.when if out is None else out.when
            out = hit(token.rlike(f"^(?:{pattern})$"), letter)
        return out.otherwise(token)

    return F.array_join(F.transform(tokens, kind), "")


@dataclass(frozen=True)
class Leaf:
    """Lines with the same number of tokens and the same leading types; seen has the sketch of each leading position."""

    tokens: int
    lead: str
    lines: int
    seen: tuple[int, ...]


@dataclass(frozen=True)
class Fields:
    """Positions of fields in the leading tokens, as far as they are known."""

    level: int | None = None
    #: (position, different words): components for certain, and words that are if a level or closing mark follows
    names: tuple[tuple[int, int], ...] = ()
    pending: tuple[tuple[int, int], ...] = ()
    end: int = 0
    in_parens: bool = False
    in_key: bool = False

    def confirmed(self, end: int, **changes) -> Fields:
        return replace(self, names=self.names + self.pending, pending=(), end=end, **changes)


def _lines(leaves: list[Leaf]) -> int:
    return sum(x.lines for x in leaves)


def _words(leaves: list[Leaf], i: int) -> int:
    return reduce(or_, (x.seen[i] for x in leaves), 0).bit_count()


def _type(leaf: Leaf, i: int) -> str:
    """A leaf's type at a position, '' beyond its end; words are W, numbers N."""
    t = leaf.lead[i : i + 1]
    return "W" if t and t in "WLD" else "N" if t and t in "NS" else t


def _split(leaves: list[Leaf], i: int) -> dict[str, list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        out.setdefault(_type(leaf, i), []).append(leaf)
    return out


def _learn(leaves: list[Leaf], i: int, at: Fields) -> Iterator[tuple[list[Leaf], Fields]]:
    """Templates of leaves that agree in the types before position i: their leaves and fields."""
    total = _lines(leaves)
    for kind, part in _split(leaves, i).items():
        n = _lines(part)
        known = n >= FEW
        if kind == "" or i >= DEPTH or (total >= FEW and not known):
            yield part, at
        elif kind == "W":
            yield from _word(part, i, at)
        elif kind == "N":
            severities = _lines([x for x in part if x.lead[i] == "S"]) >= NEARLY_ALL * n
            if at.level is None and severities and known and part[0].lead[i - 1] in "|;=[,":
                at_level = at.confirmed(i + 1, level=i, in_key=False)
                yield from _learn(part, i + 1, at_level)
            else:
                yield from _learn(part, i + 1, replace(at, in_key=False))
        elif kind == "=":
            if at.in_key:
                yield from _learn(part, i + 1, at)
            else:
                yield part, at
        elif kind in "([":
            # a word before a bracket: name[number]
            usual = n >= CONTINUES * total if total >= FEW else n >= NEARLY_ALL * total
            closed = at.confirmed(i) if kind == "[" and at.pending and usual else at
            yield from _learn(part, i + 1, replace(closed, in_parens=kind == "("))
        elif kind in CLOSERS:
            usual = n >= CONTINUES * total if total >= FEW else n >= NEARLY_ALL * total
            if usual:
                yield from _learn(part, i + 1, at.confirmed(i + 1, in_parens=False))
            else:
                yield part, at
        elif kind in STAMPS and any(t in STAMPS for t in part[0].lead[:i]):
            yield part, at  # a second stamp is message
        elif kind in STAMPS or kind == "P" and n >= CONTINUES * total:
            yield from _learn(part, i + 1, replace(at, end=i + 1))
        else:
            yield from _learn(part, i + 1, at)


def _word(part: list[Leaf], i: int, at: Fields) -> Iterator[tuple[list[Leaf], Fields]]:
    """The templates of leaves with a word at position i: whether it is a level, a component, a key or message."""
    n = _lines(part)
    before = part[0].lead[i - 1] if i else ""
    levels = [x for x in part if x.lead[i] == "L"]
    if at.level is None and levels:
        share = _lines(levels) / n
        after_name = before == ":" and bool(at.names)
        several = _words(levels, i) >= 3
        if n >= FEW:
            apart = share >= NEARLY_ALL and (several or not after_name) or (
                several and _lines(levels) >= FEW and share >= (0.5 if at.pending else LEVELS_SHARE) and not after_name
            )
        else:
            apart = share >= 0.5 and not after_name
        if apart:
            same = part if share >= NEARLY_ALL else levels
            yield from _learn(same, i + 1, at.confirmed(i + 1, level=i, in_key=False))
            part = [] if same is part else [x for x in part if x.lead[i] != "L"]
            if not part:
                return
            n = _lines(part)
    words = _words(part, i)
    after = {kind: _lines(leaves) for kind, leaves in _split(part, i + 1).items()}
    mark, share = max(after.items(), key=lambda x: x[1])
    nearly_all = share >= NEARLY_ALL * n
    source = mark == ":" and nearly_all and _lines(_split(part, i + 2).get("N", [])) >= NEARLY_ALL * n
    if before == "=" and at.in_key:
        yield from _learn(part, i + 1, replace(at, names=(*at.names, (i, words)), end=i + 1, in_key=False))
    elif mark == "=" and nearly_all and (words == 1 if n >= FEW else part[0].lead[1:2] == "="):
        yield from _learn(part, i + 1, replace(at, in_key=True))
    elif at.in_parens or source:
        yield from _learn(part, i + 1, at)
    elif nearly_all and mark and mark in CLOSERS:
        yield from _learn(part, i + 1, replace(at, names=(*at.names, (i, words))))
    elif (words <= NAMES or n < FEW) and i + 1 < DEPTH:
        yield from _learn(part, i + 1, replace(at, pending=(*at.pending, (i, words))))
    else:
        yield part, at


def _component(lead: str, names: tuple[tuple[int, int], ...]) -> int | None:
    ids = [i for i, _ in names if lead[i] == "D"]
    for i in ids:
        if i - 1 in ids and i + 1 in ids:
            return i
    return max(names, key=lambda x: (x[1], x[0]))[0] if names else None


def _templates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Leaves of one stem (the types up to the stamp) to templates and the positions (from 1) of their fields."""
    seen = [f"w{i}" for i in range(DEPTH)]
    leaves = [
        Leaf(int(t), lead, int(n), tuple(int(x) & (2**64 - 1) for x in bits))
        for t, lead, n, bits in zip(pdf["tokens"], pdf["lead"], pdf["n"], pdf[seen].itertuples(index=False))
    ]
    leaves.sort(key=lambda x: (x.lead, x.tokens))
    rows = []
    for part, at in _learn(leaves, 0, Fields()):
        for leaf in part:
            lead = leaf.lead
            stamp = next(k for k, t in enumerate(lead) if t in STAMPS)
            end = max(at.end, stamp + 1)
            component = _component(lead, at.names)
            # a key before the stamp is a head's only if a level follows
            head = lead[0] not in "WD" or at.level is not None
            priority = lead[:end].find("P") + 1 or None
            letter = lead[:end].find("G") + 1 or None
            level = None if at.level is None else at.level + 1
            rows.append((leaf.tokens, lead, f"{lead[:end]}*", head, level, None if component is None else component + 1, priority, letter, stamp + 1, end))
    out = pd.DataFrame(rows, columns=["tokens", "lead", "template", "head", "l", "c", "p", "g", "t", "end"])
    return out.astype({c: "Int64" for c in ("l", "c", "p", "g", "t", "end")})


def mine_templates(lexed_lines: DataFrame) -> DataFrame:
    """tokens, lead, template, head and the positions of fields, of lines with `_tokens` (number), `_lead` (types) and `_first` (leading tokens).

    Only lines with a stamp of their own take part. The sketch of a position has one bit of 64 for each word, digits and case aside.
    """

    def sketch(i: int) -> Column:
        word = F.regexp_replace(F.lower(F.try_element_at("_first", F.lit(i + 1))), r"\p{N}+", "0")
        return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int")))

    leaves = (
        lexed_lines.where(F.col("_own"))
        .groupBy(F.col("_tokens").alias("tokens"), F.col("_lead").alias("lead"))
        .agg(F.count(F.lit(1)).alias("n"), *[sketch(i).alias(f"w{i}") for i in range(DEPTH)])
    )
    stem = F.regexp_extract("lead", rf"^[^{STAMPS}]*[{STAMPS}]", 0)
    return leaves.groupBy(stem).applyInPandas(
        lambda pdf: _templates(pdf), "tokens int, lead string, template string, head boolean, l int, c int, p int, g int, t int, end int"
    )


def lex_lines(lines: DataFrame, text: str, message: bool = True) -> DataFrame:
    """lines with `text` replaced by its number of tokens, leading tokens and their types, and the fields of JSON objects; written once."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\x{FEFF}|\r$", "")
    json = F.from_json(F.when(F.col("_line").rlike(r"^\{.*\}\s*$"), F.col("_line")), "map<string,string>")

    def key(names: list[str]) -> Column:
        return F.coalesce(*[F.try_element_at("_json", F.lit(n)) for n in names])

    out = (
        lines.withColumn("_line", clean)
        .withColumn("_all", lexed(F.col("_line")))
        .withColumn("_tokens", F.size("_all"))
        .withColumn("_first", F.slice("_all", 1, DEPTH))
        .withColumn("_lead", kinds(F.col("_first")))
        .withColumn("_own", F.col("_lead").rlike(OWN_STAMP))
        .withColumns({c: F.when(F.col("_own"), F.col(c)) for c in ("_first", "_lead", "_tokens")})
        .withColumn("_json", json)
        .withColumns({"_j_ts": key(JSON_TIME), "_j_level": key(JSON_LEVEL), "_j_name": key(JSON_COMPONENT), "_j_message": key(JSON_MESSAGE)})
        .drop("_all", "_json", text)
    )
    return materialize(out if message else out.drop("_line", "_j_message"))


def parse_lines(lines: DataFrame, text: str, message: bool = True) -> DataFrame:
    """Adds is_head, ts_raw, level_norm, logger, message and template to lines (without their text); the last five are null for other lines.

    A line that is a JSON object with a time key is a head whose keys are its positions. Null and empty lines are no
    heads. A byte order mark before a line and a carriage return after it are no part of it. Without `message` the
    messages are null and the lines themselves aren't kept.
    """
    rows = lex_lines(lines, text, message)
    out = rows.join(mine_templates(rows), (F.col("_lead") == F.col("lead")) & (F.col("_tokens") == F.col("tokens")), "left")

    def token(position: str) -> Column:
        return F.try_element_at("_first", F.col(position))

    is_json = F.col("_j_ts").isNotNull()
    level = (
        F.when(is_json, level_of(F.col("_j_level")))
        .when(F.col("l").isNotNull(), level_of(token("l")))
        .when(F.col("p").isNotNull(), severity(F.regexp_extract(token("p"), r"\d+", 0)))
        .when(F.col("g").isNotNull(), level_of(F.substring(token("g"), 1, 1)))
    )
    rest = F.expr("ltrim(substring(_line, aggregate(slice(_first, 1, end), 1, (p, t) -> locate(t, _line, p) + length(t))))")
    text_of = F.when(is_json, F.col("_j_message")).otherwise(rest) if message else F.lit(None).cast("string")
    return (
        out.withColumn("_head", is_json | F.coalesce(F.col("head"), F.lit(False)))
        .withColumns({
            "ts_raw": F.when(F.col("_head"), F.when(is_json, F.col("_j_ts")).otherwise(token("t"))),
            "level_norm": F.when(F.col("_head"), F.coalesce(level, F.lit("UNKNOWN"))),
            "logger": F.when(F.col("_head"), F.coalesce(F.when(is_json, F.col("_j_name")).otherwise(token("c")), F.lit(""))),
            "message": F.when(F.col("_head"), text_of),
        })
        .withColumnRenamed("_head", "is_head")
        .drop("_tokens", "_first", "_lead", "_own", "_line", "_j_ts", "_j_level", "_j_name", "_j_message")
        .drop("tokens", "lead", "head", "l", "c", "p", "g", "t", "end")
    )


def entries(lines: DataFrame, file: str, line_no: str, text: str, block: int = BLOCK_LINES, message: bool = True) -> DataFrame:
    """file, line_no, line_span, ts_raw, level_norm, logger, message (null without `message`): one row per entry.

    An entry is a head and all lines after it up to the file's next head; lines before the first head belong to none.
    Rows with a null file or line number are left out, and a line given twice counts once. Files are cut into blocks of
    lines: only the lines before a block's first head and its last head take part in the pass over a whole file.
    """
    rows = lines.select(F.col(file).alias("f"), F.col(line_no).alias("no"), F.col(text).alias("text"), F.xxhash64(text).alias("copy"))
    parsed = parse_lines(rows.dropna(subset=["f", "no"]), "text", message).withColumn("block", F.floor(F.col("no") / F.lit(block)))
    order = Window.partitionBy("f", "block").orderBy("no", "copy")
    fields = ["ts_raw", "level_norm", "logger", "message"]
    counted = (
        parsed.withColumn("once", F.coalesce(F.lag("no").over(order) != F.col("no"), F.lit(True)))
        .withColumn("entry", F.sum((F.col("is_head") & F.col("once")).cast("int")).over(order))
        .groupBy("f", "block", "entry")
        .agg(
            F.sum(F.col("once").cast("int")).alias("span"),
            F.min("no").alias("no"),
            *[F.min_by(c, F.struct("no", "copy")).alias(c) for c in fields],
        )
        .withColumn("entries", F.max("entry").over(Window.partitionBy("f", "block")))
    )
    inner = counted.where((F.col("entry") > 0) & (F.col("entry") < F.col("entries")))
    along = Window.partitionBy("f").orderBy("block", "entry")
    edges = (
        counted.where((F.col("entry") == 0) | (F.col("entry") == F.col("entries")))
        .withColumn("chain", F.sum((F.col("entry") > 0).cast("int")).over(along))
        .where(F.col("chain") > 0)
        .groupBy("f", "chain")
        .agg(F.sum("span").alias("span"), F.min("no").alias("no"), *[F.min_by(c, F.struct("no")).alias(c) for c in fields])
    )
    cols = ["f", "no", "span", *fields]
    return inner.select(*cols).union(edges.select(*cols)).select(
        F.col("f").alias(file), F.col("no").alias(line_no), F.col("span").cast("int").alias("line_span"), *fields
    )
