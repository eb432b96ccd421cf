"""Text decoded with a wrong encoding: found and, where possible, restored by minimum description length.

A candidate reading undoes a chain of wrong decodings: the text is encoded with the wrong codec and decoded with the
right one, strictly both times, once or more; between two steps a text is stored in UTF-8. Kept raw bytes give further
readings. Every reading is compressed with the zstandard dictionary of every language, and a chain costs some bytes a step.
The shortest description is chosen; unless that is shorter than the text's own, the text is left as it is. Readings are
tried for the whole text, for the pieces between separators and for single words, as only a part may be affected. The
ASCII words before and after the first and last other character are the same in every reading and aren't compressed.

Bytes that no text holds (replacement characters, C1 controls, private use characters, interleaved zeros) show a wrong
decoding even where nothing is left to restore it from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: codecs that texts were written with, and those they were read with by mistake
WRITTEN = ["utf-8", "gb18030", "cp1251", "koi8-r", "cp1252", "mac_roman"]
READ = ["latin-1", "cp1252", "cp1251", "koi8-r", "mac_roman", "gb18030"]
STEPS = 3
#: bytes that a step of a chain costs by the codec that it ends in: a text rarely passes UTF-8 by chance and often the others, of
#: which cp1252 is the most common
STEP_COST = dict.fromkeys(WRITTEN, 12.0) | {"utf-8": 0.5, "cp1252": 10.5}
#: texts in the sample of each language, size of a dictionary in bytes, compression level
SAMPLE, DICT_BYTES, LEVEL = 2000, 32_768, 9
#: readings and sizes that a task remembers
REMEMBERED = 50_000
#: by the characters that tell the languages of the table apart; the first that is found holds
LANGUAGES = [
    ("han", r"[\u4e00-\u9fff]"),
    ("cyrillic", r"[\u0400-\u04ff]"),
    ("umlaut", r"[\u00e4\u00f6\u00fc\u00df\u00c4\u00d6\u00dc]"),
    ("tilde", r"[\u00e3\u00f5\u00c3\u00d5]"),
    ("accent", r"[\u00e0-\u00ff\u0152\u0153\u00c0-\u00df]"),
    ("other", r"[^\u0000-\u007f]"),
]
SURE = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff\U000f0000-\U0010ffff]|\x00[^\x00]\x00|(?:[^\x00]\x00){3}")
NOT_ASCII = re.compile(r"[^\x00-\x7f]")
BLANK = re.compile(r"\s")
PIECES = re.compile(r"( <- | -> | / | \| )")
HOLE = re.compile("[\x81\x8d\x8f\x90\x9d]")


def encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeError:
        if codec != "cp1252" or not HOLE.search(text):
            return None
    try:  # what a lenient reader does with the five bytes the code page leaves out
        return b"".join(c.encode("latin-1" if HOLE.match(c) else "cp1252") for c in text)
    except UnicodeError:
        return None


def decode(data: bytes, codec: str) -> str | None:
    try:
        return data.decode(codec)
    except UnicodeError:
        return None


def chain_cost(chain: str) -> float:
    return sum(STEP_COST[step.partition(">")[2]] for step in chain.split() if step != "+")


def readings(text: str, steps: int = STEPS) -> dict[str, str]:
    """Texts that decode by chains of at most `steps` steps from this one, with their chains, cheapest first; the text itself is one."""
    found = {text: ""}
    edge = [text]
    for _ in range(steps):
        new = []
        for t in edge:
            tried = set()
            for wrong in READ:
                data = encode(t, wrong)
                if data is None or data in tried or data.isascii():
                    continue
                tried.add(data)
                for right in WRITTEN:
                    out = decode(data, right) if right != wrong else None
                    if out is not None and out not in found:
                        found[out] = f"{found[t]} {wrong}>{right}".strip()
                        if right == "utf-8":
                            new.append(out)
        edge = new
        if not edge:
            break
    return found


class Describer:
    """Description length by the best of all languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.compressors = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        if not self.compressors:
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        self.sizes: dict[str, int] = {}
        self.bests: dict[str, tuple[str, str]] = {}

    def size(self, text: str) -> int:
        if (known := self.sizes.get(text)) is not None:
            return known
        data = text.encode("utf-8", "surrogatepass")
        if len(self.sizes) >= REMEMBERED:
            self.sizes.clear()
        self.sizes[text] = out = min(len(c.compress(data)) for c in self.compressors)
        return out

    def best(self, text: str) -> tuple[str, str]:
        """The reading with the shortest description, and its chain ('' if it is the text itself)."""
        if (known := self.bests.get(text)) is not None:
            return known
        options = {text: ""} if "\ufffd" in text else readings(text)
        least, out = self.size(text), text
        for t, chain in options.items():
            # a size is never negative
            if chain and (cost := chain_cost(chain)) < least and (total := cost + self.size(t)) < least:
                least, out = total, t
        if len(self.bests) >= REMEMBERED:
            self.bests.clear()
        self.bests[text] = known = out, options[out]
        return known


def core(text: str) -> tuple[int, int]:
    """Bounds of the words from the first to the last that hold a character beyond ASCII; (0, 0) if there is none."""
    first = NOT_ASCII.search(text)
    if not first:
        return 0, 0
    backwards = text[::-1]
    last = len(text) - NOT_ASCII.search(backwards).start()
    before = BLANK.search(backwards, len(text) - first.start())
    after = BLANK.search(text, last)
    return len(text) - before.start() if before else 0, after.start() if after else len(text)


def _by_parts(parts: list[str], describe: Describer) -> tuple[str, str]:
    fixed = [describe.best(p) if NOT_ASCII.search(p) else (p, "") for p in parts]
    return "".join(p for p, _ in fixed), " + ".join(dict.fromkeys(c for _, c in fixed if c))


def restore(text: str, raw: bytes | None, describe: Describer) -> tuple[bool, str, str]:
    """Whether the text is affected, the chain by which it was restored ('' if it can't be), the restored text."""
    evident = bool(SURE.search(text))
    a, b = core(text)
    if not evident and a == b:
        return False, "", text
    if "\x00" in text and evident:
        data = text.encode("latin-1", "ignore")
        wide = [(f"latin-1>{codec}", decode(data[: len(data) // 2 * 2], codec)) for codec in ("utf-16-le", "utf-16-be")]
        wide = [(describe.size(out), chain, out) for chain, out in wide if out and "\x00" not in out]
        if wide:
            return True, *min(wide)[1:]
    inner = text[a:b]
    own = describe.size(inner)
    tried = [describe.best(inner), _by_parts(PIECES.split(inner), describe), _by_parts(re.split(r"(\s+)", inner), describe)]
    options = [(describe.size(t) + chain_cost(chain), chain, text[:a] + t + text[b:]) for t, chain in tried if chain]
    if raw is not None:
        data = raw.rstrip(b"\r\n")
        certain = not data.isascii() and decode(data, "utf-8") is not None
        for codec in ["utf-8"] if certain else WRITTEN:
            out = decode(data, codec)
            if out is not None and out != text:
                # what it is shorter by, over all that differs
                c, d = core(out)
                before, after = min(a, c), min(len(text) - b, len(out) - d)
                shorter = describe.size(text[before : len(text) - after]) - describe.size(out[before : len(out) - after])
                chain = f"raw>{codec}"
                options.append((own - shorter + chain_cost(chain), chain, out))
    if evident:
        # the text itself is no candidate then, nor is any other that can't have been written
        options = [x for x in options if not SURE.search(x[2])]
    else:
        options.append((own, "", text))
    _, chain, out = min(options, default=(own, "", text))
    return evident or bool(chain), chain, out


def language(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LANGUAGES):
        out = F.when(text.rlike(re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)), name).otherwise(out)
    return out


def _clean(text: str) -> bool:
    """Whether no part of a text could be UTF-8 that was read by another codec: strict decoding rarely succeeds by chance."""
    parts = {text, *PIECES.split(text), *text.split()}
    return not any(chain.endswith(">utf-8") for p in parts if NOT_ASCII.search(p) for chain in readings(p, 1).values())


def train(df: DataFrame, text: str, raw: str, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary of each language, from at most `sample` distinct texts each that agree with their bytes in UTF-8.

    The texts are those with the smallest hashes of the whole table, read once: a task passes on at most `sample` of each language.
    """
    agree = (
        df.where(F.col(raw).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]") & ~F.col(text).rlike(r"[\x{FFFD}\x{80}-\x{9F}\x{E000}-\x{F8FF}]"))
        .where(F.regexp_replace(F.col(raw).cast("string"), r"[\r\n]+$", "") == F.regexp_replace(F.col(text), r"[\r\n]+$", ""))
        .select(language(F.col(text)).alias("language"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    )

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, set[tuple[int, str]]] = {}
        for batch in batches:
            for name, h, t in zip(*[c.to_pylist() for c in batch.columns]):
                kept.setdefault(name, set()).add((h, t))
            kept = {name: set(sorted(rows)[:sample]) if len(rows) > sample else rows for name, rows in kept.items()}
        rows = [(name, h, t) for name, own in kept.items() for h, t in own]
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int64(), pa.string()])], names=["language", "hash", "text"])

    place = F.dense_rank().over(Window.partitionBy("language").orderBy("hash", "text"))
    chosen = agree.mapInArrow(smallest, agree.schema).distinct().withColumn("place", place).where(F.col("place") <= sample)
    texts: dict[str, list[bytes]] = {}
    for row in chosen.select("language", "text").collect():
        if _clean(row.text):
            a, b = core(row.text)
            texts.setdefault(row.language, []).append(row.text[a:b].encode())
    out = {}
    for name, samples in texts.items():
        try:
            out[name] = zstandard.train_dictionary(DICT_BYTES, sorted(samples)).as_bytes()
        except zstandard.ZstdError:  # too few samples: they are the dictionary themselves
            out[name] = b"\n".join(sorted(samples))[:DICT_BYTES]
    return {k: v for k, v in out.items() if len(v) >= 8}


def repair(df: DataFrame, row_id: str, text: str, raw: str, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """row_id, affected, chain, restored of every row with a text; a row given twice comes out twice.

    Null and empty texts are left out. chain is '' where the text is fine or can't be restored.
    """
    shared = df.sparkSession.sparkContext.broadcast(train(df, text, raw) if dictionaries is None else dictionaries)
    schema = T.StructType([
        df.schema[row_id], T.StructField("affected", T.BooleanType()), T.StructField("chain", T.StringType()), T.StructField("restored", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = Describer(shared.value)
        for batch in batches:
            done = [restore(t, b, describe) for t, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.string()),
                    pa.array([d[2].encode("utf-8", "replace").decode() for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=schema.names)

    return df.select(row_id, text, raw).where(F.length(text) > 0).mapInArrow(run, schema)
