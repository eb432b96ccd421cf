"""An inverted index of search tokens: which lines hold a token, as bitmaps of line ids without their empty words.

A posting is a token, a word of 64 line ids and its bits. Written by token, sorted, a lookup reads the row groups that
can hold its tokens (their statistics tell), not the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def postings(lines: DataFrame, tokens: str = "msg_tokens", line_id: str = "line_id") -> DataFrame:
    """token, word, bits of lines with tokens joined by blanks. Null texts and ids give none; a line given twice counts once."""
    each = lines.where(F.col(line_id).isNotNull()).select(F.col(line_id).cast("bigint").alias("id"), F.explode(F.array_distinct(F.split(F.lower(tokens), " "))).alias("token"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("id").bitwiseAND(F.lit(63)).cast("int"))
    return each.where(F.col("token") != "").groupBy("token", F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def write_index(lines: DataFrame, path: str) -> None:
    """Postings in files of token ranges. A frequent token is many words, so its range is split among several files."""
    postings(lines).repartitionByRange("token", "word").sortWithinPartitions("token", "word").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(index: DataFrame, words: list[str], every: bool = False) -> DataFrame:
    """line_id of the lines that hold any or every one of the tokens, in whatever case; no words, no lines."""
    wanted = sorted({w.lower() for w in words})
    hits = index.where(F.col("token").isin(wanted))
    united = hits.groupBy("word").agg((F.bit_and("bits") if every else F.bit_or("bits")).alias("bits"), F.count(F.lit(1)).alias("n"))
    if every:
        united = united.where(F.col("n") == len(wanted))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return united.select(F.explode(F.transform(bits, lambda i: F.call_function("shiftleft", F.col("word"), F.lit(6)) + i)).alias("line_id"))
