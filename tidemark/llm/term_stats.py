"""Occurrence and record counts of every term, from vertical record bitmaps.

A term's bitmap of record ids is kept word by word, without the words that hold no bit (as word-aligned compressed bitmaps
do): one row of 64 ids, so that a rare term takes no more rows than it has records and a dense one a 64th of them. Words
and counters are built in one aggregation that combines before it shuffles; partial words merge by union (bitwise or),
and cardinalities are bit counts. A frequent term is many words, which no task need hold together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _word(number: Column) -> Column:
    return F.shiftright(number, 6)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))


def term_bitmaps(df: DataFrame, term: str, record: str, occurrence: str | None = None) -> DataFrame:
    """Words of each term's bitmaps: term, of_occurrences, record, lost, word (its 64 ids), bits, rows (that it took).

    A term has one bitmap of records; with `occurrence` also one of the occurrences in each record, so that a repeated
    (term, record, occurrence) counts once; else every row counts. Record and occurrence ids are whole numbers. Null terms
    are left out, and null occurrences where they are asked for. A null record counts as an occurrence but as no
    record: in the bitmap of records its word is null, among those of occurrences it has record -1 and lost is true.
    """
    number = F.col(record).cast("bigint")
    rows = df.select(F.col(term).alias("term"), number.alias("id"), F.col(occurrence or record).cast("bigint").alias("occurrence"))
    rows = rows.where(F.col("term").isNotNull())
    none = F.lit(None).cast("bigint")
    of_records = F.struct(F.lit(False).alias("of_occurrences"), none.alias("record"), F.lit(False).alias("lost"), _word(F.col("id")).alias("word"), _bit(F.col("id")).alias("bit"))
    kinds = [of_records]
    if occurrence:
        rows = rows.where(F.col("occurrence").isNotNull())
        kinds.append(F.struct(
            F.lit(True).alias("of_occurrences"), F.coalesce("id", F.lit(-1)).alias("record"), F.col("id").isNull().alias("lost"),
            _word(F.col("occurrence")).alias("word"), _bit(F.col("occurrence")).alias("bit"),
        ))
    return (
        rows.select("term", F.inline(F.array(*kinds)))
        .groupBy("term", "of_occurrences", "record", "lost", "word")
        .agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("rows"))
    )


def term_frequencies(df: DataFrame, term: str, record: str, occurrence: str | None = None) -> DataFrame:
    """term, occurrences, records (document frequency), all_records (records with any term).

    An empty input gives no rows. The words are written once; the terms' cardinalities and the union over all terms
    both come from them.
    """
    words = materialize(term_bitmaps(df, term, record, occurrence))
    of_records = ~F.col("of_occurrences")
    cardinality = F.coalesce(F.bit_count("bits"), F.lit(0))
    universe = (
        words.where(of_records & F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.bit_count(F.bit_or("bits")).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )
    occurrences = F.when(F.col("of_occurrences"), cardinality) if occurrence else F.col("rows")
    return (
        words.groupBy("term")
        .agg(F.sum(occurrences).alias("occurrences"), F.sum(F.when(of_records, cardinality).otherwise(0)).alias("records"))
        .withColumn("all_records", universe.scalar())
    )


def mark_terms(stats: DataFrame, min_records: int = 3, max_share: float = 0.15) -> DataFrame:
    """Adds mark: 'rare' below min_records records, else 'common' above max_share of all records, else null."""
    return stats.withColumn(
        "mark",
        F.when(F.col("records") < min_records, "rare").when(
            F.col("records") > F.col("all_records") * F.lit(max_share), "common"
        ),
    )
