"""Copies hidden by formatting: white space, letter case, punctuation, order of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

# key, closing quote, = or :, opening quote, value; a value that is itself followed by = or : is a key
FIELD = (
    r"""(?U)(?<![\p{L}\p{N}_])[\p{L}_][\p{L}\p{N}_]*+["']?+\s*+[=:：]\s*+["'\[(]?+"""
    r"""[^\s=,;|/"'\[\](){}，。；、]++(?!["'\])]?+\s*+[=:：])"""
)
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical_text(text: Column) -> Column:
    """Words in their order, then the fields (key with value) sorted; only letters and digits count, in lower case.

    Null stays null. Texts without a letter or digit are equal only to texts with the same characters besides white space.
    """
    low = F.lower(text)
    fields = F.array_sort(
        F.transform(
            F.regexp_extract_all(low, F.lit(FIELD), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, NOT_WORD, " "))
        )
    )
    words = F.trim(F.regexp_replace(F.regexp_replace(low, FIELD, " "), NOT_WORD, " "))
    full = F.concat_ws("\x01", words, F.array_join(fields, "\x02"))
    bare = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(text.isNull(), None).when(full == "\x01", F.concat(F.lit("\x03"), bare)).otherwise(full)


def _distinct_raw(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Byte-identical texts once: first and last id, number of rows; then the canonical text of each survivor."""
    return (
        df.select(F.col(row_id).alias("id"), F.col(text).alias("raw"))
        .where(F.col("raw").isNotNull() & F.col("id").isNotNull())
        .groupBy("raw")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .withColumn("canonical", canonical_text(F.col("raw")))
    )


def copy_groups(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id (smallest), text (its raw form), copies (rows): each record once. Rows with a null id or text are left out."""
    return (
        _distinct_raw(df, row_id, text)
        .groupBy("canonical")
        .agg(F.min_by("raw", "lo").alias(text), F.min("lo").alias(row_id), F.sum("n").alias("copies"))
        .select(row_id, text, "copies")
    )


def copy_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """id_a, id_b: each record's smallest id with each other id of its group; a row delivered twice counts once.

    Most distinct texts stand for one row, so their pair comes from the collapsed table alone. Only texts with
    several ids are looked up in the input again; the join is on the raw text, and a hot text splits there
    (adaptive skew join), since one side holds it in one row.
    """
    single = materialize(_distinct_raw(df, row_id, text).drop("n"))
    groups = (
        single.groupBy("canonical")
        .agg(F.min("lo").alias("id_a"), F.max("hi").alias("last"))
        .where(F.col("id_a") < F.col("last"))
        .drop("last")
    )
    members = single.join(groups, "canonical").select("raw", "lo", "hi", "id_a")
    alone = members.where((F.col("lo") == F.col("hi")) & (F.col("lo") != F.col("id_a"))).select(
        "id_a", F.col("lo").alias("id_b")
    )
    many = (
        df.select(F.col(row_id).alias("id_b"), F.col(text).alias("raw"))
        .where(F.col("raw").isNotNull() & F.col("id_b").isNotNull())
        .join(members.where(F.col("lo") < F.col("hi")).select("raw", "id_a"), "raw")
        .where(F.col("id_b") != F.col("id_a"))
        .select("id_a", "id_b")
        .distinct()
    )
    return alone.union(many)
