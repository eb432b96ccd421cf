"""Lines of JSON: read as maps, appended one by one or as a table."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str = "map<string,string>") -> DataFrame:
    """value of each line that isn't blank, and line, the text of those that are no such JSON (value is null then)."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "line")
    parsed = lines.withColumn("value", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    return parsed.select("value", F.when(F.col("value").isNull(), F.col("line")).alias("line"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """Appends rows as objects with sorted keys, a file a partition; nulls are written too."""
    row = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def append_record(path: str, record: dict) -> None:
    """One event of the driver, on disk before this returns."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, ensure_ascii=False, sort_keys=True, default=str) + "\n")
        f.flush()
        os.fsync(f.fileno())
