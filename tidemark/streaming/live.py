"""The overviews over arriving lines: event time, a watermark as long as a clock step, bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "5 seconds"


def read_lines(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(lines: DataFrame, late: str = LATE) -> DataFrame:
    """Second deliveries within the watermark are dropped."""
    return lines.withWatermark("ts_utc", late).dropDuplicatesWithinWatermark(["line_id"])


def timeline(lines: DataFrame, bucket: str = "1 minute", late: str | None = LATE) -> DataFrame:
    """bucket (start), component, n, errors, warns; a bucket comes out when the watermark passes its end.

    late is None for lines that have a watermark already, as from once().
    """
    return (
        (lines.withWatermark("ts_utc", late) if late else lines)
        .groupBy(F.window("ts_utc", bucket), "component")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level_num") >= 40).alias("errors"), F.count_if(F.col("level_num") == 30).alias("warns"))
        .select(F.col("window.start").alias("bucket"), "component", "n", "errors", "warns")
    )


def active_spans(lines: DataFrame, pause: str = "30 seconds", late: str = LATE) -> DataFrame:
    """component, start, end, n of stretches without a pause; the pauses between them are the gaps."""
    return (
        lines.withWatermark("ts_utc", late)
        .groupBy(F.session_window("ts_utc", pause).alias("span"), "component")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts_utc").alias("end"))
        .select("component", F.col("span.start").alias("start"), "end", "n")
    )


def clock_epochs(lines: DataFrame, step_ms: int = 5000) -> DataFrame:
    """file_id, line_no, clock_epoch of arriving lines, which come in line order within a file; state is two numbers a file."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, epoch = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("line_no")
        out = []
        for no, us in zip(rows["line_no"], rows["us"]):
            if not pd.isna(us):
                if last is not None and us - last < -step_ms * 1000:
                    epoch += 1
                last = int(us)
            out.append((key[0], no, epoch))
        state.update((last, epoch))
        yield pd.DataFrame(out, columns=["file_id", "line_no", "clock_epoch"])

    rows = lines.select("file_id", "line_no", F.unix_micros("ts_utc").alias("us"))
    return rows.groupBy("file_id").applyInPandasWithState(
        run, "file_id int, line_no bigint, clock_epoch int", "last bigint, epoch int", "append", GroupStateTimeout.NoTimeout
    )


def write_table(df: DataFrame, path: str, checkpoint: str):
    """Starts an exactly-once append to Parquet; available input only."""
    return df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
