"""Event-time windows on streams, with watermarks for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, of the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(rows: DataFrame, at: str, late: str | None) -> DataFrame:
    """rows with a watermark on their time, if they are a stream and late is given."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if late and rows.isStreaming else rows


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour", by: str = "event_type", at: str = "ts") -> DataFrame:
    rows = timed(events, at, late)
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = "1 hour", at: str = "ts") -> DataFrame:
    rows = timed(events, at, late)
    return rows.groupBy(F.window(at, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour", by: str = "user_id", at: str = "ts") -> DataFrame:
    rows = timed(events, at, late)
    return rows.groupBy(by, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def first_seen(rows: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """Each key once: what was seen within the watermark is suppressed."""
    return timed(rows, at, within).dropDuplicatesWithinWatermark([key])
