"""Tables in the shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or in local mode a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again. The folder's owner clears it when the results are stored."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str, count: Column) -> tuple[DataFrame, int]:
    """df as ``written`` gives it, and an aggregate of it (0 without rows) that is taken while it is written."""
    seen = Observation()
    table = written(df.observe(seen, count.alias("n")), label)
    return table, seen.get["n"] or 0


def small_batches(spark: SparkSession, rows: int = 256, most_bytes: int | None = None) -> None:
    """Lowers the rows of a batch that goes to Python, and its bytes if these are given: whole texts stand in memory several times on their way."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)):
        now = spark.conf.get(key)
        if most and not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
