"""Quality of retrieval: recall, hits, reciprocal ranks, latencies and accuracies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(gold: DataFrame, found: DataFrame, k: int) -> DataFrame:
    best = found.where(F.col("rank") <= k).select("query_id", "id", "rank")
    return gold.join(best, ["query_id", "id"], "left")


def recall(gold: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """type, queries, recall (share of a query's expected ids found), hit (any found). gold: query_id, type, id."""
    each = _judged(gold, found, k).groupBy("type", "query_id").agg((F.count("rank") / F.count("*")).alias("recall"), (F.count("rank") > 0).cast("double").alias("hit"))
    return each.groupBy("type").agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit"))


def mrr(gold: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """type, queries, mrr: mean reciprocal rank of the first expected id."""
    first = _judged(gold, found, k).groupBy("type", "query_id").agg(F.min("rank").alias("r"))
    return first.groupBy("type").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def latency(rows: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, mean, p95 (nearest rank)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"))


def accuracy(rows: DataFrame, by: str, correct: str) -> DataFrame:
    """by (null: all), n, accuracy, by rollup."""
    return rows.rollup(by).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("double")), 6).alias("accuracy"))


def lift(gold: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """type, queries, base, recall, lift: mean recall of two result lists (query_id, id) against gold (query_id, type, id)."""
    marked = lambda df, name: df.select("query_id", "id", F.lit(1).alias(name)).distinct()
    each = gold.join(marked(base, "b"), ["query_id", "id"], "left").join(marked(found, "f"), ["query_id", "id"], "left").groupBy("type", "query_id").agg(*[(F.count(c) / F.count("*")).alias(c) for c in "bf"])
    return each.groupBy("type").agg(F.count("*").alias("queries"), F.round(F.avg("b"), 6).alias("base"), F.round(F.avg("f"), 6).alias("recall"), F.round(F.avg("f") - F.avg("b"), 6).alias("lift"))
