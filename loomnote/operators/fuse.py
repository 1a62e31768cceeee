"""Fusion of ranked lists, and hybrid search composed of all signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..storage import written
from . import lexical
from .order import rank


def ranked(stream: DataFrame, source: str, weight: float = 1.0, score: str = "score", cap: int | None = None) -> DataFrame:
    """query_id, id, source, rank, weight of a stream with query_id, id and a score."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    out = stream.select("query_id", "id", F.row_number().over(order).alias("rank"))
    out = out.where(F.col("rank") <= cap) if cap else out
    return out.select("query_id", "id", F.lit(source).alias("source"), "rank", F.lit(float(weight)).alias("weight"))


def global_rank(rows: DataFrame, score: str = "score", key: str = "id") -> DataFrame:
    """rows with rank by score descending, then key, over all rows, without sorting them in one task."""
    return rank(rows, [], [F.desc(score), key])


def rrf(streams: list[DataFrame], k: int = params.RRF_K) -> DataFrame:
    """query_id, id, score, signals (by source), dominant: weighted reciprocal-rank fusion; only rows that a stream other than metadata has."""
    every = reduce(DataFrame.unionByName, streams)
    fused = every.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 6).alias("score"),
        F.array_sort(F.collect_list(F.struct("source", "rank"))).alias("signals"),
        F.min_by("source", F.struct("rank", "source")).alias("dominant"),
        F.max((F.col("source") != "metadata").cast("int")).alias("asked"),
    )
    return fused.where("asked = 1").drop("asked")


SIGNALS = ("bm25", "vector", "exact", "graph", "graph-spread", "metadata")


def intent_weight(intent: Column, source: Column) -> Column:
    """Weight of a signal for a query's intent; 1 for intents and signals that have none."""
    known = {f"{i}/{s}": float(w) for i, ws in params.INTENT_WEIGHTS.items() for s, w in zip(SIGNALS, ws, strict=True)}
    weights = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, F.concat_ws("/", intent, source)), F.lit(1.0))


def seeds(bm25: DataFrame, vector: DataFrame, best: int = 3) -> DataFrame:
    """query_id, id, place: the best of either stream (query_id, id, score), those of bm25 first, each row once."""
    streams = [ranked(s, name, cap=best).select("query_id", "id", (F.col("rank") + n * best).alias("place")) for n, (name, s) in enumerate((("bm25", bm25), ("vector", vector)))]
    return streams[0].unionByName(streams[1]).groupBy("query_id", "id").agg(F.min("place").alias("place"))


def hybrid(streams: dict[str, DataFrame], prior: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None) -> DataFrame:
    """query_id, id, score, signals, dominant, rank: the k best documents of each query (query_id, intent) over named streams (query_id, id, score).

    Streams: bm25 and vector count their best 50 (without vector this is lexical search); exact, graph and
    graph-spread count whole. The prior (id, score), which all documents have, is ranked once for all queries and
    joined to what the streams found, and alone finds nothing. Every signal weighs by the query's intent.
    """
    lists = [ranked(s, name, cap=params.SIGNAL_CAP if name in ("bm25", "vector") else None) for name, s in streams.items()]
    found = written(reduce(DataFrame.unionByName, lists).drop("weight"), "streams")
    placed = global_rank(prior).select("id", "rank")
    own = found.select("query_id", "id").distinct().join(placed, "id").select("query_id", "id", F.lit("metadata").alias("source"), "rank")
    every = found.withColumn("rank", F.col("rank").cast("long")).unionByName(own)
    weighted = every.join(queries.select("query_id", "intent"), "query_id").withColumn("weight", intent_weight(F.col("intent"), F.col("source"))).drop("intent")
    best = lexical.top(rrf([weighted]), k)
    return best.where(F.col("score") >= least) if least is not None else best


def rerank(found: DataFrame, texts: DataFrame, scorer, best: int = 5, most_chars: int = 1200) -> DataFrame:
    """found with its first ``best`` rows of each query reordered by scorer(query column, text column), a column function; the rest follow in their order."""
    joined = found.join(texts, "id")
    scored = joined.withColumn("rerank_score", F.when(F.col("rank") <= best, scorer(F.col("query"), F.substring("text", 1, most_chars))))
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank", "id")
    return scored.withColumn("rank", F.row_number().over(order)).drop("text")
