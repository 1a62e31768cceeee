"""Incremental work with state: byte watermarks, spending caps and an index kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import order, tables
from . import windows

SLICE = "path string, start long, end long, reset boolean"


def byte_slices(files: DataFrame) -> DataFrame:
    """path, start, end, reset: the bytes of each file (stream of path, size) that no earlier batch has covered; a file that shrank starts again at 0."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.get[0] if state.exists else 0
        size = max(int(f["size"].max()) for f in frames)
        start, reset = (0, True) if size < done else (done, False)
        state.update((size,))
        if size > start or reset:
            yield pd.DataFrame([(key[0], start, size, reset)], columns=["path", "start", "end", "reset"])

    return files.groupBy("path").applyInPandasWithState(advance, SLICE, "done long", "append", GroupStateTimeout.NoTimeout)


def daily_cap(calls: DataFrame, budget: float) -> DataFrame:
    """calls (stream of day, seq, cost) with admitted: in order of seq within a batch, until the day's admitted cost would pass the budget."""

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values("seq")
        admitted = []
        for cost in rows["cost"]:
            admitted.append(spent + cost <= budget)
            spent += cost if admitted[-1] else 0.0
        state.update((spent,))
        yield rows.assign(admitted=admitted)[["day", "seq", "cost", "admitted"]]

    return calls.groupBy("day").applyInPandasWithState(admit, "day string, seq long, cost double, admitted boolean", "spent double", "append", GroupStateTimeout.NoTimeout)


def fair_slices(pending: DataFrame, total: int = 200_000, each: int = 10_000, most_files: int = 40) -> DataFrame:
    """path, bytes: round-robin shares of a byte budget over the oldest files (path, since, pending), at most ``each`` a file.

    Files are admitted oldest first, so their shares follow from running sums of what each may take.
    """
    first = pending.orderBy("since", "path").limit(most_files)
    take = first.withColumn("want", F.least("pending", F.lit(each)))
    level = take.selectExpr("collect_list(want) AS w").select(F.expr(f"""
        aggregate(sequence(1, {most_files}), struct(CAST({total} AS BIGINT) AS left, CAST(0 AS BIGINT) AS level),
          (a, i) -> named_struct('left', a.left, 'level', greatest(a.level, IF(size(w) = 0, CAST(0 AS BIGINT),
            CAST((a.left - aggregate(filter(w, x -> x <= a.level), CAST(0 AS BIGINT), (s, x) -> s + x)) DIV greatest(1, size(filter(w, x -> x > a.level))) AS BIGINT)))),
          a -> a.level)""").alias("level"))
    return take.join(F.broadcast(level)).select("path", F.least("want", "level").alias("bytes")).where("bytes > 0")


def keep_index(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """State (path, hash, generation) after a micro-batch (path, hash): files of a batch are changes, so nothing is removed; for foreachBatch."""
    latest = batch.groupBy("path").agg(F.max("hash").alias("hash"))
    if state is None:
        return latest.withColumn("generation", F.lit(1))
    plan = tables.reconcile(state, latest, "path", complete=False).select("path", "generation")
    both = latest.select("path", "hash").unionByName(state.join(latest, "path", "left_anti").select("path", "hash"))
    return both.join(plan, "path")


def oversize(files: DataFrame, chunks: DataFrame, most_bytes: int = 16 << 20, most_chunks: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Chunks (path, ...) of the files (path, size) that may be indexed, and the files that may not (path, error): too many bytes, or too many chunks."""
    counted = files.join(chunks.groupBy("path").agg(F.count("*").alias("chunks")), "path", "left")
    error = F.when(F.col("size") > most_bytes, "too large").when(F.col("chunks") > most_chunks, "too many chunks")
    bad = counted.select("path", error.alias("error")).where("error IS NOT NULL")
    return chunks.join(bad.select("path"), "path", "left_anti"), bad


#: Seconds until a slice is tried again, by the number of failures; and the stalls after which it is set aside.
RETRY_SECONDS, MOST_STALLS = (30, 60, 120, 240, 480), 2


def retries(tries: DataFrame) -> DataFrame:
    """tries (path, failures, stalls, failed_at) with action (now, wait, quarantine) as of column now, and due, the time of the next try."""
    wait = F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.least(F.greatest("failures", F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))
    due = F.when(F.col("failures") > 0, F.timestamp_seconds(F.unix_timestamp("failed_at") + wait))
    action = F.when(F.col("stalls") >= MOST_STALLS, "quarantine").when(due > F.col("now"), "wait").otherwise("now")
    return tries.withColumn("due", due).withColumn("action", action)


def tick(pending: DataFrame, most_docs: int = 25, most_tokens: int = 50_000) -> DataFrame:
    """Of pending documents (path, since, tokens) the oldest that one tick takes: so many at most, and so many tokens; the first always."""
    placed = order.running(pending, [], ["since", "path"], __n="1L", __sum="tokens")
    return placed.where((F.col("__n") <= most_docs) & ((F.col("__sum") <= most_tokens) | (F.col("__n") == 1))).drop("__n", "__sum")


def quiet(captures: DataFrame, seconds: int = 30, late: str | None = "10 seconds", key: str = "path", at: str = "at") -> DataFrame:
    """key, first, due, captures: each stretch of captures (stream or table of key, at) of one key that are less than ``seconds`` apart, when that long nothing has come; due is its last capture plus ``seconds``.

    A session window per key is the timer: on a stream, a row comes out once the watermark has passed its due time, and
    a capture before that puts it off. Nothing waits in memory but the open stretches. Null keys and times take no part.
    """
    rows = windows.timed(captures.where(F.col(key).isNotNull() & F.col(at).isNotNull()), at, late)
    open_ = rows.groupBy(key, F.session_window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("captures"))
    return open_.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("due"), "captures")
