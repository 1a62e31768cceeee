"""Changes of tables: diffs, tombstones, closings and rewrites; pure functions from old to new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def tombstones(state: DataFrame, seen: DataFrame, key: str, complete: bool) -> DataFrame:
    """State rows not seen in a complete walk; none after a walk that broke off."""
    return state.join(seen.select(key).distinct(), key, "left_anti") if complete else state.limit(0)


def reconcile(state: DataFrame, seen: DataFrame, key: str, complete: bool = True) -> DataFrame:
    """key, action, generation: insert, update (another hash), keep or delete. Both have hash; state has generation."""
    s, n = state.alias("s"), seen.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full")
    gone = F.when(F.lit(complete), "delete").otherwise("keep")
    action = F.when(F.col(f"s.{key}").isNull(), "insert").when(F.col(f"n.{key}").isNull(), gone).when(F.col("s.hash").eqNullSafe(F.col("n.hash")), "keep").otherwise("update")
    return joined.select(F.coalesce(f"s.{key}", f"n.{key}").alias(key), action.alias("action"), (F.coalesce("s.generation", F.lit(0)) + action.isin("insert", "update").cast("int")).alias("generation"))


def close_versions(rows: DataFrame, key: str, start: str) -> DataFrame:
    """rows as versions: valid_to is the day of the key's next version, and the last one is current."""
    w = Window.partitionBy(key).orderBy(start, *[c for c in rows.columns if c not in (key, start)])
    out = rows.withColumn("valid_to", F.lead(start).over(w))
    return out.withColumn("current", F.col("valid_to").isNull())


def retarget(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """edges whose to_path is an alias (alias, canonical) pointed at the canonical page, without repeats."""
    a = aliases.select(F.col("alias").alias("__a"), F.col("canonical").alias("__c"))
    return edges.join(a, F.col("to_path") == F.col("__a"), "left").withColumn("to_path", F.coalesce("__c", "to_path")).drop("__a", "__c").distinct()


def ground(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose target is a page (path)."""
    return edges.join(pages.select(F.col("path").alias("__p")).distinct(), F.col("to_path") == F.col("__p"), "left_semi")


def new_mentions(edges: DataFrame, found: DataFrame) -> DataFrame:
    """edges (from_path, to_path, confidence) and the found ones whose pair is not there yet, confidence to 3 places."""
    fresh = found.join(edges.select("from_path", "to_path"), ["from_path", "to_path"], "left_anti")
    return edges.unionByName(fresh.withColumn("confidence", F.round("confidence", 3)))


def keyset_page(rows: DataFrame, before, by: str, key: str, limit: int) -> DataFrame:
    """The next ``limit`` rows before a (value, key) cursor, newest first."""
    value, tie = before
    return rows.where((F.col(by) < F.lit(value)) | ((F.col(by) == F.lit(value)) & (F.col(key) < F.lit(tie)))).orderBy(F.desc(by), F.desc(key)).limit(limit)


def timeline(events: DataFrame, start: str, end: str, width_hours: int, by: str = "ts") -> DataFrame:
    """bucket, n: counts of events in buckets from start, empty ones too. Counting comes before the join with the buckets."""
    at, to, width = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), width_hours * 3600
    n = F.floor((F.unix_timestamp(by) - F.unix_timestamp(at)) / width)
    counts = events.where((F.col(by) >= at) & (F.col(by) < to)).groupBy(n.alias("i")).agg(F.count("*").alias("n"))
    spark = events.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.ceil((F.unix_timestamp(to) - F.unix_timestamp(at)) / width).cast("int") - 1)).alias("i"))
    return span.join(counts, "i", "left").select(F.timestamp_seconds(F.unix_timestamp(at) + F.col("i") * width).alias("bucket"), F.coalesce("n", F.lit(0)).alias("n"))


def islands(rows: DataFrame, group: str, day: str, most_gap: int) -> DataFrame:
    """group, island, first, last, n: runs of days whose neighbours are at most most_gap days apart."""
    w = Window.partitionBy(group).orderBy(day)
    days = rows.groupBy(group, day).agg(F.count("*").alias("n"))
    cut = F.coalesce((F.datediff(day, F.lag(day).over(w)) > most_gap).cast("int"), F.lit(0))
    return days.withColumn("cut", cut).withColumn("island", F.sum("cut").over(w)).groupBy(group, "island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.sum("n").alias("n"))


def decay(pages: DataFrame, now: str, accessed: str = "updated", strength: float = 8.0, period: int = 14, archive_days: int = 180, pinned: str | None = None) -> DataFrame:
    """pages with periods, strength and archive: a tenth lost every period; archived below 1 after archive_days unless pinned."""
    days = F.datediff(F.lit(now).cast("date"), F.col(accessed))
    out = pages.withColumn("periods", F.floor(days / period)).withColumn("strength", F.round(strength * F.pow(F.lit(0.9), F.col("periods")), 6))
    old = (F.col("strength") < 1) & (days >= archive_days)
    return out.withColumn("archive", old & ~F.col(pinned) if pinned else old)


def collisions(links: DataFrame, orphans: int, most_share: float = 0.2, least_orphans: int = 5) -> DataFrame:
    """Links (raw, target, score) after suppression of mass collisions: each raw row keeps its best target, but while a target holds more than a share of all orphans, it goes, and its rows turn to their next best.

    Each pass is a table in the shared folder; a pass takes a target away, so there are no more of them than targets.
    """
    left = written(links.select("raw", "target", "score"), "collisions")
    while True:
        best = left.groupBy("raw").agg(F.max_by("target", F.struct("score", "target")).alias("target"))
        chosen = written(best, "collisions-best")
        many = chosen.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") > most_share * orphans)
        if orphans < least_orphans or many.isEmpty():
            return chosen
        left = written(left.join(many.select("target"), "target", "left_anti"), "collisions")
