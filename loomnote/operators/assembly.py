"""Assembly of contexts, and checks of what language models return, as column functions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .order import running
from . import distill
from .apply import covers

TURN = r"(?m)^## \[\d{2}:\d{2}:\d{2}\] "
FACT = "title string, facts array<string>, narrative string, concepts array<string>, files array<string>, importance double"


def split_turns(logs: DataFrame, key: str, text: str) -> DataFrame:
    """key, turn (from 0), kind, body of the turns of a log; what stands before the first header belongs to none."""
    parts = F.slice(F.split(text, TURN), 2, 1 << 30)
    rows = logs.select(key, F.posexplode(parts).alias("turn", "part"))
    return rows.select(key, "turn", F.substring_index("part", "\n", 1).alias("kind"), F.when(F.contains("part", F.lit("\n")), F.expr("substr(part, locate('\\n', part) + 1)")).otherwise("").alias("body"))


def sampled_chunks(total: Column, most: int) -> Column:
    """Positions of at most ``most`` (2 or more) of ``total`` chunks, evenly spaced, first and last among them."""
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (total - 1) / (most - 1) + 0.5)))
    return F.when(total <= 0, F.array().cast("array<bigint>")).when(total <= most, F.sequence(F.lit(0).cast("bigint"), total.cast("bigint") - 1)).otherwise(even)


def json_in(reply: Column) -> Column:
    """The JSON in a model's reply: in a fence, else from the first brace to the last; null if there is none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def fact_of(json: Column) -> Column:
    """A fact struct, strings trimmed and importance rounded into 1 to 10; null if a required field is missing."""
    f = F.from_json(json, FACT)
    clean = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    good = (F.trim(f["title"]) != "") & (F.size(clean(f["facts"])) > 0) & (F.trim(f["narrative"]) != "") & (F.size(clean(f["concepts"])) > 0) & f["importance"].isNotNull()
    made = F.struct(
        F.trim(f["title"]).alias("title"), clean(f["facts"]).alias("facts"), F.trim(f["narrative"]).alias("narrative"), clean(f["concepts"]).alias("concepts"), clean(f["files"]).alias("files"),
        F.greatest(F.lit(1), F.least(F.lit(10), F.round(f["importance"]).cast("int"))).alias("importance"),
    )
    return F.when(F.coalesce(good, F.lit(False)), made)


def condensed(lines: DataFrame, key: str, most_bytes: int, most_chars: int = 80) -> DataFrame:
    """key, entries, kept, bytes: index lines (key, line_no, line) shortened, and how many fit a budget of bytes in order."""
    short = F.when(F.length("line") > most_chars, F.concat(F.rtrim(F.substring("line", 1, most_chars)), F.lit("..."))).otherwise(F.col("line"))
    rows = lines.select(key, "line_no", (F.octet_length(short) + 1).cast("long").alias("b"))
    return running(rows, [key], ["line_no"], run="b").groupBy(key).agg(F.count("*").alias("entries"), F.count_if(F.col("run") - 1 <= most_bytes).alias("kept"), F.coalesce(F.max(F.when(F.col("run") - 1 <= most_bytes, F.col("run") - 1)), F.lit(0)).alias("bytes"))


def context_block(path: Column, kind: Column, lifecycle: Column, tags: Column, backlinks: Column, most: int = 10, chars: int = 500) -> Column:
    """The header put before a page's text when it is embedded."""
    links = F.array_sort(backlinks)
    more = F.when(F.size(links) > most, F.concat(F.lit(" (+"), F.size(links) - most, F.lit(" more)"))).otherwise("")
    shown = F.array_join(F.transform(F.slice(links, 1, most), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), ", ")
    parts = F.array_compact(F.array(
        F.concat(F.lit("# "), path), F.concat(F.lit("# Type: "), kind, F.lit(" | Lifecycle: "), lifecycle),
        F.when(F.size(tags) > 0, F.concat(F.lit("# Tags: "), F.array_join(F.array_sort(tags), ", "))), F.when(F.size(links) > 0, F.concat(F.lit("# Backlinks: "), shown, more)),
    ))
    return F.substring(F.array_join(parts, "\n"), 1, chars)


def embedding_input(body: Column, most_tokens: int = 30_000) -> Column:
    """What of a body is embedded and hashed: redacted, and cut to the model's length."""
    return T.truncate_to_tokens(T.redact(body), most_tokens)


def page_detail(pages: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """path, direction (outbound, inbound), other, place, total of pages (path): the first ``most`` distinct targets and sources of each in order, and how many there are. Only the edges of the pages asked for are looked at."""
    ends = edges.select(F.col("from_path").alias("path"), F.lit("outbound").alias("direction"), F.col("to_path").alias("other"))
    ends = ends.unionByName(edges.select(F.col("to_path").alias("path"), F.lit("inbound").alias("direction"), F.col("from_path").alias("other")))
    own = ends.join(pages.select("path").distinct(), "path", "left_semi").distinct()
    total = own.groupBy("path", "direction").agg(F.count("*").alias("total"))
    first = own.withColumn("place", F.row_number().over(Window.partitionBy("path", "direction").orderBy("other"))).where(F.col("place") <= most)
    return first.join(total, ["path", "direction"]).select("path", "direction", "other", "place", "total")


def topic_overlap(topics: Column, names: Column) -> Column:
    """How many distinct topics are names of pages, whatever their case."""
    return F.size(F.array_intersect(F.transform(topics, F.lower), F.transform(names, F.lower))).cast("long")


def steered(ops: DataFrame, pages: DataFrame) -> DataFrame:
    """path, seq, outcome of operations (path, seq, kind, body) on pages (path, body): apply, skip (nothing new), stage for review, or reject (rewrite of no page).

    A rewrite that keeps too few of the page's anchors of any kind is staged, one with the same prose applies. To a
    page with prose only dated events are added; what else is new is staged.
    """
    rows = ops.join(pages.select("path", F.col("body").alias("old")), "path", "left").withColumn("__op", F.struct("path", "seq"))
    adds = rows.where("kind IN ('write', 'append') AND old IS NOT NULL")
    fresh = distill.net_new(adds.select("__op", "body"), adds.select("__op", F.col("old").alias("body")), "__op").select("__op", F.lit(True).alias("__new"))
    dated = distill.strip(F.col("body")).rlike(r"(?m)^##\s+\d{4}-\d{2}-\d{2}\b")
    before, after = distill.anchors_by_kind(F.coalesce("old", F.lit(""))), distill.anchors_by_kind(F.col("body"))
    keeps = covers(lambda k: distill.coverage(before[k], after[k]))
    rewrite = F.when(F.col("old").isNull(), "reject").when((distill.prose(F.col("old")) == distill.prose(F.col("body"))) | keeps, "apply").otherwise("stage")
    add = F.when(F.col("old").isNull() | (distill.prose(F.col("old")) == ""), "apply").when(F.col("__new").isNull(), "skip").when((F.col("kind") == "append") & dated, "apply").otherwise("stage")
    return rows.join(fresh, "__op", "left").select("path", "seq", F.when(F.col("kind") == "rewrite", rewrite).when(F.col("kind").isin("write", "append"), add).otherwise("apply").alias("outcome"))


def blessed(current: DataFrame, baseline: DataFrame, records: DataFrame) -> DataFrame:
    """records (path, hash, ...) with the hash of current (path, raw_hash, hash) where only the redaction changed since the baseline (path, raw_hash, hash)."""
    only = current.alias("c").join(baseline.alias("b"), "path").where("c.raw_hash = b.raw_hash AND c.hash <> b.hash").select(F.col("path").alias("__p"), F.col("c.hash").alias("__new"), F.col("b.hash").alias("__old"))
    joined = records.join(only, (F.col("path") == F.col("__p")) & (F.col("hash") == F.col("__old")), "left")
    return joined.withColumn("hash", F.coalesce("__new", "hash")).drop("__p", "__new", "__old")


def bumped(pages: DataFrame, changed: DataFrame, day: str) -> DataFrame:
    """pages (path, version, history array<struct<version, day>>, strength) with version + 1 and one more entry of history where path is among changed."""
    hit = pages.join(changed.select("path").distinct().withColumn("__hit", F.lit(True)), "path", "left")
    entry = F.struct(F.col("version").alias("version"), F.lit(day).alias("day"))
    return hit.select(
        "path", F.when(F.col("__hit"), F.col("version") + 1).otherwise(F.col("version")).alias("version"),
        F.when(F.col("__hit"), F.array_append("history", entry)).otherwise(F.col("history")).alias("history"), F.coalesce("strength", F.lit(8.0)).alias("strength"),
    )
