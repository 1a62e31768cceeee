"""Readers and writers of note folders, session logs, embeddings and facts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distill, vector

FRONT = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
EMBEDDING = "path string, hash string, vector array<float>, model string, dim int, ts string, archived boolean"
EVENT = "type string, timestamp string, sessionId string, message struct<role:string,content:string>"
FACT = "title string, facts array<string>, narrative string, concepts array<string>, files array<string>, importance int, type string, session_id string, observed_at string"


def field(front: Column, name: str) -> Column:
    """A scalar of the front matter without its quotes, null if absent."""
    found = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit(""))


def listed(front: Column, name: str) -> Column:
    """A list of the front matter, written in brackets or as lines with dashes."""
    flow = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*?)\]", 1)
    lines = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:[ \t]*-[ \t]+.*\n?)+)", 1)
    items = F.when(flow != "", F.split(flow, ",")).otherwise(F.split(F.regexp_replace(lines, r"(?m)^[ \t]*-[ \t]+", ""), "\n"))
    return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def read_vault(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Pages and errors of the .md files under wiki/, raw/ and crystals/ of a folder; archives and dot folders are left out.

    Pages: path, kind, title, type, status, tags, confidence, created, updated, body, size. A file whose front
    matter does not end is an error (path, reason), not a page. Bad values become defaults.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    rel = F.regexp_extract("path", r".*?/((?:wiki|raw|crystals)/.*)$", 1)
    rows = files.select(rel.alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text")).where(r"path <> '' AND NOT path RLIKE '^wiki/(archive|\\.[^/]*)/'")
    front, body = F.regexp_extract("text", FRONT, 1), F.regexp_extract("text", FRONT, 2)
    opens, closes = F.col("text").rlike(r"\A---\r?\n"), F.col("text").rlike(FRONT)
    broken = opens & ~closes
    parsed = rows.where(~broken).select("path", "size", F.when(opens, front).otherwise("").alias("front"), F.when(opens, body).otherwise(F.col("text")).alias("body"))
    kind = F.when(F.col("path").startswith("raw/"), "raw").when(F.col("path").startswith("crystals/"), "crystal").otherwise("wiki")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    f = F.col("front")
    pages = parsed.select(
        "path", kind.alias("kind"), F.coalesce(field(f, "title"), name).alias("title"), F.coalesce(field(f, "type"), F.get(F.split("path", "/"), 1)).alias("type"),
        F.coalesce(field(f, "status"), F.lit("active")).alias("status"), listed(f, "tags").alias("tags"), F.expr("try_cast(nullif(regexp_extract(front, '(?m)^confidence:[ \\\\t]*([0-9.]+)', 1), '') AS DOUBLE)").alias("confidence"),
        field(f, "created").alias("created"), field(f, "updated").alias("updated"), "body", "size",
    )
    return pages, rows.where(broken).select("path", F.lit("front matter does not end").alias("reason"))


def read_embeddings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The last record of each path by ts, and the lines that are no records."""
    rows = spark.read.schema(f"{EMBEDDING}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("line", F.monotonically_increasing_id())
    good = rows.where(F.col("path").isNotNull() & F.col("vector").isNotNull())
    bad = rows.where(F.col("path").isNull() | F.col("vector").isNull()).select("_corrupt")
    return vector.latest(good.drop("_corrupt"), "path", "ts", "line").drop("line"), bad


def write_embeddings(records: DataFrame, path: str, dim: int) -> DataFrame:
    """Writes the records that pass the guard in place of those under path and returns those that do not, with the reason.

    The new table is written beside the old one and takes its place when it is whole; the old one stays as a backup.
    """
    checked = vector.guard(records, dim, "vector")
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    checked.where("reason IS NULL").drop("reason").write.json(staged)
    jvm, conf = records.sparkSession._jvm, records.sparkSession._jsparkSession.sessionState().newHadoopConf()
    new, now, old = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, path, f"{path.rstrip('/')}.backup"))
    fs = now.getFileSystem(conf)
    if fs.exists(now):
        fs.delete(old, True)
        fs.rename(now, old)
    if not fs.rename(new, now):
        fs.rename(old, now)
        raise OSError(f"could not put {staged} in place of {path}")
    return checked.where("reason IS NOT NULL")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each session of event logs in JSON lines: turns in order, first and last timestamp, body."""
    rows = spark.read.schema(EVENT).json(path).where("message.content IS NOT NULL AND sessionId IS NOT NULL")
    turns = rows.select(F.col("sessionId").alias("conv_id"), F.struct("timestamp", F.col("message.content").alias("c")).alias("turn"), F.col("message.role").alias("role"), F.col("message.content").alias("text"))
    times = rows.groupBy(F.col("sessionId").alias("conv_id")).agg(F.min("timestamp").alias("started"), F.max("timestamp").alias("ended"))
    return distill.sessionize(turns).select("conv_id", "turns", "body").join(times, "conv_id")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts with a title and an importance of 1 to 10; files that are no facts are skipped."""
    rows = spark.read.schema(FACT).option("multiLine", True).option("recursiveFileLookup", True).json(path).where("title IS NOT NULL")
    return rows.withColumn("importance", F.greatest(F.lit(1), F.least(F.lit(10), F.coalesce("importance", F.lit(1)))))


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts as JSON in folders by day; the writer's commit keeps a failed job's files out."""
    facts.withColumn("date", F.substring("observed_at", 1, 10)).write.mode("append").partitionBy("date").json(path)


def signature(files: DataFrame) -> DataFrame:
    """One hash over path, size and time of change (mtime, if there) of all files, independent of their order; files that repeat count each."""
    columns = [c for c in ("path", "size", "mtime") if c in files.columns]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    return files.agg(F.sha2(F.concat_ws("/", total.cast("string"), F.count("*").cast("string")), 256).alias("signature"), F.count("*").alias("files"))


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """scope, key, value (JSON) of key-value files <scope>.bin: a JSON object with whatever bytes after it; files that begin with none give no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for scope, content in zip(f["scope"], f["content"], strict=True):
                try:
                    found, _ = json.JSONDecoder().raw_decode(bytes(content).decode("utf-8", "ignore").lstrip())
                except ValueError:
                    continue
                rows += [(scope, k, json.dumps(v, ensure_ascii=False)) for k, v in found.items()] if isinstance(found, dict) else []
            yield pd.DataFrame(rows, columns=["scope", "key", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", True).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.bin$", "")
    return files.select(name.alias("scope"), "content").mapInPandas(run, "scope string, key string, value string")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, type, expected of gold questions in JSON lines, under any of the names that such sets use. A line that is no question raises."""
    schema = "id string, question_id string, query string, question string, type string, category string, expected_paths array<string>, expected_evidence_ids array<string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    text, expected = F.coalesce("query", "question"), F.coalesce("expected_paths", "expected_evidence_ids")
    whole = F.when(text.isNull() | expected.isNull(), F.raise_error(F.lit("a gold question without text or evidence"))).otherwise(text)
    return rows.select(F.coalesce("id", "question_id", F.sha2(text, 256)).alias("query_id"), whole.alias("query"), F.coalesce("type", "category").alias("type"), expected.alias("expected"))


def manifest_faults(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """file, fault of a manifest (file, sha256) against the files under path: missing, changed, or unlisted. Files are hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("own"))
    both = manifest.join(files, "file", "full")
    fault = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("own") != F.lower("sha256"), "changed")
    return both.select("file", fault.alias("fault")).where("fault IS NOT NULL")


def tail(spark: SparkSession, path: str, needle: str | None = None) -> DataFrame:
    """Stream of path, line: lines of files that come to a folder, those with the needle (a pattern) if one is given."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(needle)) if needle else lines
