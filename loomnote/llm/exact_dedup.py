"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every scan partition's digests form runs. In each round ``fan_in`` neighbouring runs (the binomial partners of
log2(fan_in) pairwise rounds) exchange their rows by (parent run, digest) and are merged by sort aggregation:
of each digest the smallest identifier and the count stay. The root run holds one row per distinct text. The
answers then go down the same tree, run by run, so that a digest with a third of all rows is spread over all
runs in every exchange, both ways. Only digests are shuffled, never texts.

Equality is verified at every level: rows merge only if SHA-256, a second 64-bit hash and the length agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table, written

KEY = ["digest", "second", "length"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _digests(df: DataFrame, text: str) -> DataFrame:
    norm = df.withColumn("__norm", normalised(F.col(text)))
    return norm.select(
        "*",
        F.unhex(F.sha2("__norm", 256)).alias("digest"),
        F.xxhash64("__norm").alias("second"),
        F.length("__norm").alias("length"),
    ).drop("__norm")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after every run of ASCII white space became one space; null counts as empty.
    The smallest id stays; null ids come after all others. Of rows that repeat both id and text exactly one is
    ``kept``. An empty table gives an empty result. Other columns of docs are not read.
    """
    rows = written(
        _digests(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
        .drop("text")
        .withColumn("row_no", F.monotonically_increasing_id())
        .withColumn("run", F.expr(f"pmod(shiftright(row_no, 33), {runs})")),
        "dedup-digests",
    )
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")
    levels = [written(rows.groupBy("run", *KEY).agg(F.min(first).alias("first"), F.count("*").alias("n")), "dedup-run")]
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        up = levels[-1].withColumn("run", F.expr(f"run DIV {fan_in}"))
        levels.append(written(up.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n")), "dedup-run"))
    answer = levels.pop()
    for level in reversed(levels):
        answer = level.select(F.expr(f"run DIV {fan_in}").alias("parent"), "run", *KEY).join(answer.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return rows.join(answer, ["run", *KEY]).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("first.row_no") == F.col("row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without its exact copies, with all its columns, whatever their names: of each distinct text the row with the smallest id."""
    kept = exact_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha")).alias("d")
    same = rows.join(kept, F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.sha") == F.col("k.sha"))).select("d.*")
    order = Window.partitionBy("id", "sha").orderBy(F.xxhash64(F.col("row").cast("string")))
    return same.withColumn("n", F.row_number().over(order)).where("n = 1").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op3_exact_dedup": op3_exact_dedup}
ORACLES = {"op3_exact_dedup": ORACLE}
