"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents, shuffled by a hash of their ids, stand end to end as one stream of words that is cut
into blocks of equal size. The mix is a sequence of slots of one block each. Slot t has the golden-ratio point
frac(t * phi); where it falls among the cumulative shares of the sources decides whose block the slot takes, so
every stretch of the mix holds the sources in nearly their target shares. A slot's rank among its source's slots
names the block; after the last block a source starts again, up to ``most`` passes.

Neither the shuffle nor the ranking sorts a source in one task: documents are laid out by (source, bucket) and
slots are ranked by (source, chunk), and only the totals of buckets and chunks are summed up in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

SHARE, MOST, SEED = 1.5, 2, 4
#: By the place of the source in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
BUCKET_DOCS, CHUNK = 4096, 65536
#: Slots that the smallest source with a target gets at least, unless blocks fell below LEAST_BLOCK words or there
#: were more than 4 slots for each document (or MOST_SLOTS, if that is more).
SMALLEST_SLOTS, LEAST_BLOCK, MOST_SLOTS = 2000, 16, 1 << 18
#: Fractional parts of the golden ratio, and of its 2**20-fold.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.607787409740351
#: Cells of the unit interval by which slots find their source.
CELLS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, place, target of each source. sizes: source, size.

    The targets share share * the sum of sizes by weight; none exceeds most times its source's size, the excess
    going to the others by weight. That level is found in closed form: sources ordered by the level at which
    they are full, with running sums (one row per source).
    """
    if share > most:
        raise ValueError("no mix of that size keeps to the most passes")
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = total.withColumn("place", F.row_number().over(order) - 1)
    w = placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("full", most * F.col("source_size") / F.col("weight"))
    by_level = Window.orderBy("full", "place")
    sums = w.select(
        "*",
        (most * (F.sum("source_size").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))).alias("below"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
        F.sum("source_size").over(Window.partitionBy()).alias("all_size"),
    )
    # The first source in that order which the level, with all before it full, does not fill.
    at = (share * F.col("all_size") - F.col("below")) / F.col("above")
    level = F.min_by(at, F.when(at <= F.col("full"), F.struct("full", "place"))).over(Window.partitionBy())
    return sums.withColumn("level", level).select("source", "source_size", "place", F.least(F.col("weight") * F.col("level"), (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words of it in the mix, repeats counted), source.

    Size is the number of words; null and empty texts have none and are never taken. A null source is a source,
    last in order. Reruns over the same rows agree, rows that repeat id, source and size being interchangeable.
    An empty table gives an empty result. Sources are assumed to be far fewer than documents.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size")), "mix-sizes")
    goal = written(targets(rows, weights, share, most), "mix-targets")
    n, total, goals, smallest = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()[:2] + goal.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.min(F.when(F.col("target") > 0, F.col("target")))).first()[:2]
    block = max(LEAST_BLOCK, int((smallest or 0) / SMALLEST_SLOTS), int(goals / max(MOST_SLOTS, 4 * n)))
    slots = -(-int(goals) // block)

    # Layout: bucket of a document by hash, sums of buckets in order, place within the bucket.
    count = rows.groupBy("source").agg(F.ceil(F.count("*") / BUCKET_DOCS).alias("buckets"))
    goal_count = goal.join(count.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    sized = rows.join(F.broadcast(goal_count) if _few(goal) else goal_count, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = sized.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(seed))).withColumn("bucket", F.pmod("h", "buckets"))
    within = Window.partitionBy("place", "bucket").orderBy("h", "id", "size")
    laid = dealt.withColumn("row_no", F.row_number().over(within)).withColumn("before", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laid = written(laid.select("id", "size", "source_size", "place", "target", "source", "bucket", "row_no", "before"), "mix-layout")
    offsets = laid.groupBy("place", "bucket").agg(F.sum("size").alias("s")).withColumn("offset", F.sum("s").over(Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).drop("s")
    spread = laid.join(offsets, ["place", "bucket"]).withColumn("start", F.col("before") + F.col("offset"))

    # Schedule: slots ranked within their source, block by block.
    taken_blocks = schedule(goal, slots, block, most).groupBy("place", "block").agg(F.count("*").alias("times"))

    # A document's pieces, one for each block that it reaches into.
    piece = spread.withColumn("block", F.explode_outer(F.expr(f"IF(size > 0, sequence(start DIV {block}, (start + size - 1) DIV {block}), array())")))
    part = F.expr(f"least(start + size, (block + 1) * {block}) - greatest(start, block * {block})")
    keys = ["place", "bucket", "row_no", "id", "size", "source_size", "target", "source"]
    return (
        piece.join(taken_blocks, ["place", "block"], "left")
        .groupBy(*keys).agg(F.coalesce(F.sum(part * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "source")
    )


def _few(goal: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources, of which each row is small, may be broadcast: its size is counted."""
    return goal.limit(most + 1).count() <= most


def schedule(goal: DataFrame, slots: int, block: int, most: int = MOST) -> DataFrame:
    """slot, place (of the source), rank, block, pass of every slot of the mix in order."""
    ends = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("target").over(Window.partitionBy())
    lines = (
        goal.where("target > 0")
        .select("place", "source_size", (F.sum("target").over(ends) / whole).alias("upto"), ((F.sum("target").over(ends) - F.col("target")) / whole).alias("from"))
        .withColumn("last", F.max("place").over(Window.partitionBy()) == F.col("place"))
    )
    lines = written(lines, "mix-lines")
    lines = lines.withColumn("cell", F.explode(F.expr(f"sequence(CAST(floor(from * {CELLS}) AS INT), CAST(least({CELLS - 1}, floor(upto * {CELLS})) AS INT))")))
    point = (F.expr(f"(id DIV {1 << 20}) * {GOLDEN_20}D % 1 + (id % {1 << 20}) * {GOLDEN}D")) % 1
    at = lines.sparkSession.range(0, max(slots, 0)).select(F.col("id").alias("slot"), F.expr(f"id DIV {CHUNK}").alias("chunk"), point.alias("point"))
    at = at.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    hit = at.join(F.broadcast(lines) if _few(lines) else lines, "cell").where("point >= from AND (point < upto OR last)").drop("cell")
    counted = hit.groupBy("place", "chunk").agg(F.count("*").alias("n")).withColumn("earlier", F.sum("n").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    ranked = hit.withColumn("own", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1).join(counted, ["place", "chunk"]).withColumn("rank", F.col("own") + F.col("earlier"))
    blocks = F.ceil(F.col("source_size") / block)
    return ranked.withColumn("pass", F.floor(F.col("rank") / blocks)).where(F.col("pass") < most).select("slot", "place", "rank", (F.col("rank") % blocks).alias("block"), "pass")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs as the mix has them, with all their columns, whatever their names: each row as often as taken / size, rounded, says."""
    plan = mix(docs, id_col, text_col, source_col, **options).where("size > 0").select(F.col(id_col).alias("id"), "source", "size", "taken")
    own = Window.partitionBy("id", "source", "size")
    plan = plan.select("id", "source", "size", F.row_number().over(own.orderBy("taken")).alias("n"), F.expr("CAST(floor(taken / size + 0.5) AS INT)").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"))
    rows = rows.withColumn("n", F.row_number().over(own.orderBy(F.xxhash64(F.col("row").cast("string")))))
    d, p = rows.alias("d"), plan.where("copies > 0").alias("p")
    same = F.col("d.id").eqNullSafe(F.col("p.id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")) & (F.col("d.n") == F.col("p.n"))
    return d.join(p, same).select("d.row", F.explode(F.sequence(F.lit(1), "p.copies")).alias("copy")).select("row.*")


def op4_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op4_golden_mix": op4_golden_mix}
ORACLES: dict[str, str] = {}
