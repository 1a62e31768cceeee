"""Links for captures that have none: mentions consolidated into typed relations, and vectors or titles that tie them to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from . import predicates, resolve, tables, vector

#: How many of the best scores show that vectors say nothing, from which score on, and the dimensions that a vector needs.
TOP, SAME, LEAST_DIM = 3, 0.999, 16


def mention_confidence(score: Column, floor: float) -> Column:
    """Confidence of a full-text mention, from 0.5 at the floor to 0.8 at twice that."""
    return F.least(F.lit(0.8), F.greatest(F.lit(0.5), 0.5 + (score - floor) / floor * 0.3))


def consolidated(observations: DataFrame, lexical: DataFrame, bm25: DataFrame, pages: DataFrame, least: float = 0.6, most: int = 5, force: bool = False) -> DataFrame:
    """id, target, relation, confidence, source, place: the relations that observations (id, linked) should get from mentions of titles (id, target, position, confidence) and by full text (id, target, confidence) of pages (target, path, title).

    Mentions of both kinds are one, of the higher confidence. Of an observation's the best ``most`` of ``least`` at least
    stay, in order of confidence, position in the text (those without last) and path; an observation that is linked
    already has none, unless forced. The relation follows from the page's section and title and the kind of mention.
    """
    open_ = observations if force else observations.where(~F.coalesce("linked", F.lit(False)))
    both = resolve.combine_mentions(lexical.drop("position"), bm25).where(F.col("confidence") >= least).join(open_.select("id"), "id", "left_semi")
    seen = both.join(lexical.select("id", "target", "position"), ["id", "target"], "left").join(pages.select("target", "path", "title"), "target")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("confidence"), F.asc_nulls_last("position"), "path"))
    ranked = seen.withColumn("place", place).where(F.col("place") <= most)
    return ranked.select("id", "target", predicates.edge_type_for(F.col("path"), F.col("title"), F.col("source")).alias("relation"), F.round("confidence", 3).alias("confidence"), "source", "place")


def degenerate(raw: DataFrame, wiki: DataFrame, dim: int | None = None, least_dim: int | None = None) -> DataFrame:
    """raw_id, reason of the raw vectors (raw_id, v) that say nothing about pages' (page_id, v): dimension (too few or other ones, its own or among the first pages'), collision (zero, a stand-in, or a page's very vector), top-k-collision (its best scores are all one)."""
    usable = lambda v: (F.size(v) >= (least_dim or LEAST_DIM)) & (F.size(v) == dim if dim else F.lit(True))
    heads = wiki.orderBy("page_id").limit(TOP).agg(F.coalesce(F.bool_and(usable(F.col("v"))), F.lit(True)).alias("fit"), F.collect_set(F.size("v")).alias("sizes"))
    fits = usable(F.col("v")) & F.col("fit") & (F.size(F.array_union("sizes", F.array(F.size("v")))) <= 1 if not dim else F.lit(True))
    sized = raw.join(F.broadcast(heads)).select("raw_id", "v", (~fits).alias("wrong"))  # one row
    same = raw.select("raw_id", F.to_json("v").alias("j")).join(wiki.select(F.to_json("v").alias("j")).distinct(), "j", "left_semi").select("raw_id", F.lit(True).alias("same"))
    why = F.when(F.col("wrong"), "dimension").when(vector.zero(F.col("v")) | vector.stub(F.col("v")) | F.col("same"), "collision")
    judged = written(sized.join(same.distinct(), "raw_id", "left").select("raw_id", "v", why.alias("reason")), "link-judged")
    # Only vectors that nothing else rules out are compared with the pages'.
    scores = vector.nearest(wiki.select(F.col("page_id").alias("id"), "v"), judged.where("reason IS NULL").select(F.col("raw_id").alias("query_id"), F.col("v").alias("q")), TOP, -1.0)
    flat = scores.groupBy(F.col("query_id").alias("raw_id")).agg(F.count("*").alias("n"), F.min("score").alias("low")).where((F.col("n") >= 2) & (F.col("low") >= SAME)).select("raw_id", F.lit("top-k-collision").alias("flat"))
    return judged.join(flat, "raw_id", "left").select("raw_id", F.coalesce("reason", "flat").alias("reason")).where("reason IS NOT NULL")


def auto_linked(raw: DataFrame, raw_vectors: DataFrame, pages: DataFrame, page_vectors: DataFrame, least: float = 0.65, least_title: float = 0.55, most: int = 3, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (raw_id, page_id, score, strategy) for raw texts (raw_id, raw, linked), and those without any (raw_id, reason).

    A raw text goes by its vector (raw_id, v) if it has one that is not degenerate and pages have vectors (page_id, v),
    by cosine of ``least`` at least; else by titles (page_id, title, summary), score ``least_title`` at least; ``most``
    each, best first, ties by page. Texts that are linked already are left out: "raw already has relations".
    """
    open_ = raw.where(~F.coalesce("linked", F.lit(False)))
    own = raw_vectors.join(open_.select("raw_id"), "raw_id", "left_semi")
    bad = written(degenerate(own, page_vectors, dim), "link-degenerate")
    by_vector = own.join(bad.select("raw_id"), "raw_id", "left_anti") if not page_vectors.isEmpty() else own.limit(0)
    near = vector.nearest(page_vectors.select(F.col("page_id").alias("id"), "v"), by_vector.select(F.col("raw_id").alias("query_id"), F.col("v").alias("q")), most, least)
    one = near.select(F.col("query_id").alias("raw_id"), F.col("id").alias("page_id"), "score", F.lit("embedding").alias("strategy"))
    rest = open_.join(by_vector.select("raw_id"), "raw_id", "left_anti").select("raw_id", "raw")
    two = resolve.title_score(rest, pages, most, least_title).select("raw_id", "page_id", "score", F.lit("title").alias("strategy"))
    links = written(one.unionByName(two), "links")
    without = raw.join(links.select("raw_id").distinct(), "raw_id", "left_anti").join(bad, "raw_id", "left")
    why = F.when(F.coalesce("linked", F.lit(False)), "raw already has relations").when(F.col("reason").isNotNull(), "degenerate embeddings").otherwise("no match")
    return links, without.select("raw_id", why.alias("reason"))


def with_mentions(edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges (from_path, to_path, confidence) with the links (raw_id, page_id, score) that are not there yet."""
    return tables.new_mentions(edges, links.select(F.col("raw_id").alias("from_path"), F.col("page_id").alias("to_path"), F.col("score").alias("confidence")))
