"""Checks of a vault's pages and relations: lint, contradictions, pruning, maintenance, graph health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, predicates, resolve

LINK = r"\[\[([^\]\n]+)\]\]"
# What the ends of a relation may be.
GRAMMAR = {
    "caused_by": (["issues"], ["issues", "decisions", "tools", "references"]),
    "fixed_by": (["issues"], ["decisions", "procedures", "tools"]),
    "learned_from": (["lessons"], ["issues", "decisions", "procedures"]),
}
# From where on a metric warns or fails; below: it should not be less, else it should not be more.
THRESHOLDS = {
    "salient-episode-anchor-rate": ("below", 75, 50), "duplicate-entities": ("from", 3, 10), "edge-type-entropy": ("below", 0.8, 0.4), "cross-galaxy-ratio": ("above", 99, 99.5),
    "hub-overload": ("above", 200, 650), "temporal-coverage": ("below", 60, 30), "provenance-coverage": ("below", 80, 50), "confidence-coverage": ("below", 70, 40), "contradiction-coverage": ("above", 5, 20),
    "project-subgraph-density": ("below", 0.1, 0.03), "agent-attribution": ("below", 90, 70), "participation-rate": ("below", 50, 25), "narrative-thread-coverage": ("below", 50, 25),
}
WINDOW_DAYS, SALIENT = 30, 4


def links(pages: DataFrame) -> DataFrame:
    """from_path, target, to_path (null if broken) of the distinct [[links]] in the pages' bodies."""
    found = pages.select(F.col("path").alias("from_path"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(LINK), 1))).alias("target"))
    return graph.lint_resolve(found, pages)


def relations(pages: DataFrame) -> DataFrame:
    """from_path, relation, target, to_path (null if broken), and both ends' categories."""
    found = graph.lint_resolve(pages.where("target IS NOT NULL").select(F.col("path").alias("from_path"), "relation", "target", F.col("category").alias("from_type")), pages)
    return found.join(pages.select(F.col("path").alias("to_path"), F.col("category").alias("to_type")), "to_path", "left")


def grammar_fault(relation: Column, from_type: Column, to_type: Column) -> Column:
    """Why a relation between pages of such types is suspect, null if it isn't."""
    out = F.when((relation == "fixed_by") & (from_type == "lessons"), "from lessons").when((relation == "fixed_by") & (to_type == "lessons"), "to lessons")
    for name, (sources, targets) in GRAMMAR.items():
        out = out.when((relation == name) & ~(from_type.isin(sources) & to_type.isin(targets)), "types")
    return out


def orphans(pages: DataFrame, link: DataFrame, relation: DataFrame) -> DataFrame:
    """path of the pages to which no link and no relation leads."""
    inbound = link.select(F.col("to_path").alias("path")).union(relation.select("to_path")).dropna()
    return pages.select("path").join(inbound, "path", "left_anti")


def stale(now: str, days: int = 180) -> Column:
    return F.coalesce(F.col("updated") < F.date_sub(F.lit(now).cast("date"), days), F.lit(False))


def superseded_dependents(pages: DataFrame, relation: DataFrame) -> DataFrame:
    """start, path, via: pages that lead over at most two relations to a superseded page (start)."""
    return graph.dependents(relation.where("to_path IS NOT NULL"), pages.where("status = 'superseded'"))


def issues(pages: DataFrame, now: str) -> DataFrame:
    """category, page, detail: what the eight checks find."""
    link, relation = links(pages), relations(pages)
    row = lambda df, category, page, detail: df.select(F.lit(category).alias("category"), page.alias("page"), detail.cast("string").alias("detail"))
    path = F.col("path")
    fault = grammar_fault(F.col("relation"), F.col("from_type"), F.col("to_type"))
    found = [
        row(pages.where((F.coalesce("title", F.lit("")) == "") | F.col("status").isNull()), "frontmatter", path, F.when(F.col("status").isNull(), "status").otherwise("title")),
        row(link.where("to_path IS NULL"), "broken-link", F.col("from_path"), F.col("target")),
        row(relation.where("to_path IS NULL"), "broken-relation", F.col("from_path"), F.col("target")),
        row(orphans(pages, link, relation), "orphan", path, F.lit(None)),
        row(pages.where((F.coalesce("status", F.lit("active")) == "active") & stale(now)), "stale", path, F.col("updated")),
        row(pages.where("confidence < 0.5"), "draft", path, F.col("confidence")),
        row(relation.where("to_path IS NOT NULL").withColumn("fault", fault).where("fault IS NOT NULL").select("from_path", F.concat_ws(" ", "relation", "fault").alias("d")).distinct(), "edge-grammar", F.col("from_path"), F.col("d")),
        row(superseded_dependents(pages, relation), "superseded-dependent", path, F.col("start")),
    ]
    return reduce(DataFrame.unionByName, found)


def contradictions(relation: DataFrame) -> DataFrame:
    """reason, page_a, page_b, dependent: pairs of pages that contradict (each once, named by the smaller path that says so), and the pages that lead to either over at most two relations."""
    sure = relation.where("to_path IS NOT NULL").select("from_path", "to_path", "relation")
    said = sure.where("relation = 'contradicts'").withColumn("low", F.least("from_path", "to_path")).withColumn("high", F.greatest("from_path", "to_path"))
    pair = said.groupBy("low", "high").agg(F.min(F.struct("from_path", "to_path")).alias("p")).select(F.col("p.from_path").alias("page_a"), F.col("p.to_path").alias("page_b"))
    ends = pair.select(F.col("page_a").alias("path")).union(pair.select("page_b")).distinct()
    near = graph.dependents(sure, ends)
    led = pair.select("*", F.explode(F.array("page_a", "page_b")).alias("start")).join(near, "start").where("path <> page_a AND path <> page_b").select("page_a", "page_b", "path").distinct()
    return pair.select(F.lit("contradiction").alias("reason"), "page_a", "page_b", F.lit(None).cast("string").alias("dependent")).unionByName(led.select(F.lit("derived").alias("reason"), "page_a", "page_b", F.col("path").alias("dependent")))


def prune(pages: DataFrame, now: str) -> DataFrame:
    """path, updated, confidence: active pages that are stale, orphans and of low confidence, crystals aside."""
    alone = orphans(pages, links(pages), relations(pages))
    return pages.where((F.col("kind") != "crystal") & (F.coalesce("status", F.lit("active")) == "active") & (F.col("confidence") < 0.5) & stale(now)).join(alone, "path", "left_semi").select("path", "updated", "confidence")


def maintenance(pages: DataFrame, now: str) -> DataFrame:
    """category, path: pages without any link in or out, of confidence below 0.6, stale, dependent on superseded pages, and candidates for pruning."""
    link, relation = links(pages), relations(pages)
    touched = reduce(DataFrame.union, [x.where("to_path IS NOT NULL").select(F.col(c).alias("path")) for x in (link, relation) for c in ("from_path", "to_path")])
    found = {
        "orphan": pages.select("path").join(touched, "path", "left_anti"), "low-confidence": pages.where("confidence < 0.6"), "stale": pages.where(stale(now)),
        "superseded-dependent": superseded_dependents(pages, relation).select("path").distinct(), "prune": prune(pages, now),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("category"), "path") for name, df in found.items()])


def status(metric: Column, value: Column) -> Column:
    """pass, warn or fail of a metric's value by its thresholds; n/a without a value."""
    out = F.when(value.isNull(), "n/a")
    for name, (kind, warn, fail) in THRESHOLDS.items():
        past = lambda at, kind=kind: value < at if kind == "below" else value >= at if kind == "from" else value > at
        out = out.when((metric == name) & past(fail), "fail").when((metric == name) & past(warn), "warn")
    return out.otherwise("pass")


def worst(rows: DataFrame, by: str = "status") -> DataFrame:
    """One row: the worst status, fail over warn over pass; n/a if there is nothing else."""
    place = F.when(F.col(by) == "fail", 3).when(F.col(by) == "warn", 2).when(F.col(by) == "pass", 1).otherwise(0)
    return rows.agg(F.coalesce(F.max_by(by, place), F.lit("n/a")).alias(by))


def graph_metrics(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """id, value, status of the graph's seventeen metrics.

    pages: path, kind, category, title, status, source, confidence, importance, created, updated; edges between
    them: from_path, to_path, relation_type, valid_from. Wiki metrics leave raw pages out.
    """
    e = edges.withColumn("class", predicates.edge_class(F.col("relation_type")))
    reasoning = e.where("class = 'reasoning'")
    share = lambda test: F.round(100 * F.coalesce(F.avg(test.cast("int")), F.lit(0)), 2)
    one = lambda df, **values: df.agg(F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("id"), v.cast("double").alias("value")) for n, v in values.items()]).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    mark = lambda df, name: df.select("path").distinct().withColumn(name, F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ends = lambda df: df.select(F.explode(F.array("from_path", "to_path")).alias("path"))
    wiki, raw = pages.where("kind <> 'raw'"), pages.where("kind = 'raw'")
    kinds = pages.select("path", "kind", "category")
    ended = e.join(kinds.select(F.col("path").alias("from_path"), F.col("kind").alias("k1"), F.col("category").alias("c1")), "from_path").join(kinds.select(F.col("path").alias("to_path"), F.col("kind").alias("k2"), F.col("category").alias("c2")), "to_path")
    # Raw pages: of all, of the trailing window, and what of it is anchored in the wiki or named by a thread.
    anchored = ended.where("class <> 'association' AND (k1 = 'raw') <> (k2 = 'raw')").select(F.when(F.col("k1") == "raw", F.col("from_path")).otherwise(F.col("to_path")).alias("path"))
    threaded = ended.where("k1 <> 'raw' AND c1 = 'threads'").select(F.col("to_path").alias("path"))
    recent = predicates.trailing_days(raw.withColumn("day", F.coalesce("created", "updated")), "day", WINDOW_DAYS)
    recent = recent.join(mark(anchored, "anchored"), "path", "left").join(mark(threaded, "threaded"), "path", "left")
    salient = F.col("importance") >= SALIENT
    threads = wiki.where("category = 'threads'").limit(1).count() > 0
    rate = lambda test, of: F.round(100 * F.avg(F.when(of, test.cast("int"))), 2)
    degree = raw.select("path").join(mark(ends(e), "linked"), "path", "left")
    known = F.coalesce(F.trim("source"), F.lit("")) != ""
    part = wiki.join(mark(ends(reasoning), "linked"), "path", "left")
    projects = wiki.where("category = 'projects'")
    density = graph.subgraph(reasoning, projects, wiki)
    titles = wiki.select("path", F.array_join(T.scoring_list(F.col("title")), " ").alias("key")).where("key <> ''")
    entity = wiki.where(F.col("category").isin("projects", "issues", "people", "decisions", "tools")).select("path")
    near = reasoning.join(entity.withColumnRenamed("path", "from_path"), "from_path", "left_semi").join(entity.withColumnRenamed("path", "to_path"), "to_path", "left_semi")
    groups = graph.communities(near, least=3).join(mark(ended.where("k1 <> 'raw' AND c1 = 'threads'").select(F.col("to_path").alias("path")), "told"), "path", "left").groupBy("community").agg(F.count("*").alias("n"), F.bool_or(flag("told")).alias("told"))
    found = [
        one(degree, orphan_episodic=share(~flag("linked"))),
        one(recent, salient_episode_anchor_rate=rate(flag("anchored"), salient), narrative_thread_coverage=rate(flag("threaded"), F.lit(threads))),
        one(resolve.close_pairs(titles), duplicate_entities=F.coalesce(F.sum("n"), F.lit(0))),
        graph.entropy(e).select(F.lit("edge-type-entropy").alias("id"), F.round("bits", 2).alias("value")),
        one(ended, cross_galaxy_ratio=share(F.col("c1") != F.col("c2"))),
        one(graph.degrees(reasoning), hub_overload=F.coalesce(F.max("total"), F.lit(0))),
        one(e, provenance_edge_share=share(F.col("class") == "provenance"), association_edge_share=share(F.col("class") == "association"), temporal_coverage=share(F.col("valid_from").isNotNull()), contradiction_coverage=F.count_if(F.col("relation_type") == "contradicts")),
        one(wiki, provenance_coverage=share(known), confidence_coverage=share(F.col("confidence").isNotNull()), agent_attribution=share(known)),
        one(density, project_subgraph_density=F.round(F.coalesce(F.min("density"), F.lit(0)), 3)),
        one(part, participation_rate=share(flag("linked"))),
        one(groups.where("n >= 3 AND NOT told"), suggested_thread_count=F.count("*")),
    ]
    return reduce(DataFrame.unionByName, found).withColumn("status", status(F.col("id"), F.col("value")))


def filter_report(filtered: DataFrame) -> DataFrame:
    """One row of filtered texts (raw, kept: bytes; classes: map of bytes cut by class): sums, reduction in per cent, and the maps' sum by class."""
    total = filtered.agg(F.sum("raw").cast("long").alias("raw_bytes"), F.sum("kept").cast("long").alias("kept_bytes"))
    by_class = filtered.select(F.explode("classes").alias("c", "b")).groupBy("c").agg(F.sum("b").cast("long").alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("c", "b"))).alias("classes"))
    return total.join(F.broadcast(by_class)).select("raw_bytes", "kept_bytes", F.round(F.when(F.col("raw_bytes") > 0, 100 * (F.col("raw_bytes") - F.col("kept_bytes")) / F.col("raw_bytes")).otherwise(0.0), 2).alias("reduction"), "classes")
