"""Filters and row-wise classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import text as T
from .order import running


def valid_as_of(pages: DataFrame, as_of: str, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Pages valid on a day, both ends included; a missing bound does not limit."""
    day = F.lit(as_of).cast("date")
    return pages.where((F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day)))


def identity_filter(pages: DataFrame, agent: str | None = None, user: str | None = None, strict: bool = False) -> DataFrame:
    """Pages of an identity. Strict: every asked dimension must match. Else pages without tags pass too, but not those tagged on another dimension alone."""
    asked = [(c, v) for c, v in (("agent_id", agent), ("user_id", user)) if v is not None]
    if not asked:
        return pages
    if strict:
        test = F.lit(True)
        for c, v in asked:
            test &= F.coalesce(F.col(c) == v, F.lit(False))
        return pages.where(test)
    untagged = F.col("agent_id").isNull() & F.col("user_id").isNull()
    match = F.lit(True)
    for c, v in asked:
        match &= F.coalesce(F.col(c) == v, F.lit(False))
    return pages.where(untagged | match)


def traversable(edges: DataFrame, as_of: str | None = None) -> DataFrame:
    """Edges that are not superseded and have not ended before a day."""
    open_ = F.coalesce(F.trim("superseded_by"), F.lit("")) == ""
    if as_of is None:
        return edges.where(open_)
    return edges.where(open_ & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of).cast("date"))))


def list_pages(pages: DataFrame, kind: str | None = None, tag: str | None = None, status: str | None = None) -> DataFrame:
    for test in (kind and F.col("kind") == kind, tag and F.array_contains("tags", tag), status and F.col("status") == status):
        if test is not None:
            pages = pages.where(test)
    return pages


def trailing_days(rows: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last days up to the latest day, both ends included. The latest day is one row, so it is broadcast."""
    upper = rows.agg(F.max(day).alias("__upper"))
    return rows.join(F.broadcast(upper), F.col(day).between(F.date_sub("__upper", days), F.col("__upper"))).drop("__upper")


def intent(query: Column) -> tuple[Column, Column]:
    """Label and confidence of a query by the first matching rule; open-ended with 0.5 else."""
    low = F.lower(F.trim(query))
    label, sure = None, None
    for pattern, name, confidence in params.INTENT_RULES:
        hit = low.rlike(pattern)
        label = label.when(hit, name) if label is not None else F.when(hit, name)
        sure = sure.when(hit, confidence) if sure is not None else F.when(hit, confidence)
    return label.otherwise("open-ended"), sure.otherwise(0.5)


def edge_class(relation: Column) -> Column:
    return F.when(relation.isin(params.REASONING_EDGES), "reasoning").when(relation.isin(params.PROVENANCE_EDGES), "provenance").otherwise("association")


def edge_type_for(path: Column, title: Column, source: Column) -> Column:
    """Relation type suggested for a mention, by section, title and source."""
    section = lambda s: path.like(f"wiki/{s}/%.md")
    return (
        F.when(section("tools"), "uses").when(section("crystals"), "derived_from").when(title.rlike("(?i)deprecated|superseded-by"), "supersedes")
        .when((source == "bm25") & (section("decisions") | section("lessons")), "derived_from").otherwise("mentions")
    )


def dispatch(conflict: Column, similarity: Column, threshold: Column, newer: Column) -> Column:
    authority = (similarity >= threshold) & newer
    return (
        F.when(conflict == "noop", "noop").when(~F.coalesce(authority, F.lit(False)), "rewrite_page")
        .when(conflict == "contradiction", "dispute_page").when(conflict == "supersession", "supersede_page").otherwise("rewrite_page")
    )


def cognitive_type(kind: Column, category: Column, status: Column, inbound: Column, day: Column, now: str) -> Column:
    age = F.datediff(F.lit(now).cast("date"), day)
    return (
        F.when(category == "crystals", "semantic").when(category == "prospective", "prospective").when(category == "threads", "episodic")
        .when(category == "procedures", "procedural").when((category == "projects") & (status == "active") & (inbound >= 5), "core")
        .when(category.isin("tools", "lessons"), "procedural").when(category.isin("references", "decisions"), "semantic")
        .when((kind == "raw") & age.between(0, 30), "episodic").otherwise("semantic")
    )


def lifecycle(explicit: Column, kind: Column, confidence: Column) -> Column:
    return F.coalesce(explicit, F.when(kind == "raw", "observed").when((kind == "wiki") & (confidence >= 0.6), "canonical").otherwise("proposed"))


def normal_confidence(extraction: Column, source: Column, default: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(extraction, source, F.lit(default))))


def proposal_confidence(stripped: Column, leaks: Column, commands: Column, observations: Column, sessions: Column) -> tuple[Column, Column]:
    """Level and reasons: high only if nothing was stripped and there are 5 observations in 2 sessions."""
    reasons = F.array_compact(F.array(
        F.when(stripped != 0, F.concat(F.lit("strippedReferenceCount="), stripped)), F.when(leaks != 0, F.concat(F.lit("prosePathLeaksCount="), leaks)),
        F.when(commands != 0, F.concat(F.lit("commandsStripped="), commands)),
        F.when(observations < 5, F.concat(F.lit("observationCount="), observations, F.lit(" below threshold 5"))),
        F.when(sessions < 2, F.concat(F.lit("distinctSessions="), sessions, F.lit(" below threshold 2"))),
    ))
    return F.when(F.size(reasons) == 0, "high").otherwise("low"), F.when(F.size(reasons) == 0, F.array(F.lit("all signals clean"))).otherwise(reasons)


def provenance_tier(kind: Column, confidence: Column, facts: Column, derived: Column) -> Column:
    thin = (facts <= 1) & (derived <= 1)
    weak = F.coalesce(confidence < 0.5, F.lit(False))
    return F.when((kind == "wiki") & (thin | weak), "low").when((confidence.isNull() | (confidence >= 0.9)) & (facts >= 3) & (derived >= 2), "high").otherwise("medium")


def metadata_score(status: Column, stage: Column, validation: Column, confidence: Column, day: Column, now: str) -> Column:
    """Prior of a page: status, lifecycle and validation factors, confidence and recency, at most 1."""
    factor = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c], F.lit(1.0))
    age = F.datediff(F.lit(now).cast("date"), day)
    recent = F.when(age.between(0, params.RECENCY_DAYS), 1 + params.RECENCY_BOOST).otherwise(1.0)
    return F.least(F.lit(1.0), factor(params.STATUS_FACTOR, F.lower(status)) * factor(params.LIFECYCLE_FACTOR, stage) * factor(params.VALIDATION_FACTOR, validation) * F.coalesce(confidence, F.lit(params.DEFAULT_CONFIDENCE)) * recent)


def grep_context(docs: DataFrame, pattern: str, context: int = 2, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, line_no (from 1), line, hit: the matching lines and those up to ``context`` lines around, document by document."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1).withColumn("hit", F.col("line").rlike(pattern))
    near = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(-context, context)
    return lines.withColumn("near", F.max("hit").over(near)).where("near").drop("near")


def byte_budget(files: DataFrame, budget: int, by_order: str = "path", size: str = "size", group: str | None = None) -> DataFrame:
    """The newest files (highest order) until the running size reaches the budget; the newest always stays."""
    summed = running(files, [group] if group else [], [F.desc(by_order)], __sum=F.col(size).cast("long"))
    return summed.where(F.col("__sum") - F.col(size) < budget).drop("__sum")


def scope(pages: DataFrame, kind: str = "all") -> DataFrame:
    """Pages of a kind, or all."""
    return pages if kind == "all" else pages.where(F.col("kind") == kind)


def crystals(pages: DataFrame) -> DataFrame:
    """Pages that are crystals, by kind or type."""
    return pages.where(F.lower("kind").isin("crystal", "crystals") | (F.lower("type").isin("crystal", "crystals") if "type" in pages.columns else F.lit(False)))


def needs_expansion(query: Column, hits: Column) -> Column:
    """Whether a query should be expanded by a made-up answer: five words at most, or nothing found."""
    return (F.size(T.tokens(query)) <= 5) | (hits == 0)


def recent(day: Column, now: str, days: int) -> Column:
    """Whether a day is at most so many days ago, and not to come."""
    return F.coalesce(F.datediff(F.lit(now).cast("date"), day).between(0, days), F.lit(False))


def captures(files: DataFrame) -> DataFrame:
    """files (path) with day, source and session as their names say: raw/<day>/<source>-<session>.md."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.withColumns({"day": T.path_day(F.col("path")), "source": F.regexp_extract(name, r"^([a-z]+(?:-[a-z]+)*)-", 1), "session": F.regexp_extract(name, r"^[a-z]+(?:-[a-z]+)*-(.+)$", 1)})


def refreshing(facts: DataFrame, now: str, needle: str, days: int = 14) -> DataFrame:
    """doc_id, k of facts (doc_id, updated, body, fact) of the last days whose page names the needle: each once by its text in lower case and single blanks (k), with the smallest doc_id."""
    new = facts.where((F.col("updated") > F.date_sub(F.lit(now).cast("date"), days)) & (F.col("updated") <= F.lit(now).cast("date")) & F.contains(F.lower("body"), F.lower(F.lit(needle))))
    return new.groupBy(F.trim(F.regexp_replace(F.lower("fact"), r"\s+", " ")).alias("k")).agg(F.min("doc_id").alias("doc_id"))
