"""Queries over the documents as a vault of linked pages: lint, contradictions, pruning, maintenance, health, verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..operators import lint, vector
from ..tables import VAULT_SQL, table, vault_of
from .base import query
from .searches import _LISTED

NOW = "2024-09-01"
_CLEAN = "regexp_replace(trim({c}), '\\.md$', '')"


def _resolved(pages: str) -> str:
    """The oracle's links and relations of a set of pages."""
    return f"""{VAULT_SQL}, pg AS MATERIALIZED (SELECT * FROM vault WHERE {pages}), nm AS (SELECT string_split(path, '/')[-1] AS name, min(path) AS only FROM pg GROUP BY 1 HAVING count(*) = 1),
rel AS MATERIALIZED (SELECT p.path AS from_path, p.relation, p.target, p.category AS from_type, p.valid_from, coalesce(i.path, n.only) AS to_path, t.category AS to_type FROM pg p LEFT JOIN pg i ON {_CLEAN.format(c='p.target')} = i.path LEFT JOIN nm n ON {_CLEAN.format(c='p.target')} = n.name LEFT JOIN pg t ON t.path = coalesce(i.path, n.only)),
l0 AS (SELECT path, unnest(list_distinct(regexp_extract_all(body, '\\[\\[([^\\]\\n]+)\\]\\]', 1))) AS target FROM pg),
lnk AS MATERIALIZED (SELECT l0.path AS from_path, l0.target, coalesce(i.path, n.only) AS to_path FROM l0 LEFT JOIN pg i ON {_CLEAN.format(c='l0.target')} = i.path LEFT JOIN nm n ON {_CLEAN.format(c='l0.target')} = n.name)"""


def _dependents(starts: str, name: str) -> str:
    return f"""{name}1 AS (SELECT DISTINCT to_path AS start, from_path AS path FROM rel WHERE to_path IN ({starts}) AND from_path <> to_path),
{name} AS (SELECT start, path FROM {name}1 UNION SELECT h.start, r.from_path FROM {name}1 h JOIN rel r ON r.to_path = h.path WHERE r.from_path <> h.start)"""


_STALE = f"updated < DATE '{NOW}' - 180"
_GRAMMAR = """CASE WHEN relation = 'fixed_by' AND from_type = 'lessons' THEN 'from lessons' WHEN relation = 'fixed_by' AND to_type = 'lessons' THEN 'to lessons' """ + " ".join(
    f"WHEN relation = '{n}' AND NOT (from_type IN {tuple(a) if len(a) > 1 else '(' + repr(a[0]) + ')'} AND to_type IN {tuple(b)}) THEN 'types'" for n, (a, b) in lint.GRAMMAR.items()
) + " END"
_LINT = f"""{_resolved("kind <> 'raw'")}, {_dependents("SELECT path FROM pg WHERE status = 'superseded'", 'dep')},
orph AS (SELECT path FROM pg WHERE path NOT IN (SELECT to_path FROM rel WHERE to_path IS NOT NULL UNION SELECT to_path FROM lnk WHERE to_path IS NOT NULL)),
issues AS (SELECT 'frontmatter' AS category, path AS page, CASE WHEN status IS NULL THEN 'status' ELSE 'title' END AS detail FROM pg WHERE coalesce(title, '') = '' OR status IS NULL
UNION ALL SELECT 'broken-link', from_path, target FROM lnk WHERE to_path IS NULL UNION ALL SELECT 'broken-relation', from_path, target FROM rel WHERE to_path IS NULL UNION ALL SELECT 'orphan', path, NULL FROM orph
UNION ALL SELECT 'stale', path, CAST(updated AS VARCHAR) FROM pg WHERE status = 'active' AND {_STALE} UNION ALL SELECT 'draft', path, CAST(confidence AS VARCHAR) FROM pg WHERE confidence < 0.5
UNION ALL SELECT DISTINCT 'edge-grammar', from_path, relation || ' ' || {_GRAMMAR} FROM rel WHERE to_path IS NOT NULL AND {_GRAMMAR} IS NOT NULL UNION ALL SELECT 'superseded-dependent', path, start FROM dep)"""


def wiki(spark, sf):
    return vault_of(spark, sf).where("kind <> 'raw'")


@query("lint_issues", f"WITH {_LINT} SELECT category, page, detail FROM issues")
def lint_issues(spark, sf):
    return lint.issues(wiki(spark, sf), NOW)


@query("lint_report", f"WITH {_LINT} SELECT category, count(*) AS issues, count(DISTINCT page) AS pages FROM issues GROUP BY category")
def lint_report(spark, sf):
    return lint.issues(wiki(spark, sf), NOW).groupBy("category").agg(F.count("*").alias("issues"), F.count_distinct("page").alias("pages"))


@query("lint_links", f"WITH {_resolved('kind <> ' + repr('raw'))} SELECT from_path, target, to_path FROM lnk")
def lint_links(spark, sf):
    return lint.links(wiki(spark, sf)).select("from_path", "target", "to_path")


@query("contradictions", f"""WITH {_resolved("kind <> 'raw'")}, p AS (SELECT min((from_path, to_path)) AS m FROM rel WHERE relation = 'contradicts' AND to_path IS NOT NULL GROUP BY least(from_path, to_path), greatest(from_path, to_path)),
pair AS (SELECT m[1] AS page_a, m[2] AS page_b FROM p), {_dependents('SELECT page_a FROM pair UNION SELECT page_b FROM pair', 'dep')}
SELECT 'contradiction' AS reason, page_a, page_b, NULL AS dependent FROM pair UNION ALL SELECT DISTINCT 'derived', page_a, page_b, path FROM pair JOIN dep ON start IN (page_a, page_b) WHERE path NOT IN (page_a, page_b)""")
def contradictions(spark, sf):
    return lint.contradictions(lint.relations(wiki(spark, sf)))


_PRUNE = f"SELECT path, updated, confidence FROM pg WHERE kind <> 'crystal' AND status = 'active' AND confidence < 0.5 AND {_STALE} AND path IN (SELECT path FROM orph)"


@query("prune_pages", f"WITH {_LINT} {_PRUNE}")
def prune_pages(spark, sf):
    return lint.prune(wiki(spark, sf), NOW)


@query("maintenance_scan", f"""WITH {_LINT}, ends AS (SELECT from_path AS path FROM rel WHERE to_path IS NOT NULL UNION SELECT to_path FROM rel UNION SELECT from_path FROM lnk WHERE to_path IS NOT NULL UNION SELECT to_path FROM lnk)
SELECT 'orphan' AS category, path FROM pg WHERE path NOT IN (SELECT path FROM ends WHERE path IS NOT NULL) UNION ALL SELECT 'low-confidence', path FROM pg WHERE confidence < 0.6 UNION ALL SELECT 'stale', path FROM pg WHERE {_STALE}
UNION ALL SELECT DISTINCT 'superseded-dependent', path FROM dep UNION ALL SELECT 'prune', path FROM ({_PRUNE})""")
def maintenance_scan(spark, sf):
    return lint.maintenance(wiki(spark, sf), NOW)


_CLASS = "CASE WHEN relation IN (" + ", ".join(f"'{x}'" for x in params.REASONING_EDGES) + ") THEN 'reasoning' WHEN relation IN (" + ", ".join(f"'{x}'" for x in params.PROVENANCE_EDGES) + ") THEN 'provenance' ELSE 'association' END"
_STATUS = "CASE WHEN value IS NULL THEN 'n/a' " + " ".join(
    f"WHEN id = '{n}' AND value {op} {at} THEN '{s}'" for n, (kind, warn, fail) in lint.THRESHOLDS.items() for op in [{"below": "<", "from": ">=", "above": ">"}[kind]] for at, s in ((fail, "fail"), (warn, "warn"))
) + " ELSE 'pass' END"
_SHARE = "round(100.0::DOUBLE * coalesce(avg(CASE WHEN {t} THEN 1 ELSE 0 END), 0), 2)"
_HEALTH = f"""{_resolved('true')}, ed AS MATERIALIZED (SELECT r.*, {_CLASS.replace('relation', 'r.relation')} AS class, a.kind AS k1, b.kind AS k2 FROM rel r JOIN vault a ON a.path = r.from_path JOIN vault b ON b.path = r.to_path),
ends AS (SELECT from_path AS path, class FROM ed UNION ALL SELECT to_path, class FROM ed), wk AS (SELECT * FROM vault WHERE kind <> 'raw'), rw AS (SELECT * FROM vault WHERE kind = 'raw'),
anch AS (SELECT CASE WHEN k1 = 'raw' THEN from_path ELSE to_path END AS path FROM ed WHERE class <> 'association' AND (k1 = 'raw') <> (k2 = 'raw')), thr AS (SELECT to_path AS path FROM ed WHERE k1 <> 'raw' AND from_type = 'threads'),
win AS (SELECT * FROM rw WHERE created >= (SELECT max(created) FROM rw) - 30), keys AS (SELECT path, array_to_string({_LISTED.format(c='title')}, ' ') AS key FROM wk),
types AS (SELECT relation, count(*) AS n FROM ed WHERE class = 'reasoning' GROUP BY 1), bo AS (SELECT from_path AS near, to_path AS far FROM ed WHERE class = 'reasoning' UNION SELECT to_path, from_path FROM ed WHERE class = 'reasoning'),
c0 AS (SELECT path AS centre, path FROM wk WHERE category = 'projects'), c1 AS (SELECT centre, far AS path FROM c0 JOIN bo ON near = path UNION SELECT * FROM c0), c2 AS (SELECT centre, far AS path FROM c1 JOIN bo ON near = path UNION SELECT * FROM c1),
cn AS MATERIALIZED (SELECT centre, path FROM c2 WHERE path IN (SELECT path FROM wk)), ce AS (SELECT a.centre, count(*) AS e FROM ed JOIN cn a ON a.path = from_path JOIN cn b ON b.path = to_path AND a.centre = b.centre WHERE class = 'reasoning' GROUP BY 1),
dens AS (SELECT n.centre, coalesce(e, 0) / CAST(n * (n - 1) AS DOUBLE) AS density FROM (SELECT centre, count(*) AS n FROM cn GROUP BY 1 HAVING count(*) > 1) n LEFT JOIN ce USING (centre)),
m AS (SELECT 'orphan-episodic' AS id, {_SHARE.format(t='path NOT IN (SELECT path FROM ends)')} AS value FROM rw
UNION ALL SELECT 'salient-episode-anchor-rate', round(100.0::DOUBLE * avg(CASE WHEN path IN (SELECT path FROM anch) THEN 1 ELSE 0 END) FILTER (WHERE importance >= 4), 2) FROM win
UNION ALL SELECT 'narrative-thread-coverage', CASE WHEN (SELECT count(*) FROM wk WHERE category = 'threads') > 0 THEN round(100.0::DOUBLE * avg(CASE WHEN path IN (SELECT path FROM thr) THEN 1 ELSE 0 END), 2) END FROM win
UNION ALL SELECT 'duplicate-entities', CAST(count(*) AS DOUBLE) FROM keys a JOIN keys b ON a.path < b.path AND a.key <> '' AND b.key <> '' AND levenshtein(a.key, b.key) <= 2
UNION ALL SELECT 'edge-type-entropy', round(coalesce(-sum(p * log2(p)), 0), 2) FROM (SELECT n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM types)
UNION ALL SELECT 'cross-galaxy-ratio', {_SHARE.format(t='from_type <> to_type')} FROM ed
UNION ALL SELECT 'hub-overload', CAST(coalesce(max(n), 0) AS DOUBLE) FROM (SELECT count(*) AS n FROM ends WHERE class = 'reasoning' GROUP BY path)
UNION ALL SELECT 'provenance-edge-share', {_SHARE.format(t="class = 'provenance'")} FROM ed UNION ALL SELECT 'association-edge-share', {_SHARE.format(t="class = 'association'")} FROM ed
UNION ALL SELECT 'temporal-coverage', {_SHARE.format(t='valid_from IS NOT NULL')} FROM ed UNION ALL SELECT 'contradiction-coverage', CAST(count(*) FILTER (WHERE relation = 'contradicts') AS DOUBLE) FROM ed
UNION ALL SELECT 'provenance-coverage', {_SHARE.format(t="coalesce(trim(source), '') <> ''")} FROM wk UNION ALL SELECT 'confidence-coverage', {_SHARE.format(t='confidence IS NOT NULL')} FROM wk UNION ALL SELECT 'agent-attribution', {_SHARE.format(t="coalesce(trim(source), '') <> ''")} FROM wk
UNION ALL SELECT 'project-subgraph-density', round(coalesce(min(density), 0), 3) FROM dens
UNION ALL SELECT 'participation-rate', {_SHARE.format(t="path IN (SELECT path FROM ends WHERE class = 'reasoning')")} FROM wk), metrics AS (SELECT id, value, {_STATUS} AS status FROM m)"""


def metrics_of(spark, sf):
    pages = vault_of(spark, sf)
    starts = pages.select(F.col("path").alias("from_path"), "valid_from")
    edges = lint.relations(pages).where("to_path IS NOT NULL").join(starts, "from_path").select("from_path", "to_path", F.col("relation").alias("relation_type"), "valid_from")
    return lint.graph_metrics(pages, edges)


@query("graph_health", f"WITH {_HEALTH} SELECT id, value, status FROM metrics")
def graph_health(spark, sf):
    """The metrics that SQL can express too."""
    return metrics_of(spark, sf).where("id <> 'suggested-thread-count'")


@query("graph_metrics")
def graph_metrics(spark, sf):
    """All seventeen metrics."""
    return metrics_of(spark, sf)


@query("health_status", f"WITH {_HEALTH} SELECT CASE max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'n/a' END AS status FROM metrics")
def health_status(spark, sf):
    """The worst status of all metrics."""
    return lint.worst(graph_health(spark, sf))


@query("verify_report", f"""WITH {_resolved('true')}, c AS (SELECT 'freshness' AS id, CAST(count(*) FILTER (WHERE updated < DATE '{NOW}' - 90) AS DOUBLE) AS value, count(*) AS n FROM vault WHERE kind <> 'raw' AND status = 'active'
UNION ALL SELECT 'overdue', CAST(count(*) AS DOUBLE), 0 FROM vault WHERE status = 'active' AND valid_until < DATE '2024-02-01' UNION ALL SELECT 'relation-coverage', round(100.0::DOUBLE * avg(CASE WHEN path IN (SELECT from_path FROM rel WHERE to_path IS NOT NULL) THEN 1 ELSE 0 END), 2), 0 FROM vault WHERE kind = 'raw'
UNION ALL SELECT 'source-field', CAST(count(*) FILTER (WHERE coalesce(trim(source), '') = '') AS DOUBLE), 0 FROM vault UNION ALL SELECT 'append-only', CAST(count(*) AS DOUBLE), 0 FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)
UNION ALL SELECT 'embedding-integrity', CAST(count(*) FILTER (WHERE embedding IS NULL OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x <> 0)) = 0 OR embedding[1] = 1 AND len(list_filter(embedding[2:], lambda x: x <> 0)) = 0) AS DOUBLE), 0 FROM embeddings)
SELECT id, value, CASE id WHEN 'freshness' THEN CASE WHEN value >= 100 OR value >= 0.3 * n AND n > 0 THEN 'fail' WHEN value >= 20 OR value >= 0.1 * n AND n > 0 THEN 'warn' ELSE 'pass' END WHEN 'overdue' THEN CASE WHEN value >= 3 THEN 'fail' WHEN value > 0 THEN 'warn' ELSE 'pass' END
 WHEN 'relation-coverage' THEN CASE WHEN value < 30 THEN 'warn' ELSE 'pass' END WHEN 'source-field' THEN CASE WHEN value > 2 THEN 'fail' WHEN value > 0 THEN 'warn' ELSE 'pass' END ELSE CASE WHEN value > 0 THEN 'fail' ELSE 'pass' END END AS status FROM c""")
def verify_report(spark, sf):
    """Data checks: how many pages are out of date or overdue, what share of raw pages is linked, missing sources, turns written twice, and broken vectors."""
    pages = vault_of(spark, sf)
    linked = lint.relations(pages).where("to_path IS NOT NULL").select(F.col("from_path").alias("path"), F.lit(True).alias("linked")).distinct()
    count = lambda df, name, test=None: df.agg((F.count("*") if test is None else F.count_if(test)).cast("double").alias("value"), F.count("*").alias("n")).select(F.lit(name).alias("id"), "value", "n")
    raw = pages.where("kind = 'raw'").join(linked, "path", "left")
    found = count(pages.where("kind <> 'raw' AND status = 'active'"), "freshness", F.col("updated") < F.date_sub(F.lit(NOW).cast("date"), 90))
    found = found.union(count(pages.where("status = 'active' AND valid_until < DATE '2024-02-01'"), "overdue"))
    found = found.union(raw.agg(F.round(100 * F.avg(F.coalesce("linked", F.lit(False)).cast("int")), 2).alias("value"), F.count("*").alias("n")).select(F.lit("relation-coverage"), "value", "n"))
    found = found.union(count(pages, "source-field", F.coalesce(F.trim("source"), F.lit("")) == ""))
    found = found.union(count(table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("c")).where("c > 1"), "append-only"))
    found = found.union(count(vector.guard(table(spark, sf, "embeddings").select(F.col("embedding").alias("v")), 64), "embedding-integrity", F.col("reason").isNotNull()))
    v, i = F.col("value"), F.col("id")
    fresh = F.when((v >= 100) | ((v >= 0.3 * F.col("n")) & (F.col("n") > 0)), "fail").when((v >= 20) | ((v >= 0.1 * F.col("n")) & (F.col("n") > 0)), "warn").otherwise("pass")
    status = F.when(i == "freshness", fresh).when(i == "relation-coverage", F.when(v < 30, "warn").otherwise("pass"))
    status = status.when((i == "overdue") & (v >= 3), "fail").when((i == "source-field") & (v > 2), "fail").when(i.isin("overdue", "source-field") & (v > 0), "warn").when(v > 0, "fail").otherwise("pass")
    return found.select("id", "value", F.when(i.isin("overdue", "source-field") & (v == 0), "pass").otherwise(status).alias("status"))
