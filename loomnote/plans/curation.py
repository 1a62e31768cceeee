"""Queries of curation: noise, costs, headings, clusters, imports and lint."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation
from ..tables import EDGES_SQL, PAGES_SQL, edges_of, pages_of, table
from .base import query


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NOISY = "(" + " OR ".join(f"regexp_matches(x, {_lit(p)})" for p in curation.PAGE_NOISE) + ")"
_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@query("page_noise", f"""WITH {PAGES_SQL}, f AS (SELECT doc_id, title, ['Subagent A ', 'git commit 0123abcd ', 'the prompt ', '', ''][doc_id % 5 + 1] || body AS x FROM pages_),
o AS (SELECT *, CASE WHEN len({_LONG.format(c='title')}) = 0 THEN 0.0 ELSE len(list_intersect({_LONG.format(c='title')}, {_LONG.format(c='x')})) / CAST(len({_LONG.format(c='title')}) AS DOUBLE) END AS overlap FROM f)
SELECT doc_id, CASE WHEN {_NOISY} AND overlap < 0.5 THEN 'drop' WHEN {_NOISY} THEN 'review' ELSE 'keep' END AS verdict FROM o""")
def page_noise(spark, sf):
    marks = F.element_at(F.array(*[F.lit(x) for x in ("Subagent A ", "git commit 0123abcd ", "the prompt ", "", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.concat(marks, "body")
    return pages_of(spark, sf).select("doc_id", curation.page_noise(F.col("title"), text).alias("verdict"))


_FAULT = "CASE WHEN trim(x) = '' THEN 'body is empty' " + " ".join(f"WHEN regexp_matches(x, {_lit(p)}) THEN {_lit(r)}" for p, r in curation.NARRATIVE_FAULTS) + " END"


@query("narrative_check", f"SELECT fault, count(*) AS docs FROM (SELECT {_FAULT} AS fault FROM (SELECT ['', '# ', '- ', '1. ', '```', '|'][doc_id % 6 + 1] || text || CASE WHEN doc_id % 6 = 5 THEN '|' ELSE '' END AS x FROM documents)) GROUP BY fault")
def narrative_check(spark, sf):
    marks = F.element_at(F.array(*[F.lit(x) for x in ("", "# ", "- ", "1. ", "```", "|")]), (F.col("doc_id") % 6 + 1).cast("int"))
    text = F.concat(marks, "text", F.when(F.col("doc_id") % 6 == 5, "|").otherwise(""))
    return table(spark, sf, "documents").groupBy(curation.narrative_fault(text).alias("fault")).agg(F.count("*").alias("docs"))


_PATHS = "['wiki/crystals/', 'wiki/.audit/backfill-', 'wiki/.audit/consolidate-', 'wiki/.audit/', 'wiki/preferences/', 'wiki/tools/']"


@query("source_backfill", f"SELECT inferred, count(*) AS docs FROM (SELECT CASE {' '.join(f'WHEN regexp_matches(p, {_lit(a)}) THEN {_lit(b)}' for a, b in curation.SOURCES)} END AS inferred FROM (SELECT {_PATHS}[doc_id % 6 + 1] || source || '.md' AS p FROM documents)) GROUP BY 1")
def source_backfill(spark, sf):
    roots = _PATHS.strip("[]").replace("'", "").split(", ")
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in roots]), (F.col("doc_id") % 6 + 1).cast("int")), "source", F.lit(".md"))
    return table(spark, sf, "documents").groupBy(curation.source_of(path).alias("inferred")).agg(F.count("*").alias("docs"))


@query("capture_mode", """SELECT event_type, CASE WHEN regexp_matches(props, '"k": 1[0-9]?\\}') THEN 'skip' WHEN event_type = 'view' THEN 'metadata' WHEN event_type = 'click' THEN 'summary' ELSE 'full' END AS mode, count(*) AS n FROM events GROUP BY 1, 2""")
def capture_mode(spark, sf):
    mode = curation.capture_mode(F.col("event_type"), F.col("props"), [r'"k": 1[0-9]?\}'], {"view": "metadata", "click": "summary"})
    return table(spark, sf, "events").groupBy("event_type", mode.alias("mode")).agg(F.count("*").alias("n"))


@query("automation_sessions", "SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING bool_and(coalesce(regexp_matches(text, '(?i)^[a-m]'), false))")
def automation_sessions(spark, sf):
    return curation.automated(table(spark, sf, "conversations"), ["(?i)^[a-m]"])


_PRICES = [("alpha", "small", 0.5, 1.5), ("alpha", "large", 5.0, 15.0), ("beta", "small", 0.25, 1.25)]


@query("cost_estimate", f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _PRICES)}) t(provider, model, price_in, price_out)),
c AS (SELECT event_id, ['alpha', 'beta', 'Ollama'][event_id % 3 + 1] AS provider, ['small', 'large'][event_id % 2 + 1] AS model, user_id * 100 AS tokens_in, event_id % 1000 AS tokens_out FROM events)
SELECT c.provider, c.model, count(*) AS calls, count(*) FILTER (WHERE c.provider <> 'Ollama' AND price_in IS NULL) AS unknown, round(sum(CASE WHEN c.provider = 'Ollama' THEN 0 ELSE tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out END), 6) AS cost FROM c LEFT JOIN p ON p.provider = lower(c.provider) AND p.model = c.model GROUP BY 1, 2""")
def cost_estimate(spark, sf):
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    calls = table(spark, sf, "events").select(pick(["alpha", "beta", "Ollama"], 3).alias("provider"), pick(["small", "large"], 2).alias("model"), (F.col("user_id") * 100).alias("tokens_in"), (F.col("event_id") % 1000).alias("tokens_out"))
    costed = curation.costs(calls, spark.createDataFrame(_PRICES, "provider string, model string, price_in double, price_out double"))
    return costed.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.count_if(F.col("cost").isNull()).alias("unknown"), F.round(F.sum("cost"), 6).alias("cost"))


_MARKED = "l AS (SELECT conv_id, turn, ['# ', '## ', '### ', '', ''][turn % 5 + 1] || role || turn AS line FROM conversations)"


@query("heading_paths", f"""WITH {_MARKED}, h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_replace(line, '^#+\\s+', '')) AS t FROM l)
SELECT a.conv_id, a.turn, concat_ws(' > ',
 (SELECT max_by(t, turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND level = 1),
 (SELECT max_by(t, turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND level = 2 AND b.turn > coalesce((SELECT max(turn) FROM h c WHERE c.conv_id = a.conv_id AND c.turn <= a.turn AND c.level = 1), -1)),
 (SELECT max_by(t, turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND level = 3 AND b.turn > coalesce((SELECT max(turn) FROM h c WHERE c.conv_id = a.conv_id AND c.turn <= a.turn AND c.level IN (1, 2)), -1))) AS path FROM h a""")
def heading_paths(spark, sf):
    marks = F.element_at(F.array(*[F.lit(x) for x in ("# ", "## ", "### ", "", "")]), (F.col("turn") % 5 + 1).cast("int"))
    lines = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.concat(marks, "role", "turn").alias("line"))
    return curation.heading_paths(lines, "conv_id").select("conv_id", F.col("line_no").alias("turn"), "path")


@query("shared_entities", """WITH m AS (SELECT DISTINCT l_suppkey % 50 AS cluster, l_orderkey AS id, l_linestatus AS entity FROM lineitem), s AS (SELECT cluster, count(DISTINCT id) AS m FROM m GROUP BY 1)
SELECT m.cluster, entity, count(DISTINCT id) AS n FROM m JOIN s ON m.cluster = s.cluster GROUP BY m.cluster, entity, s.m HAVING count(DISTINCT id) >= ceil(s.m * 0.5)""")
def shared_entities(spark, sf):
    return curation.shared_entities(table(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("cluster"), F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("entity")))


@query("import_plan", """WITH k AS (SELECT sha256(text) AS hash, 't' || doc_id % 400 AS title, doc_id AS updated FROM documents WHERE doc_id % 2 = 0), e AS (SELECT doc_id AS id, sha256(text) AS hash, 't' || doc_id % 500 AS title, doc_id % 700 AS updated FROM documents), t AS (SELECT title, max(updated) AS known_at FROM k GROUP BY title)
SELECT id, CASE WHEN hash IN (SELECT hash FROM k) THEN 'skip' WHEN known_at IS NULL THEN 'add' WHEN updated > known_at THEN 'conflict' ELSE 'skip' END AS action FROM e LEFT JOIN t USING (title)""")
def import_plan(spark, sf):
    row = lambda n: table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"), F.concat(F.lit("t"), F.col("doc_id") % n).alias("title"))
    return curation.import_plan(row(500).withColumn("updated", F.col("id") % 700), row(400).where("id % 2 = 0").withColumn("updated", F.col("id")))


@query("page_reference_score", """WITH c AS (SELECT doc_id, lower(text) AS x, 'the ' || lang AS title, lang || '-' || source AS slug FROM documents)
SELECT doc_id, CAST((length(x) - length(replace(x, title, ''))) / length(title) + (length(x) - length(replace(x, replace(slug, '-', ' '), ''))) / length(slug) + (length(x) - length(replace(x, slug, ''))) / length(slug) + (length(x) - length(replace(x, lang_, ''))) / length(lang_) AS BIGINT) AS score FROM (SELECT *, substr(title, 1, 3) AS lang_ FROM c)""")
def page_reference_score(spark, sf):
    title, slug = F.concat(F.lit("the "), "lang"), F.concat("lang", F.lit("-"), "source")
    return table(spark, sf, "documents").select("doc_id", curation.reference_score(F.col("text"), title, slug, F.lit("the")).alias("score"))


@query("subgraph_density", f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT from_path, to_path FROM edges_ WHERE relation_type IN ('linked', 'mentions')), l AS (SELECT from_path AS near, to_path AS far FROM e UNION SELECT to_path, from_path FROM e), p AS (SELECT 'r/' || r_regionkey AS path FROM region),
n1 AS (SELECT path AS project, far AS node FROM p JOIN l ON near = path), n AS (SELECT path AS project, path AS node FROM p UNION SELECT * FROM n1 UNION SELECT project, far FROM n1 JOIN l ON near = node),
s AS (SELECT project, count(*) AS nodes FROM n GROUP BY 1 HAVING count(*) > 1), i AS (SELECT a.project, count(*) AS c FROM e JOIN n a ON a.node = from_path JOIN n b ON b.node = to_path AND a.project = b.project GROUP BY 1)
SELECT s.project, nodes, coalesce(c, 0) AS edges, round(coalesce(c, 0) / CAST(nodes * (nodes - 1) AS DOUBLE), 6) AS density FROM s LEFT JOIN i ON s.project = i.project""")
def subgraph_density(spark, sf):
    e = edges_of(spark, sf).where("relation_type IN ('linked', 'mentions')")
    return curation.density(e, table(spark, sf, "region").select(F.concat(F.lit("r/"), "r_regionkey").alias("path")))


@query("embedding_batches", """WITH RECURSIVE o AS (SELECT source AS kind, doc_id AS id, ceil(n_chars / 4.0) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
p AS (SELECT kind, id, place, 0 AS n, 1 AS docs, tokens AS held FROM o WHERE (place - 1) % 4096 = 0 UNION ALL
SELECT o.kind, o.id, o.place, CASE WHEN p.docs >= 64 OR p.held + o.tokens > 20000 THEN p.n + 1 ELSE p.n END, CASE WHEN p.docs >= 64 OR p.held + o.tokens > 20000 THEN 1 ELSE p.docs + 1 END, CASE WHEN p.docs >= 64 OR p.held + o.tokens > 20000 THEN o.tokens ELSE p.held + o.tokens END
FROM p JOIN o ON o.kind IS NOT DISTINCT FROM p.kind AND o.place = p.place + 1 WHERE (o.place - 1) % 4096 <> 0) SELECT kind, id, CAST((place - 1) // 4096 AS VARCHAR) || '-' || CAST(n AS VARCHAR) AS batch FROM p""")
def embedding_batches(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("kind"), F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return curation.batches(docs, 64, 20_000)


def thread_items(spark, sf):
    """Orders as observations: those of fifty customers each are a group, the kinds of their lines the entities."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("entities"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.expr("o_custkey DIV 50").alias("group"), F.to_date("o_orderdate").alias("day"))
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("group", F.col("o_orderkey").alias("id"), "day", "entities")


@query("thread_clusters")
def thread_clusters(spark, sf):
    return curation.thread_clusters(thread_items(spark, sf))


def procedure_items(spark, sf):
    """A user's events of a day as an observation: kinds of event, and each with what it is about, as commands, successful if something was bought."""
    command = F.explode(F.array("event_type", F.concat("event_type", F.get_json_object("props", "$.k"))))
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", command.alias("command"))
    days = rows.groupBy("user_id", "day").agg(F.collect_set("command").alias("commands"), F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    return days.select(F.concat("user_id", F.lit("/"), "day").alias("id"), F.col("user_id").alias("session"), "commands", "ok")


@query("procedure_clusters")
def procedure_clusters(spark, sf):
    return curation.procedure_clusters(procedure_items(spark, sf))
