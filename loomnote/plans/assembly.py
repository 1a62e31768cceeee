"""Queries of context assembly and of checks on what models return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly
from ..tables import EDGES_SQL, PAGES_SQL, edges_of, pages_of, table
from .base import query
from .texts import KINDS_SQL, NET_NEW, PROSE



@query("turn_split", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role AS kind, sha256(text || chr(10)) AS body_sha256 FROM conversations WHERE text IS NOT NULL")
def turn_split(spark, sf):
    part = F.concat(F.lit("## [10:00:00] "), "role", F.lit("\n"), "text", F.lit("\n"))
    logs = table(spark, sf, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "").alias("log"))
    return assembly.split_turns(logs, "conv_id", "log").select("conv_id", "turn", "kind", F.sha2("body", 256).alias("body_sha256"))


@query("chunk_sample", """WITH c AS (SELECT doc_id, CAST(ceil(n_chars / 400.0) AS BIGINT) AS total FROM documents), s AS (SELECT doc_id, total, CASE WHEN total <= 0 THEN [] WHEN total <= 8 THEN range(0, total) ELSE list_sort(list_distinct(list_transform(range(0, 8), lambda i: CAST(floor(i * (total - 1) / 7.0 + 0.5) AS BIGINT)))) END AS p FROM c)
SELECT doc_id, total, array_to_string(p, ',') AS positions FROM s""")
def chunk_sample(spark, sf):
    c = table(spark, sf, "documents").select("doc_id", F.ceil(F.col("n_chars") / 400).alias("total"))
    return c.select("doc_id", "total", F.array_join(assembly.sampled_chunks(F.col("total"), 8).cast("array<string>"), ",").alias("positions"))




@query("fact_validation", """SELECT doc_id, CASE WHEN doc_id % 3 <> 1 AND doc_id % 4 <> 0 THEN lang END AS title, CASE WHEN doc_id % 3 <> 1 AND doc_id % 4 <> 0 THEN 1 END AS facts, CASE WHEN doc_id % 3 <> 1 AND doc_id % 4 <> 0 THEN CAST(greatest(1, least(10, doc_id % 15)) AS INTEGER) END AS importance FROM documents""")
def fact_validation(spark, sf):
    d = F.col("doc_id")
    fence = F.lit("```")
    head = F.when(d % 3 == 0, "Here: ").when(d % 3 == 1, "none").otherwise(F.concat(fence, F.lit("json\n")))
    body = F.concat(F.lit('{"title": " '), "lang", F.lit(' ", "facts": ["'), "source", F.lit('", " "], "narrative": "n", "concepts": ['), F.when(d % 4 == 0, "").otherwise('"c"'), F.lit('], "importance": '), d % 15, F.lit("}"))
    reply = F.concat(head, F.when(d % 3 == 1, "").otherwise(body), F.when(d % 3 == 2, F.concat(F.lit("\n"), fence)).otherwise(""))
    fact = table(spark, sf, "documents").select("doc_id", assembly.fact_of(assembly.json_in(reply)).alias("f"))
    return fact.select("doc_id", "f.title", F.when(F.col("f").isNotNull(), F.size("f.facts")).alias("facts"), "f.importance")


@query("condense_index", """WITH t AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT source, doc_id * 100000 + i AS no, CASE WHEN length(ls[i]) > 80 THEN rtrim(substr(ls[i], 1, 80)) || '...' ELSE ls[i] END AS s FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM t)),
r AS (SELECT source, CAST(sum(strlen(s) + 1) OVER (PARTITION BY source ORDER BY no) AS BIGINT) AS run FROM l) SELECT source, count(*) AS entries, count(*) FILTER (WHERE run - 1 <= 20000) AS kept, coalesce(max(CASE WHEN run - 1 <= 20000 THEN run - 1 END), 0) AS bytes FROM r GROUP BY source""")
def condense_index(spark, sf):
    """Every line of every text is an entry of its source's index."""
    lines = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return assembly.condensed(lines.select("source", (F.col("doc_id") * 100_000 + F.col("i") + 1).alias("line_no"), "line"), "source", 20_000)


@query("context_text", f"""WITH {PAGES_SQL}, b AS (SELECT doc_id // 20 AS k, list(CAST(doc_id AS VARCHAR)) AS links FROM pages_ WHERE kind = 'raw' GROUP BY 1)
SELECT doc_id, substr('# wiki/' || doc_id || chr(10) || '# Type: ' || kind || ' | Lifecycle: ' || lifecycle || chr(10) || '# Tags: ' || array_to_string(list_sort(tags), ', ') || CASE WHEN links IS NULL THEN '' ELSE chr(10) || '# Backlinks: ' || array_to_string(list_transform((list_sort(links))[1:3], lambda x: '[[' || x || ']]'), ', ') || CASE WHEN len(links) > 3 THEN ' (+' || (len(links) - 3) || ' more)' ELSE '' END END, 1, 500) AS context
FROM pages_ LEFT JOIN b ON pages_.doc_id // 20 = b.k""")
def context_text(spark, sf):
    pages = pages_of(spark, sf)
    back = pages.where("kind = 'raw'").groupBy(F.expr("doc_id DIV 20").alias("k")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("links"))
    joined = pages.withColumn("k", F.expr("doc_id DIV 20")).join(back, "k", "left")
    block = assembly.context_block(F.concat(F.lit("wiki/"), "doc_id"), F.col("kind"), F.col("lifecycle"), F.col("tags"), F.coalesce("links", F.array().cast("array<string>")), most=3)
    return joined.select("doc_id", block.alias("context"))


@query("page_detail", f"""WITH {EDGES_SQL}, e AS (SELECT DISTINCT from_path AS path, 'outbound' AS direction, to_path AS other FROM edges_ UNION ALL SELECT DISTINCT to_path, 'inbound', from_path FROM edges_),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path, direction ORDER BY other) AS INTEGER) AS place, count(*) OVER (PARTITION BY path, direction) AS total FROM e WHERE path IN (SELECT 'n/' || n_nationkey FROM nation)) SELECT path, direction, other, place, total FROM r WHERE place <= 20""")
def page_detail(spark, sf):
    pages = table(spark, sf, "nation").select(F.concat(F.lit("n/"), "n_nationkey").alias("path"))
    return assembly.page_detail(pages, edges_of(spark, sf))


@query("topic_overlap", "WITH n AS (SELECT list(DISTINCT upper(lang)) AS names FROM documents) SELECT conv_id, turn, CAST(len(list_intersect(list_distinct(list_transform(['EN', 'Fr', role, 'en'], lambda x: lower(x))), list_transform(names, lambda x: lower(x)))) AS BIGINT) AS score FROM conversations, n")
def topic_overlap(spark, sf):
    names = table(spark, sf, "documents").select(F.upper("lang").alias("l")).distinct().agg(F.collect_list("l").alias("names"))
    return table(spark, sf, "conversations").join(F.broadcast(names)).select("conv_id", "turn", assembly.topic_overlap(F.array(F.lit("EN"), F.lit("Fr"), "role", F.lit("en")), F.col("names")).alias("score"))


# Of every eight turns the first four write or rewrite the page's own text, the others what they say and the text, and a rewrite only the text's first third.
_SHARES = " AND ".join(f"(len({v.format(c='old')}) = 0 OR len(list_intersect({v.format(c='old')}, {v.format(c='body')})) >= {least} * len({v.format(c='old')}))" for v, least in zip(KINDS_SQL.values(), (0.9, 0.8, 0.8), strict=True))


@query("steering", rf"""WITH o AS (SELECT doc_id AS path, turn AS seq, ['write', 'append', 'rewrite', 'append_log'][turn % 4 + 1] AS kind, CASE WHEN turn % 8 < 4 THEN d.text WHEN turn % 4 = 2 THEN substr(d.text, 1, CAST(length(d.text) // 3 AS BIGINT)) ELSE CASE WHEN conv_id % 3 = 0 THEN '## 2024-02-03 said' || chr(10) ELSE '' END || coalesce(c.text, '') || chr(10) || chr(10) || d.text END AS body, d.text AS old FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
new_ AS (SELECT path || '/' || seq AS key, body FROM o WHERE kind IN ('write', 'append')), old_ AS (SELECT path || '/' || seq AS key, old AS body FROM o WHERE kind IN ('write', 'append')), {NET_NEW}
SELECT path, seq, CASE kind WHEN 'rewrite' THEN CASE WHEN {PROSE.replace('part', 'old')} = {PROSE.replace('part', 'body')} OR {_SHARES} THEN 'apply' ELSE 'stage' END WHEN 'append_log' THEN 'apply'
 ELSE CASE WHEN {PROSE.replace('part', 'old')} = '' THEN 'apply' WHEN fresh IS NULL THEN 'skip' WHEN kind = 'append' AND regexp_matches(regexp_replace(body, '^\s+|\s+$', '', 'g'), '(?m)^##\s+\d{{4}}-\d{{2}}-\d{{2}}\b') THEN 'apply' ELSE 'stage' END END AS outcome FROM o LEFT JOIN fresh ON key = path || '/' || seq""")
def steering(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("body"))
    turns = table(spark, sf, "conversations").join(docs, F.col("conv_id") == F.col("path"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("write", "append", "rewrite", "append_log")]), (F.col("turn") % 4 + 1).cast("int"))
    said = F.concat(F.when(F.col("conv_id") % 3 == 0, "## 2024-02-03 said\n").otherwise(""), F.coalesce("text", F.lit("")), F.lit("\n\n"), "body")
    body = F.when(F.col("turn") % 8 < 4, F.col("body")).when(F.col("turn") % 4 == 2, F.expr("substr(body, 1, CAST(length(body) DIV 3 AS INT))")).otherwise(said)
    return assembly.steered(turns.select("path", F.col("turn").alias("seq"), kind.alias("kind"), body.alias("body")), docs)


@query("rebless_plan", """WITH r AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'old' || doc_id END AS hash FROM documents)
SELECT path, CASE WHEN hash = 'old' || path AND path % 2 = 0 THEN 'new' || path ELSE hash END AS hash FROM r""")
def rebless_plan(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("raw_hash"))
    named = lambda p: d.withColumn("hash", F.concat(F.lit(p), "path"))
    current = named("new").withColumn("raw_hash", F.when(F.col("path") % 2 == 0, F.col("raw_hash")).otherwise("changed"))
    records = d.select("path", F.when(F.col("path") % 3 == 0, "stale").otherwise(F.concat(F.lit("old"), "path")).alias("hash"))
    return assembly.blessed(current, named("old"), records)


@query("version_bump", "SELECT doc_id AS path, CASE WHEN quality IS NOT NULL THEN 2 ELSE 1 END AS version, CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END AS history, 8.0::DOUBLE AS strength FROM documents LEFT JOIN labels USING (doc_id)")
def version_bump(spark, sf):
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.array().cast("array<struct<version:int,day:string>>").alias("history"), F.lit(None).cast("double").alias("strength"))
    changed = table(spark, sf, "labels").select(F.col("doc_id").alias("path"))
    return assembly.bumped(pages, changed, "2024-05-01").withColumn("history", F.size("history"))
