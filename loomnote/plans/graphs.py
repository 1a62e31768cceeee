"""Queries over the typed-edge graph: degrees, neighbourhoods, activation, health, links and rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params
from ..operators import graph, lint, predicates, tables
from ..tables import EDGES_SQL, PAGES_SQL, edges_of, pages_of, table, vault_of
from .base import query

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_CLASS = f"CASE WHEN relation_type IN ({_IN(params.REASONING_EDGES)}) THEN 'reasoning' WHEN relation_type IN ({_IN(params.PROVENANCE_EDGES)}) THEN 'provenance' ELSE 'association' END"
_BOTH = "both_ AS (SELECT from_path AS near, to_path AS far, relation_type, kind FROM edges_ UNION ALL SELECT to_path, from_path, relation_type, kind FROM edges_)"
_SEEDS = "seeds AS (SELECT 'o/' || o_orderkey AS path FROM orders WHERE o_orderpriority = '1-URGENT')"


def seeds_of(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o/"), "o_orderkey").alias("path"))


@query("edge_class_mix", f"WITH {EDGES_SQL} SELECT {_CLASS} AS edge_class, relation_type, count(*) AS edges FROM edges_ GROUP BY 1, 2")
def edge_class_mix(spark, sf):
    return edges_of(spark, sf).groupBy(predicates.edge_class(F.col("relation_type")).alias("edge_class"), "relation_type").agg(F.count("*").alias("edges"))


@query("edge_traversable", f"WITH {EDGES_SQL} SELECT relation_type, count(*) AS edges FROM edges_ WHERE coalesce(trim(superseded_by), '') = '' AND (valid_to IS NULL OR valid_to >= DATE '1998-01-01') GROUP BY 1")
def edge_traversable(spark, sf):
    return predicates.traversable(edges_of(spark, sf), "1998-01-01").groupBy("relation_type").agg(F.count("*").alias("edges"))


@query("node_degree", f"WITH {EDGES_SQL}, e AS (SELECT from_path AS path, 0 AS i, 1 AS o FROM edges_ UNION ALL SELECT to_path, 1, 0 FROM edges_) SELECT path, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound, CAST(count(*) AS BIGINT) AS total FROM e GROUP BY path")
def node_degree(spark, sf):
    return graph.degrees(edges_of(spark, sf))


@query("edge_entropy", f"WITH {EDGES_SQL}, c AS (SELECT count(*) AS n FROM edges_ WHERE relation_type IN ({_IN(params.REASONING_EDGES)}) GROUP BY relation_type) SELECT round(-sum(n / CAST((SELECT sum(n) FROM c) AS DOUBLE) * log2(n / CAST((SELECT sum(n) FROM c) AS DOUBLE))), 6) AS bits FROM c")
def edge_entropy(spark, sf):
    return graph.entropy(edges_of(spark, sf))


@query("backlinks", f"WITH {EDGES_SQL} SELECT to_path, count(DISTINCT from_path) AS sources, min(from_path) AS first_source FROM edges_ WHERE relation_type IN ({_IN(params.PROVENANCE_EDGES)}) GROUP BY to_path")
def backlinks(spark, sf):
    e = edges_of(spark, sf).where(F.col("relation_type").isin(params.PROVENANCE_EDGES))
    return e.groupBy("to_path").agg(F.countDistinct("from_path").alias("sources"), F.min("from_path").alias("first_source"))


@query("graph_expand_1hop", f"WITH {EDGES_SQL}, {_BOTH}, {_SEEDS} SELECT DISTINCT far AS path, 1 AS hop FROM both_ JOIN seeds ON near = path WHERE far NOT IN (SELECT path FROM seeds)")
def graph_expand_1hop(spark, sf):
    return graph.expand(edges_of(spark, sf), seeds_of(spark, sf), 1)


_TWO = """h1 AS (SELECT DISTINCT far AS path FROM {b} JOIN seeds ON near = path WHERE far NOT IN (SELECT path FROM seeds)),
h2 AS (SELECT DISTINCT far AS path FROM {b} JOIN h1 ON near = path WHERE far NOT IN (SELECT path FROM seeds) AND far NOT IN (SELECT path FROM h1))"""


@query("graph_expand_2hop", f"WITH {EDGES_SQL}, {_BOTH}, {_SEEDS}, {_TWO.format(b='both_')} SELECT path, 1 AS hop FROM h1 UNION ALL SELECT path, 2 FROM h2")
def graph_expand_2hop(spark, sf):
    return graph.expand(edges_of(spark, sf), seeds_of(spark, sf), 2)


@query("dependents_2hop", f"""WITH {EDGES_SQL}, seeds AS (SELECT 'n/' || n_nationkey AS path FROM nation), h1 AS (SELECT from_path AS path, min(to_path) AS via FROM edges_ JOIN seeds ON to_path = path WHERE from_path NOT IN (SELECT path FROM seeds) GROUP BY 1),
h2 AS (SELECT e.from_path AS path, min(e.to_path) AS via FROM edges_ e JOIN h1 ON e.to_path = h1.path WHERE e.from_path NOT IN (SELECT path FROM seeds) AND e.from_path NOT IN (SELECT path FROM h1) GROUP BY 1) SELECT path, via, 1 AS hop FROM h1 UNION ALL SELECT path, via, 2 FROM h2""")
def dependents_2hop(spark, sf):
    e = edges_of(spark, sf).select("from_path", "to_path")
    start = table(spark, sf, "nation").select(F.concat(F.lit("n/"), "n_nationkey").alias("path"))
    back = lambda known: e.join(known, e["to_path"] == known["path"]).groupBy("from_path").agg(F.min("to_path").alias("via")).withColumnRenamed("from_path", "p")
    h1 = back(start).join(start, F.col("p") == F.col("path"), "left_anti").select(F.col("p").alias("path"), "via", F.lit(1).alias("hop"))
    seen = start.unionByName(h1.select("path"))
    h2 = back(h1.select("path")).join(seen, F.col("p") == F.col("path"), "left_anti").select(F.col("p").alias("path"), "via", F.lit(2).alias("hop"))
    return h1.unionByName(h2)


_WEIGHT = "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in params.EDGE_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


def _round(n: int) -> str:
    """One unrolled round of activation from f{n-1} and the nodes reached so far, r{n-1}."""
    return f"""c{n} AS (SELECT f.path AS near, b.far, sum(f.activation * {_WEIGHT} * 0.6::DOUBLE) AS c FROM f{n - 1} f JOIN both_ b ON b.near = f.path ANTI JOIN r{n - 1} r ON r.path = b.far GROUP BY 1, 2),
k{n} AS (SELECT near, far, c, row_number() OVER (PARTITION BY near ORDER BY c DESC, far DESC) AS p, max(c) OVER (PARTITION BY near) AS m FROM c{n}), s{n} AS (SELECT near, max(c) FILTER (WHERE p = 2) AS second FROM k{n} GROUP BY near),
t{n} AS (SELECT far AS path, sum(c) - 0.15::DOUBLE * sum(CASE WHEN p = 1 THEN coalesce(second, 0) ELSE m END) AS activation FROM k{n} JOIN s{n} USING (near) GROUP BY far), f{n} AS MATERIALIZED (SELECT * FROM t{n} WHERE activation > 0.01), r{n} AS MATERIALIZED (SELECT * FROM r{n - 1} UNION ALL SELECT * FROM f{n})"""


@query("spreading_activation", f"WITH {EDGES_SQL}, {_BOTH}, {_SEEDS}, f0 AS (SELECT path, 1.0::DOUBLE AS activation FROM seeds), r0 AS (SELECT * FROM f0), {', '.join(map(_round, range(1, 6)))} SELECT path, round(activation + 1e-9::DOUBLE, 5) AS activation FROM r5")
def spreading_activation(spark, sf):
    return graph.activate(edges_of(spark, sf), seeds_of(spark, sf)).select("path", F.round(F.col("activation") + 1e-9, 5).alias("activation"))


def page_links(spark, sf):
    """from_path, to_path of all links and relations between the vault's pages."""
    pages = vault_of(spark, sf)
    link, relation = lint.links(pages), lint.relations(pages)
    return link.select("from_path", "to_path").unionByName(relation.select("from_path", "to_path")).where("to_path IS NOT NULL").distinct()


@query("communities")
def communities(spark, sf):
    """Pages of the vault that links and relations tie together."""
    return graph.communities(page_links(spark, sf))


@query("orphans", f"WITH {EDGES_SQL}, n AS (SELECT 'o/' || o_orderkey AS path FROM orders UNION ALL SELECT 'p/' || p_partkey FROM part UNION ALL SELECT 's/' || s_suppkey FROM supplier UNION ALL SELECT 'c/' || c_custkey FROM customer) SELECT path FROM n WHERE path NOT IN (SELECT to_path FROM edges_)")
def orphans(spark, sf):
    node = lambda t, k, p: table(spark, sf, t).select(F.concat(F.lit(p), k).alias("path"))
    nodes = node("orders", "o_orderkey", "o/").union(node("part", "p_partkey", "p/")).union(node("supplier", "s_suppkey", "s/")).union(node("customer", "c_custkey", "c/"))
    return nodes.join(edges_of(spark, sf).select(F.col("to_path").alias("path")), "path", "left_anti")


@query("graph_feed", f"""WITH {EDGES_SQL}, i AS (SELECT to_path, count(*) AS n FROM edges_ GROUP BY 1), o AS (SELECT from_path, count(*) AS n FROM edges_ GROUP BY 1)
SELECT 's/' || s_suppkey AS path, s_name AS title, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM supplier LEFT JOIN i ON i.to_path = 's/' || s_suppkey LEFT JOIN o ON o.from_path = 's/' || s_suppkey""")
def graph_feed(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.concat(F.lit("s/"), "s_suppkey").alias("path"), F.col("s_name").alias("title"))
    return nodes.join(graph.degrees(edges_of(spark, sf)), "path", "left").select("path", "title", F.coalesce("inbound", F.lit(0)).alias("in_degree"), F.coalesce("outbound", F.lit(0)).alias("out_degree"))


_LINKED = "regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '[[\\1]] \\2', 'g')"


@query("wikilinks", f"SELECT DISTINCT doc_id, trim(unnest(regexp_extract_all({_LINKED}, '\\[\\[([^\\[\\]\\|#]+)(?:[#\\|][^\\[\\]]*)?\\]\\]', 1))) AS target FROM documents")
def wikilinks(spark, sf):
    marked = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "([A-Z][a-z]+) ([a-z]+)", "[[$1]] $2").alias("body"))
    return graph.wikilinks(marked)


_NAME = "lower(split_part(p_name, ' ', 1))"


@query("resolve_links", f"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS raw FROM pages), p AS (SELECT DISTINCT 'wiki/' || lang || '/' || substr(source, 4) || '.md' AS path FROM documents UNION SELECT 'wiki/words/' || regexp_extract(text, '[A-Za-z]+') || '.md' FROM documents WHERE doc_id % 3 = 0 AND regexp_extract(text, '[A-Za-z]+') <> ''),
f AS (SELECT DISTINCT path, unnest([path, regexp_replace(path, '\\.md$', ''), regexp_extract(path, '[^/]*$'), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', '')]) AS form FROM p), k AS (SELECT form, count(DISTINCT path) AS n, min(path) AS p FROM f GROUP BY form)
SELECT raw, count(*) AS links, CASE WHEN any_value(n) = 1 THEN any_value(p) END AS to_path, CASE WHEN any_value(n) IS NULL THEN 'not-found' WHEN any_value(n) > 1 THEN 'ambiguous' END AS reason FROM l LEFT JOIN k ON raw = form GROUP BY raw""")
def resolve_links(spark, sf):
    links = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("raw")).groupBy("raw").agg(F.count("*").alias("links"))
    docs = table(spark, sf, "documents")
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    a = docs.select(F.concat(F.lit("wiki/"), "lang", F.lit("/"), F.substring("source", 4, 9), F.lit(".md")).alias("path"))
    b = docs.where((F.col("doc_id") % 3 == 0) & (word != "")).select(F.concat(F.lit("wiki/words/"), word, F.lit(".md")).alias("path"))
    return graph.resolve(links, a.union(b).distinct())


@query("ground_relations", f"WITH {EDGES_SQL} SELECT relation_type, count(*) AS edges FROM edges_ WHERE to_path IN (SELECT 's/' || s_suppkey FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'p/' || p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def ground_relations(spark, sf):
    pages = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s/"), "s_suppkey").alias("path")).union(table(spark, sf, "part").where("p_size > 25").select(F.concat(F.lit("p/"), "p_partkey")))
    return tables.ground(edges_of(spark, sf), pages).groupBy("relation_type").agg(F.count("*").alias("edges"))


@query("alias_rewrite", f"WITH {EDGES_SQL}, a AS (SELECT 's/' || s_suppkey AS alias, 's/' || (s_suppkey // 10 * 10 + 1) AS canonical FROM supplier) SELECT to_path, count(*) AS edges FROM (SELECT DISTINCT from_path, coalesce(canonical, to_path) AS to_path, relation_type FROM edges_ LEFT JOIN a ON to_path = alias) WHERE to_path LIKE 's/%' GROUP BY 1")
def alias_rewrite(spark, sf):
    aliases = table(spark, sf, "supplier").select(F.concat(F.lit("s/"), "s_suppkey").alias("alias"), F.concat(F.lit("s/"), F.expr("s_suppkey DIV 10 * 10 + 1")).alias("canonical"))
    return tables.retarget(edges_of(spark, sf).select("from_path", "to_path", "relation_type"), aliases).where("to_path LIKE 's/%'").groupBy("to_path").agg(F.count("*").alias("edges"))


@query("relation_order", f"""WITH {EDGES_SQL}, e AS (SELECT from_path, to_path, CASE WHEN length(to_path) % 3 <> 0 THEN round((length(to_path) + ascii(right(to_path, 1)) % 10) / 20.0::DOUBLE, 3) END AS confidence FROM edges_ WHERE relation_type = 'depends_on')
SELECT from_path, string_agg(to_path, ',' ORDER BY confidence DESC NULLS LAST, to_path) AS targets FROM e GROUP BY from_path""")
def relation_order(spark, sf):
    conf = F.when(F.length("to_path") % 3 != 0, F.round((F.length("to_path") + F.ascii(F.right("to_path", F.lit(1))) % 10) / 20, 3))
    e = edges_of(spark, sf).where("relation_type = 'depends_on'").select("from_path", "to_path", conf.alias("confidence"))
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce(-F.col("confidence"), F.lit(9.0)).alias("o"), "to_path")))
    return e.groupBy("from_path").agg(F.array_join(F.transform(listed, lambda x: x["to_path"]), ",").alias("targets"))


@query("triples_to_edges", """WITH t AS (SELECT l_orderkey AS subject, 'supplier#' || lpad(CAST(l_suppkey % 150 AS VARCHAR), 9, '0') AS object, l_returnflag AS predicate FROM lineitem), n AS (SELECT lower(s_name) AS key, min(s_suppkey) AS id, count(*) AS c FROM supplier GROUP BY 1)
SELECT CASE predicate WHEN 'R' THEN 'contradicts' WHEN 'A' THEN 'supersedes' ELSE 'uses' END AS relation_type, id AS to_id, count(*) AS edges FROM t JOIN n ON t.object = n.key AND n.c = 1 GROUP BY 1, 2""")
def triples_to_edges(spark, sf):
    facts = table(spark, sf, "lineitem").select(F.concat(F.lit("supplier#"), F.lpad((F.col("l_suppkey") % 150).cast("string"), 9, "0")).alias("object"), "l_returnflag")
    names = table(spark, sf, "supplier").groupBy(F.lower("s_name").alias("object")).agg(F.min("s_suppkey").alias("to_id"), F.count("*").alias("c")).where("c = 1")
    relation = F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "supersedes").otherwise("uses")
    return facts.join(names, "object").groupBy(relation.alias("relation_type"), "to_id").agg(F.count("*").alias("edges"))


def _suppress(n: int) -> str:
    """One unrolled pass: the best of the links left, and the links without targets that too many took."""
    return f"""b{n} AS MATERIALIZED (SELECT raw, arg_max(target, (score, target)) AS target FROM l{n - 1} GROUP BY raw), l{n} AS MATERIALIZED (SELECT * FROM l{n - 1} WHERE target NOT IN (SELECT target FROM b{n} GROUP BY target HAVING count(*) > 0.05 * (SELECT count(*) FROM pages)))"""


@query("mass_collision", f"""WITH l0 AS (SELECT raw, target, count(*) AS score FROM (SELECT page_id AS raw, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS target FROM pages) GROUP BY ALL),
{', '.join(map(_suppress, range(1, 40)))} SELECT raw, target FROM b39""")
def mass_collision(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select(F.col("page_id").alias("raw"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("target")).groupBy("raw", "target").agg(F.count("*").alias("score"))
    return tables.collisions(links, pages.count(), 0.05)


@query("facts_by_concept", f"""WITH {PAGES_SQL}, f AS (SELECT doc_id, lang AS concept, doc_id % 10 + 1 AS importance FROM pages_ WHERE kind <> 'raw' UNION ALL SELECT doc_id, source, doc_id % 10 + 1 FROM pages_ WHERE kind <> 'raw'), g AS (SELECT *, count(*) OVER (PARTITION BY concept) AS c, row_number() OVER (PARTITION BY concept ORDER BY importance DESC, doc_id) AS n FROM f WHERE importance >= 4)
SELECT concept, doc_id, importance, CAST(n AS INTEGER) AS n FROM g WHERE c >= 3 AND n <= 8""")
def facts_by_concept(spark, sf):
    facts = pages_of(spark, sf).where("kind <> 'raw'").select("doc_id", F.explode("tags").alias("concept"), (F.col("doc_id") % 10 + 1).alias("importance")).where("importance >= 4")
    enough = facts.groupBy("concept").agg(F.count("*").alias("c")).where("c >= 3").select("concept")
    w = Window.partitionBy("concept").orderBy(F.desc("importance"), "doc_id")
    return facts.join(enough, "concept", "left_semi").withColumn("n", F.row_number().over(w)).where("n <= 8").select("concept", "doc_id", "importance", "n")
