"""The given tables, and the views over them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The first three words, found without reading on.
_FIRST_WORDS = "^" + r"[^A-Za-z]*+([A-Za-z]++)?" * 3


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memory pages: doc_id, body, lang, source, kind, title, tags, status, lifecycle, validation, confidence, created, updated, valid_from, valid_until, agent_id, user_id."""
    n = F.substring("source", 4, 10).cast("int")
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    pick = lambda names, c: F.element_at(F.array(*[F.lit(x) for x in names]), (c + 1).cast("int"))
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("body"), "lang", "source",
        F.when(n % 4 == 0, "raw").when(n % 4 == 1, "crystal").otherwise("wiki").alias("kind"),
        F.when(F.col("text").isNotNull(), F.concat_ws(" ", *[F.nullif(F.regexp_extract("text", _FIRST_WORDS, i), F.lit("")) for i in (1, 2, 3)])).alias("title"),
        F.array("lang", "source").alias("tags"),
        pick(["active", "active", "active", "superseded", "archived"], d % 5).alias("status"),
        pick(["observed", "linked", "proposed", "consolidated", "canonical", "stale", "disputed", "dormant", "archived"], d % 9).alias("lifecycle"),
        pick(["unvalidated", "auto", "user", "challenged", "revoked"], d % 7 % 5).alias("validation"),
        F.when(d % 11 != 0, (d % 101) / F.lit(100.0)).alias("confidence"),
        day(d % 300).alias("created"), day(d % 300 + d % 67).alias("updated"),
        F.when(d % 3 != 0, day(d % 200)).alias("valid_from"), F.when(d % 4 != 0, day(d % 200 + d % 150)).alias("valid_until"),
        F.when(d % 6 != 0, F.concat(F.lit("agent"), d % 5)).alias("agent_id"), F.when(d % 5 != 0, F.concat(F.lit("user"), d % 7)).alias("user_id"),
    )


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges from the keys of the tables: from_path, to_path, kind, relation_type, valid_from, valid_to, superseded_by."""
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c))
    line = table(spark, sf_dir, "lineitem")
    made = [
        table(spark, sf_dir, "nation").select(node("n/", "n_nationkey"), node("r/", "n_regionkey"), F.lit("linked"), F.lit(None).cast("date"), F.lit(None).cast("date")),
        table(spark, sf_dir, "customer").select(node("c/", "c_custkey"), node("n/", "c_nationkey"), F.lit("uses"), F.lit(None).cast("date"), F.lit(None).cast("date")),
        table(spark, sf_dir, "supplier").select(node("s/", "s_suppkey"), node("n/", "s_nationkey"), F.lit("mentions"), F.lit(None).cast("date"), F.lit(None).cast("date")),
        table(spark, sf_dir, "orders").select(node("o/", "o_orderkey"), node("c/", "o_custkey"), F.lit("derived_from"), F.to_date("o_orderdate"), F.lit(None).cast("date")),
        line.select(node("o/", "l_orderkey"), node("p/", "l_partkey"), F.lit("depends_on"), F.to_date("l_shipdate"), F.date_add(F.to_date("l_shipdate"), 365)),
        line.select(node("o/", "l_orderkey"), node("s/", "l_suppkey"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("caused_by"), F.to_date("l_shipdate"), F.lit(None).cast("date")),
    ]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    out = out.toDF("from_path", "to_path", "relation_type", "valid_from", "valid_to")
    return out.withColumn("kind", F.when(F.col("relation_type") == "linked", "wikilink").otherwise("relation")).withColumn("superseded_by", F.when(F.substring("from_path", -2, 2) == "13", F.lit("o/1")))


CATEGORIES = "projects issues lessons decisions tools references threads procedures people notes".split()


def _vault(d: str, spark: bool) -> dict[str, str]:
    """Expressions of a document's number d in the SQL of Spark or of the oracle: its category, path, and what it relates and links to."""
    div = "DIV" if spark else "//"
    pick = lambda names, at: (f"element_at(array({names}), CAST({at} + 1 AS INT))" if spark else f"([{names}])[{at} + 1]")
    names = ", ".join(f"'{c}'" for c in CATEGORIES)
    path = lambda n: f"CASE WHEN ({n}) % 25 = 1 THEN concat({pick(names, f'({n}) % 10')}, '/', {n}, '/shared') ELSE concat({pick(names, f'({n}) % 10')}, '/p', {n}) END"
    third, half = f"({d} {div} 3)", f"({d} {div} 2)"
    return {
        "category": pick(names, f"{d} % 10"), "path": path(d),
        "relation": pick("'caused_by', 'fixed_by', 'learned_from', 'contradicts', 'depends_on', 'mentions'", f"{d} % 6"),
        "target": f"CASE WHEN {d} % 13 = 0 THEN concat('missing/x', {d}) WHEN {d} % 4 = 0 THEN concat('p', {third}) ELSE {path(third)} END",
        "link": f"CASE WHEN {d} % 17 = 0 THEN 'nowhere' WHEN {d} % 25 = 2 THEN 'shared' ELSE concat({path(half)}, '.md') END",
    }


def vault_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages_of as the pages of a vault: path, category, text with a [[link]], and the relation and target that its front matter names."""
    e = _vault("doc_id", True)
    pages = pages_of(spark, sf_dir).withColumns({c: F.expr(e[c]) for c in ("category", "path", "relation", "target")})
    return pages.withColumn("body", F.concat("body", F.lit(" [["), F.expr(e["link"]), F.lit("]]"))).withColumn("importance", F.col("doc_id") % 10 + 1)


# The same views for the oracle.
PAGES_SQL = """pages_ AS (SELECT doc_id, text AS body, lang, source,
  CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN 'raw' WHEN CAST(substr(source, 4) AS INT) % 4 = 1 THEN 'crystal' ELSE 'wiki' END AS kind,
  array_to_string(string_split(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')[1:3], ' ') AS title,
  [lang, source] AS tags,
  ['active', 'active', 'active', 'superseded', 'archived'][doc_id % 5 + 1] AS status,
  ['observed', 'linked', 'proposed', 'consolidated', 'canonical', 'stale', 'disputed', 'dormant', 'archived'][doc_id % 9 + 1] AS lifecycle,
  ['unvalidated', 'auto', 'user', 'challenged', 'revoked'][doc_id % 7 % 5 + 1] AS validation,
  CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 101) / 100.0::DOUBLE END AS confidence,
  DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS created, DATE '2024-01-01' + CAST(doc_id % 300 + doc_id % 67 AS INT) AS updated,
  CASE WHEN doc_id % 3 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 AS INT) END AS valid_from,
  CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 200 + doc_id % 150 AS INT) END AS valid_until,
  CASE WHEN doc_id % 6 <> 0 THEN 'agent' || doc_id % 5 END AS agent_id, CASE WHEN doc_id % 5 <> 0 THEN 'user' || doc_id % 7 END AS user_id
  FROM documents)"""

EDGES_SQL = """raw_edges AS (
  SELECT 'n/' || n_nationkey AS from_path, 'r/' || n_regionkey AS to_path, 'linked' AS relation_type, CAST(NULL AS DATE) AS valid_from, CAST(NULL AS DATE) AS valid_to FROM nation
  UNION ALL SELECT 'c/' || c_custkey, 'n/' || c_nationkey, 'uses', NULL, NULL FROM customer
  UNION ALL SELECT 's/' || s_suppkey, 'n/' || s_nationkey, 'mentions', NULL, NULL FROM supplier
  UNION ALL SELECT 'o/' || o_orderkey, 'c/' || o_custkey, 'derived_from', CAST(o_orderdate AS DATE), NULL FROM orders
  UNION ALL SELECT 'o/' || l_orderkey, 'p/' || l_partkey, 'depends_on', CAST(l_shipdate AS DATE), CAST(l_shipdate AS DATE) + 365 FROM lineitem
  UNION ALL SELECT 'o/' || l_orderkey, 's/' || l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'caused_by' END, CAST(l_shipdate AS DATE), NULL FROM lineitem),
edges_ AS (SELECT *, CASE WHEN relation_type = 'linked' THEN 'wikilink' ELSE 'relation' END AS kind,
  CASE WHEN right(from_path, 2) = '13' THEN 'o/1' END AS superseded_by FROM raw_edges)"""

_V = _vault("doc_id", False)
VAULT_SQL = f"""{PAGES_SQL}, vault AS (SELECT * REPLACE (body || ' [[' || {_V['link']} || ']]' AS body), {_V['category']} AS category, {_V['path']} AS path, {_V['relation']} AS relation, {_V['target']} AS target, doc_id % 10 + 1 AS importance FROM pages_)"""
