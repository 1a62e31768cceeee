"""Queries of retrieval: lexical, vector, fusion, mentions, resolution and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params
from ..functions import text as T
from ..operators import evaluation, fuse, graph, lexical, linking, predicates, resolve, vector
from ..storage import written
from ..tables import PAGES_SQL, pages_of, table
from .base import query
from .texts import _CASES, _INTENT, tokens_sql

_STOP = ", ".join(f"'{w}'" for w in params.STOPWORDS)
#: Every passage of the benchmark, whole, is a query.
QUERIES_SQL = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
BM25_SQL = f"""docs AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens_sql('query')}) AS term FROM asked) WHERE term NOT IN ({_STOP})),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT query_id, id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY 1, 2 HAVING score > 0)"""


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_of(spark, sf, best=None):
    return lexical.bm25(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), asked(spark, sf), best=best)


@query("bm25_topk", f"""WITH {QUERIES_SQL}, {BM25_SQL} SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm25) WHERE rank <= 10""")
def bm25_topk(spark, sf):
    return lexical.top(bm25_of(spark, sf, 10), 10)


@query("term_idf", f"""WITH d AS (SELECT doc_id, list_distinct({tokens_sql('text')}) AS w FROM documents), t AS (SELECT unnest(w) AS term FROM d)
SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM d) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1), 6) AS idf FROM t GROUP BY term""")
def term_idf(spark, sf):
    return lexical.term_statistics(table(spark, sf, "documents"), text_col="text").withColumn("idf", F.round("idf", 6))


_FIELDS = "doc_id, title || ' ' || array_to_string(tags, ' ') || ' ' || body AS text"
_MENTIONS_SQL = BM25_SQL.replace("FROM documents", f"FROM (SELECT {_FIELDS} FROM pages_ WHERE kind = 'wiki')")


# The texts are short: a score of 60 is what 200 is for whole notes.
FLOOR = 60.0
_BM25_MENTIONS = f"mentioned AS (SELECT query_id, id, round(least(0.8, greatest(0.5, 0.5 + (score - {FLOOR}) / {FLOOR} * 0.3)), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 WHERE score >= {FLOOR}) WHERE rank <= 10)"


def mentions_of(spark, sf):
    pages = pages_of(spark, sf).where("kind = 'wiki'").select("doc_id", F.concat_ws(" ", "title", F.array_join("tags", " "), "body").alias("body"))
    found = lexical.top(lexical.bm25(pages, asked(spark, sf), best=10).where(F.col("score") >= FLOOR), 10)
    return found.select("query_id", "id", F.round(linking.mention_confidence(F.col("score"), FLOOR), 6).alias("confidence"))


@query("bm25_mentions", f"WITH {PAGES_SQL}, {QUERIES_SQL}, {_MENTIONS_SQL}, {_BM25_MENTIONS} SELECT query_id, id, confidence FROM mentioned")
def bm25_mentions(spark, sf):
    """Pages, by title, tags and body, that a passage mentions: ten at most."""
    return mentions_of(spark, sf)


_HOLD = f"""hold AS (SELECT query_id, doc_id FROM (SELECT query_id, list_distinct({tokens_sql('query')}) AS a FROM asked) q JOIN (SELECT doc_id, {tokens_sql('text')} AS w FROM documents) d ON list_has_all(d.w, q.a) WHERE len(q.a) > 0)"""


def holding(spark, sf):
    """Documents that hold every word of a passage."""
    return lexical.all_terms(table(spark, sf, "documents"), asked(spark, sf).select("query_id", T.tokens(F.col("query")).alias("terms")), text_col="text")


@query("fts_and", f"WITH {QUERIES_SQL}, {_HOLD} SELECT query_id, doc_id FROM hold")
def fts_and(spark, sf):
    return holding(spark, sf).withColumnRenamed("id", "doc_id")


@query("fts_topk", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {_HOLD}, r AS (SELECT h.query_id, h.doc_id, score, CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY score DESC, h.doc_id) AS INTEGER) AS rank FROM hold h JOIN bm25 b ON h.query_id = b.query_id AND h.doc_id = b.id)
SELECT query_id, doc_id, score, rank, source, lang FROM r JOIN documents USING (doc_id) WHERE rank <= 5""")
def fts_topk(spark, sf):
    """Full-text search: documents with all words, best first; the few that stay are joined with their rows after the limit."""
    scored = holding(spark, sf).join(bm25_of(spark, sf), ["query_id", "id"])
    best = lexical.top(scored, 5).withColumnRenamed("id", "doc_id")
    return best.join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select("query_id", "doc_id", "score", "rank", "source", "lang")


@query("exact_boost", f"""WITH q AS (SELECT p_partkey AS query_id, list_distinct({tokens_sql("p_name || ' ' || p_brand")} || [lower(p_brand)]) AS q FROM part WHERE p_partkey % 20 = 0)
SELECT query_id, p_partkey AS id, CAST(least(8, 3 + CASE WHEN nm THEN 2 ELSE 0 END + CASE WHEN ti THEN 2 ELSE 0 END + CASE WHEN tg THEN 1 ELSE 0 END) AS INTEGER) AS score FROM (
SELECT query_id, p_partkey, len(list_filter(q, lambda t: contains(lower(p_name), t))) > 0 AS nm, len(list_filter(q, lambda t: contains(lower(p_type), t))) > 0 AS ti, list_has_any(q, [lower(p_brand)]) AS tg FROM part, q) WHERE nm OR ti OR tg""")
def exact_boost(spark, sf):
    part = table(spark, sf, "part").withColumn("tags", F.array("p_brand"))
    queries = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(T.tokens(F.concat_ws(" ", "p_name", "p_brand")), F.array(F.lower("p_brand"))).alias("terms"))
    return lexical.exact_boost(part, queries, "p_partkey", "p_name", "p_type", "tags")


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
_COS = f"{_DOT.format(a='d.embedding', b='q.embedding')} / (sqrt({_DOT.format(a='d.embedding', b='d.embedding')}) * sqrt({_DOT.format(a='q.embedding', b='q.embedding')}))"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("cosine_topk", f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, d.vec_id AS id, round({_COS}, 6) AS score FROM embeddings d JOIN embeddings q ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0) WHERE score >= 0.25) WHERE rank <= 50""")
def cosine_topk(spark, sf):
    v = vectors(spark, sf)
    return vector.nearest(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))


@query("find_similar", f"""SELECT query_id, id, score, rank FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, d.vec_id AS id, round({_COS}, 6) AS score FROM embeddings d JOIN embeddings q ON q.vec_id <> d.vec_id AND q.vec_id % 20 = 0 WHERE d.label <> 9) WHERE score >= 0.3) WHERE rank <= 10""")
def find_similar(spark, sf):
    v = vectors(spark, sf)
    return vector.nearest(v.where("label <> 9"), v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10, 0.3, same_dim=True)


@query("l2_knn", """SELECT query_id, id, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, d.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(d.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))), 6) AS distance
FROM embeddings d, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def l2_knn(spark, sf):
    v = vectors(spark, sf)
    return vector.nearest_l2(v, v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))


@query("embedding_guard", "SELECT vec_id, CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' WHEN embedding[1] = 1 AND len(list_filter(embedding[2:], lambda x: x <> 0)) = 0 THEN 'stub' END AS reason FROM embeddings")
def embedding_guard(spark, sf):
    return vector.guard(vectors(spark, sf), 64).select(F.col("id").alias("vec_id"), "reason")


@query("embedding_health", """SELECT count(*) AS records, count(DISTINCT len(embedding)) AS dims, CAST(min(len(embedding)) AS BIGINT) AS least_dim, count(DISTINCT embedding) AS distinct_vectors,
count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero, count(*) FILTER (WHERE embedding[1] = 1 AND len(list_filter(embedding[2:], lambda x: x <> 0)) = 0) AS stub, count(*) FILTER (WHERE len(embedding) < 16) AS below_floor FROM embeddings""")
def embedding_health(spark, sf):
    return vector.health(vectors(spark, sf))


@query("latest_embedding", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_embedding(spark, sf):
    return vector.latest(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id")


_STATE = "SELECT doc_id AS id, CASE WHEN doc_id % 8 = 0 THEN 'old' ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1 - doc_id, 'x' FROM documents WHERE doc_id % 50 = 0"


@query("embedding_refresh_plan", f"""WITH r AS ({_STATE}), d AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents)
SELECT coalesce(d.id, r.id) AS id, CASE WHEN d.id IS NULL THEN 'remove' WHEN r.id IS NULL OR d.hash <> r.hash THEN 'pending' ELSE 'unchanged' END AS action FROM d FULL JOIN r ON d.id = r.id""")
def embedding_refresh_plan(spark, sf):
    docs = table(spark, sf, "documents")
    plain = lambda df: df.withColumns({"model": F.lit("m"), "dim": F.lit(64)})
    hashed = docs.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    state = hashed.where("id % 5 <> 0").withColumn("hash", F.when(F.col("id") % 8 == 0, "old").otherwise(F.col("hash")))
    gone = docs.where("doc_id % 50 = 0").select((-1 - F.col("doc_id")).alias("id"), F.lit("x").alias("hash"))
    return vector.refresh_plan(plain(hashed), plain(state.unionByName(gone)))


@query("mark_archived", "SELECT vec_id, vec_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS archived FROM embeddings")
def mark_archived(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("bad")).distinct()
    return table(spark, sf, "embeddings").select("vec_id").join(bad, "vec_id", "left").select("vec_id", F.coalesce("bad", F.lit(False)).alias("archived"))


@query("auto_link_embedding", f"""SELECT raw_id, page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, page_id) AS n FROM (
SELECT q.vec_id AS raw_id, d.vec_id AS page_id, round({_COS}, 6) AS score FROM embeddings q JOIN embeddings d ON d.label >= 5 AND q.label = 0 AND q.vec_id <> d.vec_id) WHERE score >= 0.3) WHERE n <= 3""")
def auto_link_embedding(spark, sf):
    v = vectors(spark, sf)
    found = vector.nearest(v.where("label >= 5"), v.where("label = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 3, 0.3)
    return found.select(F.col("query_id").alias("raw_id"), F.col("id").alias("page_id"), "score")


_LISTED = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in params.TITLE_STOPWORDS) + ") AND NOT regexp_full_match(x, '[0-9]+'))"
_SCORING = f"list_distinct({_LISTED})"


@query("auto_link_title", f"""WITH r AS (SELECT item_id AS raw_id, {_SCORING.format(c='text')} AS rt, ' ' || array_to_string({_LISTED.format(c='text')}, ' ') || ' ' AS rp FROM benchmark),
p AS (SELECT doc_id AS page_id, {_SCORING.format(c='title')} AS tt, array_to_string({_LISTED.format(c='title')}, ' ') AS tp, {_SCORING.format(c="title || chr(10) || body")} AS ct FROM ({f'WITH {PAGES_SQL} SELECT * FROM pages_'})),
j AS (SELECT * FROM r JOIN p ON list_has_any(r.rt, p.tt)), k AS (SELECT *, list_filter(ct, lambda x: NOT list_contains(tt, x)) AS rest FROM j),
s AS (SELECT raw_id, page_id, round(least(1.0, 0.42::DOUBLE * len(list_intersect(tt, rt)) / len(tt) + 0.43::DOUBLE * CASE WHEN len(rest) = 0 THEN 0 ELSE CAST(len(list_intersect(rest, rt)) AS DOUBLE) / len(rest) END
 + 0.15::DOUBLE * len(list_intersect(ct, rt)) / len(list_distinct(list_concat(ct, rt))) + CASE WHEN contains(rp, ' ' || tp || ' ') THEN 0.1::DOUBLE ELSE 0 END), 3) AS score FROM k)
SELECT raw_id, page_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, page_id) AS rank FROM s) WHERE rank <= 3""")
def auto_link_title(spark, sf):
    raw = table(spark, sf, "benchmark").select(F.col("item_id").alias("raw_id"), F.col("text").alias("raw"))
    pages = pages_of(spark, sf).select(F.col("doc_id").alias("page_id"), "title", F.col("body").alias("summary"))
    return resolve.title_score(raw, pages)


@query("title_mentions", f"""WITH {PAGES_SQL}, t AS (SELECT min(doc_id) AS title_id, array_to_string({tokens_sql('title')}, ' ') AS phrase FROM pages_ GROUP BY 2 HAVING phrase <> ''),
d AS (SELECT doc_id AS id, {tokens_sql('text')} AS w FROM documents), n AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM t),
g AS (SELECT id, array_to_string(w[i:i + n - 1], ' ') AS phrase, i FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM d), n WHERE i + n - 1 <= len(w))
SELECT id, title_id, CAST(min(i) AS INTEGER) AS position FROM g JOIN t USING (phrase) GROUP BY 1, 2""")
def title_mentions(spark, sf):
    """All titles in all texts."""
    titles = pages_of(spark, sf).groupBy(F.array_join(T.tokens(F.col("title")), " ").alias("title")).agg(F.min("doc_id").alias("title_id"))
    return resolve.title_mentions(table(spark, sf, "documents"), titles, id_col="doc_id", text_col="text")


@query("combine_mentions", """WITH a AS (SELECT doc_id AS id, doc_id % 7 AS target, (doc_id % 10) / 10.0 AS confidence FROM labels WHERE quality = 1), b AS (SELECT doc_id AS id, doc_id % 7 AS target, (doc_id % 13) / 13.0 AS confidence FROM labels WHERE toxic = 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.target, b.target) AS target, round(CAST(greatest(a.confidence, b.confidence) AS DOUBLE), 6) AS confidence, CASE WHEN a.id IS NULL THEN 'bm25' WHEN b.id IS NULL THEN 'lexical' ELSE 'both' END AS source FROM a FULL JOIN b ON a.id = b.id AND a.target = b.target""")
def combine_mentions(spark, sf):
    labels = table(spark, sf, "labels")
    made = lambda test, n: labels.where(test).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("target"), (F.col("doc_id") % n / n).alias("confidence"))
    return resolve.combine_mentions(made("quality = 1", 10), made("toxic = 0", 13)).withColumn("confidence", F.round("confidence", 6))


_PATH = "concat('wiki/', CASE doc_id % 4 WHEN 0 THEN 'tools' WHEN 1 THEN 'decisions' WHEN 2 THEN 'crystals' ELSE 'people' END, '/p', doc_id, '.md')"
_TITLE = "CASE WHEN doc_id % 12 = 3 THEN concat('Deprecated ', title) ELSE title END"


@query("consolidation_plan", f"""WITH {PAGES_SQL}, {QUERIES_SQL}, {_MENTIONS_SQL}, {_BM25_MENTIONS},
t AS (SELECT min(doc_id) AS target, array_to_string({tokens_sql('title')}, ' ') AS phrase FROM pages_ WHERE kind = 'wiki' GROUP BY 2 HAVING phrase <> ''), w AS (SELECT query_id, {tokens_sql('query')} AS w FROM (SELECT -1 - query_id AS query_id, query FROM asked UNION ALL SELECT doc_id, body FROM pages_ WHERE kind = 'raw')), n AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM t),
g AS (SELECT query_id, array_to_string(w[i:i + n - 1], ' ') AS phrase, i FROM (SELECT query_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), n WHERE i + n - 1 <= len(w)),
l AS (SELECT query_id, target, min(i) AS position FROM g JOIN t USING (phrase) GROUP BY 1, 2),
m AS (SELECT coalesce(l.query_id, b.query_id) AS id, coalesce(l.target, b.id) AS target, CASE WHEN l.target IS NULL THEN b.confidence ELSE 1.0::DOUBLE END AS confidence, CASE WHEN l.target IS NULL THEN 'bm25' WHEN b.id IS NULL THEN 'lexical' ELSE 'both' END AS source, position FROM l FULL JOIN (SELECT -1 - query_id AS query_id, id, confidence FROM mentioned) b ON b.query_id = l.query_id AND b.id = l.target),
p AS (SELECT doc_id, {_PATH} AS path, {_TITLE} AS title FROM pages_), r AS (SELECT m.*, path, title, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, position NULLS LAST, path) AS place FROM m JOIN p ON doc_id = target WHERE confidence >= 0.6 AND id % 4 <> 0)
SELECT id, target, CASE WHEN path LIKE 'wiki/tools/%' THEN 'uses' WHEN path LIKE 'wiki/crystals/%' THEN 'derived_from' WHEN regexp_matches(title, '(?i)deprecated|superseded-by') THEN 'supersedes' WHEN source = 'bm25' AND path LIKE 'wiki/decisions/%' THEN 'derived_from' ELSE 'mentions' END AS relation, round(confidence, 3) AS confidence, source, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def consolidation_plan(spark, sf):
    """Relations that raw pages (by their titles' mentions) and passages (numbered below zero, by full text too) should get; every fourth is linked already."""
    every = pages_of(spark, sf)
    wiki = every.where("kind = 'wiki'")
    titles = wiki.groupBy(F.array_join(T.tokens(F.col("title")), " ").alias("title")).agg(F.min("doc_id").alias("title_id"))
    number = -1 - F.col("query_id")
    texts = asked(spark, sf).select(number.alias("id"), F.col("query").alias("body")).unionByName(every.where("kind = 'raw'").select(F.col("doc_id").alias("id"), "body"))
    named = resolve.title_mentions(texts, titles, id_col="id").select("id", F.col("title_id").alias("target"), "position", F.lit(1.0).alias("confidence"))
    text = mentions_of(spark, sf).select(number.alias("id"), F.col("id").alias("target"), "confidence")
    pages = wiki.select(F.col("doc_id").alias("target"), F.expr(_PATH).alias("path"), F.expr(_TITLE).alias("title"))
    return linking.consolidated(texts.select("id", (F.col("id") % 4 == 0).alias("linked")), named, text, pages)


_VECTOR = "CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN vec_id % 11 = 0 THEN embedding[1:8] ELSE embedding END"


@query("auto_links", f"""WITH {PAGES_SQL}, w AS (SELECT p.*, embedding FROM pages_ p LEFT JOIN embeddings ON vec_id = doc_id WHERE kind = 'wiki'), raw AS (SELECT doc_id AS raw_id, title || chr(10) || body AS raw, doc_id % 9 = 0 AS linked, CASE WHEN vec_id IS NOT NULL THEN {_VECTOR} END AS v FROM pages_ LEFT JOIN embeddings ON vec_id = doc_id WHERE kind = 'raw'),
bad AS (SELECT raw_id FROM raw WHERE v IS NOT NULL AND (len(v) < 16 OR raw_id % 7 = 0)), e AS (SELECT raw_id, doc_id AS page_id, round({_COS.replace('d.embedding', 'w.embedding').replace('q.embedding', 'raw.v')}, 6) AS score FROM raw JOIN w ON w.embedding IS NOT NULL WHERE NOT linked AND v IS NOT NULL AND raw_id NOT IN (SELECT raw_id FROM bad)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, page_id) AS rank FROM e WHERE score >= 0.3) WHERE rank <= 3),
r AS (SELECT raw_id, {_SCORING.format(c='raw')} AS rt, ' ' || array_to_string({_LISTED.format(c='raw')}, ' ') || ' ' AS rp FROM raw WHERE NOT linked AND (v IS NULL OR raw_id IN (SELECT raw_id FROM bad))),
p AS (SELECT doc_id AS page_id, {_SCORING.format(c='title')} AS tt, array_to_string({_LISTED.format(c='title')}, ' ') AS tp, {_SCORING.format(c="title || chr(10) || lang")} AS ct FROM w),
j AS (SELECT * FROM r JOIN p ON list_has_any(r.rt, p.tt)), k AS (SELECT *, list_filter(ct, lambda x: NOT list_contains(tt, x)) AS rest FROM j),
s AS (SELECT raw_id, page_id, round(least(1.0, 0.42::DOUBLE * len(list_intersect(tt, rt)) / len(tt) + 0.43::DOUBLE * CASE WHEN len(rest) = 0 THEN 0 ELSE CAST(len(list_intersect(rest, rt)) AS DOUBLE) / len(rest) END
 + 0.15::DOUBLE * len(list_intersect(ct, rt)) / len(list_distinct(list_concat(ct, rt))) + CASE WHEN contains(rp, ' ' || tp || ' ') THEN 0.1::DOUBLE ELSE 0 END), 3) AS score FROM k),
two AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_id ORDER BY score DESC, page_id) AS rank FROM s WHERE score >= 0.45) WHERE rank <= 3),
links AS (SELECT raw_id, page_id, score, 'embedding' AS strategy FROM one UNION ALL SELECT raw_id, page_id, score, 'title' FROM two)
SELECT raw_id, page_id, score, strategy FROM links UNION ALL SELECT raw_id, NULL, NULL, CASE WHEN linked THEN 'raw already has relations' WHEN raw_id IN (SELECT raw_id FROM bad) THEN 'degenerate embeddings' ELSE 'no match' END FROM raw WHERE raw_id NOT IN (SELECT raw_id FROM links)""")
def auto_links(spark, sf):
    """Links of all raw pages to wiki pages by vectors, or by titles where a vector is missing or says nothing (every seventh is zero, every eleventh short), and why the others have none."""
    pages = pages_of(spark, sf)
    named = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    held = pages.join(named, "doc_id")
    broken = F.when(F.col("doc_id") % 7 == 0, F.transform("v", lambda x: F.lit(0.0).cast("float"))).when(F.col("doc_id") % 11 == 0, F.slice("v", 1, 8)).otherwise(F.col("v"))
    raw = pages.where("kind = 'raw'").select(F.col("doc_id").alias("raw_id"), F.concat("title", F.lit("\n"), "body").alias("raw"), (F.col("doc_id") % 9 == 0).alias("linked"))
    wiki = pages.where("kind = 'wiki'").select(F.col("doc_id").alias("page_id"), "title", F.col("lang").alias("summary"))
    links, without = linking.auto_linked(raw, held.where("kind = 'raw'").select(F.col("doc_id").alias("raw_id"), broken.alias("v")), wiki, held.where("kind = 'wiki'").select(F.col("doc_id").alias("page_id"), "v"), 0.3, 0.45)
    return links.unionByName(without.select("raw_id", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("double").alias("score"), F.col("reason").alias("strategy")))


_KEY = "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({c}), 2)), lambda i: substr({c}, i, 2)))"


@query("entity_dedup", f"""WITH k AS (SELECT p_type AS type, {_KEY} AS key, min(p_partkey) AS id FROM part GROUP BY 1, 2), s AS (
SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, greatest(1 - levenshtein(a.key, b.key) / CAST(greatest(length(a.key), length(b.key)) AS DOUBLE),
 len(list_intersect({_GRAMS.format(c='a.key')}, {_GRAMS.format(c='b.key')})) / CAST(len(list_distinct(list_concat({_GRAMS.format(c='a.key')}, {_GRAMS.format(c='b.key')}))) AS DOUBLE)) AS similarity FROM k a JOIN k b ON a.type = b.type AND a.key < b.key)
SELECT left_id, right_id, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.85
UNION ALL SELECT k.id, p.p_partkey, 1.0 FROM part p JOIN k ON k.type = p.p_type AND k.key = {_KEY} WHERE p.p_partkey <> k.id""")
def entity_dedup(spark, sf):
    return resolve.duplicate_entities(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type")))


@query("jaccard_pairs", f"""WITH t AS (SELECT item_id, list_distinct({tokens_sql('text')}) AS w FROM benchmark)
SELECT a.item_id AS left_id, b.item_id AS right_id, round(len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) >= 0.1""")
def jaccard_pairs(spark, sf):
    w = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("items"))
    return resolve.similar_sets(w, 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query("longest_prefix", """WITH u AS (SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages), x AS (SELECT DISTINCT regexp_extract(path, '^[^/]*') AS prefix FROM u UNION SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') FROM u)
SELECT u.id, max_by(x.prefix, length(x.prefix)) AS prefix_id FROM u LEFT JOIN x ON u.path = x.prefix OR starts_with(u.path, x.prefix || '/') GROUP BY u.id""")
def longest_prefix(spark, sf):
    u = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))
    x = u.select(F.regexp_extract("path", "^[^/]*", 0).alias("prefix")).union(u.select(F.regexp_extract("path", "^[^/]*/[^/]*", 0))).distinct()
    return resolve.longest_prefix(u, x.select("prefix", F.col("prefix").alias("prefix_id")))


def links_of(spark, sf):
    """Typed links between documents: each depends on that of a third of its number, and is linked to that whose number is its length."""
    ids = table(spark, sf, "documents").select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.expr("doc_id DIV 3").alias("up"), "n_chars")
    made = docs.select(F.col("doc_id").alias("from_path"), F.col("up").alias("to_path"), F.lit("depends_on").alias("relation_type"), F.lit("relation").alias("kind"))
    made = made.union(docs.select("doc_id", "n_chars", F.lit("linked"), F.lit("wikilink"))).where("from_path <> to_path")
    return made.join(ids.withColumnRenamed("doc_id", "to_path"), "to_path", "left_semi").select("from_path", "to_path", "relation_type", "kind")


_LINKS_SQL = """links AS (SELECT * FROM (SELECT doc_id AS from_path, doc_id // 3 AS to_path, 'depends_on' AS relation_type, 'relation' AS kind FROM documents UNION ALL SELECT doc_id, n_chars, 'linked', 'wikilink' FROM documents)
 WHERE from_path <> to_path AND to_path IN (SELECT doc_id FROM documents)), both_ AS (SELECT from_path AS near, to_path AS far, relation_type, kind FROM links UNION ALL SELECT to_path, from_path, relation_type, kind FROM links)"""
_EDGE_WEIGHT = "CASE relation_type WHEN 'depends_on' THEN 1.0::DOUBLE ELSE 0.1 END"


def _spread(n: int) -> str:
    """One unrolled round of activation of each query, from f{n-1} and the nodes it has reached so far, r{n-1}."""
    return f"""c{n} AS (SELECT query_id, f.path AS near, b.far, sum(f.activation * {_EDGE_WEIGHT} * 0.6::DOUBLE) AS c FROM f{n - 1} f JOIN both_ b ON b.near = f.path ANTI JOIN r{n - 1} r ON r.query_id = f.query_id AND r.path = b.far GROUP BY ALL),
k{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id, near ORDER BY c DESC, far DESC) AS p, max(c) OVER (PARTITION BY query_id, near) AS m FROM c{n}), s{n} AS (SELECT query_id, near, max(c) FILTER (WHERE p = 2) AS second FROM k{n} GROUP BY ALL),
t{n} AS (SELECT query_id, far AS path, sum(c) - 0.15::DOUBLE * sum(CASE WHEN p = 1 THEN coalesce(second, 0) ELSE m END) AS activation FROM k{n} JOIN s{n} USING (query_id, near) GROUP BY ALL),
f{n} AS MATERIALIZED (SELECT * FROM t{n} WHERE activation > 0.01), r{n} AS MATERIALIZED (SELECT * FROM r{n - 1} UNION ALL SELECT * FROM f{n})"""


_INTENTS_SQL = f"intents AS (SELECT query_id, {_INTENT} AS intent FROM (SELECT query_id, query AS q FROM asked))"
_STATED = ", ".join(f"('{i}', '{s}', {w}::DOUBLE)" for i, ws in params.INTENT_WEIGHTS.items() for s, w in zip(fuse.SIGNALS, ws, strict=True))
STREAMS_SQL = f"""meta AS ({f'WITH {PAGES_SQL} SELECT doc_id AS id, round(CAST(least(1.0, CAST({_CASES("status", params.STATUS_FACTOR)} AS DOUBLE) * coalesce(confidence, 0.7::DOUBLE)) AS DOUBLE), 6) AS score FROM pages_'}),
vec AS (SELECT b.item_id AS query_id, d.vec_id AS id, round({_COS}, 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id JOIN embeddings d ON d.vec_id <> q.vec_id JOIN documents x ON x.doc_id = d.vec_id WHERE score >= 0.25),
best_bm25 AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25 QUALIFY rank <= 50),
best_vec AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vec QUALIFY rank <= 50),
words AS (SELECT query_id, list_distinct(list_filter({tokens_sql('query')}, lambda x: x NOT IN ({_STOP}))) AS q FROM asked),
exact AS (SELECT query_id, id, least(8, 3 + CASE WHEN nm THEN 2 ELSE 0 END + CASE WHEN ti THEN 2 ELSE 0 END + CASE WHEN tg THEN 1 ELSE 0 END) AS score FROM (SELECT query_id, doc_id AS id, len(list_filter(q, lambda t: contains('doc-' || doc_id, t))) > 0 AS nm,
 len(list_filter(q, lambda t: contains(lower(title), t))) > 0 AS ti, list_has_any(q, [lower(lang), lower(source)]) AS tg FROM words, ({f'WITH {PAGES_SQL} SELECT doc_id, title, lang, source FROM pages_'})) WHERE nm OR ti OR tg),
seeds AS (SELECT query_id, id AS path, min(place) AS place FROM (SELECT query_id, id, rank AS place FROM best_bm25 WHERE rank <= 3 UNION ALL SELECT query_id, id, rank + 3 FROM best_vec WHERE rank <= 3) GROUP BY ALL), {_LINKS_SQL},
hop AS (SELECT query_id, far AS id, -min(place) AS score FROM seeds JOIN both_ ON near = path ANTI JOIN seeds s ON s.query_id = seeds.query_id AND s.path = far GROUP BY ALL),
f0 AS (SELECT query_id, path, 1.0::DOUBLE AS activation FROM seeds), r0 AS (SELECT * FROM f0), {', '.join(map(_spread, range(1, 6)))}, {_INTENTS_SQL},
lists AS MATERIALIZED (SELECT query_id, id, 'bm25' AS source, rank FROM best_bm25 UNION ALL SELECT query_id, id, 'vector', rank FROM best_vec
 UNION ALL SELECT query_id, id, 'exact', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM exact
 UNION ALL SELECT query_id, id, 'graph', row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) FROM hop
 UNION ALL SELECT query_id, path, 'graph-spread', row_number() OVER (PARTITION BY query_id ORDER BY round(activation, 6) DESC, path) FROM r5),
every AS (SELECT * FROM lists UNION ALL SELECT query_id, id, 'metadata', rank FROM (SELECT DISTINCT query_id, id FROM lists) JOIN (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM meta) USING (id)),
fused AS (SELECT query_id, id, round(sum(coalesce(weight, 1) / (60 + rank)), 6) AS score, arg_min(source, (rank, source)) AS dominant FROM every JOIN intents USING (query_id) LEFT JOIN (VALUES {_STATED}) w(intent, source, weight) USING (intent, source) GROUP BY ALL)"""


def streams(spark, sf, semantic=True):
    """The streams of all passages' searches, the prior of all documents, and the queries with their intents. semantic: with vectors; without, search is lexical."""
    q = asked(spark, sf)
    pages = pages_of(spark, sf)
    bm25 = written(lexical.top(bm25_of(spark, sf, params.SIGNAL_CAP), params.SIGNAL_CAP).drop("rank"), "bm25")
    docs = vectors(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")
    own = q.select("query_id").join(vectors(spark, sf), F.col("query_id") == F.col("id")).select("query_id", F.col("v").alias("q"))
    near = written(vector.nearest(docs, own).drop("rank"), "vector") if semantic else bm25.limit(0)
    exact = lexical.exact_boost(pages.withColumn("name", F.concat(F.lit("doc-"), "doc_id")), q.select("query_id", T.lexical_terms(F.col("query")).alias("terms")), "doc_id", "name", "title", "tags")
    start = written(fuse.seeds(bm25, near).withColumnRenamed("id", "path"), "seeds")
    links = links_of(spark, sf)
    hop = graph.neighbours(links, start).withColumnRenamed("path", "id")
    spread = graph.activate(links, start, by=("query_id",)).select("query_id", F.col("path").alias("id"), F.round("activation", 6).alias("score"))
    factor = F.when(F.col("status") == "archived", 0.0).when(F.col("status") == "superseded", 0.1).otherwise(1.0)
    prior = pages.select(F.col("doc_id").alias("id"), F.round(F.least(F.lit(1.0), factor * F.coalesce("confidence", F.lit(0.7))), 6).alias("score"))
    found = {"bm25": bm25, "vector": near, "exact": exact, "graph": hop, "graph-spread": spread}
    return {k: v for k, v in found.items() if semantic or k != "vector"}, prior, q.withColumn("intent", predicates.intent(F.col("query"))[0])


@query("rrf_fuse", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {STREAMS_SQL} SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, arg_min(source, (rank, source)) AS dominant FROM lists GROUP BY ALL""")
def rrf_fuse(spark, sf):
    """All that any stream finds, unweighted."""
    found, _, _ = streams(spark, sf)
    lists = [fuse.ranked(s, name, cap=params.SIGNAL_CAP if name in ("bm25", "vector") else None) for name, s in found.items()]
    return fuse.rrf(lists).select("query_id", "id", "score", "dominant")


@query("hybrid_search", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {STREAMS_SQL}, {PAGES_SQL}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fused)
SELECT query_id, id, r.score, dominant, rank, title, kind FROM r JOIN pages_ ON doc_id = id WHERE rank <= 10 AND r.score >= 0.02""")
def hybrid_search(spark, sf):
    """All six signals, weighted by the query's intent; the ten best with at least 0.02, joined with their pages."""
    best = fuse.hybrid(*streams(spark, sf), 10, 0.02)
    return best.join(pages_of(spark, sf).select(F.col("doc_id").alias("id"), "title", "kind"), "id").select("query_id", "id", "score", "dominant", "rank", "title", "kind")


_GOLD = """gold AS (SELECT b.item_id AS query_id, 'type' || b.item_id % 3 AS type, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
found AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25)"""


def gold(spark, sf):
    """The documents in which a passage stands word for word: of those with all its words."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    held = written(holding(spark, sf), "gold").join(texts, "id").join(asked(spark, sf), "query_id").where(F.contains("text", "query"))
    return held.select("query_id", F.concat(F.lit("type"), F.col("query_id") % 3).alias("type"), "id")


@query("eval_recall", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {_GOLD}, e AS (SELECT type, g.query_id, count(f.rank) / CAST(count(*) AS DOUBLE) AS r, CASE WHEN count(f.rank) > 0 THEN 1.0 ELSE 0.0 END AS h FROM gold g LEFT JOIN (SELECT * FROM found WHERE rank <= 5) f ON g.query_id = f.query_id AND g.id = f.id GROUP BY 1, 2)
SELECT type, count(*) AS queries, round(avg(r), 6) AS recall, round(avg(h), 6) AS hit FROM e GROUP BY type""")
def eval_recall(spark, sf):
    return evaluation.recall(gold(spark, sf), lexical.top(bm25_of(spark, sf, 5), 5), 5)


@query("eval_mrr", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {_GOLD}, e AS (SELECT type, g.query_id, min(f.rank) AS r FROM gold g LEFT JOIN (SELECT * FROM found WHERE rank <= 10) f ON g.query_id = f.query_id AND g.id = f.id GROUP BY 1, 2)
SELECT type, count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM e GROUP BY type""")
def eval_mrr(spark, sf):
    return evaluation.mrr(gold(spark, sf), lexical.top(bm25_of(spark, sf, 10), 10), 10)


@query("eval_lift", f"""WITH {QUERIES_SQL}, {BM25_SQL}, {STREAMS_SQL}, {_GOLD.split('),')[0]}), h AS (SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 5),
g AS (SELECT query_id, type, count(*) AS n, count(b.id) AS base, count(h.id) AS found FROM gold LEFT JOIN (SELECT query_id, id FROM best_bm25 WHERE rank <= 5) b USING (query_id, id) LEFT JOIN h USING (query_id, id) GROUP BY ALL)
SELECT type, count(*) AS queries, round(avg(CAST(base AS DOUBLE) / n), 6) AS base, round(avg(CAST(found AS DOUBLE) / n), 6) AS recall, round(avg(CAST(found AS DOUBLE) / n) - avg(CAST(base AS DOUBLE) / n), 6) AS lift FROM g GROUP BY type""")
def eval_lift(spark, sf):
    """Recall at 5 of the fused search over that of BM25 alone."""
    found, prior, q = streams(spark, sf)
    return evaluation.lift(gold(spark, sf), lexical.top(found["bm25"], 5), fuse.hybrid(found, prior, q, 5))


@query("latency_p95", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, sf):
    return evaluation.latency(table(spark, sf, "events"), "value", "event_type")


@query("accuracy_rollup", "SELECT d.lang AS lang, count(*) AS n, round(avg(CAST(l.quality = 1 AS INT)), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) GROUP BY ROLLUP (d.lang)")
def accuracy_rollup(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("correct"))
    return evaluation.accuracy(rows, "lang", "correct")
