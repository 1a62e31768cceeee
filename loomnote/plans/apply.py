"""Queries of the apply path, of narrower filters and of small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import apply, lexical, lint, predicates, resolve
from ..tables import PAGES_SQL, VAULT_SQL, pages_of, table, vault_of
from .base import query
from .searches import BM25_SQL, QUERIES_SQL, asked, bm25_of
from .texts import KINDS_SQL, NET_NEW, PROSE, tokens_sql

# Answers made of the turns: each writes, appends to, rewrites, lists, logs, disputes or supersedes the page of its conversation, or is broken.
_KINDS = [*apply.KINDS, "unknown_kind"]


def _category(n: str, spark: bool) -> str:
    """The category of the page of a document or conversation, in the SQL of Spark or of the oracle: every third is a thread."""
    names = ", ".join(f"'{c}'" for c in apply.CATEGORIES)
    return f"CASE WHEN {n} % 3 = 0 THEN 'threads' ELSE " + (f"element_at(array({names}), CAST({n} % 11 + 1 AS INT))" if spark else f"([{names}])[{n} % 11 + 1]") + " END"


def answers(spark, sf):
    """id, text: one answer a turn, with a fenced block of one operation. Some blocks are broken, some pages are outside, of no known category or not there; texts are the turn's own, the page's, both, or a dated event."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", F.coalesce("text", F.lit("")).alias("said"))
    t = t.join(table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("page")), "conv_id", "left")
    t = t.withColumn("kind", F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("id") % 8 + 1).cast("int")))
    name = F.expr(f"concat('wiki/', {_category('conv_id', True)}, IF(conv_id % 5 = 4, '/New ', '/D '), conv_id, '.md')")
    path = F.when(F.col("id") % 19 == 0, "../etc/passwd.md").when(F.col("id") % 17 == 0, "wiki/unknown/x.md").otherwise(name)
    page = F.coalesce("page", F.lit("nothing"))
    said = F.when(F.col("id") % 5 == 1, page).when(F.col("id") % 5 == 2, F.concat(F.lit("## 2024-01-05 seen\n\n"), "said")).when(F.col("id") % 5 == 3, F.concat(page, F.lit("\n\n"), "said")).otherwise(F.col("said"))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    op = F.struct(
        "kind", F.when(of("write_page", "append_page", "rewrite_page", "dispute_page"), path).alias("path"), F.when(of("write_page", "rewrite_page"), said).alias("body"), F.when(of("append_page"), said).alias("section"),
        F.when(of("dispute_page"), F.lit("wiki/lessons/other.md")).alias("conflicting_page"), F.when(of("supersede_page"), path).alias("new_page"), F.when(of("append_log"), F.lit("seen")).alias("line"),
        F.when(F.col("id") % 3 == 0, 0.9).when(F.col("id") % 3 == 1, 0.5).alias("confidence"), F.when(F.col("id") % 2 == 0, F.array(F.lit("raw/a"), F.lit("raw/b"))).otherwise(F.array(F.lit("raw/a"))).alias("derived_from"),
        F.when(F.col("id") % 4 == 2, F.array(F.lit("lessons/d-1"))).alias("relations"),
    )
    block = F.concat(F.lit("Here it is:\n```compile-ops\n"), F.when(F.col("id") % 11 == 0, "[{").otherwise(F.concat(F.lit("["), F.to_json(op), F.lit("]"))), F.lit("\n```\nDone."))
    return t.select("id", block.alias("text"))


_ANSWERS = f"""raw AS (SELECT conv_id * 100 + turn AS id, conv_id, coalesce(c.text, '') AS said, coalesce(d.text, 'nothing') AS page, {_KINDS}[(conv_id * 100 + turn) % 8 + 1] AS kind FROM conversations c LEFT JOIN documents d ON doc_id = conv_id),
ops AS (SELECT id, kind, CASE WHEN kind = 'update_index' THEN 'index.md' WHEN kind = 'append_log' THEN 'log.md' WHEN id % 19 = 0 THEN '../etc/passwd.md' WHEN id % 17 = 0 THEN 'wiki/unknown/x.md' WHEN kind IN ('dispute_page', 'supersede_page') THEN concat('wiki/', {_category('conv_id', False)}, CASE WHEN conv_id % 5 = 4 THEN '/New ' ELSE '/D ' END, conv_id, '.md')
 ELSE concat('wiki/', {_category('conv_id', False)}, CASE WHEN conv_id % 5 = 4 THEN '/new-' ELSE '/d-' END, conv_id, '.md') END AS path, {_category('conv_id', False)} AS category, kind IN ('write_page', 'append_page', 'rewrite_page') AS paged,
 CASE WHEN id % 5 = 1 THEN page WHEN id % 5 = 2 THEN '## 2024-01-05 seen' || chr(10) || chr(10) || said WHEN id % 5 = 3 THEN page || chr(10) || chr(10) || said ELSE said END AS t,
 CASE id % 3 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS conf, id % 2 = 0 AS two, CASE WHEN id % 4 = 2 THEN ['lessons/d-1'] END AS rel FROM raw WHERE id % 11 <> 0 AND kind <> 'unknown_kind'),
vault_pages AS (SELECT concat('wiki/', {_category('doc_id', False)}, '/d-', doc_id, '.md') AS path, CASE WHEN doc_id % 7 = 3 THEN '' ELSE text END AS body, CASE WHEN doc_id % 2 = 0 THEN ['lessons/d-1', 'wiki/tools/X.md'] END AS rel FROM documents)"""


def own_pages(spark, sf):
    """All documents as pages, every seventh of them without prose."""
    d = table(spark, sf, "documents")
    return d.select(
        F.expr(f"concat('wiki/', {_category('doc_id', True)}, '/d-', doc_id, '.md')").alias("path"), F.when(F.col("doc_id") % 7 == 3, "").otherwise(F.col("text")).alias("body"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("lessons/d-1"), F.lit("wiki/tools/X.md"))).alias("relations"),
    )


@query("parse_operations", f"WITH {_ANSWERS} SELECT id, kind, CASE WHEN paged THEN path END AS path, length(CASE WHEN paged THEN t END) AS chars FROM ops")
def parse_operations(spark, sf):
    found = apply.targeted(apply.operations(answers(spark, sf)))
    path = F.when(F.col("kind").isin("write_page", "append_page", "rewrite_page"), F.col("path"))
    return found.select("id", "kind", path.alias("path"), F.length(F.coalesce("body", "section")).cast("long").alias("chars"))


def _shares(old: str, new: str) -> str:
    """Whether a rewrite keeps enough of each kind of anchors."""
    kept = lambda a, b, least: f"(len({a}) = 0 OR len(list_intersect({a}, {b})) >= {least} * len({a}))"
    key = "list_distinct(list_transform({c}, lambda x: lower(regexp_replace(regexp_replace(x, '^wiki/', ''), '(?i)[.]md$', ''))))"
    return " AND ".join(kept(sql.format(c=old), sql.format(c=new), {"links": 0.9, "code": 0.8, "names": 0.8}[k]) for k, sql in KINDS_SQL.items()) + " AND " + kept(key.format(c="coalesce(old_rel, [])"), key.format(c="coalesce(rel, old_rel, [])"), 0.9)


def _prose(c: str) -> str:
    return PROSE.replace("part", c)


_ENDED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g') || chr(10)"
_JOINED = r"regexp_replace({a}, '\s+$', '') || CASE WHEN regexp_replace({a}, '\s+$', '') = '' OR regexp_replace({b}, '^\s+|\s+$', '', 'g') = '' THEN '' ELSE chr(10) || chr(10) END || " + _ENDED.replace("{c}", "{b}")
# The table of rules, row by row: what comes first (an append to no page is a write of little confidence, but for preferences), what each further one does, and what becomes of what is left for a page.
_JUDGED = rf"""{_ANSWERS}, placed AS (SELECT o.*, p.body AS old, p.rel AS old_rel, row_number() OVER (PARTITION BY o.path ORDER BY id) AS n FROM ops o LEFT JOIN vault_pages p ON p.path = o.path WHERE paged AND o.path LIKE 'wiki/%' AND o.path NOT LIKE 'wiki/unknown/%'),
fold AS (SELECT path, n, id, category, old, old_rel, CASE WHEN kind = 'append_page' AND old IS NULL THEN 'write_page' ELSE kind END AS kind, t, kind = 'append_page' AND old IS NULL AND category <> 'preferences' AS low, CASE WHEN kind = 'append_page' AND old IS NULL THEN CASE WHEN category = 'preferences' THEN 0.8::DOUBLE END ELSE conf END AS conf, two, rel FROM placed WHERE n = 1
UNION ALL SELECT f.path, p.n, f.id, f.category, f.old, f.old_rel,
 CASE WHEN p.kind = 'rewrite_page' THEN p.kind ELSE f.kind END,
 CASE WHEN f.low AND f.kind = 'write_page' AND p.kind = 'write_page' THEN {_JOINED.format(a='p.t', b='f.t')} WHEN p.kind = 'rewrite_page' THEN p.t WHEN f.kind IN ('write_page', 'append_page') AND p.kind = 'append_page' THEN {_JOINED.format(a='f.t', b='p.t')} ELSE f.t END,
 f.low AND NOT (f.kind = 'write_page' AND p.kind = 'write_page'),
 CASE WHEN p.kind = 'rewrite_page' OR f.low AND p.kind = 'write_page' AND f.kind = 'write_page' THEN p.conf ELSE f.conf END, CASE WHEN p.kind = 'rewrite_page' OR f.low AND p.kind = 'write_page' AND f.kind = 'write_page' THEN p.two ELSE f.two END, CASE WHEN p.kind = 'rewrite_page' OR f.low AND p.kind = 'write_page' AND f.kind = 'write_page' THEN p.rel ELSE f.rel END
 FROM fold f JOIN placed p ON p.path = f.path AND p.n = f.n + 1),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY path ORDER BY n DESC) = 1), old_ AS (SELECT path AS key, old AS body FROM last WHERE old IS NOT NULL AND kind <> 'rewrite_page'), new_ AS (SELECT path AS key, t AS body FROM last WHERE old IS NOT NULL AND kind <> 'rewrite_page'), {NET_NEW},
facts AS (SELECT l.*, coalesce(f.fresh, '') AS fresh, old IS NOT NULL AND {_prose("coalesce(old, '')")} <> '' AS prose, CASE WHEN kind = 'rewrite_page' THEN {_prose("coalesce(old, '')")} = {_prose('t')} END AS same, CASE WHEN kind = 'rewrite_page' THEN {_shares("coalesce(old, '')", 't')} END AS enough,
 CASE WHEN conf IS NOT NULL AND (kind = 'rewrite_page' OR category = 'preferences') THEN conf >= 0.7 ELSE two END AS sure FROM last l LEFT JOIN fresh f ON f.key = path),
left_ AS (SELECT *, CASE
 WHEN kind = 'rewrite_page' THEN CASE WHEN old IS NULL THEN 'rejected' WHEN NOT same AND NOT enough THEN 'staged-for-review' WHEN NOT sure THEN 'staged-for-review' WHEN same THEN 'skipped: no new content' ELSE 'rewritten' END
 WHEN old IS NULL THEN CASE WHEN sure AND NOT (low AND FALSE) THEN 'created' ELSE 'staged-for-review' END
 WHEN prose AND category <> 'threads' THEN 'staged-for-review'
 WHEN fresh = '' THEN CASE WHEN kind = 'append_page' AND NOT prose AND category <> 'threads' THEN 'rejected' ELSE 'skipped: no new content' END
 WHEN prose AND NOT (kind = 'append_page' AND regexp_matches(regexp_replace(t, '^\s+|\s+$', '', 'g'), '(?m)^##\s+\d{{4}}-\d{{2}}-\d{{2}}\b')) THEN 'staged-for-review'
 WHEN kind = 'write_page' AND NOT sure THEN 'staged-for-review' WHEN category <> 'threads' THEN 'rejected' ELSE 'appended' END AS outcome FROM facts),
judged AS (SELECT p.id, p.path, CASE WHEN p.n > 1 THEN 'merged' ELSE l.outcome END AS outcome FROM placed p JOIN left_ l ON l.path = p.path
 UNION ALL SELECT id, path, CASE WHEN path LIKE '../%' OR path LIKE 'wiki/unknown/%' AND paged THEN 'rejected' WHEN kind = 'update_index' THEN 'index-updated' WHEN kind = 'append_log' THEN 'log-appended' ELSE 'created' END FROM ops WHERE NOT (paged AND path LIKE 'wiki/%' AND path NOT LIKE 'wiki/unknown/%'))"""


def carried_out(spark, sf):
    return apply.carried_out(apply.operations(answers(spark, sf)), own_pages(spark, sf), "2024-06-01")


@query("operation_outcomes", f"WITH RECURSIVE {_JUDGED} SELECT id, path, outcome FROM judged")
def operation_outcomes(spark, sf):
    """What becomes of each operation of the answers, on pages of all documents."""
    return carried_out(spark, sf)[0].select("id", "path", "outcome")


@query("applied_pages", rf"""WITH RECURSIVE {_JUDGED}, a AS (SELECT path, CASE WHEN outcome IN ('created', 'rewritten') THEN {_ENDED.format(c='t')} ELSE regexp_replace(old, '\s+$', '') || chr(10) || chr(10) || CASE WHEN kind = 'write_page' THEN '## 2024-06-01 update' || chr(10) || chr(10) || {_ENDED.format(c='fresh')} ELSE {_ENDED.format(c='t')} END END AS body FROM left_ WHERE outcome IN ('created', 'rewritten', 'appended'))
SELECT path, sha256(coalesce(a.body, p.body, '')) AS body_sha256 FROM vault_pages p FULL JOIN a USING (path)""")
def applied_pages(spark, sf):
    """All pages after the operations of the answers."""
    return carried_out(spark, sf)[1].select("path", F.sha2("body", 256).alias("body_sha256"))


@query("supersede_approved", f"""WITH {VAULT_SQL}, a AS (SELECT path AS old_page, target AS new_page FROM vault WHERE relation = 'contradicts' AND target IN (SELECT path FROM vault)), e AS (SELECT old_page, max(new_page) AS b FROM a GROUP BY 1), n AS (SELECT new_page, max(old_page) AS o FROM a GROUP BY 1)
SELECT path, CASE WHEN b IS NOT NULL AND status <> 'superseded' THEN 'superseded' ELSE status END AS status, CASE WHEN b IS NOT NULL AND status <> 'superseded' THEN DATE '2024-09-01' ELSE valid_until END AS valid_until, CASE WHEN b IS NOT NULL AND status <> 'superseded' THEN b END AS superseded_by, o AS supersedes
FROM vault LEFT JOIN e ON path = old_page LEFT JOIN n ON path = new_page""")
def supersede_approved(spark, sf):
    pages = vault_of(spark, sf)
    said = pages.where("relation = 'contradicts'").select(F.col("path").alias("old_page"), F.col("target").alias("new_page")).join(pages.select(F.col("path").alias("new_page")), "new_page", "left_semi")
    rows = pages.select("path", "status", "valid_until", F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("string").alias("supersedes"))
    return apply.superseded(rows, said, "2024-09-01")


@query("relation_union", f"WITH {VAULT_SQL} SELECT path, relation, target FROM vault WHERE doc_id % 2 = 0 UNION SELECT path, relation, target FROM vault WHERE doc_id % 3 = 0")
def relation_union(spark, sf):
    pages = vault_of(spark, sf)
    return apply.relations_joined(pages.where("doc_id % 2 = 0"), pages.where("doc_id % 3 = 0"))


@query("next_run", "SELECT CAST(max(run) + 1 AS BIGINT) AS next_run FROM (SELECT conv_id AS run FROM conversations UNION ALL SELECT user_id FROM events)")
def next_run(spark, sf):
    return apply.next_run(table(spark, sf, "conversations").select(F.col("conv_id").alias("run")), table(spark, sf, "events").select(F.col("user_id").alias("run")))


@query("scoped_pages", f"WITH {PAGES_SQL} SELECT kind, count(*) AS pages, count(*) FILTER (WHERE kind = 'crystal' OR list_contains(tags, 'crystal')) AS crystals FROM pages_ WHERE kind IN ('wiki', 'crystal') GROUP BY kind")
def scoped_pages(spark, sf):
    pages = pages_of(spark, sf)
    wide = predicates.scope(pages, "wiki").unionByName(predicates.crystals(pages))
    return wide.groupBy("kind").agg(F.count("*").alias("pages"), F.count_if((F.col("kind") == "crystal") | F.array_contains("tags", "crystal")).alias("crystals"))


@query("hyde_trigger", f"""WITH {QUERIES_SQL}, {BM25_SQL}, h AS (SELECT query_id, count(*) AS hits FROM bm25 GROUP BY 1) SELECT query_id, len({tokens_sql('query')}) <= 5 OR coalesce(hits, 0) = 0 AS expand FROM asked LEFT JOIN h USING (query_id)""")
def hyde_trigger(spark, sf):
    hits = bm25_of(spark, sf).groupBy("query_id").agg(F.count("*").alias("hits"))
    return asked(spark, sf).join(hits, "query_id", "left").select("query_id", predicates.needs_expansion(F.col("query"), F.coalesce("hits", F.lit(0))).alias("expand"))


@query("partial_titles", f"""WITH {PAGES_SQL}, t AS (SELECT doc_id, {tokens_sql('title')} AS w FROM pages_) SELECT doc_id, w[1] || ' ' || w[2] AS phrase, 0.85::DOUBLE AS confidence FROM t WHERE len(w) >= 3""")
def partial_titles(spark, sf):
    return resolve.partial_titles(pages_of(spark, sf).select("doc_id", "title"), "doc_id")


@query("entity_references", f"""WITH {VAULT_SQL}, p AS (SELECT path, title, target FROM vault WHERE kind <> 'raw'), i AS (SELECT target AS name, count(*) AS n FROM p GROUP BY 1) SELECT path, 1 + greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS refs FROM p LEFT JOIN i a ON a.name = p.path LEFT JOIN i b ON b.name = p.title""")
def entity_references(spark, sf):
    return resolve.reference_counts(vault_of(spark, sf).where("kind <> 'raw'"))


@query("canonical_names", f"""WITH {VAULT_SQL}, p AS (SELECT path, title, target, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM vault WHERE kind <> 'raw'), i AS (SELECT target AS name, count(*) AS n FROM p GROUP BY 1), r AS (SELECT p.*, 1 + greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS refs FROM p LEFT JOIN i a ON a.name = p.path LEFT JOIN i b ON b.name = p.title)
SELECT key, arg_min(path, (-refs, title, path)) AS canonical, count(*) AS pages FROM r WHERE key <> '' GROUP BY key""")
def canonical_names(spark, sf):
    """Of pages whose names come to the same key the one with most references, then the first by name."""
    pages = vault_of(spark, sf).where("kind <> 'raw'")
    counted = resolve.reference_counts(pages).join(pages.select("path", "title"), "path").withColumn("key", T.entity_key(F.col("title"))).where("key <> ''")
    return counted.groupBy("key").agg(F.min_by("path", F.struct(-F.col("refs"), "title", "path")).alias("canonical"), F.count("*").alias("pages"))


@query("candidate_pages", "SELECT target, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) AS target FROM pages) GROUP BY target ORDER BY n DESC, target LIMIT 50")
def candidate_pages(spark, sf):
    named = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), 1)).alias("target"))
    return named.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(50)


@query("filter_report", """WITH f AS (SELECT doc_id, strlen(text) AS raw, strlen(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '[ \\t]+', ' ', 'g')) AS kept, strlen(text) - strlen(regexp_replace(text, '[0-9]+', '', 'g')) AS digits FROM documents)
SELECT CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum(kept) AS BIGINT) AS kept_bytes, round(100.0::DOUBLE * (sum(raw) - sum(kept)) / sum(raw), 2) AS reduction, CAST(sum(digits) AS BIGINT) AS digits, CAST(sum(raw - digits - kept) AS BIGINT) AS blanks FROM f""")
def filter_report(spark, sf):
    """What filters cut from all texts: bytes by class, merged from each text's own map."""
    plain = F.regexp_replace("text", "[0-9]+", "")
    kept = F.regexp_replace(plain, r"[ \t]+", " ")
    each = table(spark, sf, "documents").select(F.octet_length("text").alias("raw"), F.octet_length(kept).alias("kept"), F.create_map(F.lit("digits"), F.octet_length("text") - F.octet_length(plain), F.lit("blanks"), F.octet_length(plain) - F.octet_length(kept)).alias("classes"))
    return lint.filter_report(each).select("raw_bytes", "kept_bytes", "reduction", F.col("classes")["digits"].alias("digits"), F.col("classes")["blanks"].alias("blanks"))


@query("path_dates", "SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 0")
def path_dates(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("raw/"), F.when(F.col("event_id") % 3 == 0, "undated").otherwise(F.date_format("ts", "yyyy-MM-dd")), F.lit("/s-"), "event_id", F.lit(".md")).alias("path"))
    return e.select("event_id", T.path_day(F.col("path")).alias("day"))


@query("raw_by_date", "SELECT CAST(ts AS DATE) AS day, event_type AS source, count(*) AS files, min(event_id) AS first_id FROM events GROUP BY ALL")
def raw_by_date(spark, sf):
    """Captures by day and by the source that their names begin with."""
    files = table(spark, sf, "events").select("event_id", F.concat(F.lit("raw/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), "event_type", F.lit("-"), "event_id", F.lit(".md")).alias("path"))
    listed = predicates.captures(files)
    return listed.groupBy("day", "source").agg(F.count("*").alias("files"), F.min(F.col("session").cast("long")).alias("first_id"))


@query("glob_match", "SELECT page_id, regexp_matches(u, '^[^/]*/[a-z]+/[0-9][^/]*$') AS direct, starts_with(u, 'm.') AS mobile FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)")
def glob_match(spark, sf):
    u = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf, "pages").select("page_id", u.rlike(T.glob_pattern("*/[a-z]+/[0-9]*")).alias("direct"), u.rlike(T.glob_pattern("m.**")).alias("mobile"))


@query("excerpts", r"SELECT doc_id, CASE WHEN length(s) > 120 THEN rtrim(substr(s, 1, 119)) || '…' ELSE s END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), 120).alias("excerpt"))


@query("refresh_facts", f"""WITH {PAGES_SQL} SELECT min(doc_id) AS doc_id, k FROM (SELECT doc_id, trim(regexp_replace(lower(substr(body, 1, 200)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS k, updated, body FROM pages_) WHERE updated > DATE '2024-09-01' - 14 AND updated <= DATE '2024-09-01' AND contains(lower(body), 'the') GROUP BY k""")
def refresh_facts(spark, sf):
    """Facts of the last fourteen days that name a needle, each once; a fact is the beginning of its page."""
    facts = pages_of(spark, sf).select("doc_id", "updated", "body", F.substring("body", 1, 200).alias("fact"))
    return predicates.refreshing(facts, "2024-09-01", "the").select("doc_id", "k")


@query("config_redaction", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '[REDACTED]' ELSE s_name END AS value FROM supplier")
def config_redaction(spark, sf):
    """Values under keys that look like secrets are hidden."""
    key = F.element_at(F.array(F.lit("api_key"), F.lit("name")), (F.col("s_suppkey") % 2 + 1).cast("int"))
    hidden = T.redact_config(F.create_map(key, F.col("s_name")))
    return table(spark, sf, "supplier").select("s_suppkey", F.map_values(hidden)[0].alias("value"))


@query("prompts", "SELECT n_nationkey, 'Tell me of ' || n_name || ' in ' || n_regionkey || '{{none}}' AS prompt FROM nation")
def prompts(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.filled(F.lit("Tell me of {{name}} in {{region}}{{none}}"), {"name": F.col("n_name"), "region": F.col("n_regionkey").cast("string")}).alias("prompt"))


@query("clipped_raw", f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN kind = 'raw' AND length(body) > 16000 THEN 16001 ELSE length(body) END AS chars, sha256(CASE WHEN kind = 'raw' AND length(body) > 16000 THEN substr(body, 1, 8000) || chr(10) || right(body, 8000) ELSE body END) AS body_sha256 FROM pages_")
def clipped_raw(spark, sf):
    clipped = lexical.clip_raw(F.col("body"), F.col("kind"))
    return pages_of(spark, sf).select("doc_id", F.length(clipped).cast("long").alias("chars"), F.sha2(clipped, 256).alias("body_sha256"))
