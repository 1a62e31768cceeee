"""Queries over texts and pages: scalar functions, filters, classifications, chunks and diffs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import params
from ..functions import text as T
from ..operators import apply, distill, predicates, tables
from ..tables import PAGES_SQL, pages_of, table
from .base import query

TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tokens_sql(c: str) -> str:
    return TOKENS_SQL.format(c=c)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    return _literal(re.sub(r"\(\?![^)]*\)", "", pattern))


@query("tokenize", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, t[1] AS first_token FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", 0).alias("first_token"))


_REDACTED = reduce(lambda c, r: f"regexp_replace({c}, {_re2(r[0])}, {_literal(r[1].replace('$1', chr(92) + '1'))}, 'g')", params.SECRET_RULES, "text")


@query("redact_secrets", f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256, {_REDACTED} <> text AS changed FROM documents")
def redact_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.redact(F.col("text")).alias("r"), "text").select("doc_id", F.sha2("r", 256).alias("redacted_sha256"), (F.col("r") != F.col("text")).alias("changed"))


_COUNTED = " + ".join(f"len(regexp_extract_all(text, {_re2(r[0])}))" for r in params.SECRET_RULES)


@query("secret_count", f"SELECT source, CAST(sum({_COUNTED}) AS BIGINT) AS secrets, count(*) AS docs FROM documents GROUP BY source")
def secret_count(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(T.secret_count(F.col("text"))).alias("secrets"), F.count("*").alias("docs"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS short_hash, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS body_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.substring(F.sha2("text", 256), 1, 16).alias("short_hash"), T.body_key(F.col("text")).alias("body_hash"))


@query("slugify", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("snippet", "SELECT doc_id, substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], 1, 240) AS snippet FROM documents")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("as_of_filter", f"WITH {PAGES_SQL} SELECT doc_id, valid_from, valid_until FROM pages_ WHERE coalesce(valid_from, DATE '2024-05-01') <= DATE '2024-05-01' AND coalesce(valid_until, DATE '2024-05-01') >= DATE '2024-05-01'")
def as_of_filter(spark, sf):
    return predicates.valid_as_of(pages_of(spark, sf), "2024-05-01").select("doc_id", "valid_from", "valid_until")


@query("identity_inclusive", f"WITH {PAGES_SQL} SELECT doc_id, agent_id, user_id FROM pages_ WHERE (agent_id IS NULL AND user_id IS NULL) OR agent_id = 'agent2'")
def identity_inclusive(spark, sf):
    return predicates.identity_filter(pages_of(spark, sf), agent="agent2").select("doc_id", "agent_id", "user_id")


@query("identity_strict", f"WITH {PAGES_SQL} SELECT doc_id, agent_id, user_id FROM pages_ WHERE agent_id = 'agent2' AND user_id = 'user3'")
def identity_strict(spark, sf):
    return predicates.identity_filter(pages_of(spark, sf), "agent2", "user3", strict=True).select("doc_id", "agent_id", "user_id")


@query("list_pages", f"WITH {PAGES_SQL} SELECT doc_id, title, updated FROM pages_ WHERE kind = 'wiki' AND list_contains(tags, 'en') AND status = 'active'")
def list_pages(spark, sf):
    return predicates.list_pages(pages_of(spark, sf), "wiki", "en", "active").select("doc_id", "title", "updated").orderBy(F.desc("updated"), "doc_id")


@query("trailing_window", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 30 AND (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY 1")
def trailing_window(spark, sf):
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return predicates.trailing_days(orders, "day", 30).groupBy("day").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("grep_context", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
m AS (SELECT *, regexp_matches(line, '(?i)licensed under') AS hit FROM l),
n AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, hit FROM n WHERE near""")
def grep_context(spark, sf):
    return predicates.grep_context(table(spark, sf, "documents"), "(?i)licensed under", text_col="text")


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(q, {_literal(p)}) THEN {_literal(n)}" for p, n, _ in params.INTENT_RULES) + " ELSE 'open-ended' END"
_SURE = "CASE " + " ".join(f"WHEN regexp_matches(q, {_literal(p)}) THEN {c}" for p, _, c in params.INTENT_RULES) + " ELSE 0.5 END"
_ASKED = "lower(trim(['how do i ', 'what did we decide on ', 'when did ', 'show me the code of ', 'the error in ', 'on 2024-05-01 ', ''][turn % 7 + 1] || text))"


@query("query_intent", f"SELECT conv_id, turn, {_INTENT} AS intent, CAST({_SURE} AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, {_ASKED} AS q FROM conversations WHERE role = 'user')")
def query_intent(spark, sf):
    asked = F.element_at(F.array(*[F.lit(x) for x in ("how do i ", "what did we decide on ", "when did ", "show me the code of ", "the error in ", "on 2024-05-01 ", "")]), (F.col("turn") % 7 + 1).cast("int"))
    label, sure = predicates.intent(F.concat(asked, "text"))
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", label.alias("intent"), sure.alias("confidence"))


_CATEGORY = "['tools', 'lessons', 'projects', 'decisions', 'references', 'threads', 'procedures', 'prospective', 'crystals', 'notes']"


@query("cognitive_type", f"""WITH {PAGES_SQL}, i AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id),
c AS (SELECT p.*, {_CATEGORY}[doc_id // 7 % 10 + 1] AS category, coalesce(e.n, 0) AS inbound FROM pages_ p LEFT JOIN (SELECT value AS doc_id, count(*) AS n FROM (SELECT user_id AS value FROM events UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1) e USING (doc_id))
SELECT doc_id, CASE WHEN category = 'crystals' THEN 'semantic' WHEN category = 'prospective' THEN 'prospective' WHEN category = 'threads' THEN 'episodic' WHEN category = 'procedures' THEN 'procedural'
 WHEN category = 'projects' AND status = 'active' AND inbound >= 5 THEN 'core' WHEN category IN ('tools', 'lessons') THEN 'procedural' WHEN category IN ('references', 'decisions') THEN 'semantic'
 WHEN kind = 'raw' AND DATE '2024-08-01' - created BETWEEN 0 AND 30 THEN 'episodic' ELSE 'semantic' END AS cognitive_type FROM c""")
def cognitive_type(spark, sf):
    names = _CATEGORY.strip("[]").replace("'", "").split(", ")
    category = F.element_at(F.array(*[F.lit(x) for x in names]), (F.expr("doc_id DIV 7") % 10 + 1).cast("int"))
    # What points at a page: the rows that carry its number.
    inbound = table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).union(table(spark, sf, "lineitem").select("l_suppkey")).groupBy("doc_id").agg(F.count("*").alias("n"))
    pages = pages_of(spark, sf).join(inbound, "doc_id", "left")
    return pages.select("doc_id", predicates.cognitive_type(F.col("kind"), category, F.col("status"), F.coalesce("n", F.lit(0)), F.col("created"), "2024-08-01").alias("cognitive_type"))


@query("dispatch_policy", """SELECT vec_id, CASE WHEN c = 'noop' THEN 'noop' WHEN NOT (sim >= 0.5 AND newer) THEN 'rewrite_page' WHEN c = 'contradiction' THEN 'dispute_page' WHEN c = 'supersession' THEN 'supersede_page' ELSE 'rewrite_page' END AS decision
FROM (SELECT vec_id, ['noop', 'contradiction', 'supersession', 'update'][vec_id % 4 + 1] AS c, (vec_id % 10) / 10.0 AS sim, label % 2 = 0 AS newer FROM embeddings)""")
def dispatch_policy(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("noop", "contradiction", "supersession", "update")]), (F.col("vec_id") % 4 + 1).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", predicates.dispatch(kind, F.col("vec_id") % 10 / 10, F.lit(0.5), F.col("label") % 2 == 0).alias("decision"))


@query("proposal_confidence", """WITH c AS (SELECT conv_id, count(*) AS obs, count(DISTINCT role) AS sessions, conv_id % 3 // 2 AS stripped, conv_id % 5 // 4 AS leaks, conv_id % 7 // 6 AS commands FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(r) = 0 THEN 'high' ELSE 'low' END AS level, CASE WHEN len(r) = 0 THEN 'all signals clean' ELSE array_to_string(r, '; ') END AS reasons FROM (
SELECT conv_id, list_filter([CASE WHEN stripped <> 0 THEN 'strippedReferenceCount=' || stripped END, CASE WHEN leaks <> 0 THEN 'prosePathLeaksCount=' || leaks END, CASE WHEN commands <> 0 THEN 'commandsStripped=' || commands END,
 CASE WHEN obs < 5 THEN 'observationCount=' || obs || ' below threshold 5' END, CASE WHEN sessions < 2 THEN 'distinctSessions=' || sessions || ' below threshold 2' END], lambda x: x IS NOT NULL) AS r FROM c)""")
def proposal_confidence(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("obs"), F.countDistinct("role").alias("sessions"))
    level, reasons = predicates.proposal_confidence(F.expr("conv_id % 3 DIV 2"), F.expr("conv_id % 5 DIV 4"), F.expr("conv_id % 7 DIV 6"), F.col("obs"), F.col("sessions"))
    return c.select("conv_id", level.alias("level"), F.array_join(reasons, "; ").alias("reasons"))


@query("provenance_tier", f"""WITH {PAGES_SQL} SELECT doc_id, CASE WHEN kind = 'wiki' AND ((facts <= 1 AND derived <= 1) OR coalesce(confidence < 0.5, false)) THEN 'low' WHEN (confidence IS NULL OR confidence >= 0.9) AND facts >= 3 AND derived >= 2 THEN 'high' ELSE 'medium' END AS tier
FROM (SELECT *, doc_id % 6 AS facts, doc_id % 4 AS derived FROM pages_)""")
def provenance_tier(spark, sf):
    return pages_of(spark, sf).select("doc_id", predicates.provenance_tier(F.col("kind"), F.col("confidence"), F.col("doc_id") % 6, F.col("doc_id") % 4).alias("tier"))


_CASES = lambda c, t: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + " ELSE 1.0 END"


@query("metadata_score", f"""WITH {PAGES_SQL} SELECT doc_id, round(CAST(least(1.0, CAST({_CASES('status', params.STATUS_FACTOR)} AS DOUBLE) * CAST({_CASES('lifecycle', params.LIFECYCLE_FACTOR)} AS DOUBLE) * CAST({_CASES('validation', params.VALIDATION_FACTOR)} AS DOUBLE)
 * coalesce(confidence, 0.7::DOUBLE) * CASE WHEN DATE '2024-06-01' - updated BETWEEN 0 AND 30 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS DOUBLE), 6) AS score FROM pages_""")
def metadata_score(spark, sf):
    s = predicates.metadata_score(F.col("status"), F.col("lifecycle"), F.col("validation"), F.col("confidence"), F.col("updated"), "2024-06-01")
    return pages_of(spark, sf).select("doc_id", F.round(s, 6).alias("score"))


@query("byte_budget_scan", """SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 20000""")
def byte_budget_scan(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return predicates.byte_budget(docs, 20_000, "path", "n_chars", "source").select("doc_id", "source", "n_chars")


@query("exact_dedup", r"""SELECT min(doc_id) AS doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS body_hash, count(*) AS copies FROM documents GROUP BY 2""")
def exact_dedup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.body_key(F.col("text")).alias("body_hash")).groupBy("body_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("turn_spans", """WITH b AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, CAST(coalesce(sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "begin" FROM conversations)
SELECT conv_id, turn, role, "begin", CAST(coalesce(lead("begin") OVER (PARTITION BY conv_id ORDER BY turn), "begin" + n) AS BIGINT) AS "end" FROM b""")
def turn_spans(spark, sf):
    return distill.turn_spans(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "begin", "end")


@query("sessionize_turns", """SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn, sha256(string_agg('## ' || role || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)) AS body_sha256 FROM conversations GROUP BY conv_id""")
def sessionize_turns(spark, sf):
    return distill.sessionize(table(spark, sf, "conversations")).select("conv_id", "turns", "first_turn", "last_turn", F.sha2("body", 256).alias("body_sha256"))


@query("log_tail", "SELECT conv_id, turn, role, n FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def log_tail(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("n")).where("n <= 3")


@query("token_windows", r"""WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil((n - 48) / 336.0) AS BIGINT), 1))) AS ordinal FROM t WHERE n > 0)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(ordinal * 336 AS INTEGER) AS first, CAST(least(384, n - ordinal * 336) AS INTEGER) AS n_tokens FROM w""")
def token_windows(spark, sf):
    return distill.token_windows(table(spark, sf, "documents"), text_col="text").withColumnRenamed("first", "first")


@query("chunk_stats")
def chunk_stats(spark, sf):
    c = distill.chunks(table(spark, sf, "documents"), text_col="text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("byte_start").alias("first_byte"), F.max("byte_end").alias("last_byte"), F.sum(F.length("text")).alias("chars"))


_CLASS = lambda p: f"strlen(text) - strlen(regexp_replace(text, {_literal(p.replace('(?m)', '(?m)'))}, '', 'g'))"


@query("noise_bytes", "SELECT source, " + ", ".join(f"CAST(sum({_CLASS(p)}) AS BIGINT) AS {n}" for n, p in distill.NOISE_RULES.items()) + ", CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def noise_bytes(spark, sf):
    cols = distill.noise_bytes(F.col("text"))
    return table(spark, sf, "documents").groupBy("source").agg(*[F.sum(c.cast("long")).alias(n) for n, c in cols.items()], F.sum(F.octet_length("text").cast("long")).alias("bytes"))


_ANCHORS = r"list_distinct(list_concat(list_concat(regexp_extract_all({c}, '\[\[([^\]\|]+)', 1), regexp_extract_all({c}, '`([^`\n]+)`', 1)), regexp_extract_all({c}, '\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b', 1)))"
_MARKED = "regexp_replace(text, '([A-Z][a-z]+) ([a-z])', '`\\1` \\2', 'g')"


@query("extract_anchors", f"SELECT doc_id, CAST(len({_ANCHORS.format(c=_MARKED)}) AS BIGINT) AS anchors FROM documents")
def extract_anchors(spark, sf):
    marked = F.regexp_replace("text", r"([A-Z][a-z]+) ([a-z])", "`$1` $2")
    return table(spark, sf, "documents").select("doc_id", F.size(distill.anchors(marked)).cast("long").alias("anchors"))


_HALF = f"substr({_MARKED}, 1, CAST(length({_MARKED}) // 2 AS BIGINT))"


# The anchors of each kind, as the rules of rewrites name them.
_KEY = r"lower(trim(regexp_replace(regexp_replace(replace(x, chr(92), '/'), '^wiki/', ''), '(?i)\.md$', '')))"
KINDS_SQL = {
    "links": r"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({c}, '\[\[([^\]\n]+)\]\]', 1), lambda x: trim(string_split(x, '|')[1])), lambda x: x <> ''), lambda x: KEY))",
    "code": r"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({c}, '`([^`\n]+)`', 1), lambda x: trim(x)), lambda x: regexp_matches(x, '[\\/._-]')), lambda x: KEY))",
    "names": r"list_distinct(list_transform(list_filter(regexp_extract_all({c}, '\b((?:[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*|[A-Za-z]+[A-Z][A-Za-z0-9]*))\b', 1), lambda x: length(x) > 2), lambda x: KEY))",
}
KINDS_SQL = {k: v.replace("KEY", _KEY) for k, v in KINDS_SQL.items()}
# Words before full stops become links, the last words of sentences before a comma code.
_ANCHORED = "regexp_replace(regexp_replace(replace(text, '`', ''), '([a-z]+)\\. ', '[[\\1]] ', 'g'), '([a-z]+), ', '`a/\\1` ', 'g')"
_FRONT = f"substr({_ANCHORED}, 1, CAST(length({_ANCHORED}) * 17 // 20 AS BIGINT))"


@query("anchor_coverage", f"""WITH a AS (SELECT doc_id, {', '.join(f"{v.format(c=_ANCHORED)} AS {k}_b, {v.format(c=_FRONT)} AS {k}_a" for k, v in KINDS_SQL.items())} FROM documents),
c AS (SELECT doc_id, {', '.join(f"CASE WHEN len({k}_b) = 0 THEN 1.0 ELSE len(list_intersect({k}_b, {k}_a)) / CAST(len({k}_b) AS DOUBLE) END AS {k}" for k in KINDS_SQL)} FROM a)
SELECT doc_id, {', '.join(f"round({k}, 6) AS {k}" for k in KINDS_SQL)}, links >= 0.9 AND code >= 0.8 AND names >= 0.8 AS enough FROM c""")
def anchor_coverage(spark, sf):
    """What the first 85 % of each text keep of its anchors, kind by kind, and whether that is enough for a rewrite."""
    plain = F.replace("text", F.lit("`"), F.lit(""))
    whole = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.regexp_replace(plain, r"([a-z]+)\. ", "[[$1]] "), "([a-z]+), ", "`a/$1` ").alias("m"))
    before, after = distill.anchors_by_kind(F.col("m")), distill.anchors_by_kind(F.expr("substr(m, 1, CAST(length(m) * 17 DIV 20 AS INT))"))
    shares = whole.select("doc_id", *[distill.coverage(before[k], after[k]).alias(k) for k in before])
    return shares.select("doc_id", *[F.round(k, 6).alias(k) for k in before], apply.covers(lambda k: F.col(k)).alias("enough"))


@query("net_new_lines", """WITH l AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT *, trim(lower(line)) AS norm FROM l WHERE trim(lower(line)) <> '')
SELECT DISTINCT source, norm AS line FROM n a WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM n b WHERE b.source = a.source AND b.norm = a.norm AND b.doc_id % 2 = 0)""")
def net_new_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("body"))
    return distill.net_new_lines(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "source").select("source", F.trim(F.lower("line")).alias("line")).distinct()


# A page's text without every " the ", and the next page's after it, as its update; the update of every fifth begins with a dated heading.
PROSE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(part, '(?m)^#+\s+', '', 'g'), '[`*_~\[\]()#>:.-]+', ' ', 'g'), '\s+', ' ', 'g')))"
_STRIPPED = r"list_transform(string_split_regex({c}, '{by}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_BLOCKS = "list_filter(" + _STRIPPED.replace("{by}", r"\n\s*\n") + ", lambda x: x <> '')"
_ROWS = _STRIPPED.replace("{by}", r"\r?\n")
_UNDATED = r"array_to_string(list_filter(string_split_regex(body, '\r?\n'), lambda x: NOT regexp_matches(trim(x), '(?i)^##\s+\d{4}-\d{2}-\d{2}\s+update\b')), chr(10))"
_TOKENS = "list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) > 2))"
NET_NEW = f"""b AS (SELECT key, unnest(l) AS part, generate_subscripts(l, 1) AS block FROM (SELECT key, {_BLOCKS.format(c=_UNDATED)} AS l FROM new_)),
l AS (SELECT key, block, unnest(l) AS part, generate_subscripts(l, 1) AS line FROM (SELECT key, block, {_ROWS.format(c='part')} AS l FROM b)),
p AS (SELECT *, {PROSE} AS norm FROM (SELECT key, block, 0 AS line, part FROM b UNION ALL SELECT key, block, line, part FROM l)), pw AS (SELECT *, {_TOKENS} AS w FROM p WHERE norm <> ''),
h AS (SELECT key, whole, {PROSE} AS norm FROM (SELECT key, true AS whole, unnest({_BLOCKS.format(c='body')}) AS part FROM old_ UNION ALL SELECT key, false, unnest({_ROWS.format(c='body')}) FROM old_)), hw AS (SELECT DISTINCT key, whole, norm, {_TOKENS} AS w FROM h WHERE norm <> ''),
k AS (SELECT * FROM pw WHERE len(w) > 0 AND NOT EXISTS (SELECT 1 FROM hw WHERE hw.key = pw.key AND ((hw.norm = pw.norm AND hw.whole = (line = 0)) OR 100 * len(list_intersect(hw.w, pw.w)) >= 80 * len(pw.w)))),
t AS (SELECT a.key, a.block, string_agg(k.part, chr(10) ORDER BY k.line) AS part FROM k a JOIN k ON k.key = a.key AND k.block = a.block AND k.line > 0 WHERE a.line = 0 GROUP BY 1, 2),
fresh AS (SELECT key, string_agg(part, chr(10) || chr(10) ORDER BY block) AS fresh FROM t GROUP BY 1)"""


@query("net_new_prose", f"""WITH old_ AS (SELECT doc_id AS key, text AS body FROM documents),
new_ AS (SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN '## 2024-01-05 update' || chr(10) || chr(10) ELSE '' END || replace(text, ' the ', ' ') || chr(10) || chr(10) || coalesce((SELECT m.text FROM documents m WHERE m.doc_id = d.doc_id + 1), '') AS body FROM documents d),
{NET_NEW} SELECT key AS doc_id, sha256(fresh) AS fresh_sha256 FROM fresh""")
def net_new_prose(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    dated = F.when(F.col("doc_id") % 5 == 0, "## 2024-01-05 update\n\n").otherwise("")
    new = docs.join(after, "doc_id", "left").select("doc_id", F.concat(dated, F.replace("text", F.lit(" the "), F.lit(" ")), F.lit("\n\n"), F.coalesce("next", F.lit(""))).alias("body"))
    found = distill.net_new(new, docs.withColumnRenamed("text", "body"), "doc_id")
    return found.select("doc_id", F.sha2("fresh", 256).alias("fresh_sha256"))


# The rule table, row by row: what the first operation on a page is, what comes next, and what is then.
@query("merge_ops", r"""WITH RECURSIVE o AS (SELECT conv_id AS path, ['append', 'write', 'append', 'rewrite', 'append', 'write'][(conv_id + turn * (conv_id % 3 + 1)) % 6 + 1] AS kind, ' ' || role || turn || chr(10) AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT path, kind, content, n FROM o WHERE n = 1 UNION ALL
SELECT f.path, CASE WHEN o.kind = 'rewrite' THEN 'rewrite' ELSE f.kind END,
 CASE WHEN o.kind = 'rewrite' THEN o.content WHEN f.kind IN ('write', 'append') AND o.kind = 'append' THEN regexp_replace(f.content, '\s+$', '') || chr(10) || chr(10) || regexp_replace(o.content, '^\s+|\s+$', '', 'g') || chr(10) ELSE f.content END, o.n
FROM f JOIN o ON o.path = f.path AND o.n = f.n + 1)
SELECT path, arg_max(kind, n) AS kind, arg_max(content, n) AS content FROM f GROUP BY path""")
def merge_ops(spark, sf):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("append", "write", "append", "rewrite", "append", "write")]), ((F.col("conv_id") + F.col("turn") * (F.col("conv_id") % 3 + 1)) % 6 + 1).cast("int"))
    return distill.merge_operations(table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("seq"), kind.alias("kind"), F.concat(F.lit(" "), "role", "turn", F.lit("\n")).alias("content")))


@query("decay", "SELECT o_orderkey, CAST(p AS BIGINT) AS periods, round(8 * pow(CAST(0.9 AS DOUBLE), p), 6) AS strength, round(8 * pow(CAST(0.9 AS DOUBLE), p), 6) < 1 AND d >= 180 AND o_orderstatus <> 'P' AS archive FROM (SELECT *, DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS d, floor((DATE '2000-01-01' - CAST(o_orderdate AS DATE)) / 14.0) AS p FROM orders)")
def decay(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("updated"), (F.col("o_orderstatus") == "P").alias("pinned"))
    return tables.decay(orders, "2000-01-01", pinned="pinned").select("o_orderkey", "periods", "strength", "archive")


@query("stale_pages", f"WITH {PAGES_SQL} SELECT doc_id, kind, updated FROM pages_ WHERE status = 'active' AND DATE '2025-01-01' - updated > 180")
def stale_pages(spark, sf):
    return pages_of(spark, sf).where((F.col("status") == "active") & (F.datediff(F.lit("2025-01-01").cast("date"), "updated") > 180)).select("doc_id", "kind", "updated")


@query("freshness_check", f"""WITH {PAGES_SQL}, c AS (SELECT kind, count(*) AS pages, count(*) FILTER (WHERE DATE '2025-01-01' - updated > 90) AS stale FROM pages_ GROUP BY kind)
SELECT kind, pages, stale, CASE WHEN stale * 100 >= pages * 30 OR stale >= 100 THEN 'fail' WHEN stale * 100 >= pages * 10 OR stale >= 20 THEN 'warn' ELSE 'pass' END AS status FROM c""")
def freshness_check(spark, sf):
    c = pages_of(spark, sf).groupBy("kind").agg(F.count("*").alias("pages"), F.count_if(F.datediff(F.lit("2025-01-01").cast("date"), "updated") > 90).alias("stale"))
    bad = lambda share, n: (F.col("stale") * 100 >= F.col("pages") * share) | (F.col("stale") >= n)
    return c.withColumn("status", F.when(bad(30, 100), "fail").when(bad(10, 20), "warn").otherwise("pass"))


@query("bloated_pages", "SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 8")
def bloated_pages(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines")).where("lines >= 8")


@query("remember_topk", f"""WITH {PAGES_SQL}, p AS (SELECT lang, doc_id, confidence, row_number() OVER (PARTITION BY lang ORDER BY confidence DESC, doc_id) AS n FROM pages_ WHERE confidence >= 0.7 AND kind <> 'raw')
SELECT lang, doc_id, confidence, n FROM p WHERE n <= 10""")
def remember_topk(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.desc("confidence"), "doc_id")
    return pages_of(spark, sf).where("confidence >= 0.7 AND kind <> 'raw'").select("lang", "doc_id", "confidence", F.row_number().over(w).cast("long").alias("n")).where("n <= 10")


@query("confidence_buckets", f"WITH {PAGES_SQL} SELECT kind, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS pages FROM pages_ GROUP BY 1, 2")
def confidence_buckets(spark, sf):
    bucket = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    return pages_of(spark, sf).groupBy("kind", bucket.alias("bucket")).agg(F.count("*").alias("pages"))


@query("index_by_category", f"WITH {PAGES_SQL} SELECT kind, status, doc_id, title, count(*) OVER (PARTITION BY kind, status) AS pages FROM pages_")
def index_by_category(spark, sf):
    """The index: an entry for each page, its category and how many that holds; a list of a category is never gathered."""
    pages = pages_of(spark, sf).select("kind", "status", "doc_id", "title")
    return pages.join(F.broadcast(pages.groupBy("kind", "status").agg(F.count("*").alias("pages"))), ["kind", "status"])


@query("storage_stats", "SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(doc_id) AS latest FROM documents GROUP BY source")
def storage_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max("doc_id").alias("latest"))
