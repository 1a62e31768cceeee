"""Queries of captures: debounced queues, compaction, lost anchors, extracted facts and threads to be."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import compact, curation, distill, lint, models, narrative
from ..sources import frontmatter
from ..streaming import drain
from ..tables import VAULT_SQL, table, vault_of
from .base import query


@query("quiet_captures", """WITH e AS (SELECT user_id AS path, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts) AS n FROM e)
SELECT path, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS due, count(*) AS captures FROM g GROUP BY path, n""")
def quiet_captures(spark, sf):
    """A user's events as captures of one file, due after six hours of quiet."""
    found = drain.quiet(table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("at")), 6 * 3600)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first", "due")})


def logs(spark, sf):
    """Conversations as logs: each turn a tool observation whose input is what was said and whose output is the text of the document of its number."""
    turns = table(spark, sf, "conversations").join(table(spark, sf, "documents").select(F.col("doc_id").alias("__d"), F.col("text").alias("output")), F.expr("__d = conv_id * 7 + turn"), "left")
    block = F.concat(F.lit("\n## [10:00:0"), "turn", F.lit("] ToolUse: "), "role", F.lit("\n\n**Input:**\n\n```json\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n\n**Output:**\n\n```\n"), F.coalesce("output", F.lit("")), F.lit("\n```\n"))
    whole = F.array_sort(F.collect_list(F.struct("turn", block.alias("b"))))
    return turns.groupBy(F.concat(F.lit("raw/c"), "conv_id").alias("path")).agg(F.concat(F.lit("# log"), F.array_join(F.transform(whole, lambda x: x["b"]), "")).alias("text"))


CAPS = (400, 1000)


@query("compact_raw")
def compact_raw(spark, sf):
    """Logs that compaction changes, and where a watermark at three quarters of each then stands."""
    texts, remap = compact.compacted(logs(spark, sf), *CAPS)
    marks = texts.select("path", F.expr("bytes_before * 3 DIV 4").alias("bytes"))
    digests = texts.select("path", F.sha2("text", 256).alias("text_sha256"), "bytes_before", "bytes_after", "observations")
    return digests.join(compact.carried(marks, remap).withColumnRenamed("bytes", "watermark"), "path")


def rewritten(spark, sf):
    """Each text with its first long word of every line as a link and the last as code before a rewrite, and without those marks, case and the last line after it: what it lost."""
    old = F.regexp_replace(F.regexp_replace("text", r"(?m)^([A-Za-z]{5,})", "[[x/$1]]"), r"(?m)([a-z]{5,})\.$", "`lib/$1.py`.")
    d = table(spark, sf, "documents").select("doc_id", old.alias("old"), F.regexp_replace("text", r"\n[^\n]*$", "").alias("body"))
    before, after = distill.anchors_by_kind(F.col("old")), distill.anchors_by_kind(F.col("body"))
    lost = lambda k: F.array_except(before[k], after[k])
    return d.select(F.col("doc_id").alias("path"), "body", lost("links").alias("links"), lost("code").alias("code"), (F.col("doc_id") % 5).alias("other"))


@query("relink_anchors")
def relink_anchors(spark, sf):
    made = compact.relinked(rewritten(spark, sf))
    return made.select("path", F.sha2("body", 256).alias("body_sha256"), F.size("restored").cast("long").alias("restored"), "skipped")


@query("extracted_facts", r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS pos FROM documents), f AS (SELECT doc_id, pos, trim(line) AS fact, lower(regexp_replace(trim(line), '\s+', ' ', 'g')) AS plain FROM l WHERE contains(lower(line), 'ation')),
o AS (SELECT doc_id, plain, min(pos) AS pos, arg_min(fact, pos) AS fact FROM f GROUP BY ALL), a AS (SELECT doc_id, sha256(string_agg(fact, chr(10) ORDER BY pos)) AS facts_sha256, count(*) AS facts FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(facts, 0) AS facts, coalesce(facts_sha256, sha256('')) AS facts_sha256, d.doc_id % 3 = 0 AS from_cache FROM documents d LEFT JOIN a USING (doc_id)""")
def extracted_facts(spark, sf):
    """Facts that a stand-in model finds in every text, sent in chunks of 2,000 bytes; a third of the texts are in the cache of a run before."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end"), F.lit("ation").alias("entity"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    _, cache = models.extracted_facts(d.where("path % 3 = 0"), models.line_model, most_bytes=2000)
    found, _ = models.extracted_facts(d, models.line_model, cache, 2000)
    return found.select(F.col("path").cast("long").alias("doc_id"), F.size("facts").cast("long").alias("facts"), F.sha2(F.array_join("facts", "\n"), 256).alias("facts_sha256"), "from_cache")


def thread_inputs(spark, sf):
    """Pages of the vault, their links and relations, and what threads relate to."""
    pages = vault_of(spark, sf)
    relation = lint.relations(pages)
    edges = lint.links(pages).select("from_path", "to_path").unionByName(relation.select("from_path", "to_path")).where("to_path IS NOT NULL").distinct()
    threads = pages.where("category = 'threads' AND kind <> 'raw'").select(F.col("path").alias("from_path")).join(relation, "from_path").select(F.col("from_path").alias("thread"), F.col("to_path").alias("target")).where("target IS NOT NULL")
    return pages.select("path", "title", "kind", "category"), edges, threads


@query("discovered_threads")
def discovered_threads(spark, sf):
    return curation.discovered_threads(*thread_inputs(spark, sf))


def detect_stand_in(prompts: list[str]) -> list[tuple[str, bool, int]]:
    """Facts that begin with "not " as claims, others that the body does not hold as news."""
    out = []
    for prompt in prompts:
        head, _, old = prompt.partition("\n---\n")
        facts = head.split("\n")[1:]
        found = {"contradicted_claims": [f for f in facts if f.startswith("not ")], "net_new_facts": [f for f in facts if not f.startswith("not ") and f not in old]}
        out.append((json.dumps(found), False, 1))
    return out


def write_stand_in(prompts: list[str]) -> list[tuple[str, bool, int]]:
    """The body with the news after it; by the page's number with a heading, without its links, or only with a full stop more."""
    out = []
    for prompt in prompts:
        head, news, old = prompt.split("\n---\n", 2)
        kind = int(head.split("\n")[0]) % 5
        body = f"# x\n{old}" if kind == 2 else re.sub(r"\[\[.*?\]\]", "", old) if kind == 3 else f"{old}." if kind == 4 else f"{old} {' '.join(news.split(chr(10)))}"
        out.append(("Here:\n```json\n" + json.dumps({"body": body}) + "\n```", False, 2))
    return out


@query("narrative_rewrites", rf"""WITH {VAULT_SQL}, n AS (SELECT v.doc_id, v.body AS old, trim(string_split(replace(d.text, chr(13), ''), chr(10))[1]) AS news FROM vault v LEFT JOIN documents d ON d.doc_id = v.doc_id + 1),
k AS (SELECT *, news IS NOT NULL AND news <> '' AND NOT contains(old, news) AS fresh, doc_id % 10 = 1 AS many, regexp_extract(old, '\[\[[^\]]+\]\]') AS link FROM n WHERE news <> '' OR doc_id % 10 = 1 OR doc_id % 4 = 0),
o AS (SELECT *, CASE WHEN many THEN 'staged-for-review' WHEN NOT fresh THEN 'unchanged' WHEN doc_id % 5 IN (2, 3) THEN 'staged-for-review' WHEN doc_id % 5 = 4 THEN 'unchanged' ELSE 'rewritten' END AS outcome FROM k)
SELECT doc_id, outcome, CASE WHEN many THEN 'too many contradicted claims for automatic rewrite' WHEN fresh AND doc_id % 5 = 2 THEN 'narrative body must not contain headings' WHEN fresh AND doc_id % 5 = 3 THEN 'synthesized body dropped wikilinks: ' || link END AS reason,
 CASE WHEN outcome = 'rewritten' THEN sha256(regexp_replace(regexp_replace(old || ' ' || news, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) END AS body_sha256, CASE WHEN many OR NOT fresh THEN 1 ELSE 2 END AS calls FROM o""".replace("\\\\", chr(92)))
def narrative_rewrites(spark, sf):
    """All pages of the vault, with the first line of the next document as a fact, every fourth also its own, every tenth ten contradicted claims."""
    pages = vault_of(spark, sf)
    first = F.trim(F.get(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), F.lit(0)))
    lines = table(spark, sf, "documents").select("doc_id", first.alias("fact"))
    claims = pages.where("doc_id % 10 = 1").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat(F.lit("not "), i))).alias("fact"))
    facts = lines.select((F.col("doc_id") - 1).alias("doc_id"), "fact").unionByName(lines.where("doc_id % 4 = 0")).where("fact <> ''").unionByName(claims)
    named = lambda df, *more: df.select(F.col("doc_id").cast("string").alias("path"), *more)
    made = narrative.synthesized(named(pages, "body"), named(facts, "fact"), detect_stand_in, write_stand_in)
    body = F.when(F.col("outcome") == "rewritten", F.sha2("body", 256))
    return made.select(F.col("path").cast("long").alias("doc_id"), "outcome", "reason", body.alias("body_sha256"), "calls")


def fact_stand_in(prompts: list[str]) -> list[tuple[str, bool, int]]:
    """Of each log's chunk one fact for every tool observation: named by its role, with the first two lines of its input."""
    out = []
    for prompt in prompts:
        facts = [{"title": f"said by {role}", "facts": [x.strip() for x in given.split("\n")[:2]], "narrative": f"{role} spoke", "concepts": [role], "files": [], "importance": len(given) % 12} for role, given in re.findall(r"ToolUse: (\w+)\n\n\*\*Input:\*\*\n\n```json\n([\s\S]*?)\n```", prompt)]
        out.append((json.dumps({"facts": facts}), False, 1))
    return out


@query("compressed_sessions")
def compressed_sessions(spark, sf):
    """Facts of all sessions, every third of which an earlier run has compressed already."""
    files = logs(spark, sf).withColumn("size", F.octet_length("text").cast("long"))
    state = files.where("length(path) % 3 = 0").select("path", F.col("size").alias("bytes"), F.lit(narrative.VERSION).alias("version"))
    report, facts, _ = narrative.compressed(files, state, fact_stand_in, most_bytes=6000, most_chunks=4, most=1 << 30)
    return report.join(facts, "path", "left").select("path", "outcome", report["facts"].alias("n_facts"), "chunks", "sent", "title", "members", "importance", F.sha2(F.array_join(facts["facts"], "\n"), 256).alias("facts_sha256"))


def page_files(spark, sf):
    """Pages of the vault as texts with nested front matter; that of every seventh is broken."""
    front = F.concat(
        F.lit("---\ntype: lessons # a kind\ntitle: \""), F.coalesce("title", F.lit("")), F.lit("\"\ntags: ["), "lang", F.lit(", '"), "source", F.lit("']\nrelations:\n  "), "relation", F.lit(":\n    - target: "), "target", F.lit("\n      confidence: 0."),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit("\n      source: {agent: x, at: null}\n  uses:\n  - 'it''s'\n"), F.when(F.col("doc_id") % 7 == 0, "more: [1\n").otherwise(""), F.lit("---\n\n"),
    )
    return vault_of(spark, sf).select("doc_id", "path", F.concat(front, "body").alias("text"))


@query("front_matter", f"""WITH {VAULT_SQL}, p AS (SELECT * FROM vault WHERE doc_id % 7 <> 0)
SELECT path, relation, target, CAST('0.' || doc_id % 9 + 1 AS DOUBLE) AS confidence FROM p UNION ALL SELECT path, 'uses', 'it''s', NULL FROM p UNION ALL SELECT path, 'error', 'front matter: a bracket does not close', NULL FROM vault WHERE doc_id % 7 = 0""".replace("'0.' || doc_id % 9 + 1", "'0.' || (doc_id % 9 + 1)"))
def front_matter(spark, sf):
    """The relations that pages' front matter names, after it was read, written and read again; and what cannot be read."""
    read = frontmatter.with_front(page_files(spark, sf).select("path", "text"))
    again = frontmatter.with_front(read.where("error IS NULL").select("path", frontmatter.page_text(F.col("front"), F.col("body")).alias("text")))
    wrong = read.where("error IS NOT NULL").select("path", F.lit("error").alias("relation"), F.col("error").alias("target"), F.lit(None).cast("double").alias("confidence"))
    return frontmatter.relations(again).unionByName(wrong)
