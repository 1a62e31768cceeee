"""From a model's answer to changed pages: operations parsed, judged, applied and journalled, as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import distill

# Kinds of operations, what may become of one, categories of pages, and those whose pages only a rewrite changes.
KINDS = ["write_page", "append_page", "rewrite_page", "update_index", "append_log", "dispute_page", "supersede_page"]
OUTCOMES = ["created", "appended", "rewritten", "index-updated", "log-appended", "staged-for-review", "merged", "skipped: no new content", "skipped: already applied", "rejected"]
CATEGORIES = ["projects", "people", "decisions", "lessons", "issues", "references", "tools", "threads", "procedures", "prospective", "preferences"]
KNOWLEDGE = [c for c in CATEGORIES if c != "threads"]
#: Fields of an operation; a kind uses some of them. derived_from and relations: targets that its front matter names.
OPERATION = "kind string, path string, body string, section string, entries array<string>, line string, conflicting_page string, old_page string, new_page string, reason string, valid_to string, confidence double, derived_from array<string>, relations array<string>"
SAFE = r"^wiki/(projects|people|decisions|lessons|issues|references|tools|threads|procedures|prospective|preferences)/[a-z0-9][a-z0-9._-]*\.md$"
#: Shares of the old page's anchors of each kind that a rewrite has to keep, and the confidence that it needs.
COVERAGE = {"links": 0.9, "code": 0.8, "names": 0.8, "relations": 0.9}
CONFIDENT = 0.7


def safe_path(path: Column) -> Column:
    """Whether a page may be written there: of a known category, without steps up."""
    return F.coalesce(path.rlike(SAFE) & ~F.contains(path, F.lit("..")), F.lit(False))


def covers(share: Callable[[str], Column], kinds: tuple[str, ...] = ("links", "code", "names")) -> Column:
    """Whether the shares of anchors kept are enough, each kind by its own measure."""
    enough = F.lit(True)
    for kind in kinds:
        enough &= share(kind) >= COVERAGE[kind]
    return enough


def operations(answers: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, seq, key and the fields of every operation in the fenced compile-ops block (a JSON list) or compile-op block (one) of an answer; other kinds and broken JSON give none."""
    block = lambda name: F.trim(F.regexp_extract(text_col, rf"(?s)```{name}\s+(.*?)```", 1))
    listed = F.from_json(block("compile-ops"), f"array<struct<{OPERATION.replace(' string', ': string').replace(' array', ': array')}>>")
    single = F.from_json(block("compile-op"), f"struct<{OPERATION.replace(' string', ': string').replace(' array', ': array')}>")
    found = F.coalesce(listed, F.when(single.isNotNull(), F.array(single)))
    rows = answers.select(F.col(id_col).alias("id"), F.posexplode(found).alias("seq", "op")).where(F.col("op.kind").isin(KINDS))
    return rows.select("id", "seq", "op.*")


def targeted(ops: DataFrame) -> DataFrame:
    """ops with the path that each is about, kebab-case for pages, its category (null where no page of a known one can be), and allowed."""
    path = F.coalesce(F.when(F.col("kind") == "supersede_page", F.col("new_page")).otherwise(F.col("path")), F.when(F.col("kind") == "update_index", "index.md").when(F.col("kind") == "append_log", "log.md"), F.lit(""))
    steps = F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/")
    at = lambda i: F.coalesce(F.get(steps, F.lit(i)), F.lit(""))
    paged, allowed = F.col("kind").isin("write_page", "append_page", "rewrite_page") & (at(0) == "wiki") & (F.size(steps) > 2), F.col("path")
    allowed = ~F.contains(allowed, F.lit("..")) & ~allowed.rlike("(?i)^(/|[a-z]:)") & ((allowed.startswith("wiki/") & allowed.endswith(".md")) | allowed.isin("index.md", "log.md"))
    known = paged & at(1).isin(CATEGORIES) & (F.size(steps) == 3) & at(2).endswith(".md")
    slug = T.slug(F.regexp_replace(at(2), r"\.md$", ""))
    named = ops.withColumn("path", path).withColumns({"allowed": allowed & (~paged | known), "category": F.when(known & allowed, at(1))})
    return named.withColumn("path", F.when(F.col("category").isNotNull() & (slug != ""), F.concat(F.lit("wiki/"), at(1), F.lit("/"), slug, F.lit(".md"))).otherwise(F.col("path")))


_STATE = "struct<kind:string,text:string,low:boolean,confidence:double,derived_from:array<string>,relations:array<string>,id:bigint,seq:int,out:array<struct<id:bigint,seq:int,kind:string,reason:string,kept:boolean>>>"


def _merged(ops: DataFrame) -> DataFrame:
    """One row per page and batch of ops (n, path, category, old, ...): the operation that all of them come to, in order of answer and place, and in out what became of those merged into it."""
    fields = ["id", "seq", "kind", "text", "confidence", "derived_from", "relations"]
    op = lambda own, kind, text, low: F.struct(kind.alias("kind"), text.alias("text"), low.alias("low"), *[own[c].alias(c) for c in fields[4:]])

    def step(acc: Column, x: Column) -> Column:
        a, b, missing = acc["kind"], x["kind"], x["old_missing"]
        core = x["category"] == "preferences"
        # What comes first: an append to no page is a write of little confidence, but for preferences.
        created = F.struct(
            F.when((b == "append_page") & missing, "write_page").otherwise(b).alias("kind"), x["text"].alias("text"), ((b == "append_page") & missing & ~core).alias("low"),
            F.when((b == "append_page") & missing, F.when(core, 0.8)).otherwise(x["confidence"]).alias("confidence"), x["derived_from"].alias("derived_from"), x["relations"].alias("relations"),
        )
        none = F.lit(False)
        raised = acc["low"] & (a == "write_page") & (b == "write_page")
        joins = a.isin("write_page", "append_page") & (b == "append_page")
        after = (
            F.when(a.isNull(), created)
            .when(raised, op(x, b, distill.joined_body(x["text"], acc["text"]), none))
            .when(b == "rewrite_page", op(x, b, x["text"], acc["low"]))
            .when(joins, op(acc, a, distill.joined_body(acc["text"], x["text"]), acc["low"]))
            .otherwise(op(acc, a, acc["text"], acc["low"]))
        )
        reason = (
            F.when(raised | joins & (a == "write_page"), "merged append_page into write_page").when(b == "rewrite_page", F.concat(F.lit("rewrite_page superseded duplicate "), a, F.lit(" for same target")))
            .when(a == "rewrite_page", F.concat(F.lit("skipped duplicate "), b, F.lit(" for rewrite target"))).when(joins, "merged append_page into append_page")
            .when(a == "append_page", "skipped write_page for existing append target").otherwise("skipped duplicate write_page for same target")
        )
        row = F.struct(x["id"].alias("id"), x["seq"].alias("seq"), b.alias("kind"), reason.alias("reason"), (raised | joins | (b == "rewrite_page")).alias("kept"))
        first = a.isNull()
        return F.struct(
            *[after[c].alias(c) for c in ("kind", "text", "low", "confidence", "derived_from", "relations")], F.when(first, x["id"]).otherwise(acc["id"]).alias("id"), F.when(first, x["seq"]).otherwise(acc["seq"]).alias("seq"),
            F.when(first, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"),
        ).cast(_STATE)

    none = F.struct(*[F.lit(None).alias(c) for c in ("kind", "text", "low", "confidence", "derived_from", "relations", "id", "seq")], F.array().alias("out")).cast(_STATE)
    packed = F.array_sort(F.collect_list(F.struct(*fields, "category", F.col("old").isNull().alias("old_missing"))))
    folded = ops.groupBy("path", "category").agg(packed.alias("ops"), F.first("old").alias("old"), F.first("old_relations").alias("old_relations")).withColumn("m", F.aggregate("ops", none, step))
    return folded.select("path", "category", "old", "old_relations", "m.*")


def _judged(ops: DataFrame, fresh: DataFrame, done: DataFrame) -> DataFrame:
    """ops of ``_merged`` with key, outcome, converted, reason, and after: the page's body where it changes."""
    key = F.sha2(F.to_json(F.struct("kind", "path", "text", "confidence", "derived_from", "relations")), 256)
    rows = ops.withColumn("key", key).join(fresh, "path", "left").join(done.select("key", F.lit(True).alias("again")).distinct(), "key", "left")
    kind, old, text = F.col("kind"), F.col("old"), F.coalesce("text", F.lit(""))
    there, said, new = old.isNotNull(), distill.prose(F.coalesce("old", F.lit(""))) != "", F.coalesce(F.col("fresh") != "", F.lit(False))
    knowledge = F.coalesce(F.col("category").isin(KNOWLEDGE), F.lit(False))
    before, then = distill.anchors_by_kind(F.coalesce("old", F.lit(""))), distill.anchors_by_kind(text)
    keys = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), distill.anchor_key))
    before["relations"], then["relations"] = keys(F.col("old_relations")), keys(F.coalesce("relations", "old_relations"))
    equal = distill.prose(F.coalesce("old", F.lit(""))) == distill.prose(text)
    enough = equal | covers(lambda k: distill.coverage(before[k], then[k]), tuple(COVERAGE))
    sources = F.size(F.array_distinct(F.filter(F.coalesce("derived_from", F.array().cast("array<string>")), lambda x: x.startswith("raw/")))) >= 2
    sure = F.when(F.col("confidence").isNotNull() & ((kind == "rewrite_page") | F.coalesce(F.col("category") == "preferences", F.lit(False))), F.col("confidence") >= CONFIDENT).otherwise(sources)
    update, write, append = kind.isin("write_page", "append_page"), kind == "write_page", kind == "append_page"
    dated = distill.strip(text).rlike(r"(?m)^##\s+\d{4}-\d{2}-\d{2}\b")
    rule = lambda outcome, reason=None, converted=False: F.struct(F.lit(outcome).alias("outcome"), (reason if isinstance(reason, Column) else F.lit(reason)).cast("string").alias("reason"), F.lit(converted).alias("converted"))
    verdict = (
        F.when(F.col("again"), rule("skipped: already applied", "recorded in the journal"))
        .when(update & there & said & knowledge, rule("staged-for-review", "knowledge-page update requires a rewrite"))
        .when(append & there & said & ~new, rule("skipped: no new content"))
        .when(write & there & said & ~new, rule("skipped: no new content", "no new content", True))
        .when(write & there & said | append & there & said & ~dated, rule("staged-for-review", "use rewrite_page for existing pages"))
        .when(write & there & ~new, rule("skipped: no new content", "no new content", True))
        .when((kind == "rewrite_page") & ~there, rule("rejected", "target page does not exist"))
        .when((kind == "rewrite_page") & ~enough, rule("staged-for-review", "rewrite drops anchors"))
        .when((kind != "append_page") & ~sure, rule("staged-for-review", F.when(F.col("low"), "append->create: low confidence").otherwise("low confidence")))
        .when((kind == "rewrite_page") & equal, rule("skipped: no new content")).when(kind == "rewrite_page", rule("rewritten"))
        .when(write & ~there, rule("created")).when(~there, rule("rejected", "target page does not exist"))
        .when(knowledge, rule("rejected", "knowledge-page update requires a rewrite"))
        .when(~new, rule("skipped: no new content")).when(write, rule("appended", None, True)).otherwise(rule("appended"))
    )
    rows = rows.withColumn("v", verdict).select("*", "v.*")
    section = F.when(write, F.concat(F.lit("## "), F.col("day"), F.lit(" update\n\n"), distill.strip(F.coalesce("fresh", F.lit(""))))).otherwise(text)
    after = F.when(F.col("outcome").isin("created", "rewritten"), F.concat(distill.strip(text), F.lit("\n"))).when(F.col("outcome") == "appended", F.concat(F.regexp_replace(old, r"\s+$", ""), F.lit("\n\n"), distill.strip(section), F.lit("\n")))
    return rows.withColumn("after", after).drop("v", "fresh", "again")


def carried_out(ops: DataFrame, pages: DataFrame, day: str, journal: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What becomes of operations (of ``operations``, and a column batch if they come in several) on pages (path, body, relations: array of targets), and the pages after them.

    First table: id, seq, kind, path, outcome, reason, converted, kept (whether its content is part of what was done,
    staged or skipped), key. Operations of a batch on one page are merged first (outcome "merged"): a batch has one
    operation left for a page, which is judged against the page as all batches before have left it. So round k takes
    the k-th batch of every page, side by side; rounds are as many as the batches of the page with most. Pages' own
    operations in turn: a key in the journal (key) or applied by a batch before is skipped; a page with prose takes
    updates by rewrites alone, but for threads, which take dated events; a write to a page without prose appends what
    is new under a dated heading; a rewrite must keep enough of each kind of anchors; writes need two raw sources
    (preferences and rewrites: or a number for their confidence). Index, log, dispute and supersede operations touch no
    page. Paths outside are rejected. Null texts count as empty, a null body is a page without prose.
    """
    if "batch" not in ops.columns:
        ops = ops.withColumn("batch", F.lit(0))
    if "relations" not in pages.columns:
        pages = pages.withColumn("relations", F.lit(None).cast("array<string>"))
    rows = targeted(ops).withColumns({"text": F.coalesce("body", "section", F.lit("")), "day": F.lit(day)})
    page = F.col("kind").isin("write_page", "append_page", "rewrite_page")
    # Operations on paths that are no category's pages are not merged: each is a batch of its own.
    own = F.when(F.col("category").isNull(), F.struct("batch", "id", "seq")).otherwise(F.struct("batch", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("seq")))
    acting = rows.where(page & F.col("allowed")).withColumn("n", F.dense_rank().over(Window.partitionBy("path").orderBy(own)))
    acting = written(acting.select("n", "id", "seq", "kind", "path", "category", "text", "confidence", "derived_from", "relations"), "apply-operations")
    outcome = F.when(~F.col("allowed"), "rejected").when(F.col("kind") == "update_index", "index-updated").when(F.col("kind") == "append_log", "log-appended").otherwise("created")
    aside = rows.where(~(page & F.col("allowed"))).select("id", "seq", "kind", "path", outcome.alias("outcome"), F.when(~F.col("allowed"), "path outside allowed targets").alias("reason"), F.lit(False).alias("converted"), F.col("allowed").alias("kept"), F.lit(None).cast("string").alias("key"))
    state = pages.select("path", F.coalesce("body", F.lit("")).alias("body"), "relations")
    done = journal.select("key") if journal is not None else ops.sparkSession.createDataFrame([], "key string")
    judged = [aside]
    for n in range(1, (acting.agg(F.max("n")).first()[0] or 0) + 1):
        turn = acting.where(F.col("n") == n).join(state.select("path", F.col("body").alias("old"), F.col("relations").alias("old_relations")), "path", "left")
        turn = written(_merged(turn).withColumn("day", F.lit(day)), "apply-merged")
        asks = turn.where("old IS NOT NULL AND kind <> 'rewrite_page'")
        if asks.isEmpty():
            fresh = asks.select("path", F.lit("").alias("fresh"))
        else:
            fresh = distill.net_new(asks.select("path", F.col("text").alias("body")), asks.select("path", F.col("old").alias("body")), "path")
        made = written(_judged(turn, fresh, done), "apply-judged")
        merged = made.select("path", F.explode("out").alias("o")).select("o.id", "o.seq", "o.kind", "path", F.lit("merged").alias("outcome"), "o.reason", F.lit(False).alias("converted"), "o.kept", F.lit(None).cast("string").alias("key"))
        judged += [made.select("id", "seq", "kind", "path", "outcome", "reason", "converted", (F.col("outcome") != "rejected").alias("kept"), "key"), merged]
        changes = made.where("after IS NOT NULL").select("path", F.col("after").alias("new"), F.when(F.col("outcome") == "appended", F.col("old_relations")).otherwise(F.coalesce("relations", "old_relations")).alias("new_relations"))
        state = written(state.join(changes, "path", "full").select("path", F.coalesce("new", "body").alias("body"), F.when(F.col("new").isNotNull(), F.col("new_relations")).otherwise(F.col("relations")).alias("relations")), "apply-pages")
        done = done.unionByName(made.where("after IS NOT NULL").select("key"))
    out = judged[0]
    for j in judged[1:]:
        out = out.unionByName(j)
    return out, state


def advanced(state: DataFrame, slices: DataFrame, judged: DataFrame, noise: DataFrame, gated: bool = True, plan: bool = False) -> DataFrame:
    """state (path, bytes) with the watermarks moved to the end of slices (path, bytes): only if gated and no mere plan, and of real slices only if an operation was applied or staged; noise-only slices (path, bytes) move on anyway."""
    if not gated or plan:
        return state
    worked = judged.where(~F.col("outcome").startswith("skipped") & (F.col("outcome") != "rejected")).limit(1).count() > 0
    moved = noise.unionByName(slices) if worked else noise
    done = moved.groupBy("path").agg(F.max("bytes").alias("__b"))
    return state.join(done, "path", "full").select("path", F.coalesce("__b", "bytes").alias("bytes"))


def superseded(pages: DataFrame, approvals: DataFrame, day: str) -> DataFrame:
    """pages (path, status, valid_until, superseded_by, supersedes) after approvals (old_page, new_page): the old one ends on the day and names the new, the new names the old. Approving again changes nothing."""
    ends = approvals.groupBy(F.col("old_page").alias("__old")).agg(F.max("new_page").alias("__by"))
    begins = approvals.groupBy(F.col("new_page").alias("__new")).agg(F.max("old_page").alias("__of"))
    rows = pages.join(ends, F.col("path") == F.col("__old"), "left").join(begins, F.col("path") == F.col("__new"), "left")
    hit = F.col("__by").isNotNull() & ~F.coalesce(F.col("status") == "superseded", F.lit(False))
    kept = [c for c in pages.columns if c not in ("status", "valid_until", "superseded_by", "supersedes")]
    return rows.select(
        *kept, F.when(hit, "superseded").otherwise(F.col("status")).alias("status"), F.when(hit, F.lit(day).cast("date")).otherwise(F.col("valid_until")).alias("valid_until"),
        F.when(hit, F.col("__by")).otherwise(F.col("superseded_by")).alias("superseded_by"), F.coalesce("supersedes", "__of").alias("supersedes"),
    )


def maintained(pages: DataFrame, action: str, paths: DataFrame, day: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """pages and the archive (path, archived_as) after delete, archive or unconfide (confidence 0) of the safe ones among paths (path); more than ``most`` at once are refused."""
    chosen = paths.where(safe_path(F.col("path"))).select("path").distinct()
    if action not in ("delete", "archive", "unconfide"):
        raise ValueError(f"no such action: {action}")
    if chosen.limit(most + 1).count() > most:
        raise ValueError(f"no more than {most} pages at once")
    name = F.element_at(F.split("path", "/"), -1)
    archive = pages.join(chosen, "path", "left_semi").select("path", F.concat(F.lit(f"wiki/.archive/{day}-"), name).alias("archived_as"))
    if action == "unconfide":
        hit = pages.join(chosen.withColumn("__hit", F.lit(True)), "path", "left")
        return hit.withColumn("confidence", F.when(F.col("__hit"), 0.0).otherwise(F.col("confidence"))).drop("__hit").select(*pages.columns), archive.limit(0)
    return pages.join(chosen, "path", "left_anti"), archive if action == "archive" else archive.limit(0)


def relations_joined(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, relation, target of both tables, each once: what a rewrite keeps of a page's relations."""
    return old.select("path", "relation", "target").union(new.select("path", "relation", "target")).distinct()


def next_run(*runs: DataFrame) -> DataFrame:
    """One row: the number after the highest that any of the tables (run) has, 1 if there is none."""
    every = runs[0].select("run")
    for r in runs[1:]:
        every = every.union(r.select("run"))
    return every.agg((F.coalesce(F.max("run"), F.lit(0)) + 1).cast("long").alias("next_run"))
