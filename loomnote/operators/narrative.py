"""Chains of model calls over pages and sessions, stage by stage: rows leave at the stage that decides them, and only the rest goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import small_batches, written
from . import assembly, curation, distill, models

#: Contradicted claims from which on a page is left to people, and the version of compression that a watermark must have.
MOST_CONTRADICTED, VERSION = 10, 1
LINKS = r"(\[\[[^\]]+\]\])"


def asked(rows: DataFrame, prompt: Column, chat: models.Chat, name: str) -> DataFrame:
    """rows with reply, cut (whether it was cut short) and tokens of a batch model, and failed: the error of its batch. Written, so that no model is asked twice for a row."""
    columns = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                said, failed = chat(f["__prompt"].tolist()), None
            except Exception as e:  # the provider's error becomes the rows' reason
                said, failed = [(None, False, 0)] * len(f), f"{type(e).__name__}: {e}"
            yield f.drop(columns="__prompt").assign(reply=[s[0] for s in said], cut=[s[1] for s in said], tokens=[s[2] for s in said], failed=failed)

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in rows.schema)
    small_batches(rows.sparkSession)
    return written(rows.withColumn("__prompt", prompt).select(*columns, "__prompt").mapInPandas(run, f"{kinds}, reply string, cut boolean, tokens long, failed string"), name)


def _strings(reply: Column, field: str) -> Column:
    got = F.from_json(assembly.json_in(reply), f"{field} array<string>")[field]
    return F.filter(F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def synthesized(pages: DataFrame, facts: DataFrame, detect: models.Chat, write: models.Chat, judge: models.Chat | None = None) -> DataFrame:
    """path, outcome (unchanged, staged-for-review, rewritten, failed), reason, body, calls, tokens of the pages (path, body) that have facts (path, fact).

    Stages: detect names contradicted claims and new facts (neither: unchanged; too many claims: staged), write gives a
    body that takes them in, judge, if given, may find it unsupported; it must be narrative, keep every link of the old
    body, and say something else than that. Replies cut short or without what is asked, and failing models, give failed
    rows, to be tried again. A stage asks its model only about the rows that all before have left, in batches; body is
    the new text where there is one. Facts of one page are one prompt; null bodies count as empty; pages are distinct.
    """
    told = facts.groupBy("path").agg(F.array_sort(F.collect_set("fact")).alias("facts"))
    rows = pages.select("path", F.coalesce("body", F.lit("")).alias("old")).join(told, "path")
    done: list[DataFrame] = []

    def leave(df: DataFrame, calls: int) -> DataFrame:
        """What has an outcome now goes to the results, the rest goes on."""
        done.append(df.where("outcome IS NOT NULL").select("path", "outcome", "reason", (F.col("body") if "body" in df.columns else F.lit(None).cast("string")).alias("body"), F.lit(calls).alias("calls"), F.col("spent").alias("tokens")))
        return df.where("outcome IS NULL").drop("outcome", "reason", "reply", "cut", "tokens", "failed")

    broken = lambda missing: F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("cut"), "reply was cut short").when(missing, "no answer in the reply")
    prompt = F.concat_ws("\n", "path", F.array_join("facts", "\n"), F.lit("---"), "old")
    one = asked(rows, prompt, detect, "narrative-detect").withColumn("spent", F.col("tokens"))
    one = one.withColumns({"claims": _strings(F.col("reply"), "contradicted_claims"), "news": _strings(F.col("reply"), "net_new_facts")}).withColumn("bad", broken(assembly.json_in(F.col("reply")).isNull()))
    many = F.size("claims") >= MOST_CONTRADICTED
    one = one.withColumn("outcome", F.when(F.col("bad").isNotNull(), "failed").when((F.size("claims") == 0) & (F.size("news") == 0), "unchanged").when(many, "staged-for-review"))
    left = leave(one.withColumn("reason", F.coalesce("bad", F.when(many, "too many contradicted claims for automatic rewrite"))).drop("bad"), 1)

    prompt = F.concat_ws("\n", "path", F.array_join("claims", "\n"), F.lit("---"), F.array_join("news", "\n"), F.lit("---"), "old")
    two = asked(left, prompt, write, "narrative-write").withColumn("spent", F.col("spent") + F.col("tokens"))
    body = F.from_json(assembly.json_in(F.col("reply")), "body string")["body"]
    two = two.withColumn("bad", broken(F.coalesce(F.trim(body), F.lit("")) == "")).withColumn("body", distill.strip(F.regexp_replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), r"\n{3,}", "\n\n")))
    left = leave(two.withColumn("outcome", F.when(F.col("bad").isNotNull(), "failed")).withColumnRenamed("bad", "reason"), 2)
    calls = 2
    if judge is not None:
        three = asked(left, F.concat_ws("\n", "body", F.lit("---"), F.array_join("facts", "\n"), F.lit("---"), "old"), judge, "narrative-judge").withColumn("spent", F.col("spent") + F.col("tokens"))
        claims = F.array_join(_strings(F.col("reply"), "unsupported_claims"), "; ")
        three = three.withColumn("outcome", F.when(F.col("failed").isNotNull(), "failed").when(~models.supported(F.col("reply"), F.col("cut")), "staged-for-review"))
        left, calls = leave(three.withColumn("reason", F.coalesce("failed", F.concat(F.lit("unsupported claims: "), claims))), 3), 3
    fault = curation.narrative_fault(F.col("body"))
    lost = F.filter(F.array_distinct(F.regexp_extract_all("old", F.lit(LINKS), 1)), lambda x: ~F.contains(F.col("body"), x))
    reason = F.coalesce(fault, F.when(F.size(lost) > 0, F.concat(F.lit("synthesized body dropped wikilinks: "), F.array_join(lost, ", "))))
    same = distill.prose(F.col("old")) == distill.prose(F.col("body"))
    last = left.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNotNull(), "staged-for-review").when(same, "unchanged").otherwise("rewritten"))
    leave(last, calls)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pending_sessions(files: DataFrame, state: DataFrame, most: int = 25) -> DataFrame:
    """files (path, size, ...) with plan: skipped (the state (path, bytes, version) has this size and version), pending for the first ``most`` others by path, deferred for the rest. Paths are distinct."""
    known = state.select("path", F.col("bytes").alias("__bytes"), F.col("version").alias("__version"))
    rows = files.join(known, "path", "left").withColumn("plan", F.when((F.col("__bytes") == F.col("size")) & (F.col("__version") == VERSION), "skipped")).drop("__bytes", "__version")
    first = rows.where("plan IS NULL").select("path").orderBy("path").limit(most).withColumn("__first", F.lit(True))
    return rows.join(first, "path", "left").withColumn("plan", F.coalesce("plan", F.when(F.col("__first"), "pending").otherwise("deferred"))).drop("__first")


def compressed(files: DataFrame, state: DataFrame, chat: models.Chat, most_bytes: int = 20_000, most_chunks: int = 8, most: int = 25, like: float = 0.82) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions (path, size, text) to facts, only where size or version are new: a report, the facts, and the state (path, bytes, version) afterwards.

    Report: path, outcome (skipped, deferred, compressed, failed), facts, chunks, sent. Facts: path, seq, title, members,
    importance, narrative, facts, concepts, files, merged by like titles within a session in order. A log is cut into
    chunks, of many an even sample with the first and last is sent, secrets redacted; each chunk is a row of its own.
    A session of which any reply fails has no facts and keeps its old watermark. Null texts have no chunks.
    """
    plan = written(pending_sessions(files, state, most), "compress-plan")
    chunks = models.session_chunks(plan.where("plan = 'pending'"), most_bytes, "path", "text")
    counted = written(chunks.withColumn("chunk", F.col("chunk").cast("long")), "compress-chunks")
    total = counted.groupBy("path").agg(F.count("*").alias("chunks"))
    chosen = total.select("path", "chunks", F.explode(assembly.sampled_chunks(F.col("chunks"), most_chunks)).alias("chunk"))
    sent = counted.join(chosen, ["path", "chunk"]).select("path", "chunk", "chunks", T.redact(F.col("text")).alias("text"))
    replies = asked(sent.repartition("path", "chunk"), F.concat_ws("\n", "path", F.concat(F.lit("Chunk "), F.col("chunk") + 1, F.lit(" of "), "chunks"), "text"), chat, "compress-replies")
    failed = F.col("failed").isNotNull() | F.col("cut")
    whole = replies.groupBy("path").agg(F.bool_or(failed).alias("failed"), F.count("*").alias("sent"), F.first("chunks").alias("chunks"))
    objects = F.from_json(F.get_json_object(assembly.json_in(F.col("reply")), "$.facts"), f"array<struct<{', '.join(':'.join(x.split()) for x in assembly.FACT.split(', '))}>>")
    single = replies.select("path", "chunk", F.posexplode(objects).alias("at", "o")).withColumn("fact", assembly.fact_of(F.to_json("o"))).where("fact IS NOT NULL")
    good = single.join(whole.where("NOT failed").select("path"), "path", "left_semi").select(F.col("path").alias("session"), (F.col("chunk") * (1 << 20) + F.col("at")).alias("seq"), "fact.*")
    facts = written(distill.merge_facts(good, like).withColumnRenamed("session", "path"), "compress-facts")
    made = facts.groupBy("path").agg(F.count("*").alias("facts"))
    outcome = F.when(F.col("plan") != "pending", F.col("plan")).when(F.coalesce("failed", F.lit(False)), "failed").otherwise("compressed")
    report = plan.select("path", "size", "plan").join(whole, "path", "left").join(made, "path", "left").select("path", "size", outcome.alias("outcome"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("facts", "chunks", "sent")])
    report = written(report, "compress-report")
    fresh = report.where("outcome = 'compressed'").select("path", F.col("size").cast("long").alias("bytes"), F.lit(VERSION).alias("version"))
    after = state.select("path", F.col("bytes").cast("long").alias("bytes"), F.col("version").cast("int").alias("version")).join(fresh, "path", "left_anti").unionByName(fresh)
    return report.drop("size"), facts, after
