"""Where models plug in: embedders, judges and chat models are Python functions of batches; deterministic stand-ins are given."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..storage import small_batches, written
from . import assembly, vector

Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(texts: list[str], dim: int = 16) -> list[list[float]]:
    """A stand-in: components from the bytes of the text's SHA-256, between -1 and 1."""
    return [[b / 127.5 - 1 for b in hashlib.sha256(t.encode()).digest()[:dim]] for t in texts]


def embed(docs: DataFrame, embedder: Embedder, model: str, dim: int, text: str = "body", key: str = "path") -> DataFrame:
    """key, hash, vector, model, dim, reason: one record a document; a vector that the guard refuses, or a batch whose embedder fails, has a reason and is to be tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                made, failed = embedder(f["input"].tolist()), None
            except Exception as e:  # the provider's error becomes the batch's reason
                made, failed = [None] * len(f), f"embedder: {e}"
            yield f.assign(vector=made, failed=failed).drop(columns="input")

    inputs = docs.select(F.col(key), assembly.embedding_input(F.coalesce(F.col(text), F.lit(""))).alias("input")).withColumn("hash", F.sha2("input", 256))
    kind = docs.schema[key].dataType.simpleString()
    made = inputs.mapInPandas(run, f"{key} {kind}, hash string, vector array<float>, failed string")
    checked = vector.guard(made, dim, "vector").withColumn("reason", F.coalesce("failed", "reason")).drop("failed")
    return checked.withColumns({"model": F.lit(model), "dim": F.lit(dim)}).select(key, "hash", "vector", "model", "dim", "reason")


def supported(reply: Column, truncated: Column) -> Column:
    """A judge's verdict: a truncated reply does not support the claim, one that cannot be read does."""
    verdict = F.get_json_object(assembly.json_in(reply), "$.supported")
    return ~F.coalesce(truncated, F.lit(False)) & F.coalesce(verdict != "false", F.lit(True))


#: Fixed value: what stands where a text was cut, with the number of bytes that are gone.
ELIDED = "\n\n\u2026 [{}bytes elided] \u2026\n\n"


def middle_cut(text: str, most: int) -> str:
    """A text of at most ``most`` bytes in UTF-8: two fifths of the room from its start, the rest from its end, between them a mark that counts what is gone; no character is cut."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    mark = ELIDED.format("").encode()
    while True:
        room = most - len(mark)
        if room <= 0:
            return mark[: max(0, most)].decode(errors="ignore")
        first = room * 2 // 5
        head, tail = raw[:first].decode(errors="ignore").encode(), raw[len(raw) - (room - first) :].decode(errors="ignore").encode()
        told = ELIDED.format(f"{len(raw) - len(head) - len(tail)} ").encode()
        if len(head) + len(told) + len(tail) <= most:
            return (head + told + tail).decode()
        mark = told


def truncate_middle(text: str | Column, most: int) -> Column:
    """``middle_cut`` of a column; null for null."""

    @F.pandas_udf(StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else middle_cut(t, most) for t in texts])

    return cut(text)


def byte_chunks(text: str, most: int) -> list[str]:
    """A log cut at observation headers, then packed to at most ``most`` bytes, over-long parts by lines and at last inside lines, never inside a character."""
    parts: list[str] = []
    for line in text.splitlines(keepends=True):
        if line.startswith("## [") or not parts:
            parts.append("")
        parts[-1] += line
    out: list[str] = []
    for part in parts:
        pieces = [part] if len(part.encode()) <= most else part.splitlines(keepends=True)
        for piece in pieces:
            raw = piece.encode()
            while len(raw) > most:
                cut = next(i for i in range(most, most - 4, -1) if raw[i] & 0xC0 != 0x80)
                out.append(raw[:cut].decode())
                raw = raw[cut:]
            piece = raw.decode()
            if out and len(out[-1].encode()) + len(raw) <= most and piece is not part:
                out[-1] += piece
            else:
                out.append(piece)
    return out


def session_chunks(logs: DataFrame, most: int, key: str, text: str) -> DataFrame:
    """key, chunk (from 0), text of the byte-capped chunks of each log."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c) for k, t in zip(f["k"], f["t"], strict=True) if t for i, c in enumerate(byte_chunks(t, most))]
            yield pd.DataFrame(rows, columns=["k", "chunk", "text"])

    kind = logs.schema[key].dataType.simpleString()
    small_batches(logs.sparkSession)
    return logs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, chunk int, text string").withColumnRenamed("k", key)


#: A chat model: prompts of a batch in, for each its answer, whether it was cut short, and the tokens it took.
Chat = Callable[[list[str]], list[tuple[str, bool, int]]]


def line_model(prompts: list[str]) -> list[tuple[str, bool, int]]:
    """A stand-in for extraction: of the text after the prompt's first line the lines that name what the first line names, as facts."""
    out = []
    for prompt in prompts:
        entity, _, text = prompt.partition("\n")
        facts = [line.strip() for line in text.split("\n") if entity.lower() in line.lower()]
        out.append(("```json\n" + json.dumps({"facts": facts}) + "\n```", False, len(prompt.encode()) // 4))
    return out


def line_chunks(text: str, most: int) -> list[str]:
    """A text's lines packed to at most ``most`` bytes in UTF-8, a longer line alone; a text that fits stays whole."""
    if len(text.encode()) <= most:
        return [text]
    out, size = [], 0
    for line in re.split(r"\r?\n", text):
        more = len(line.encode())
        if out and size + 1 + more <= most:
            out[-1].append(line)
            size += 1 + more
        else:
            out.append([line])
            size = more
    return [c for c in ("\n".join(x) for x in out) if c.strip()]


def extracted_facts(ranges: DataFrame, chat: Chat, cache: DataFrame | None = None, most_bytes: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Facts about entities in ranges of raw texts (path, start, end, entity, text), and the cache after it.

    First: path, start, end, entity, facts, truncated, from_cache, tokens, in no order. Second: path, start, end, entity,
    facts, tokens: what the cache (of such rows) had and what is new. A range goes to the model only if the cache has
    not its path, bytes and entity, compared without case and signs; of ranges that repeat those one goes. Texts are
    sent by lines in chunks, which are rows of their own, so a long text is no single task; facts are those before the
    first answer that was cut short, each once whatever its case and blanks, in order. A range with such an answer is
    truncated and not cached. Unreadable answers give no facts; null texts count as empty.
    """
    key = ["path", "start", "end", "name"]
    kind = "path string, start long, end long, entity string, facts array<string>, tokens long"
    known = cache if cache is not None else ranges.sparkSession.createDataFrame([], kind)
    known = known.withColumn("name", T.entity_key(F.col("entity")))
    rows = ranges.select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "start", "end", "entity", F.coalesce("text", F.lit("")).alias("text")).withColumn("name", T.entity_key(F.col("entity"))).dropDuplicates(key)
    missing = rows.join(known.select(*key).distinct(), key, "left_anti")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chunks = [line_chunks(t, most_bytes) for t in f["text"]]
            yield f.drop(columns="text").assign(chunk=[list(enumerate(c)) for c in chunks]).explode("chunk").dropna(subset=["chunk"]).assign(n=lambda d: [c[0] for c in d["chunk"]], prompt=lambda d: [f"{e}\n{c[1]}" for e, c in zip(d["entity"], d["chunk"], strict=True)]).drop(columns="chunk")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = chat(f["prompt"].tolist())
            yield f.drop(columns="prompt").assign(reply=[s[0] for s in said], truncated=[s[1] for s in said], tokens=[s[2] for s in said])

    ids = "path string, start long, end long, entity string, name string, n int"
    asked = missing.select("path", "start", "end", "entity", "name", "text").mapInPandas(cut, f"{ids}, prompt string").repartition("path", "start", "end", "n").mapInPandas(ask, f"{ids}, reply string, truncated boolean, tokens long")
    asked = written(asked, "facts-answers")
    found = F.coalesce(F.from_json(assembly.json_in(F.col("reply")), "facts array<string>")["facts"], F.array().cast("array<string>"))
    each = asked.withColumn("first", F.min(F.when(F.col("truncated"), F.col("n"))).over(Window.partitionBy(*key)))
    facts = each.where("first IS NULL OR n < first").select(*key, "n", F.posexplode(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")).alias("at", "fact"))
    once = facts.groupBy(*key, F.lower(F.regexp_replace("fact", r"\s+", " ")).alias("plain")).agg(F.min(F.struct("n", "at", "fact")).alias("f"))
    listed = once.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["fact"]).alias("facts"))
    whole = each.groupBy(*key).agg(F.bool_or("truncated").alias("truncated"), F.sum("tokens").alias("tokens"))
    none = F.array().cast("array<string>")
    fresh = missing.select(*key, "entity").join(listed, key, "left").join(whole, key, "left").select(*key, "entity", F.coalesce("facts", none).alias("facts"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    fresh = written(fresh, "facts-fresh")
    columns = ["path", "start", "end", "entity", "facts", "truncated", "from_cache", "tokens"]
    had = rows.select(*key, "entity").join(known.drop("entity"), key).withColumns({"truncated": F.lit(False), "from_cache": F.lit(True)})
    kept = fresh.where("NOT truncated").select("path", "start", "end", "entity", "facts", "tokens")
    return fresh.withColumn("from_cache", F.lit(False)).select(columns).unionByName(had.select(columns)), known.drop("name").select(kept.columns).unionByName(kept)
