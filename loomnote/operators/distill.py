"""Turns, chunks, noise, anchors and the merge of page operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import small_batches, written
from . import graph, resolve

# What a log line must look like to count as noise, by class.
NOISE_RULES = {
    "ansi": r"\x1b\[[0-9;]*[A-Za-z]",
    "base64": r"[A-Za-z0-9+/]{200,}={0,2}",
    "data_uri": r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
    "cwd_reset": r"(?m)^Shell cwd was reset to .*$",
}
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")


def turn_spans(rows: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """rows with begin and end: character offsets of each turn in its conversation, an end being the next begin."""
    w = Window.partitionBy(group).orderBy(order)
    begin = F.coalesce(F.sum(F.length(F.coalesce(text, F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("begin", begin)
    return placed.withColumn("end", F.coalesce(F.lead("begin").over(w), F.col("begin") + F.length(F.coalesce(text, F.lit("")))))


def sessionize(rows: DataFrame, group: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """One row a session: turns, first and last turn, and all turns' text in order as one body."""
    whole = F.array_sort(F.collect_list(F.struct(order, "role", text)))
    body = F.array_join(F.transform(whole, lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), F.coalesce(x[text], F.lit("")))), "\n")
    return rows.groupBy(group).agg(F.count("*").alias("turns"), F.min(order).alias("first_turn"), F.max(order).alias("last_turn"), body.alias("body"))


def noise_bytes(text: Column) -> dict[str, Column]:
    """Bytes that each noise class takes of a text."""
    return {name: F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, "")) for name, pattern in NOISE_RULES.items()}


def denoise(text: Column) -> Column:
    for pattern in NOISE_RULES.values():
        text = F.regexp_replace(text, pattern, "")
    return text


def anchors(text: Column) -> Column:
    """Distinct anchors of a text in order: [[links]], `code` and CamelCase names."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\[\[([^\]\|]+)"), 1), F.regexp_extract_all(text, F.lit("`([^`\\n]+)`"), 1), F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), 1))
    return F.array_distinct(found)


#: The heading of a dated update, and what a text's anchors of each kind look like.
UPDATE = r"(?i)^##\s+\d{4}-\d{2}-\d{2}\s+update\b"
LINK, CODE = r"\[\[([^\]\n]+)\]\]", "`([^`\\n]+)`"
NAME = r"(?<![A-Za-z0-9_])((?:[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*|[A-Za-z]+[A-Z][A-Za-z0-9]*))(?![A-Za-z0-9_])"


def strip(text: Column) -> Column:
    """text without white space at its ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def anchor_key(value: Column) -> Column:
    """What anchors are compared by: slashes one way, without wiki/ and .md, trimmed, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), "^wiki/", ""), r"(?i)\.md$", "")
    return F.lower(F.trim(plain))


def anchors_by_kind(text: Column) -> dict[str, Column]:
    """Distinct keys of a text's links, code (paths and dotted names only) and names (capitalised or mixed-case words, longer than two signs), each an array."""
    every = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), strip)
    links = F.transform(every(LINK), lambda x: F.trim(F.get(F.split(x, r"\|"), F.lit(0))))
    prose = F.array_join(F.filter(F.split(text, r"\r?\n"), lambda line: ~F.trim(line).rlike(UPDATE)), "\n")
    names = F.transform(F.regexp_extract_all(prose, F.lit(NAME), 1), strip)
    found = {"links": F.filter(links, lambda x: x != ""), "code": F.filter(every(CODE), lambda x: x.rlike(r"[\\/._-]")), "names": F.filter(names, lambda x: F.length(x) > 2)}
    return {kind: F.array_distinct(F.transform(values, anchor_key)) for kind, values in found.items()}


def coverage(before: Column, after: Column) -> Column:
    """Share of the earlier anchors that are still there; 1 without any."""
    return F.when(F.size(before) == 0, 1.0).otherwise(F.size(F.array_intersect(before, after)) / F.size(before))


def net_new_lines(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """key, line of new pages' lines that the old pages' lines of the same key do not have, compared trimmed and in lower case."""
    lines = lambda df: df.select(key, F.explode(F.split("body", "\n")).alias("line")).withColumn("norm", F.trim(F.lower("line"))).where("norm <> ''")
    return lines(new).join(lines(old).select(key, "norm").distinct(), [key, "norm"], "left_anti").select(key, "line")


def prose(text: Column) -> Column:
    """A text as prose is compared: without heading and list signs, blanks collapsed, in lower case."""
    signs = F.regexp_replace(F.regexp_replace(text, r"(?m)^#+\s+", ""), r"[`*_~\[\]()#>:.-]+", " ")
    return F.lower(F.trim(F.regexp_replace(signs, r"\s+", " ")))


def _blocks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda b: b != "")


def unsaid(norms: list[str], heads: list[bool], known: list[str], whole: list[bool], least: int) -> list[int]:
    """Which of a new text's pieces (their prose, and whether they are whole blocks) no block or line of an old one equals or covers; of m words one of the rarest m - least * m / 100 + 1 must be among the old ones', so only such old pieces are looked at."""
    words = lambda s: frozenset(w for w in s.split(" ") if len(w) > 2)
    equal = set(zip(known, whole, strict=True))
    sets = list({w for w in map(words, set(known)) if w})
    index: dict[str, list[int]] = {}
    for n, s in enumerate(sets):
        for w in s:
            index.setdefault(w, []).append(n)
    out = []
    for i, (norm, head) in enumerate(zip(norms, heads, strict=True)):
        own = words(norm)
        if not own or (norm, head) in equal:
            continue
        rare = sorted(own, key=lambda w: len(index.get(w, ())))[: len(own) + (-len(own) * least // 100) + 1]
        if not any(100 * len(own & sets[n]) >= least * len(own) for n in {n for w in rare for n in index.get(w, ())}):
            out.append(i)
    return out


def net_new(new: DataFrame, old: DataFrame, key: str, least: int = 80) -> DataFrame:
    """key, fresh: what of each new text (key, body) the old texts of its key (key, body) don't say yet; keys with nothing new are left out.

    Blocks (between blank lines) and lines go whose prose an old block or line equals, or of whose distinct words
    (longer than two signs) an old block or line has ``least`` percent; so do those without words and headings of dated
    updates. What stays is joined again, lines by line ends, blocks by blank lines.

    New and old texts meet by key, a pair of texts a row, and no piece of them leaves that row: what is shuffled are the
    texts. Of several old texts a piece must be new to each. One row per key is taken from new; a key without old text
    is new as a whole. Null texts have nothing.
    """
    small_batches(new.sparkSession)

    @F.pandas_udf("array<int>")
    def kept(norms: pd.Series, heads: pd.Series, known: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([unsaid(list(n), list(h), list(k), list(w), least) for n, h, k, w in zip(norms, heads, known, whole, strict=True)], dtype=object)

    lines = lambda c: F.transform(F.split(c, r"\r?\n"), strip)
    undated = lambda c: F.array_join(F.filter(F.split(c, r"\r?\n"), lambda line: ~F.trim(line).rlike(UPDATE)), "\n")
    piece = lambda k, i, x: F.struct(k.alias("block"), i.alias("line"), x.alias("part"))
    pieces = lambda c: F.flatten(F.transform(_blocks(undated(c)), lambda b, k: F.concat(F.array(piece(k, F.lit(-1), b)), F.transform(lines(b), lambda x, i: piece(k, i, x)))))
    had = lambda c: F.filter(F.transform(F.concat(F.transform(_blocks(c), lambda b: F.struct(F.lit(True).alias("whole"), b.alias("part"))), F.transform(lines(c), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("part")))), lambda p: F.struct(p["whole"].alias("whole"), prose(p["part"]).alias("norm"))), lambda p: p["norm"] != "")
    none = F.array().cast("array<struct<whole:boolean,norm:string>>")
    met = new.where("body IS NOT NULL").select(key, "body").join(old.where("body IS NOT NULL").select(key, F.col("body").alias("__old")), key, "left")
    cut = met.select(key, pieces(F.col("body")).alias("p"), F.coalesce(had(F.col("__old")), none).alias("h"))
    asked = cut.select(key, "p", kept(F.transform("p", lambda x: prose(x["part"])), F.transform("p", lambda x: x["line"] < 0), F.col("h.norm"), F.col("h.whole")).alias("k"))
    every = asked.groupBy(key).agg(F.first("p").alias("p"), F.collect_list("k").alias("k"))
    left = every.select(key, "p", F.aggregate(F.slice("k", 2, F.size("k")), F.col("k")[0], lambda a, x: F.array_intersect(a, x)).alias("k")).where("size(k) > 0")
    stay = left.select(key, F.transform("k", lambda i: F.get(F.col("p"), i)).alias("s"))
    said = F.transform(F.filter("s", lambda x: x["line"] < 0), lambda h: F.transform(F.filter("s", lambda x: (x["block"] == h["block"]) & (x["line"] >= 0)), lambda x: x["part"]))
    whole = stay.select(key, F.filter(said, lambda t: F.size(t) > 0).alias("b")).where("size(b) > 0")
    return whole.select(key, F.array_join(F.transform("b", lambda t: F.array_join(t, "\n")), "\n\n").alias("fresh"))


def token_windows(docs: DataFrame, size: int = 384, overlap: int = 48, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, ordinal, first token (from 0), n_tokens: windows of white-space tokens."""
    n = F.size(F.filter(F.split(F.col(text_col), r"\s+"), lambda x: x != ""))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("n") - overlap) / step) - 1, F.lit(0)).cast("int"))
    return docs.select(id_col, n.alias("n")).where("n > 0").select(id_col, "n", F.explode(starts).alias("ordinal")).select(id_col, "ordinal", (F.col("ordinal") * step).alias("first"), F.least(F.lit(size), F.col("n") - F.col("ordinal") * step).alias("n_tokens"))


def chunk_markdown(md: str, size: int = 384, overlap: int = 48, most_bytes: int | None = None) -> list[tuple[int, str, int, int, str]]:
    """ordinal, heading path, first and last byte, text: sections by heading (fences and front matter apart), packed to at most ``size`` words and ``most_bytes`` (24 a word, 1024 at least).

    A chunk that must be cut ends with a paragraph if one ends in its second half, else with a sentence, else it is a
    window and the next one overlaps it. A fence is closed by its own sign, at least as often. One word longer than
    the bytes is a chunk of its own.
    """
    most_bytes = most_bytes or max(1024, 24 * size)
    sections: list[tuple[str, int, int]] = []
    at, fence, path, start = 0, "", [], 0
    if md.startswith("---\n") and (end := md.find("\n---\n", 3)) >= 0:
        at = start = end + 5
    for line in md[at:].splitlines(keepends=True):
        marks = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        opened = bool(fence)
        if marks and not fence:
            fence = marks[1]
        elif marks and marks[1][0] == fence[0] and len(marks[1]) >= len(fence) and not line[marks.end() :].strip():
            fence = ""
        m = None if fence or opened else HEADING.match(line.rstrip("\n"))
        if m:
            sections.append((" > ".join(path), start, at))
            path, start = [*path[: len(m[1]) - 1], m[2]], at
        at += len(line)
    sections.append((" > ".join(path), start, len(md)))
    out = []
    for heading, a, b in sections:
        words = [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", md[a:b])]
        upto = [0]
        for i, (s, e) in enumerate(words):  # bytes up to the end of each word, blanks before it included
            upto.append(upto[-1] + len(md[words[i - 1][1] if i else s : e].encode()))
        paragraphs = [i for i in range(1, len(words)) if md.count("\n", words[i - 1][1], words[i][0]) > 1]
        sentences = [i for i in range(1, len(words)) if md[words[i - 1][1] - 1] in ".!?\u2026"]
        i = 0
        while i < len(words):
            j = min(len(words), i + size)
            while j > i + 1 and upto[j] - upto[i] > most_bytes:
                j -= 1
            cut = None
            if j < len(words):
                half = i + (j - i) // 2
                cut = next((max(x) for x in ([k for k in paragraphs if half < k <= j], [k for k in sentences if half < k <= j]) if x), None)
                j = cut or j
            out.append((heading, words[i][0], words[j - 1][1]))
            i = j if j == len(words) or cut else max(i + 1, j - overlap)
    return [(n, h, len(md[:a].encode()), len(md[:b].encode()), md[a:b]) for n, (h, a, b) in enumerate(out)]


def chunks(docs: DataFrame, size: int = 384, overlap: int = 48, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, ordinal, heading, byte_start, byte_end, text of the Markdown chunks; the bytes are those of the whole text in UTF-8."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *c) for i, t in zip(f["id"], f["t"], strict=True) if t for c in chunk_markdown(t, size, overlap)]
            yield pd.DataFrame(rows, columns=["id", "ordinal", "heading", "byte_start", "byte_end", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, ordinal int, heading string, byte_start long, byte_end long, text string").withColumnRenamed("id", id_col)


def joined_body(left: Column, right: Column) -> Column:
    """Two bodies with a blank line between them, ended by a line end."""
    first, second = F.regexp_replace(left, r"\s+$", ""), strip(right)
    return F.concat(F.when(first == "", second).when(second == "", first).otherwise(F.concat(first, F.lit("\n\n"), second)), F.lit("\n"))


def merge_operations(ops: DataFrame) -> DataFrame:
    """path, kind, content of operations (path, seq, kind, content) on the same page, folded in order of seq.

    A rewrite replaces what came before it, and takes nothing that comes after. An append joins the write or append
    before it, bodies with a blank line between them. Of two writes the first stays, as does an append before a write.
    """
    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(x["kind"].alias("kind"), x["content"].alias("content"))
        joined = F.struct(acc["kind"].alias("kind"), joined_body(acc["content"], x["content"]).alias("content"))
        return F.when(acc["kind"].isNull() | (x["kind"] == "rewrite"), taken).when((acc["kind"] != "rewrite") & (x["kind"] == "append"), joined).otherwise(acc)

    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("content"))
    folded = ops.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "content"))).alias("ops")).select("path", F.aggregate("ops", none, step).alias("m"))
    return folded.select("path", "m.kind", "m.content")


def merge_facts(facts: DataFrame, least: float = 0.82) -> DataFrame:
    """session, seq, title, members, importance and those of narrative, type, facts, concepts, files, entities that facts have: facts (session, seq, title, importance) merged by like titles.

    In order of seq a fact joins the first earlier head of its session with a like title, or else is a head itself; a
    joined fact is no head, so what is like it alone begins anew. Rounds decide it for all sessions at once: a fact is a
    head when all earlier like ones are known to be none, and none when one of them is a head. Pairs meet over their
    rarest title words; equal titles of a session have their first fact's fate, and titles without words join nothing.
    A head takes the greatest importance, arrays and narratives of its members, each element once, in order of seq, and
    the first type that is not plain ("fact"). Null titles count as empty, null seq stands first; repeats join alike.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1))
    rows = written(facts.withColumn("__w", F.array_sort(words)).withColumn("__row", F.monotonically_increasing_id()).withColumn("__at", F.struct(F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), F.col("__row").alias("row"))), "facts")
    alike = rows.where(F.size("__w") > 0).groupBy("session", "__w").agg(F.min("__at").alias("at"))
    sets = alike.select(F.struct("session", "at").alias("id"), F.transform("__w", lambda w: F.concat_ws("/", F.xxhash64("session").cast("string"), w)).alias("items"))
    pairs = resolve.similar_sets(sets, least).where(F.col("left_id.session").eqNullSafe(F.col("right_id.session"))).select(F.col("left_id").alias("low"), F.col("right_id").alias("high"))
    heads = graph.first_heads(pairs, "facts-heads")
    joined = alike.select("session", "__w", F.struct("session", "at").alias("id")).join(heads, "id", "left").select("session", "__w", F.coalesce("head.at", "id.at").alias("__head"))
    named = rows.alias("r").join(joined.alias("j"), F.col("r.session").eqNullSafe(F.col("j.session")) & (F.col("r.__w") == F.col("j.__w")), "left").select("r.*", F.coalesce("j.__head", "r.__at").alias("__head"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("__at", F.col(c).alias("v"))))), lambda x: x["v"])
    first = lambda c: F.min_by(c, "__at").alias(c)
    more = [F.array_distinct(F.flatten(ordered(c))).alias(c) for c in ("facts", "concepts", "files", "entities") if c in facts.columns]
    if "narrative" in facts.columns:
        more.append(F.array_join(F.array_distinct(ordered("narrative")), "\n").alias("narrative"))
    if "type" in facts.columns:
        more.append(F.coalesce(F.min_by("type", F.when(F.col("type") != "fact", F.col("__at"))), F.min_by("type", F.when(F.col("type").isNotNull(), F.col("__at")))).alias("type"))
    return named.groupBy("session", "__head").agg(F.min("seq").alias("seq"), first("title"), F.count("*").alias("members"), F.max("importance").alias("importance"), *more).drop("__head")


def content_key(text: Column) -> Column:
    return T.body_key(text)
