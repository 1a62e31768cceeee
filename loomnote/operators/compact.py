"""Old captures made smaller and pages' lost anchors put back: changes of texts by offsets, and what points into them carried along."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import small_batches, written
from .models import middle_cut

# A tool observation of a log, its input and output between what surrounds them; TOOL is the whole as one pattern.
HEAD = r"\n## \[\d{2}:\d{2}:\d{2}\] ToolUse: [^\n]+\n\n\*\*Input:\*\*\n\n```json\n"
MIDDLE, END = "\n```\n\n**Output:**\n\n```\n", "\n```"
TOOL = rf"({HEAD})([\s\S]*?)({re.escape(MIDDLE)})([\s\S]*?)({re.escape(END)})"

#: Bytes of a batch of whole logs on its way to Python, about.
BATCH_BYTES = 4 << 20

_HEAD, _MIDDLE, _END = re.compile(HEAD.encode()), MIDDLE.encode(), END.encode()


def compacted_text(text: str, most_input: int, most_output: int) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A log with the inputs and outputs of its tool observations cut in the middle, and (old start, old end, new start, new end) in bytes of those that were.

    Equal to replacing what TOOL matches, but reads on from mark to mark: a head that nothing closes is the last one.
    """
    raw, out, spans, at, gone = text.encode(), [], [], 0, 0
    while head := _HEAD.search(raw, at):
        start, given = head.span()
        middle = raw.find(_MIDDLE, given)
        output = middle + len(_MIDDLE)
        end = raw.find(_END, output) if middle >= 0 else -1
        if end < 0:
            break
        old = raw[start : end + len(_END)]
        cut = lambda a, z, most: raw[a:z] if z - a <= most else middle_cut(raw[a:z].decode(), most).encode()
        new = raw[start:given] + cut(given, middle, most_input) + _MIDDLE + cut(output, end, most_output) + _END
        out += [raw[at:start], new]
        at = start + len(old)
        if new != old:
            spans.append((start, at, start - gone, start - gone + len(new)))
            gone += len(old) - len(new)
    return b"".join([*out, raw[at:]]).decode(), spans


def compacted(logs: DataFrame, most_input: int = 8192, most_output: int = 8192) -> tuple[DataFrame, DataFrame]:
    """Logs (path, text) with the inputs and outputs of tool observations cut to so many bytes in the middle, and the table that maps bytes of the old texts to bytes of the new ones.

    First: path, text, bytes_before, bytes_after, observations (how many were cut) of the logs that change. Second:
    path, old_start, old_end, new_start, new_end of every observation that was cut. Both starts grow with each other
    within a path, so offsets keep their order. Each log is read once, in its own row; what changes is a table in the
    shared folder, from which both results are read. Texts without observations are left out, as are null texts. Paths
    are distinct.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [compacted_text(t, most_input, most_output) for t in f["text"]]
            changed = pd.Series([bool(spans) for _, spans in made], index=f.index, dtype=bool)
            yield f.assign(text=[t for t, _ in made], spans=[[dict(zip(places, s, strict=True)) for s in spans] for _, spans in made])[changed]

    places = ["old_start", "old_end", "new_start", "new_end"]
    kind = logs.schema["path"].dataType.simpleString()
    small_batches(logs.sparkSession, most_bytes=BATCH_BYTES)
    found = logs.where(F.contains("text", F.lit("] ToolUse: "))).select("path", "text", F.octet_length("text").cast("long").alias("bytes_before"))
    made = written(found.mapInPandas(run, f"path {kind}, text string, bytes_before long, spans array<struct<{', '.join(f'{p}: long' for p in places)}>>"), "compacted")
    texts = made.select("path", "text", "bytes_before", F.octet_length("text").cast("long").alias("bytes_after"), F.size("spans").cast("long").alias("observations"))
    return texts, made.select("path", F.inline("spans"))


def carried(watermarks: DataFrame, remap: DataFrame) -> DataFrame:
    """watermarks (path, bytes) as they stand in the compacted texts: behind an observation that was cut, less what it lost; inside one, at its start; before all, as they were.

    An as-of join: of the observations that begin before a watermark the last one decides.
    """
    far = watermarks.select("path", "bytes").distinct().join(remap, "path").where("old_start < bytes").groupBy("path", "bytes").agg(F.max_by(F.struct("old_end", "new_start", "new_end"), "old_start").alias("last"))
    moved = F.when(F.col("last").isNull(), F.col("bytes")).when(F.col("bytes") < F.col("last.old_end"), F.col("last.new_start")).otherwise(F.col("bytes") - F.col("last.old_end") + F.col("last.new_end"))
    joined = watermarks.join(far, ["path", "bytes"], "left")
    return joined.select(*[moved.alias("bytes") if c == "bytes" else F.col(c) for c in watermarks.columns])


def _outside(body: str, needle: str) -> tuple[int, int] | None:
    """Where a string first stands in a text, whatever its case, outside code and links."""
    shut = [m.span() for m in re.finditer(r"`[^`\n]+`|\[\[[^\]\n]+\]\]", body)]
    for m in re.finditer(re.escape(needle), body, re.IGNORECASE):
        if not any(a <= m.start() < z for a, z in shut):
            return m.span()
    return None


def _listed(items: list[str]) -> str:
    return " and ".join(items) if len(items) < 3 else ", ".join(items[:-1]) + ", and " + items[-1]


def relinked_body(body: str, links: list[str], code: list[str]) -> tuple[str, list[str]]:
    """A body with lost links and code put around their first plain mention, or else named in a sentence at its end; and what was done, as kind:anchor (wrap or append)."""
    done = []
    for kind, lost, mark in (("wikilink", links, "[[{}]]"), ("code", code, "`{}`")):
        rest = []
        for anchor in lost:
            leaf = re.sub(r"(?i)\.md$", "", anchor.replace("\\", "/").rsplit("/", 1)[-1])
            names = [anchor, leaf, re.sub("[-_]+", " ", leaf).strip()] if kind == "wikilink" else [anchor, anchor.replace("\\", "/"), anchor.replace("/", "\\")]
            at = next((s for name in names if name and (s := _outside(body, name))), None)
            if at is None:
                rest.append(anchor)
                continue
            said = body[at[0] : at[1]]
            body = body[: at[0]] + (f"[[{anchor}|{said}]]" if kind == "wikilink" else f"`{said}`") + body[at[1] :]
            done.append(f"{kind}:{anchor} (wrap)")
        if rest:
            label = "Related anchors" if kind == "wikilink" else "Code anchors"
            body = "\n\n".join(x for x in (body.strip(), f"{label} retained from the previous version include {_listed([mark.format(a) for a in rest])}.") if x)
            done += [f"{kind}:{a} (append)" for a in rest]
    return body, done


def relinked(pages: DataFrame, most_lost: int = 3) -> DataFrame:
    """path, body, restored, skipped of pages (path, body, links, code: anchors lost, in order; other: how many of other kinds).

    Each page's anchors are put back one after the other, into the text as the one before has left it. A page with more
    than ``most_lost`` anchors of other kinds stays as it is, with the reason in skipped. Nulls count as empty.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [relinked_body(b, list(x), list(c)) if o <= most_lost else (b, []) for b, x, c, o in zip(f["body"], f["links"], f["code"], f["other"], strict=True)]
            reason = [None if o <= most_lost else f"{o} unplaceable anchors" for o in f["other"]]
            yield pd.DataFrame({"path": f["path"], "body": [b for b, _ in made], "restored": [d for _, d in made], "skipped": reason})

    none = F.array().cast("array<string>")
    whole = pages.select("path", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("links", none).alias("links"), F.coalesce("code", none).alias("code"), F.coalesce("other", F.lit(0)).cast("long").alias("other"))
    return whole.mapInPandas(run, f"path {pages.schema['path'].dataType.simpleString()}, body string, restored array<string>, skipped string")
