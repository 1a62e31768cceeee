"""Front matter of pages as VARIANT: nested YAML in, the same out again."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..storage import small_batches

# What a plain scalar means, and the fields whose dates are written in quotes.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
DATED = ("created", "updated", "last_accessed")
FRONT = re.compile(r"\A---[ \t]*\r?\n(?:(.*?)\r?\n)?---[ \t]*(?:\r?\n|\Z)(.*)\Z", re.S)
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{}"',&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
_PLAIN = re.compile(r"[A-Za-z_./$(\u00a0-\uffff][^\x00-\x1f]*\Z")


def scalar(text: str):
    """The value of a plain or quoted scalar, or of a flow list or mapping."""
    text = text.strip()
    if text[:1] in "[{" and text:
        value, rest = _flow(text)
        if rest.strip():
            raise ValueError(f"left after a flow value: {rest.strip()[:20]}")
        return value
    if text[:1] == '"':
        return json.loads(text, strict=False)
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise ValueError("a quote does not end")
        return text[1:-1].replace("''", "'")
    if text in WORDS:
        return WORDS[text]
    if re.fullmatch(r"[-+]?(0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?)", text):
        return float(text)
    return text


def _flow(text: str):
    """A flow value at the beginning of text, and what stands after it."""
    if text[0] in "[{":
        close, out, rest = {"[": "]", "{": "}"}[text[0]], [], text[1:].lstrip()
        while not rest.startswith(close):
            if not rest:
                raise ValueError("a bracket does not close")
            value, rest = _flow(rest)
            if close == "}":
                if not rest.lstrip().startswith(":"):
                    raise ValueError("a flow mapping needs values")
                item, rest = _flow(rest.lstrip()[1:].lstrip())
                value = (str(value), item)
            out.append(value)
            rest = rest.lstrip()
            rest = rest[1:].lstrip() if rest.startswith(",") else rest
        return (out if close == "]" else dict(out)), rest[1:]
    m = re.match(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}:]*(?::(?!\s)[^,\[\]{}:]*)*""", text)
    if not m[0].strip() and text[:1] not in ",:":
        raise ValueError("a value is missing")
    return scalar(m[0]), text[m.end() :]


def _bare(line: str) -> str:
    """A line without its comment."""
    if "#" not in line:
        return line.rstrip()
    m = re.match(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^"'#]|(?<=\S)[#"'])*)""", line)
    return m[1].rstrip()


def parse(text: str):
    """The value of a YAML text in block style: mappings, lists, scalars, flow values and literal (|) or folded (>) blocks; an error if it is none."""
    lines = [(len(x) - len(x.lstrip(" ")), x) for x in re.split(r"\r?\n", text)]
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(lines) and not _bare(lines[at][1]).strip():
            at += 1

    def literal(style: str, outer: int) -> str:
        nonlocal at
        held, inner = [], None
        while at < len(lines) and (not lines[at][1].strip() or lines[at][0] > outer):
            inner = lines[at][0] if inner is None and lines[at][1].strip() else inner
            held.append(lines[at][1][inner or 0 :] if lines[at][1].strip() else "")
            at += 1
        body = "\n".join(held).rstrip("\n")
        body = re.sub(r"(?<!\n)\n(?!\n)", " ", body) if style[0] == ">" else body
        return body + ("" if "-" in style else "\n")

    def value(rest: str, indent: int, inside_list: bool = False):
        nonlocal at
        if re.fullmatch(r"[|>][-+]?", rest):
            return literal(rest, indent)
        if rest:
            return scalar(rest)
        skip()
        if at < len(lines) and (lines[at][0] > indent or not inside_list and lines[at][0] == indent and _bare(lines[at][1]).lstrip().startswith("-")):
            return block(lines[at][0])
        return None

    def block(indent: int):
        nonlocal at
        out = None
        while True:
            skip()
            if at == len(lines) or lines[at][0] < indent:
                return out
            if lines[at][0] > indent or "\t" in lines[at][1][: indent + 1]:
                raise ValueError(f"line {at + 1} is indented otherwise")
            line = _bare(lines[at][1])[indent:]
            if re.match(r"-(\s|$)", line):
                if out is not None and not isinstance(out, list):
                    return out
                rest = line[1:].lstrip()
                step = indent + len(line) - len(rest)
                out = [] if out is None else out
                if rest and (_KEY.match(rest) or re.match(r"-\s", rest)) and rest[0] not in "[{":
                    lines[at] = (step, " " * step + rest)
                    out.append(block(step))
                else:
                    at += 1
                    out.append(value(rest, indent, True))
                continue
            m = _KEY.match(line)
            if not m or isinstance(out, list):
                if out is None and indent == 0 and not m:
                    raise ValueError(f"line {at + 1} is no mapping")
                raise ValueError(f"line {at + 1} has no key")
            key = str(scalar(m[1])) if m[1][0] in "\"'" else m[1]
            out = {} if out is None else out
            if key in out:
                raise ValueError(f"{key} stands twice")
            at += 1
            out[key] = value(line[m.end() :].strip(), indent)

    skip()
    found = block(lines[at][0]) if at < len(lines) else None
    skip()
    if at < len(lines):
        raise ValueError(f"line {at + 1} does not belong")
    return found


def _told(x) -> str:
    if isinstance(x, str):
        plain = _PLAIN.match(x) and x == x.strip() and x not in WORDS and ": " not in x and " #" not in x and not x.endswith(":")
        return x if plain else json.dumps(x, ensure_ascii=False)
    if isinstance(x, (dict, list)):
        return "{}" if isinstance(x, dict) else "[]"
    return "null" if x is None else json.dumps(x)


def dump(value, indent: int = 0) -> str:
    """A value as YAML in block style, two blanks a level; ``parse`` gives it back."""
    pad, out = " " * indent, []
    for key, x in value.items() if isinstance(value, dict) else ((None, x) for x in value):
        head = pad + ("-" if key is None else _told(str(key)) + ":")
        if isinstance(x, (dict, list)) and x:
            body = dump(x, indent + 2)
            out.append(f"{head} {body[indent + 2 :]}" if key is None else f"{head}\n{body}")
        else:
            told = json.dumps(x) if key in DATED and isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) else _told(x)
            out.append(f"{head} {told}\n")
    return "".join(out)


def with_front(files: DataFrame, text: str = "text") -> DataFrame:
    """files with front (VARIANT: the page's front matter with all that is nested in it; null without any), body, and error: why it cannot be read (front is null then and body the whole text). Null texts give null bodies."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f[text]:
                m = FRONT.match(t) if t is not None and t.startswith("---") else None
                try:
                    found = parse(m[1] or "") if m else None
                    if found is not None and not isinstance(found, dict):
                        raise ValueError("front matter is no mapping")
                    wrong = "front matter does not end" if t is not None and re.match(r"---[ \t]*\r?\n", t) and not m else None
                    rows.append((None if found is None else json.dumps(found), m[2].lstrip("\n") if m else t, wrong))
                except (ValueError, RecursionError) as e:
                    rows.append((None, t, f"front matter: {e}"))
            yield f.assign(__front=[r[0] for r in rows], __body=[r[1] for r in rows], __error=[r[2] for r in rows])

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in files.schema)
    small_batches(files.sparkSession)
    made = files.mapInPandas(run, f"{kinds}, __front string, __body string, __error string")
    return made.select(*[made[c] for c in files.columns], F.try_parse_json("__front").alias("front"), F.col("__body").alias("body"), F.col("__error").alias("error"))


def page_text(front: Column, body: Column) -> Column:
    """The text of a page with this front matter (VARIANT) and body: what ``with_front`` reads as the same."""

    @F.pandas_udf(StringType())
    def page(fronts: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([f"---\n{dump(json.loads(f)) if f and f != '{}' else ''}---\n\n" + (b or "").strip("\n") + "\n" for f, b in zip(fronts, bodies, strict=True)])

    return page(F.to_json(front), body)


def relations(pages: DataFrame, id_col: str = "path") -> DataFrame:
    """id, relation, target, confidence of every edge that pages' front (VARIANT) has under relations; an entry is a target, or a mapping with one."""
    edges = pages.select(id_col, F.explode(F.try_variant_get("front", "$.relations", "map<string,variant>")).alias("relation", "list"))
    each = edges.select(id_col, "relation", F.explode(F.try_variant_get("list", "$", "array<variant>")).alias("e"))
    target = F.coalesce(F.try_variant_get("e", "$.target", "string"), F.when(F.schema_of_variant("e") == "STRING", F.try_variant_get("e", "$", "string")))
    return each.select(id_col, "relation", target.alias("target"), F.try_variant_get("e", "$.confidence", "double").alias("confidence")).where("target IS NOT NULL")
