"""Captures: compaction, watermarks, anchors, cached facts, threads and the debounced queue against plain versions."""

import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomnote.operators import compact, models, narrative
from loomnote.plans import capture
from loomnote.sources import frontmatter
from loomnote.streaming import drain

from .conftest import SF
from .test_brute_force import plain_communities


def plain_compact(text, most_input, most_output):
    """The text with long tool inputs and outputs cut, and (old start, old end, new start, new end) of those cut, in bytes."""
    out, maps, at, gone = [], [], 0, 0
    for m in re.finditer(compact.TOOL, text):
        new = m[1] + models.middle_cut(m[2], most_input) + m[3] + models.middle_cut(m[4], most_output) + m[5]
        out += [text[at : m.start()], new]
        at = m.end()
        if new != m[0]:
            start, old = len(text[: m.start()].encode()), len(m[0].encode())
            maps.append((start, start + old, start - gone, start - gone + len(new.encode())))
            gone += old - len(new.encode())
    return "".join(out) + text[at:], maps


def plain_carried(offset, maps):
    moved = offset
    for old_start, old_end, new_start, new_end in maps:
        if offset <= old_start:
            break
        if offset < old_end:
            return new_start
        moved -= old_end - old_start - (new_end - new_start)
    return moved


def test_compaction_and_watermarks(spark):
    logs = {r["path"]: r["text"] for r in capture.logs(spark, SF).collect()}
    texts, remap = compact.compacted(spark.createDataFrame(list(logs.items()) + [("none", "plain"), ("null", None)], "path string, text string"), *capture.CAPS)
    found, maps = {r["path"]: r for r in texts.collect()}, {}
    for r in sorted(remap.collect(), key=lambda r: r["old_start"]):
        maps.setdefault(r["path"], []).append(tuple(r)[1:])
    want = {p: plain_compact(t, *capture.CAPS) for p, t in logs.items()}
    assert {p: r["text"] for p, r in found.items()} == {p: t for p, (t, m) in want.items() if m} and maps == {p: m for p, (_, m) in want.items() if m}
    assert all(r["bytes_before"] == len(logs[p].encode()) and r["bytes_after"] == len(r["text"].encode()) and r["observations"] == len(maps[p]) for p, r in found.items()) and found
    marks = [(p, b) for p, m in maps.items() for b in {0, 5, m[0][0], m[0][0] + 1, m[0][1], m[-1][1] - 1, m[-1][1], m[-1][1] + 9}] + [("none", 3)]
    got = compact.carried(spark.createDataFrame(marks, "path string, bytes long").withColumn("was", F.col("bytes")), remap).collect()
    assert {(r["path"], r["was"]): r["bytes"] for r in got} == {(p, b): plain_carried(b, maps.get(p, [])) for p, b in marks}
    # A text that was compacted once stays as it is.
    assert compact.compacted(texts.select("path", "text"), *capture.CAPS)[0].count() == 0


def test_middle_cut():
    assert models.middle_cut("abc", 3) == "abc" and models.middle_cut("abcd", 0) == "" and len(models.middle_cut("é" * 99, 50).encode()) <= 50
    for most in (40, 60, 200, 999):
        cut = models.middle_cut("a" * 400 + "b" * 600, most)
        head, gone, tail = re.fullmatch(r"(a*)\n\n… \[(\d+) bytes elided\] …\n\n(b*)", cut).groups()
        assert len(head) + int(gone) + len(tail) == 1000 and most - 3 <= len(cut.encode()) <= most and abs(len(head) - 0.4 * (len(head) + len(tail))) <= 1


def test_relinking(spark):
    pages = [
        ("a", "See Foo bar and `foo bar` or [[foo bar]], then src/x.py.", ["x/foo-bar", "gone"], ["src/x.py", "lib\\y.c"], 0), ("b", "`foo bar` only", ["x/foo-bar.md"], None, 3), ("c", "foo", ["foo"], None, 4), ("d", None, ["p", "q", "r"], [], None), ("e", "Alpha beta", ["alpha", "beta"], ["beta"], 0),
    ]
    got = {r["path"]: r for r in compact.relinked(spark.createDataFrame(pages, "path string, body string, links array<string>, code array<string>, other long")).collect()}
    assert got["a"]["body"] == "See [[x/foo-bar|Foo bar]] and `foo bar` or [[foo bar]], then src/x.py.\n\nRelated anchors retained from the previous version include [[gone]].\n\nCode anchors retained from the previous version include `lib\\y.c`.".replace("src/x.py.\n", "`src/x.py`.\n")
    assert got["a"]["restored"] == ["wikilink:x/foo-bar (wrap)", "wikilink:gone (append)", "code:src/x.py (wrap)", "code:lib\\y.c (append)"]
    assert got["b"]["body"].startswith("`foo bar` only\n\nRelated") and got["c"]["body"] == "foo" and got["c"]["skipped"] == "4 unplaceable anchors" and got["c"]["restored"] == []
    assert got["d"]["body"] == "Related anchors retained from the previous version include [[p]], [[q]], and [[r]]." and got["e"]["body"].startswith("[[alpha|Alpha]] [[beta|beta]]\n\nCode anchors")
    # What comes back is there afterwards, and nothing else of the text changes.
    lost = {r["path"]: r for r in capture.rewritten(spark, SF).collect()}
    wrapped = 0
    for r in compact.relinked(capture.rewritten(spark, SF)).collect():
        own = lost[r["path"]]
        assert r["skipped"] or len(r["restored"]) == len(own["links"]) + len(own["code"])
        plain = re.sub(r"\[\[[^\]|\n]+\|([^\]\n]+)\]\]", r"\1", r["body"].split("\n\nRelated anchors retained")[0].split("\n\nCode anchors retained")[0]).replace("`", "")
        assert plain.strip() == own["body"].strip().replace("`", "") or r["skipped"]
        wrapped += any("(wrap)" in x for x in r["restored"])
    assert wrapped > 20


def test_extracted_facts_and_cache(spark):
    ranges = [("raw/a", 0, 90, "Big Thing", "x\nThe big thing works.\nbig  THING here\n the Big thing works. \r\nnone"), ("raw\\a", 0, 90, "big-thing", "again"), ("raw/b", 0, 5, "thing", None), ("raw/c", 0, 9, "thing", "thing one\nCUT thing two\nthing three")]
    df = spark.createDataFrame(ranges, "path string, start long, end long, entity string, text string")

    lines = models.line_model

    def model(prompts):
        return [('{"facts": [" cut "]}' if "CUT" in p else said, "CUT" in p, tokens) for p, (said, _, tokens) in zip(prompts, lines(prompts), strict=True)]

    found, cache = models.extracted_facts(df.where("entity <> 'big-thing'"), model, most_bytes=14)
    got = {r["path"]: r for r in found.collect()}
    assert got["raw/a"]["facts"] == ["The big thing works."] and not got["raw/a"]["from_cache"] and got["raw/b"]["facts"] == [] and got["raw/c"]["facts"] == ["thing one"] and got["raw/c"]["truncated"]
    assert {r["path"] for r in cache.collect()} == {"raw/a", "raw/b"}

    def none(prompts):
        return [("no JSON", False, 1)] * len(prompts)

    again, after = models.extracted_facts(df, none, cache)
    rows = {(r["path"], r["entity"]): r for r in again.collect()}
    assert len(rows) == 3 and rows["raw/c", "thing"]["facts"] == [] and not rows["raw/c", "thing"]["from_cache"] and sum(r["from_cache"] for r in rows.values()) == 2 and after.count() == 3
    assert models.extracted_facts(df.limit(0), none)[0].count() == 0
    text = "é" * 9 + "\n" + "b" * 3 + "\n\n" + "c"
    assert models.line_chunks(text, 8) == ["é" * 9, "bbb\n\nc"] and models.line_chunks("\n\n\n", 1) == [] and models.line_chunks("", 5) == [""]


def test_discovered_threads(spark):
    pages, edges, threads = capture.thread_inputs(spark, SF)
    rows = {r["path"]: r for r in pages.collect()}
    entity = {p for p, r in rows.items() if r["kind"] == "wiki" and r["category"] != "threads"}
    links, told = [tuple(r) for r in edges.collect()], {r["target"] for r in threads.collect()}
    members: dict = {}
    for p, c in plain_communities([e for e in links if set(e) <= entity]).items():
        members.setdefault(c, []).append(p)
    want, fit = {}, []
    for c, own in members.items():
        if len(own) >= 3:
            raw = sorted({x for a, b in links for x, y in ((a, b), (b, a)) if rows.get(x) and rows[x]["kind"] == "raw" and y in own})
            want[c] = [sorted(own), raw, "represented" if told & set(own) else "later" if raw else "no raw references"]
            fit += [(-len(own), c)] * (want[c][2] == "later")
    for _, c in sorted(fit)[:10]:
        want[c][2] = "proposed"
    got = {r["cluster"]: [r["members"], r["raw"], r["outcome"]] for r in capture.discovered_threads(spark, SF).collect()}
    assert got == want and {"proposed", "represented"} <= {x[2] for x in got.values()}


def test_quiet_captures_of_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    kind = "path string, at timestamp"
    for n, rows in enumerate(([("a", at(0)), ("b", at(5)), ("a", at(20))], [("a", at(45)), ("b", at(60)), (None, at(60))], [("c", at(500))], [("c", at(900))])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    run = drain.quiet(stream, 30).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(180)
    got = sorted((r["path"], r["first"], r["due"], r["captures"]) for r in spark.table("quiet").collect())
    assert got[:3] == [("a", at(0), at(75), 3), ("b", at(5), at(35), 1), ("b", at(60), at(90), 1)]


def test_narrative_stages(spark):
    bodies = {"new": "Old [[a]] text.", "same": "Old text.", "none": "x", "cut": "x", "heading": "x", "links": "See [[a]] and [[b|c]].", "equal": "Some words", "doubt": "x", "blank": "x", "null": None}
    pages = spark.createDataFrame([*bodies.items(), ("idle", "no facts")], "path string, body string")
    facts = spark.createDataFrame([(p, f"{p} fact {i}") for p in bodies for i in (2, 1, 1)] + [("lost", "of no page")], "path string, fact string")
    seen: dict = {}

    def detect(prompts):
        return [("nothing" if p.startswith("none") else json.dumps({"contradicted_claims": [], "net_new_facts": [] if p.startswith("same") else [" new "]}), p.startswith("cut"), 3) for p in prompts]

    def write(prompts):
        said = {"new": "Old [[a]] text.\n\n\n\nNew fact.\n", "heading": "# Head", "links": "See [[a]] only", "equal": "**Some**   words.", "doubt": "made up", "blank": "  ", "null": "fresh"}
        return [(json.dumps({"body": said[p.split("\n")[0]]}), False, 5) for p in prompts]

    def judge(prompts):
        return [(json.dumps({"supported": not p.startswith("made up"), "unsupported_claims": ["made up"]}), False, 7) for p in prompts]

    for judging in (judge, None):
        got = {r["path"]: r for r in narrative.synthesized(pages, facts, detect, write, judging).collect()}
        seen = {p: (r["outcome"], r["reason"]) for p, r in got.items()}
        calls = 3 if judging else 2
        assert seen == {
            "new": ("rewritten", None), "same": ("unchanged", None), "none": ("failed", "no answer in the reply"), "cut": ("failed", "reply was cut short"), "heading": ("staged-for-review", "narrative body must not contain headings"),
            "links": ("staged-for-review", "synthesized body dropped wikilinks: [[b|c]]"), "equal": ("unchanged", None), "doubt": ("staged-for-review", "unsupported claims: made up") if judging else ("rewritten", None), "blank": ("failed", "no answer in the reply"), "null": ("rewritten", None),
        }
        assert got["new"]["body"] == "Old [[a]] text.\n\nNew fact." and (got["new"]["calls"], got["new"]["tokens"]) == (calls, 15 if judging else 8) and (got["same"]["calls"], got["same"]["tokens"]) == (1, 3)
    failing = narrative.synthesized(pages, facts, lambda prompts: 1 / 0, write).collect()
    assert {r["outcome"] for r in failing} == {"failed"} and "ZeroDivisionError" in failing[0]["reason"]
    assert narrative.synthesized(pages.limit(0), facts, detect, write).count() == 0


def test_compression_runs_only_what_is_new(spark):
    long = "".join(f"## [10:00:0{i}] note\nline {i} of part {i}, said at length\n" for i in range(9))
    files = spark.createDataFrame([("raw/a", 9, "alpha text"), ("raw/b", 9, "beta"), ("raw/c", len(long), long), ("raw/d", 4, "BAD"), ("raw/e", 1, "later"), ("raw/n", 0, None)], "path string, size long, text string")
    state = spark.createDataFrame([("raw/a", 9, narrative.VERSION), ("raw/b", 9, narrative.VERSION - 1), ("raw/d", 2, narrative.VERSION), ("raw/z", 1, 1)], "path string, bytes long, version int")

    def chat(prompts):
        fact = lambda title, x: {"title": title, "facts": [x], "narrative": "n", "concepts": ["c"], "importance": len(x)}
        return [(json.dumps({"facts": [fact("one title", p.split("\n")[1]), fact("other", "x"), {"title": "no facts"}]}), "BAD" in p, 1) for p in prompts]

    report, facts, after = narrative.compressed(files, state, chat, most_bytes=100, most_chunks=3, most=4)
    got = {r["path"]: (r["outcome"], r["facts"], r["sent"]) for r in report.collect()}
    chunks = len(models.byte_chunks(long, 100))
    assert chunks > 3 and got == {"raw/a": ("skipped", 0, 0), "raw/b": ("compressed", 2, 1), "raw/c": ("compressed", 2, 3), "raw/d": ("failed", 0, 1), "raw/e": ("compressed", 2, 1), "raw/n": ("deferred", 0, 0)}
    rows = {(r["path"], r["title"]): r for r in facts.collect()}
    assert rows["raw/c", "one title"]["members"] == 3 and rows["raw/c", "one title"]["facts"] == [f"Chunk {k} of {chunks}" for k in (1, (chunks - 1 + 1) // 2 + 1 if (chunks - 1) % 2 else (chunks - 1) // 2 + 1, chunks)]
    assert rows["raw/b", "other"]["importance"] == 1 and len(rows) == 6
    assert {(r["path"], r["bytes"], r["version"]) for r in after.collect()} == {("raw/a", 9, 1), ("raw/b", 9, 1), ("raw/c", len(long), 1), ("raw/d", 2, 1), ("raw/e", 1, 1), ("raw/z", 1, 1)}


YAML = """type: lessons # kind
title: "A: b"
tags: [a, "b, c", 1, {x: y}]
none:
empty: []
url: http://x/y#z
created: "2024-01-05"
relations:
  derived_from:
    - target: raw/a.md
      confidence: 0.9
    - raw/b
  uses:
  -
    target: z
text: |
  line 1

  line # 2
fold: >-
  one
  two
deep:
  - - 1
    - k: v"""


def test_yaml_and_back():
    want = {
        "type": "lessons", "title": "A: b", "tags": ["a", "b, c", 1, {"x": "y"}], "none": None, "empty": [], "url": "http://x/y#z", "created": "2024-01-05", "relations": {"derived_from": [{"target": "raw/a.md", "confidence": 0.9}, "raw/b"], "uses": [{"target": "z"}]},
        "text": "line 1\n\nline # 2\n", "fold": "one two", "deep": [[1, {"k": "v"}]],
    }
    assert frontmatter.parse(YAML) == want == frontmatter.parse(frontmatter.dump(want)) and 'created: "2024-01-05"\n' in frontmatter.dump(want)
    for broken in ("a: [1", "a: 'x", "a\nb: c", "a: 1\na: 2", "a: 1\n  b: 2", 'a: "x', "- a\nb: c", "a: {b}"):
        with pytest.raises(ValueError):
            frontmatter.parse(broken)
    rng = random.Random(9)

    def value(depth=0):
        k = rng.randrange(9 if depth < 4 else 6)
        if k < 3:
            return rng.choice(["a", "x: y", "- b", "# c", " pad", "", "null", "1.5", "true", "é", "a\nb", "'q'", '"', "{a}", "[b", "a #b", "a:", "2024-01-01", "@x", "-", "---", "1e3", "~"])
        if k < 6:
            return rng.choice([None, True, False, 3, -2, 1.5, 0])
        return {rng.choice(["a", "b c", "x:y", "1", "-k", "é", "'", "# h", "true", ""]): value(depth + 1) for _ in range(3)} if k < 8 else [value(depth + 1) for _ in range(rng.randrange(4))]

    for _ in range(3000):
        made = {"r": value(), "s": value()}
        assert frontmatter.parse(frontmatter.dump(made)) == made


def test_front_matter_as_variant(spark):
    texts = {"a": f"---\n{YAML}\n---\n\nBody\n---\nmore\n", "b": "no front", "c": "---\nopen: 1\nnever ends", "d": "---\n- list\n---\nx", "e": None, "f": "---\n---\nempty", "g": ""}
    files = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("front_", F.lit(1))
    read = frontmatter.with_front(files)
    got = {r["path"]: r for r in read.select("path", "front_", "text", F.to_json("front").alias("json"), "body", "error").collect()}
    assert json.loads(got["a"]["json"]) == frontmatter.parse(YAML) and got["a"]["body"] == "Body\n---\nmore\n" and got["a"]["error"] is None
    assert (got["b"]["json"], got["b"]["body"], got["b"]["error"]) == (None, "no front", None) and got["c"]["error"] == "front matter does not end" and "no mapping" in got["d"]["error"] and got["e"]["body"] is None and got["f"]["body"] == "empty" and got["g"]["body"] == ""
    again = frontmatter.with_front(read.where("front IS NOT NULL").select("path", frontmatter.page_text(F.col("front"), F.col("body")).alias("text")))
    assert {r["path"]: (json.loads(r["j"]), r["body"].strip()) for r in again.select("path", F.to_json("front").alias("j"), "body").collect()} == {"a": (frontmatter.parse(YAML), "Body\n---\nmore")}
    assert sorted(tuple(r) for r in frontmatter.relations(read).select("relation", "target", F.coalesce("confidence", F.lit(0.0))).collect()) == [("derived_from", "raw/a.md", 0.9), ("derived_from", "raw/b", 0.0), ("uses", "z", 0.0)]
    assert frontmatter.with_front(files.limit(0)).count() == 0
