"""Apply path, sources and streaming helpers on small literals."""

import datetime
import gzip
import hashlib
import json

import pytest

from loomnote.operators import apply, distill, graph, lint, resolve
from loomnote.sources import vault
from loomnote.streaming import drain

DAY = datetime.date(2024, 1, 1)


def block(*ops):
    return "text ```compile-ops\n" + json.dumps(list(ops)) + "\n``` more"


def run(spark, answers, pages, batches=None, journal=None):
    """Outcomes by answer and place, and pages' bodies."""
    ops = apply.operations(spark.createDataFrame(list(enumerate(answers)), "id long, text string"))
    if batches:
        ops = ops.join(spark.createDataFrame(list(enumerate(batches)), "id long, batch int"), "id")
    judged, after = apply.carried_out(ops, spark.createDataFrame(pages, "path string, body string, relations array<string>"), "2024-06-01", journal)
    rows = {(r["id"], r["seq"]): r for r in judged.collect()}
    assert {r["outcome"] for r in rows.values()} <= set(apply.OUTCOMES)
    return {k: r["outcome"] for k, r in sorted(rows.items())}, {r["path"]: r["body"] for r in after.collect()}, rows


SURE = {"derived_from": ["raw/1", "raw/2"]}


def test_operations_are_merged_and_applied_in_order(spark):
    path = "wiki/threads/new-page.md"
    write = {"kind": "write_page", "path": "wiki/threads/New Page.md", "body": "same line", **SURE}
    append = {"kind": "append_page", "path": path, "section": "same line"}
    # In one batch they are one operation; in two the second finds the page that the first has made.
    outcomes, pages, rows = run(spark, [block(write, append)], [])
    assert outcomes == {(0, 0): "created", (0, 1): "merged"} and pages == {path: "same line\n\nsame line\n"} and rows[0, 1]["reason"] == "merged append_page into write_page"
    dated = {"kind": "append_page", "path": path, "section": "## 2024-05-01 event\nsomething quite different happened"}
    outcomes, pages, _ = run(spark, [block(write), block(append), block(dated), block({**dated, "section": "more prose without any date"}), block(dated)], [], [0, 1, 2, 3, 4])
    assert list(outcomes.values()) == ["created", "skipped: no new content", "appended", "staged-for-review", "skipped: already applied"]
    assert pages[path] == "same line\n\n## 2024-05-01 event\nsomething quite different happened\n"
    # An append to no page is staged until a write of enough sources takes it up; then the write's text comes first.
    outcomes, pages, rows = run(spark, [block(append), block({**append, "path": "wiki/preferences/p.md"}), block({**append, "path": "wiki/tools/t.md"}, {**write, "path": "wiki/tools/t.md", "body": "first"})], [], [0, 0, 0])
    assert list(outcomes.values()) == ["staged-for-review", "created", "created", "merged"] and pages == {"wiki/preferences/p.md": "same line\n", "wiki/tools/t.md": "first\n\nsame line\n"}
    assert rows[0, 0]["reason"] == "append->create: low confidence"
    # An append and then a write of an existing page: the append stays, the write goes.
    outcomes, pages, rows = run(spark, [block(append, write)], [(path, "old", None)])
    assert outcomes == {(0, 0): "staged-for-review", (0, 1): "merged"} and not rows[0, 1]["kept"] and pages == {path: "old"}


def test_rewrites_keep_each_kind_of_anchors(spark):
    code = " ".join(f"`src/f{i}.py`" for i in range(10))
    old = f"See [[alpha]] and {code} by Ada Lovelace and Bob."
    page = [("wiki/tools/old.md", old, ["tools/a", "wiki/tools/B.md"])]
    rewrite = lambda body, **more: block({"kind": "rewrite_page", "path": "wiki/tools/old.md", "body": body, "confidence": 0.9, **more})
    outcome = lambda *a, **k: run(spark, [rewrite(*a, **k)], page)[0][0, 0]
    # Ten of eleven anchors kept, but none of the links; eight of ten code spans; seven of ten; a name lost; a relation lost.
    assert outcome(old.replace("[[alpha]]", "it")) == "staged-for-review"
    assert outcome(old.replace("`src/f1.py`", "").replace("`src/f2.py`", "") + " New words.") == "rewritten"
    assert outcome(old.replace("`src/f1.py`", "").replace("`src/f2.py`", "").replace("`src/f3.py`", "")) == "staged-for-review"
    assert outcome(old.replace("Ada Lovelace", "someone")) == "staged-for-review"
    assert outcome(old + " more", relations=["tools/a"]) == "staged-for-review" and outcome(old + " more", relations=["tools/b", "wiki/tools/a.md"]) == "rewritten"
    assert outcome(old + " more", confidence=0.5) == "staged-for-review" and outcome("# " + old.upper().lower() + "\n") == "skipped: no new content"
    assert run(spark, [rewrite("x").replace("old.md", "none.md")], page)[0] == {(0, 0): "rejected"}


def test_odd_operations(spark):
    write = {"kind": "write_page", "path": "wiki/lessons/a.md", "body": "one", **SURE}
    answers = [block({"kind": "other"}, {"kind": "update_index", "entries": ["x"]}, {"kind": "append_log", "line": "y"}), "none", None, "```compile-ops\n[{\n```", block({**write, "path": "wiki/../etc/passwd.md"}, {**write, "path": "wiki/cats/a.md"}, {**write, "path": "/wiki/a.md"}, {"kind": "dispute_page", "path": "wiki/lessons/a.md"}), block(write), block({**write, "body": None, "path": "wiki/issues/b.md"}), block({**write, "path": "wiki/lessons/empty.md", "body": "a"})]
    outcomes, pages, rows = run(spark, answers, [("wiki/lessons/empty.md", None, None), ("wiki/lessons/a.md", "old words", None)])
    assert list(outcomes.values()) == ["index-updated", "log-appended", "rejected", "rejected", "rejected", "created", "staged-for-review", "created", "skipped: no new content"]
    assert pages == {"wiki/lessons/empty.md": "", "wiki/lessons/a.md": "old words", "wiki/issues/b.md": "\n"}
    # A key in the journal is not applied again.
    journal = spark.createDataFrame([(rows[6, 0]["key"],)], "key string")
    assert run(spark, answers[6:7], [], journal=journal)[0] == {(0, 0): "skipped: already applied"}
    assert run(spark, [], [("p", "b", None)]) == ({}, {"p": "b"}, {})


def test_net_new_prose(spark):
    old = "# Title\n\nThe quick brown fox jumps over the lazy dog.\nSecond line stays here as well.\n\nshort"
    new = {
        1: "The quick brown fox jumps over the very lazy dog", 2: "## 2024-01-05 update\n\nthe quick brown fox\n\nAnother block says something else entirely.\n  Second line stays here as well.", 3: "a b c", 4: "short", 5: "title", 6: None, 7: "quick brown cat sleeps", 8: "SECOND line stays **here** as well", 9: "one\n\ntwo new words",
    }
    df = lambda rows: spark.createDataFrame(rows, "key long, body string")
    got = {r["key"]: r["fresh"] for r in distill.net_new(df(list(new.items())), df([(k, old) for k in new if k != 9] + [(9, None)]), "key").collect()}
    assert got == {2: "Another block says something else entirely.", 7: "quick brown cat sleeps", 9: "one\n\ntwo new words"}
    assert distill.net_new(df([]), df([]), "key").count() == 0


def test_watermarks_advance(spark):
    state = spark.createDataFrame([("raw/a", 10)], "path string, bytes long")
    slices, noise = (spark.createDataFrame([x], "path string, bytes long") for x in (("raw/a", 90), ("raw/b", 5)))
    judged = spark.createDataFrame([("appended",), ("skipped: no new content",)], "outcome string")
    got = lambda *a, **k: {r["path"]: r["bytes"] for r in apply.advanced(state, slices, *a, **k).collect()}
    assert got(judged, noise) == {"raw/a": 90, "raw/b": 5} and got(judged.where("outcome <> 'appended'"), noise) == {"raw/a": 10, "raw/b": 5} and got(judged, noise, plan=True) == {"raw/a": 10} == got(judged, noise, gated=False)


def test_supersede_and_maintenance(spark):
    pages = spark.createDataFrame([("a", "active", None, None, None), ("b", "active", None, None, None), ("c", "superseded", DAY, "x", None)], "path string, status string, valid_until date, superseded_by string, supersedes string")
    approvals = spark.createDataFrame([("a", "b"), ("c", "b")], "old_page string, new_page string")
    once = apply.superseded(pages, approvals, "2024-02-01")
    rows = {r["path"]: r for r in once.collect()}
    assert rows["a"]["status"] == "superseded" and rows["a"]["superseded_by"] == "b" and rows["b"]["supersedes"] == "c" and rows["c"]["superseded_by"] == "x"
    assert sorted(map(tuple, apply.superseded(once, approvals, "2025-01-01").collect())) == sorted(map(tuple, once.collect()))
    vaults = spark.createDataFrame([("wiki/tools/a.md", 0.9), ("wiki/tools/b.md", 0.8)], "path string, confidence double")
    pick = spark.createDataFrame([("wiki/tools/a.md",), ("wiki/../x",)], "path string")
    left, archive = apply.maintained(vaults, "archive", pick, "2024-01-01")
    assert [r[0] for r in left.collect()] == ["wiki/tools/b.md"] and archive.first()["archived_as"] == "wiki/.archive/2024-01-01-a.md"
    assert {r[0]: r[1] for r in apply.maintained(vaults, "unconfide", pick, "d")[0].collect()} == {"wiki/tools/a.md": 0.0, "wiki/tools/b.md": 0.8}
    with pytest.raises(ValueError, match="no more than"):
        apply.maintained(vaults, "delete", vaults.select("path"), "d", most=1)


def test_lint_resolution_and_dependents(spark):
    pages = spark.createDataFrame([("tools/a.md",), ("tools/x/b.md",), ("issues/b.md",)], "path string")
    links = spark.createDataFrame([(t,) for t in ("tools/a", " tools/a.md ", "a", "b", "issues/b.md", "none")], "target string")
    assert {r["target"]: r["to_path"] for r in graph.lint_resolve(links, pages).collect()} == {"tools/a": "tools/a.md", " tools/a.md ": "tools/a.md", "a": "tools/a.md", "b": None, "issues/b.md": "issues/b.md", "none": None}
    edges = spark.createDataFrame([(a, b) for a, b in ("ba", "cb", "dc", "ca")], "from_path string, to_path string")
    got = {(r["start"], r["path"], tuple(r["via"])) for r in graph.dependents(edges, spark.createDataFrame([("a",)], "path string")).collect()}
    assert got == {("a", "b", ("b", "a")), ("a", "c", ("c", "a")), ("a", "d", ("d", "c", "a"))}
    names = ["", "abc", "abd", "abcde", "xbcde", "kitten", "sitting", "sittin", "abc"]
    found = {(r["key_a"], r["key_b"]): r["n"] for r in resolve.close_pairs(spark.createDataFrame([(n,) for n in names], "key string")).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {("abc", "abc"): 1}
    for a in set(names):
        for b in set(names):
            if a < b and edits(a, b) <= 2:
                want[a, b] = names.count(a) * names.count(b)
    assert found == want
    assert lint.worst(spark.createDataFrame([("pass",), ("n/a",), ("warn",)], "status string")).first()[0] == "warn"


def test_sources(spark, tmp_path):
    (tmp_path / "kv").mkdir()
    (tmp_path / "kv" / "notes.bin").write_bytes(json.dumps({"a": {"x": 1}, "b": "\u00e9"}).encode() + b"\x00\xff junk")
    (tmp_path / "kv" / "bad.bin").write_bytes(b"nothing")
    assert {(r["scope"], r["key"], json.loads(r["value"])["x"] if r["key"] == "a" else r["value"]) for r in vault.read_kv(spark, str(tmp_path / "kv")).collect()} == {("notes", "a", 1), ("notes", "b", '"\u00e9"')}
    (tmp_path / "gold.jsonl").write_text(json.dumps({"query": "q", "type": "fact", "expected_paths": ["a"]}) + "\n" + json.dumps({"question_id": "7", "question": "r", "category": "misc", "expected_evidence_ids": ["b"]}))
    assert {(r["query"], r["type"], r["expected"][0]) for r in vault.read_gold(spark, str(tmp_path / "gold.jsonl")).collect()} == {("q", "fact", "a"), ("r", "misc", "b")}
    (tmp_path / "bad.jsonl").write_text('{"query": "q"}')
    with pytest.raises(Exception, match="without text or evidence"):
        vault.read_gold(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "a.gz").write_bytes(gzip.compress(b"x"))
    (tmp_path / "set" / "b").write_bytes(b"y")
    manifest = spark.createDataFrame([("a.gz", "0" * 64), ("c", "0" * 64)], "file string, sha256 string")
    assert {tuple(r) for r in vault.manifest_faults(spark, str(tmp_path / "set"), manifest).collect()} == {("a.gz", "changed"), ("b", "unlisted"), ("c", "missing")}
    exact = spark.createDataFrame([("b", hashlib.sha256(b"y").hexdigest()), ("a.gz", hashlib.sha256((tmp_path / "set" / "a.gz").read_bytes()).hexdigest())], "file string, sha256 string")
    assert vault.manifest_faults(spark, str(tmp_path / "set"), exact).count() == 0
    files = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "path string, size long, mtime long")
    one = vault.signature(files).first()["signature"]
    assert one == vault.signature(files.orderBy("path", ascending=False)).first()["signature"] != vault.signature(files.union(files)).first()["signature"]


def test_chunks_by_sentence_bytes_and_fence():
    md = "# A\n```\n# no heading\n~~~\n# nor this\n```\n# B\n" + "One two three four. " * 6 + "x" * 3000 + " end"
    got = distill.chunk_markdown(md, 10, 2)
    assert {h for _, h, *_ in got} == {"A", "B"}
    assert all(md.encode()[a:z].decode() == t for _, _, a, z, t in got)
    assert all(len(t.encode()) <= 1024 or len(t.split()) == 1 for *_, t in got)
    assert [t for _, h, _, _, t in got if h == "B"][0] == "# B\nOne two three four. One two three four."


def test_drain_helpers(spark):
    files = spark.createDataFrame([("a", 10), ("b", 99), ("c", 5)], "path string, size long")
    chunks = spark.createDataFrame([("a", i) for i in range(3)] + [("c", i) for i in range(9)] + [("b", 0)], "path string, n long")
    kept, bad = drain.oversize(files, chunks, 50, 5)
    assert {r["path"] for r in kept.collect()} == {"a"} and {tuple(r) for r in bad.collect()} == {("b", "too large"), ("c", "too many chunks")}
    at = datetime.datetime(2024, 1, 1, 12)
    tries = spark.createDataFrame([("a", 0, 0, None, at), ("b", 1, 0, at, at), ("c", 9, 0, at - datetime.timedelta(seconds=480), at), ("d", 1, 2, at, at)], "path string, failures int, stalls int, failed_at timestamp, now timestamp")
    assert {r["path"]: r["action"] for r in drain.retries(tries).collect()} == {"a": "now", "b": "wait", "c": "now", "d": "quarantine"}
    pending = spark.createDataFrame([(f"p{i:02}", i, 100) for i in range(40)], "path string, since long, tokens long")
    assert drain.tick(pending, 25, 1000).count() == 10 and drain.tick(pending).count() == 25 and drain.tick(pending, 25, 10).count() == 1
