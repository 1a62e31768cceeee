import json

from loomnote.sources import vault


def test_vault(spark, tmp_path):
    files = {
        "wiki/tools/a.md": '---\ntitle: "A tool"\ntags: [x, "y"]\nconfidence: 0.8\nupdated: 2024-05-01\n---\nBody [[b]].\n',
        "wiki/tools/b.md": "---\ntags:\n  - p\n  - q\nconfidence: high\n---\nText",
        "raw/2024-05-01/s.md": "no front matter",
        "wiki/.audit/x.md": "hidden",
        "wiki/archive/x.md": "old",
        "crystals/broken.md": "---\ntitle: never ends\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    pages, errors = vault.read_vault(spark, str(tmp_path))
    got = {r["path"]: r for r in pages.collect()}
    assert set(got) == {"wiki/tools/a.md", "wiki/tools/b.md", "raw/2024-05-01/s.md"}
    a, b, raw = got["wiki/tools/a.md"], got["wiki/tools/b.md"], got["raw/2024-05-01/s.md"]
    assert (a["title"], a["type"], a["tags"], a["confidence"], a["updated"], a["body"]) == ("A tool", "tools", ["x", "y"], 0.8, "2024-05-01", "Body [[b]].\n")
    assert (b["title"], b["tags"], b["confidence"], b["status"]) == ("b", ["p", "q"], None, "active")
    assert raw["kind"] == "raw" and raw["body"] == "no front matter"
    assert [r["path"] for r in errors.collect()] == ["crystals/broken.md"]
    assert vault.signature(pages).first()["files"] == 3


def test_embeddings(spark, tmp_path):
    rows = [{"path": "a", "vector": [1, 2], "ts": "1"}, {"path": "a", "vector": [3, 4], "ts": "2"}, {"path": "b", "vector": [0, 0], "ts": "1"}]
    (tmp_path / "e.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + "{torn\n")
    good, bad = vault.read_embeddings(spark, str(tmp_path / "e.jsonl"))
    assert {r["path"]: list(r["vector"]) for r in good.collect()} == {"a": [3.0, 4.0], "b": [0.0, 0.0]}
    assert bad.count() == 1
    refused = vault.write_embeddings(good, str(tmp_path / "out"), 2)
    assert [(r["path"], r["reason"]) for r in refused.collect()] == [("b", "zero")]


def test_sessions_and_facts(spark, tmp_path):
    events = [("s", f"2024-01-01T00:00:0{i}", r, c) for i, (r, c) in enumerate([("user", "hi"), ("assistant", "yo")])]
    (tmp_path / "log.jsonl").write_text("".join(json.dumps({"sessionId": s, "timestamp": t, "message": {"role": r, "content": c}}) + "\n" for s, t, r, c in reversed(events)))
    got = vault.read_sessions(spark, str(tmp_path / "log.jsonl")).first()
    assert (got["turns"], got["body"], got["started"]) == (2, "## user\nhi\n## assistant\nyo", "2024-01-01T00:00:00")
    facts = spark.createDataFrame([("t", 99, "2024-01-01T10:00"), ("u", 3, "2024-01-02T10:00")], "title string, importance int, observed_at string")
    vault.write_facts(facts, str(tmp_path / "facts"))
    assert {r["title"]: r["importance"] for r in vault.read_facts(spark, str(tmp_path / "facts")).collect()} == {"t": 10, "u": 3}
