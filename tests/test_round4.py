"""Small cases of the fourth round's findings."""

import random

import numpy as np

from loomnote import params
from loomnote.operators import linking, resolve, vector

from .conftest import SF


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def listed(text):
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    return [w for w in words if len(w) > 1 and w not in params.TITLE_STOPWORDS and not w.isdigit()]


def plain_titles(raw, pages, k, least):
    out = []
    for r, text in raw:
        words, scored = listed(text or ""), []
        for p, title, summary in pages:
            seq = listed(title or "")
            t = set(seq)
            rest = set(listed(f"{title}\n{summary}" if summary is not None else title or "")) - t
            j, c = len(t & set(words)), len(rest & set(words))
            if not j:
                continue
            score = 0.42 * j / len(t) + 0.43 * (c / len(rest) if rest else 0.0) + 0.15 * (j + c) / (len(t) + len(rest) + len(set(words)) - j - c)
            score += 0.1 if f" {' '.join(seq)} " in f" {' '.join(words)} " else 0.0
            scored.append((-vector._rounded(np.array([min(1.0, score)]), 3)[0], p))
        out += [(r, p, -s, n) for n, (s, p) in enumerate(sorted(x for x in scored if -x[0] >= least)[:k], 1)]
    return sorted(out)


def test_titles_are_scored_without_pairs_of_texts_and_pages(spark, monkeypatch):
    """F1: what a raw text shares a title word with never becomes rows; equal titles, blocks and every turn of rare words give the plain scores."""
    rng = random.Random(8)
    pool = [f"w{c}" for c in "abcdefgh"] + ["the", "42", "x", "en", "de"]
    title = lambda: " ".join(rng.choices(pool, k=rng.randint(0, 4)))
    pages = [(i, title() if i % 13 else None, rng.choice(["en", "de", "wa wb", "", None])) for i in range(150)]
    raw = [(1000 + i, (" ".join(rng.choices([*pool, "other", "word"], k=rng.randint(0, 14))).title() + "!") if i % 17 else None) for i in range(90)]
    a, b = spark.createDataFrame(raw, "raw_id long, raw string"), spark.createDataFrame(pages, "page_id long, title string, summary string")
    for blocks in ((4096, 131_072), (16, 20)):
        monkeypatch.setattr(resolve, "RAW_BLOCK", blocks[0])
        monkeypatch.setattr(resolve, "PAGE_BLOCK", blocks[1])
        for k, least in ((3, 0.0), (1, 0.45), (200, 0.2)):
            found = resolve.title_score(a, b, k, least)
            assert "Join" not in plan(found)
            assert sorted(map(tuple, found.select("raw_id", "page_id", "score", "rank").collect())) == plain_titles(raw, pages, k, least)
    assert resolve.title_score(a.limit(0), b).count() == 0 == resolve.title_score(a, b.limit(0)).count()


def test_only_vectors_in_doubt_are_compared(spark, monkeypatch):
    """vectors that are short, zero or a page's own are ruled out before any is compared; short ones no longer make cosines one by one."""
    v = lambda *x: [float(y) for y in x]
    pages = spark.createDataFrame([(i, v(1, i, 0.5, 2)) for i in range(1, 9)], "page_id long, v array<double>")
    raw = spark.createDataFrame([(10, v(0, 0, 0, 0)), (11, v(1, 2)), (12, v(1, 3, 0.5, 2)), (13, v(3, 1, 1, 1)), (14, v(1, 0, 0, 0))], "raw_id long, v array<double>")
    asked, real = [], vector.nearest
    monkeypatch.setattr(vector, "nearest", lambda rows, queries, *more: asked.extend(r["query_id"] for r in queries.collect()) or real(rows, queries, *more))
    assert {r["raw_id"]: r["reason"] for r in linking.degenerate(raw, pages, least_dim=4).collect()} == {10: "collision", 11: "dimension", 12: "collision", 14: "collision"}
    assert asked == [13]
    one = []
    monkeypatch.setattr(vector, "_summed", (lambda real: lambda a, b, far: (one.append(len(a)), real(a, b, far))[1])(vector._summed))
    frame = lambda key, name, rows: vector.pd.DataFrame({key: [r[0] for r in rows], name: [r[1] for r in rows], "h" if name == "v" else "g": None})
    rng = np.random.default_rng(2)
    rows, queries = [(i, rng.normal(size=8)) for i in range(3000)], [(5000 + i, rng.normal(size=8 if i % 3 else 5)) for i in range(20)]
    got = vector._best(frame("id", "v", rows), frame("query_id", "q", queries), 3, None, False, False)
    want = {(q, i) for q, x in queries for i in sorted(range(3000), key=lambda i: -(rows[i][1][: len(x)] @ x) / np.linalg.norm(rows[i][1]) / np.linalg.norm(x))[:3]}
    assert set(zip(got["query_id"], got["id"], strict=True)) == want and sum(one[2:]) < 20 * 3000 / 10


def test_activation_bounds_what_a_task_hashes(spark, monkeypatch):
    """with more links than the session's partitions may hold, the nodes that are hashed and the links come in more partitions; children are ranked without hashing them."""
    from loomnote.operators import graph

    rng = random.Random(9)
    edges = spark.createDataFrame([(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice(["uses", "linked", "mentions"]), "relation") for _ in range(120)], "from_path string, to_path string, relation_type string, kind string")
    seeds = spark.createDataFrame([("n1",), ("n2",), ("n1",)], "path string")
    rows = lambda: sorted((r["path"], round(r["activation"], 9)) for r in graph.activate(edges, seeds).collect())
    few, plans = rows(), []
    monkeypatch.setattr(graph, "TASK_LINKS", 10)
    monkeypatch.setattr(graph, "written", (lambda real: lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])(graph.written))
    assert len(few) > 20 and rows() == few
    for p in plans[1:]:
        joins = [line for line in p.splitlines() if "ShuffledHashJoin" in line]
        assert len(joins) == 2 and p.count("24), REPARTITION_BY_NUM") == 5, p


def test_procedures_keep_whole_commands(spark):
    """what an event is about is part of its command as it stands, so as many commands as the events name."""
    from loomnote.plans import curation
    from loomnote.tables import table

    named = {(r["event_type"], r["k"]) for r in table(spark, SF, "events").selectExpr("event_type", "get_json_object(props, '$.k') AS k").collect()}
    got = {c for r in curation.procedure_items(spark, SF).collect() for c in r["commands"]}
    assert got == {t for t, _ in named} | {t + k for t, k in named} and len(got) > 100


def test_like_sets_meet_by_the_sizes_that_partners_may_have(spark, monkeypatch):
    """frequent items that are all that two sets share make no pairs, and bands of sizes lose none."""
    from loomnote.operators import resolve

    rng, index = random.Random(11), {}
    sets = {i: frozenset(rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(1, 15))) for i in range(150)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>")
    for bands, like in ((12, 0.4), (3, 0.4), (2, 0.1), (12, 1.0)):
        monkeypatch.setattr(resolve, "BANDS", bands)
        want = sorted((a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= like)
        assert sorted((r["left_id"], r["right_id"], round(r["jaccard"], 9)) for r in resolve.similar_sets(rows, like, block=8).collect()) == want
    assert resolve.similar_sets(rows.limit(0), 0.4).count() == 0
    kinds = spark.createDataFrame([(i, ["p", "q", f"p{i}", f"q{i}"]) for i in range(60)], "id long, items array<string>")
    monkeypatch.setattr(resolve, "written", (lambda real: lambda df, label: index.setdefault(label, real(df, label)))(resolve.written))
    assert resolve.similar_sets(kinds, 0.4).count() == 0
    assert index["set-index"].groupBy("item", "x", "y").count().agg({"count": "max"}).first()[0] == 1
