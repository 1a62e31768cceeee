"""Mentions consolidated and captures linked, on small literals."""

from loomnote.operators import linking


def test_consolidated_relations(spark):
    observations = spark.createDataFrame([(1, False), (2, True), (3, None)], "id long, linked boolean")
    lexical = spark.createDataFrame([(1, 10, 7, 1.0), (1, 11, 2, 1.0), (1, 12, 1, 0.85), (2, 10, 1, 1.0), (3, 14, 3, 0.5)], "id long, target long, position int, confidence double")
    bm25 = spark.createDataFrame([(1, 12, 0.7), (1, 13, 0.71234), (1, 14, 0.55), (3, 13, 0.8), (3, 14, 0.6)], "id long, target long, confidence double")
    pages = spark.createDataFrame([(10, "wiki/tools/a.md", "A"), (11, "wiki/people/b.md", "Deprecated b"), (12, "wiki/crystals/c.md", None), (13, "wiki/lessons/d.md", "d"), (14, "wiki/lessons/e.md", "e")], "target long, path string, title string")
    got = lambda **k: sorted(tuple(r) for r in linking.consolidated(observations, lexical, bm25, pages, **k).collect())
    want = [(1, 10, "uses", 1.0, "lexical", 2), (1, 11, "supersedes", 1.0, "lexical", 1), (1, 12, "derived_from", 0.85, "both", 3), (1, 13, "derived_from", 0.712, "bm25", 4), (3, 13, "derived_from", 0.8, "bm25", 1), (3, 14, "mentions", 0.6, "both", 2)]
    assert got() == want and got(most=1) == [want[1], want[4]] and (2, 10, "uses", 1.0, "lexical", 1) in got(force=True)


def test_auto_links_fall_back_to_titles(spark):
    unit = lambda i, n=4: [1.0 if k == i else 0.0 for k in range(n)]
    wiki = [(1, [0.6, 0.8, 0.0, 0.0]), (2, unit(1)), (3, [0.0, 0.1, 1.0, 0.0])]
    raw = {10: [0.5, 0.5, 0.1, 0.0], 11: [0.0] * 4, 12: unit(1), 13: [1.0, 2.0], 14: unit(0), 15: None, 16: [0.1, 1.0, 0.2, 0.0]}
    texts = [(i, "Green Engine works" if i != 15 else "nothing like it", i == 16) for i in raw]
    vectors = spark.createDataFrame([(i, v) for i, v in raw.items() if v], "raw_id long, v array<double>")
    pages = spark.createDataFrame([(1, "Green Engine", None), (2, "Blue Boat", "green")], "page_id long, title string, summary string")
    page_vectors = spark.createDataFrame(wiki, "page_id long, v array<double>")
    bad = {r["raw_id"]: r["reason"] for r in linking.degenerate(vectors, page_vectors, least_dim=4).collect()}
    assert bad == {11: "collision", 12: "collision", 13: "dimension", 14: "collision"}
    close = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.001]), (2, [2.0, 0.0, 0.001, 0.0])], "page_id long, v array<double>")
    assert {r["raw_id"]: r["reason"] for r in linking.degenerate(spark.createDataFrame([(5, [3.0, 0.0, 0.0, 0.0])], "raw_id long, v array<double>"), close, least_dim=4).collect()} == {5: "top-k-collision"}
    linking_dim, linking.LEAST_DIM = linking.LEAST_DIM, 4
    try:
        links, without = linking.auto_linked(spark.createDataFrame(texts, "raw_id long, raw string, linked boolean"), vectors.where("raw_id <> 13"), pages, page_vectors, least=0.9, dim=4)
    finally:
        linking.LEAST_DIM = linking_dim
    got = {(r["raw_id"], r["page_id"]): (r["strategy"], r["score"]) for r in links.collect()}
    assert {k: v[0] for k, v in got.items()} == {(10, 1): "embedding", (11, 1): "title", (12, 1): "title", (13, 1): "title", (14, 1): "title"} and got[11, 1][1] >= 0.55
    assert {r["raw_id"]: r["reason"] for r in without.collect()} == {15: "no match", 16: "raw already has relations"}
    edges = spark.createDataFrame([(11, 1, 0.5), (9, 9, 0.1)], "from_path long, to_path long, confidence double")
    assert {(r["from_path"], r["to_path"]) for r in linking.with_mentions(edges, links).collect()} == {(11, 1), (9, 9), (10, 1), (12, 1), (13, 1), (14, 1)}
