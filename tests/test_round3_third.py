"""Steps that must not gather what they pair."""

import random

from pyspark.sql import functions as F

from loomnote.functions import text as T
from loomnote.operators import lexical, resolve
from loomnote.tables import pages_of


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_like_sets_of_few_items_are_paired_without_gathering_pairs(spark):
    rng = random.Random(5)
    sets = {i: frozenset(rng.sample("abcdefghij", rng.randint(1, 8))) for i in range(150)}
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, items array<string>")
    # Nothing above the join that forms the pairs: no distinct, no further join with the sets.
    lines = plan(resolve.similar_sets(rows, 0.4)).splitlines()
    top = next(n for n, line in enumerate(lines) if "Join" in line)
    assert not any("Aggregate" in line and "left_id" in line for line in lines), lines
    assert not any("Aggregate" in line for line in lines[:top])
    rows = [(r["left_id"], r["right_id"], round(r["jaccard"], 9)) for r in resolve.similar_sets(rows, 0.4, block=16).collect()]
    want = {(a, b, round(len(x & y) / len(x | y), 9)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.4}
    assert len(rows) == len(want) and set(rows) == want


def searched(spark, n=120):
    rng = random.Random(7)
    words = ["the", "of"] + [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    docs = [(i, text() if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, body string"), spark.createDataFrame([(q, text()) for q in range(9)], "query_id long, query string")


def test_bm25_scores_neither_shuffle_nor_gather(spark):
    docs, queries = searched(spark)
    found = lexical.bm25(docs, queries)
    assert "Aggregate" not in plan(found) and "Join" not in plan(found)
    every = {(r["query_id"], r["id"]): r["score"] for r in found.collect()}
    old, lexical.FEW_PAIRS = lexical.FEW_PAIRS, 0
    try:
        assert every and every == {(r["query_id"], r["id"]): r["score"] for r in lexical.bm25(docs, queries).collect()}
    finally:
        lexical.FEW_PAIRS = old
    rows = lambda df: sorted(map(tuple, df.collect()))
    for k in (1, 3, 500):
        assert rows(lexical.top(lexical.bm25(docs, queries, best=k), k)) == rows(lexical.top(found, k))
    # Ids that several documents share are one document's postings, as in the SQL.
    assert len(lexical.bm25(docs.union(docs), queries).collect()) == len(every)


def test_all_terms_makes_no_pairs_of_frequent_terms(spark):
    docs, queries = searched(spark, 400)
    asked = queries.select("query_id", T.tokens(F.slice(F.split("query", " "), 1, 2).cast("string")).alias("terms"))
    found = lexical.all_terms(docs, asked)
    assert "Aggregate" not in plan(found)
    bodies = {r["doc_id"]: set((r["body"] or "").split()) for r in docs.collect()}
    want = {(r["query_id"], d) for r in asked.collect() if r["terms"] for d, w in bodies.items() if set(r["terms"]) <= w}
    rows = [(r["query_id"], r["id"]) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want and want


def test_phrases_of_a_text_do_not_stand_side_by_side(spark):
    docs = spark.createDataFrame([(1, "A b, c d."), (2, ""), (3, None), (4, "a")], "doc_id long, body string")
    found = resolve.phrases(docs, [1, 3, 9])
    assert "flatten" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "d", 4), (1, "a b c", 1), (1, "b c d", 2), (4, "a", 1)}


def test_titles_are_found_without_reading_on(spark, tmp_path):
    texts = [None, "", " ", "42", "one", "1one,two", "--a1b2c3d4", "é a\nb\tc d", "ab  cd", "x" * 50 + "9 y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    old = F.array_join(F.slice(F.split(F.trim(F.regexp_replace("body", r"[^A-Za-z]+", " ")), " "), 1, 3), " ")
    pages = pages_of(spark, str(tmp_path))
    assert "regexp_replace" not in plan(pages)
    assert all(r["title"] == r["old"] for r in pages.withColumn("old", old).collect())


def test_exact_hits_of_many_words_meet_by_equality(spark):
    docs = spark.createDataFrame([(1, "Doc-1", "big red", ["x"]), (2, "doc-2", None, None), (3, "", "Red", ["no", "Big"])], "id long, name string, title string, tags array<string>")
    queries = spark.createDataFrame([(7, ["red", "doc", ""]), (8, ["big", "2", "absent"]), (9, [])], "query_id long, terms array<string>")
    rows = lambda: sorted(map(tuple, lexical.exact_boost(docs, queries, "id", "name", "title", "tags").collect()))
    few, old = rows(), lexical.FEW_WORDS
    lexical.FEW_WORDS = 0
    try:
        assert few and rows() == few
    finally:
        lexical.FEW_WORDS = old
