"""Small cases of the third round's findings."""

from loomnote.operators import lexical
from loomnote.plans import registry

from .conftest import SF


def test_parse_operations_names_pages(spark):
    got = registry.QUERIES["parse_operations"](spark, SF)
    paged = got.where("kind IN ('write_page', 'append_page', 'rewrite_page')")
    assert got.columns == ["id", "kind", "path", "chars"] and paged.count() == got.where("path IS NOT NULL").count() > 0


def test_exact_boost_scores_classes(spark, monkeypatch):
    """Rows with the same hits are scored once: what is aggregated has a row for each two classes, not for each two ids."""
    docs = spark.createDataFrame([(i, ["red bolt", "blue nut", None][i % 3], "RED", ["b1"] if i % 2 else None) for i in range(60)], "id long, name string, title string, tags array<string>")
    queries = spark.createDataFrame([(q, [["red", "b1"], ["nut", "nut", ""], ["none"]][q % 3]) for q in range(30)], "query_id long, terms array<string>")
    seen = {}
    monkeypatch.setattr(lexical, "written", lambda df, label: seen.setdefault(label, df.localCheckpoint()))
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.exact_boost(docs, queries, "id", "name", "title", "tags").collect()}
    want = {}
    for d in docs.collect():
        for q in queries.collect():
            terms = [t for t in q["terms"] if t]
            n, i = (any(t in (d[c] or "").lower() for t in terms) for c in ("name", "title"))
            g = any(t in (d["tags"] or []) for t in terms)
            if n or i or g:
                want[q["query_id"], d["id"]] = min(8, 3 + 2 * n + 2 * i + g)
    assert got == want and seen["exact-sets"].count() == 3 and seen["exact-kinds"].count() <= 6


def test_thread_clusters_never_send_short_pieces_to_python(spark, monkeypatch):
    """A piece of too few observations makes no cluster and is left where it is; the others are solved as rows."""
    from datetime import date, timedelta

    from loomnote.operators import curation

    rows = [("g", i, date(2024, 1, 1) + timedelta(days=30 * i), ["a"]) for i in range(50)] + [("h", 100 + i, date(2024, 1, 1) + timedelta(days=i), ["a", "b"][: 1 + i % 2]) for i in range(4)]
    df = spark.createDataFrame(rows, "group string, id int, day date, entities array<string>")
    seen = []
    monkeypatch.setattr(type(df), "mapInPandas", (lambda real: lambda self, f, kinds: (seen.append(self.count()), real(self, f, kinds))[1])(type(df).mapInPandas))
    got = sorted(tuple(r) for r in curation.thread_clusters(df).collect())
    assert got == [("h", 100, 100 + i) for i in range(4)] and seen == [1]


def test_texts_go_to_python_in_small_batches(spark):
    from loomnote.operators import models
    from loomnote.sources import frontmatter

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([("a", "---\nx: 1\n---\nbody")], "path string, text string")
    for made in (lambda: frontmatter.with_front(df), lambda: models.session_chunks(df, 100, "path", "text")):
        spark.conf.set(key, "10000")
        assert made().count() == 1 and int(spark.conf.get(key)) <= 256
