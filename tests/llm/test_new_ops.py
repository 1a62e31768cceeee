"""PartEnum join, fill-in-middle and periodic runs against brute force and exact round trips, and their edge cases."""

import hashlib
import itertools
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomnote.llm import fim, html_mincut, partenum, runs, warc_fixity
from tests.conftest import SF

from .test_ops import DOCS, ODD, WORDS

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"id": F.lit(1), "n": F.lit("clash"), "row": F.lit(0), "hash": F.lit("h"), "cls": F.lit(2), "sig": F.lit(3), "runs": F.lit("r"), "form": F.lit("f")})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# op11


def plain_set(text):
    words = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def plain_groups(texts, percent=90):
    """texts: row -> (id, text); row -> smallest id of those that it reaches."""
    sets, root = {r: plain_set(t) for r, (_, t) in texts.items()}, {r: r for r in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for r, (i, _) in texts.items():
        least.setdefault(find(r), []).append(i)
    return {r: min((i for i in least[find(r)] if i is not None), default=None) for r in texts}


def edited(rng, words, share):
    return [rng.choice(WORDS) + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for n in [9, 10, 11, 19, 20, 40, 150, 700, 3000]:
        layout = partenum.bands(90, 4000)
        for _ in range(60):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            gone, new = int(rng.integers(0, n // 10 + 1)), int(rng.integers(0, n // 9 + 1))
            b = np.unique(np.append(a[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)))
            a = np.unique(a)
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                shared = np.intersect1d(partenum.signatures(a, layout, 90), partenum.signatures(b, layout, 90))
                assert len(shared), (len(a), len(b), common)
                pa_, pb = (np.frombuffer(partenum.parity(x, 90), np.uint64) for x in (a, b))
                size = min(len(pa_), len(pb))
                fold = lambda x: np.bitwise_xor.reduce(x.reshape(-1, size))  # noqa: E731, B023
                assert np.bitwise_count(fold(pa_) ^ fold(pb)).sum() <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("block,first", [(1024, 32), (8, 1)])
def test_partenum_equals_brute_force(spark, monkeypatch, block, first):
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "FIRST", first)
    rng, texts = random.Random(5), []
    for size in (4, 11, 12, 40, 150):
        base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(size)]
        texts += [" ".join(edited(rng, base, share)) for share in [0, 0, 0.01, 0.02, 0.02, 0.03, 0.04, 0.06] for _ in range(4)]
        texts += [" ".join(base[: size - k]).title() for k in range(4)]
    texts += ["a", "A", "a b", "A  b", "", None, " \n", "x y z"]
    rng.shuffle(texts)
    rows = {i: (i * 7 % 1009, t) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(d, t) for d, t in rows.values()], "doc_id long, text string").repartition(5)
    want, found = plain_groups(rows), {r["doc_id"]: r for r in partenum.similar_documents(df).collect()}
    assert {d: found[d]["component_id"] for d, _ in rows.values()} == {rows[r][0]: g for r, g in want.items()}
    assert all(found[d]["n_shingles"] == len(plain_set(t)) for d, t in rows.values())
    assert len({r["component_id"] for r in found.values()}) < len(texts) - 60


def test_partenum_odd_and_empty(spark, odd):
    got = partenum.similar_documents(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "group_size"]
    rows = {i: (r[0], r[1]) for i, r in enumerate(ODD)}
    want = plain_groups(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str) == sorted(((d, len(plain_set(t)), want[i] if plain_set(t) else d) for i, (d, t) in rows.items()), key=str)
    assert partenum.similar_documents(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="80 to 99"):
        partenum.similar_documents(odd, percent=50)


# op12


def test_fill_in_middle_round_trip(spark, odd):
    texts = ["", "\n", "one line", "a\nb\nc\nd", "a\n\n\nb\n", "é\n😀 x\nü\r\n" * 9, "has <P> inside\nb", "<M>", "<\nP>\n<S\n>", "x<\n<\n<S\n"]
    made = fim.fill_in_middle(spark.createDataFrame(list(enumerate(texts * 40)), "doc_id long, text string")).withColumn("restored", fim.restored("output", "form")).collect()
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    for r in made:
        text = texts[r["doc_id"] % len(texts)]
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = [int(sha(f"7:{r['doc_id']}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
        i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>"))
        want = text if plain else f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
        assert (r["n"], r["output"], r["restored"], r["prefix_chars"], r["middle_chars"]) == (len(units), want, text, *((None, None) if plain else (len(p), len(m))))
    got = fim.fill_in_middle(odd).withColumn("restored", fim.restored("output", "form")).collect()
    assert sorted((r["doc_id"] or -1, r["restored"]) for r in got) == sorted((r[0] or -1, r[1] or "") for r in ODD)
    assert fim.fill_in_middle(odd.limit(0)).count() == 0
    assert {r["form"] for r in fim.fill_in_middle(odd, rate=0).collect()} == {"plain"}


def test_rotations_are_inverse():
    rng = random.Random(1)
    for _ in range(200):
        text = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40)))
        buf, mid = bytearray(text), rng.randrange(len(text) + 1)
        fim.rotate(buf, 0, mid, len(buf))
        assert bytes(buf) == text[mid:] + text[:mid]
        fim.rotate(buf, 0, len(text) - mid, len(buf))
        assert bytes(buf) == text


# op13


def plain_runs(w, least=24):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


@pytest.mark.parametrize("grid", [16, 1 << 14])
def test_runs_equal_brute_force(monkeypatch, grid):
    monkeypatch.setattr(runs, "GRID", grid)
    runs._grid.cache_clear()
    rng = random.Random(7)
    for _ in range(300):
        n, kinds, least = rng.randrange(300), rng.choice([1, 2, 3, 6, 60]), rng.choice([3, 8, 24])
        w = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 10 else 0):
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randrange(3, 12)
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
            w = w[a // 2 :] + w[: a // 2]
        assert [tuple(r) for r in runs.periodic_runs(np.array(w, np.int64), least).tolist()] == plain_runs(w, least)
    runs._grid.cache_clear()


def test_grammar_extensions():
    rng = random.Random(8)
    for kinds, n in itertools.product([1, 2, 5, 100], [2, 9, 64, 333]):
        w = np.array([rng.randrange(kinds) for _ in range(n)] * 2)
        pairs = [(x, y) for x, y in ((rng.randrange(2 * n), rng.randrange(2 * n)) for _ in range(50)) if x != y] + [(0, n)]
        grammar = runs.Grammar(w)
        for a, b in pairs:
            f, r = grammar.extension(a, b), grammar.extension(a, b, back=True)
            assert f == next((k for k in itertools.count() if max(a, b) + k >= len(w) or w[a + k] != w[b + k]), None)
            assert r == next((k for k in itertools.count() if min(a, b) - k <= 0 or w[a - 1 - k] != w[b - 1 - k]), None)


def test_runs_query_equals_a_plain_version(spark):
    got = {r["doc_id"]: r for r in runs.op13_periodic_runs(spark, SF).collect()}
    looped = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        w, h = SPLIT.findall(r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            looped += 1
        want = plain_runs(w)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        drop = {i for s, m, q in want for i in range(s + q, s + m)}
        row = got[r["doc_id"]]
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(want), *best, 1000 * best[1] // best[2] if want else None)
        assert row["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert row["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in drop))
    assert looped > 10 and sum(r["n_runs"] for r in got.values()) > 10


def test_runs_odd_and_empty(spark, odd):
    got = runs.word_runs(odd, loops=True)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert sorted((r["doc_id"] or -1, r["n_words"]) for r in got.collect()) == sorted((r[0] or -1, len(SPLIT.findall(r[1] or ""))) for r in ODD)
    assert runs.word_runs(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "w " * 5000), (1, None)], "doc_id long, text string")
    assert [([tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.word_runs(same).orderBy("n_words").collect()] == [([], ""), ([(0, 5000, 1)], "w")]


# op7 and op10


def test_pages_of_unclosed_elements_take_linear_time():
    began = time.perf_counter()
    for tag in sorted(html_mincut.RAW):
        found = html_mincut.blocks("<p>text</p>" + f"<{tag}>" * (1_000_000 // (len(tag) + 2)) + "<p>more</p>")
        assert found[0].text == "text"
    assert time.perf_counter() - began < 120


def test_warc_files_of_one_name(spark, tmp_path):
    page = spark.createDataFrame([(i, f"http://{i}", "x" * i) for i in range(4)], "page_id long, url string, html string")
    records = [r["r"].encode() for r in page.select(warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()]
    for folder, own in (("a", records[:2]), ("b", records[2:])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.warc").write_bytes(b"".join(own))
    got = sorted((r["file"], r["offset"], bytes(r["record"])) for r in warc_fixity.read_warc(spark, str(tmp_path)).collect())
    assert got == [("a/x.warc", 0, records[0]), ("a/x.warc", len(records[0]), records[1]), ("b/x.warc", 0, records[2]), ("b/x.warc", len(records[2]), records[3])]
