"""The ten operators against brute force, exact round trips and held-out labels, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomnote.llm import bpe, exact_dedup, golay_simhash, html_mincut, langid, mixing, ordinal_quality, registry, textfeatures, toxicity, voronoi_knn, warc_fixity
from loomnote.llm.common import components
from tests.conftest import SF
from tests.oracle import differences

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that was his with for as had you not be her on at by which have or from this him".split()
#: Nulls in every column, empty and long texts, ties and repeated rows.
ODD = [
    (1, "a b  c\td", "en", "x", 8), (2, "a b c d", "en", "x", 7), (2, "a b c d", "en", "x", 7), (3, None, None, None, None), (4, "", "fr", "y", 0), (5, " \n", "fr", "y", 2),
    (None, "a b c d", "en", "x", 7), (None, None, None, None, None), (6, "Ωmega 123 <|endoftext|> 'S été", "fr", None, 9), (7, " ".join(random.Random(1).choices(WORDS, k=60_000)), "en", "x", 1), (8, "1 2 3", "en", "y", 5), (9, "😀 1", "en", "y", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"id": F.lit(1), "size": F.lit("clash"), "rank": F.lit(0), "score": F.lit(9), "print": F.lit("p"), "key": F.lit(None)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(300, 340)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(rows(components(spark.createDataFrame(pairs, "u long, v long"))))
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    assert rows(components(spark.createDataFrame([], "u long, v long"))) == []


# op3


def test_exact_dedup_odd(odd, empty):
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(ODD)
    abcd = [r for r in got if r["text_sha256"] == hashlib.sha256(b"a b c d").hexdigest()]
    assert len(abcd) == 4 and {(r["keep_id"], r["group_size"]) for r in abcd} == {(1, 4)} and sum(r["kept"] for r in abcd) == 1
    assert sum(r["kept"] for r in got) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len({r["text_sha256"] for r in got})


# op9


def brute_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_meet():
    rng, tables = np.random.default_rng(1), golay_simhash.golay()
    a = rng.integers(-(1 << 63), 1 << 63, 1500)
    for flips in range(5):
        b = a.view(np.uint64).copy()
        for i in range(len(b)):
            for p in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1 << int(p))
        keys = [[set() for _ in a] for _ in range(2)]
        for held, x in zip(keys, (a, b.view(np.int64)), strict=True):
            for at, k in zip(*golay_simhash.fuzzy_keys(x, tables), strict=True):
                held[at].add(int(k))
        assert all(x & y for x, y in zip(*keys, strict=True))


def test_finer_keys_meet():
    rng, tables = np.random.default_rng(2), golay_simhash.golay()
    a = rng.integers(-(1 << 63), 1 << 63, 1500)
    for flips in range(5):
        b = a.view(np.uint64).copy()
        for i in range(len(b)):
            for p in rng.choice(64, flips, replace=False):
                b[i] ^= np.uint64(1 << int(p))
        coarse, fine = [[set() for _ in a] for _ in range(2)], [[set() for _ in a] for _ in range(2)]
        for held, finer, x in zip(coarse, fine, (a, b.view(np.int64)), strict=True):
            at, keys = golay_simhash.fuzzy_keys(x, tables)
            for i, k in zip(at, keys, strict=True):
                held[i].add(int(k))
            again, keys = golay_simhash.finer_keys(keys, x[at], tables)
            for i, k in zip(at[again], keys, strict=True):
                finer[i].add(int(k))
        assert all(x & y for x, y in zip(*coarse, strict=True)) and all(x & y for x, y in zip(*fine, strict=True))


def test_simhash_components_with_dense_buckets(spark, monkeypatch):
    monkeypatch.setattr(golay_simhash, "LARGE", 8)
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for seed in prints[:6]:
        for _ in range(60):
            prints.append(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))))
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    want = brute_components({p: p & ((1 << 64) - 1) for p in prints})
    got = dict(rows(golay_simhash.link_components(spark.createDataFrame([(p,) for p in prints], "print long"))))
    assert {p: got.get(p, p) for p in prints} == want
    assert rows(golay_simhash.link_components(spark.createDataFrame([], "print long"))) == []


def test_simhash_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = golay_simhash.op9_golay_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_simhash_odd(odd, empty):
    got = golay_simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {3, 4, 5, None} and {r["component_id"] for r in zero} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert golay_simhash.near_duplicates(empty).count() == 0
    assert golay_simhash.keep_one(odd).columns == odd.columns


def test_simhash_keeps_unrelated_texts_without_or_under_one_id(spark):
    text = [" ".join(random.Random(100 + i).choices(WORDS, k=40)) for i in range(5)]
    given = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (None, text[4]), (8, text[4]), (9, text[2]), (7, text[3])]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    want = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4])]
    assert sorted(rows(golay_simhash.keep_one(docs)), key=str) == sorted(want, key=str)


# op5


@pytest.fixture(scope="module")
def tokenizer():
    return bpe._plain(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_words_keep_the_ids(tokenizer):
    rng = random.Random(3)
    some = [*"abZÉéßñ09'’.,!?;:%&*#$()\"<|>-_ \t\n\x0b\x85\xa0", "é", "A̱", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "日", "१", "‍", "ǅ", "İ", "K", "😀", "ͅ", "ẞ", "Σ"]
    texts = ["".join(rng.choices(some, k=rng.randrange(25))) for _ in range(20_000)]
    for text, words in zip(texts, bpe.words(pa.array(texts), bpe.may_cut(tokenizer)).to_pylist(), strict=True):
        assert [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def same_as_library(tokenizer, found, texts):
    for r in found:
        ids = tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_equals_the_library(spark, tokenizer, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = bpe.encode_decode(docs.repartition(5, "doc_id"), path, block_bytes=20_000).collect()
    assert len(found) == docs.count()
    same_as_library(tokenizer, found, {r["doc_id"]: r["text"] for r in docs.collect()})
    named = odd.where("doc_id IS NOT NULL")
    found = bpe.encode_decode(named, path, block_bytes=10).collect()
    assert len(found) == named.count()
    same_as_library(tokenizer, found, {r[0]: r[1] for r in ODD})
    assert bpe.encode_decode(empty, path).count() == 0
    assert bpe.encode_decode(odd, path, then=bpe.DIGESTS).where("doc_id = 3").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()


# op8


def test_language_held_out(spark):
    found = langid.op8_bitsliced_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd(spark, odd, empty):
    got = {r["doc_id"]: r for r in langid.predict(odd.where("doc_id IS NOT NULL"), langid.learned_from(odd)).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {3, 4, 5, 8, 9} and got[7]["lang_pred"] == "en"
    assert langid.predict(empty, langid.learned_from(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.learned_from(empty)).collect()} == {"und"}
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and {(r["doc_id"], r["score"]) for r in kept.collect()} == {(i, 9) for i in (1, 2, 6, None)}
    foreign = spark.createDataFrame([(1, "ab ab ab ab", "en"), (3, "ab ab", None), (5, "ba ab ab", "fr"), (7, "\u4e00\u4e8c \u4e09\u56db", "en"), (9, None, "en")], "doc_id long, text string, lang string")
    learnt = langid.learn(foreign.where("doc_id = 1"))
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(foreign, learnt).where("score > 0").collect()} == dict.fromkeys((1, 3, 5), "en")


def test_language_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = langid.learned_from(docs)
    found = langid.predict(docs.where("doc_id % 5 = 0"), filters).collect()
    assert len(found) >= 40
    for r in found:
        letters = "".join(c.lower() if c.isalpha() else " " for c in r["text"] or "")
        text = f" {' '.join(letters.split())} "
        hits, n = [0] * len(filters.languages), 0
        for order in langid.ORDERS if text.strip() else ():
            for i in range(len(text) - order + 1):
                h = order
                for c in text[i : i + order]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                mask = ~0
                for k in range(filters.hashes):
                    mask &= int(filters.masks[(h >> 7) * (2 * k + 0xD6E8FEB86659FD93) % 2**64 >> (64 - (filters.slots - 1).bit_length()), 0])
                n += 1
                for j in range(len(hits)):
                    hits[j] += mask >> j & 1
        share = [(x / n - p) / (1 - p) for x, p in zip(hits, filters.false_rate, strict=True)] if n else []
        best = max(range(len(share)), key=lambda j: (share[j], -j)) if n else None
        want = ("und", 0.0) if not n else (filters.languages[best], share[best]) if share[best] > 0 else (filters.default, 0.0)
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-9


def test_bloom_filters_correct_for_false_positives():
    rng = np.random.default_rng(5)
    sets = {lang: rng.integers(0, 1 << 62, 3000).astype(np.uint64) for lang in ("a", "b", "c")}
    filters = langid.Filters(["a", "b", "c"], sets, slots=1 << 14)
    other = rng.integers(0, 1 << 62, 20_000).astype(np.uint64)
    found = None
    for at in langid.slots_of(other, filters.slots, filters.hashes):
        found = filters.masks[at] if found is None else found & filters.masks[at]
    for i in range(3):
        assert abs((found[:, 0] >> np.uint64(i) & np.uint64(1)).mean() - filters.false_rate[i]) < 0.02
        assert all((filters.masks[at][:, 0] >> np.uint64(i) & np.uint64(1)).all() for at in langid.slots_of(sets["abc"[i]], filters.slots, filters.hashes))


# op4


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


def check_mix(docs, tolerance):
    found = mixing.mix(docs).collect()
    sizes: dict = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want, took = plain_targets(sizes), {}
    for r in found:
        assert abs(r["target"] - want[r["source"]]) < 1e-3 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(took[s] - want[s]) <= max(64, tolerance * want[s])
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, found), key=str)
    return found


def test_mix(spark, odd, empty):
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"), 0.02)
    assert len(check_mix(odd, 0.02)) == len(ODD)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    copies = mixing.mixed(odd)
    assert copies.columns == odd.columns and {r[0] for r in rows(copies.select("text"))} <= {r[1] for r in ODD if r[1] and r[1].split()}


def test_schedule_spreads_sources(spark):
    goal = spark.createDataFrame([("a", 10_000, 0, 5_000.0), ("b", 10_000, 1, 3_000.0), ("c", 10_000, 2, 2_000.0)], "source string, source_size long, place int, target double")
    slots = sorted(rows(mixing.schedule(goal, 1000, 10).select("slot", "place", "rank", "block", "pass")))
    assert len(slots) == 1000
    for at in range(100, 1001, 100):
        for place, share in enumerate((0.5, 0.3, 0.2)):
            assert abs(sum(p == place for _, p, *_ in slots[:at]) - share * at) <= 4
    for place in range(3):
        assert [r for _, p, r, _, _ in slots if p == place] == list(range(sum(p == place for _, p, *_ in slots)))


# op2


def test_knn_small_and_odd(spark):
    rng = random.Random(4)
    made = [(i, [rng.gauss(0, 1) for _ in range(5)], 0) for i in range(300)] + [(300 + i, [0.5] * 5, 0) for i in range(40)]
    made += [(400, None, 0), (401, [1.0, None, 0.0, 0.0, 0.0], 0), (402, [float("nan")] * 5, 0), (403, [float("inf")] * 5, 0), (404, [9.0], 0)]
    data = voronoi_knn.quantised(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int"))
    want = {}
    vectors = {r["id"]: r["v"] for r in data.collect() if len(r["v"]) == 5}
    assert len(vectors) == 340
    for q in [i for i in vectors if i % 7 == 0]:
        best = sorted(((-sum(x * y for x, y in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q))[:5]
        want[q] = [(i, -s) for s, i in best]
    got = {}
    for r in sorted(voronoi_knn.top_k(data, data.where("id % 7 = 0"), pivots=12, group_queries=10, block_rows=50).collect()):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want
    few = data.where("id IN (0, 1, 2)")
    assert voronoi_knn.top_k(few, few.where("id = 0")).count() == 2
    assert voronoi_knn.top_k(data.limit(0), data).count() == 0


def test_knn_sends_what_is_needed_only(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 1, (40, 16))
    made = [(i, (centres[i % 40] + rng.normal(0, 0.05, 16)).tolist(), 0) for i in range(4000)]
    data = voronoi_knn.quantised(spark.createDataFrame(made, "vec_id long, embedding array<float>, label int"))
    ask = data.where("id % 7 = 0")
    met = voronoi_knn.plan(data, ask, group_queries=20)
    groups, sent = met.agg(F.count_distinct("grp"), F.count_if(~F.col("asks"))).first()
    assert groups > 10 and sent < 0.2 * groups * 4000, sent / groups / 4000
    x = np.array([r["v"] for r in sorted(data.collect())])
    score = x[::7] @ x.T
    score[np.arange(len(score)), np.arange(0, 4000, 7)] = -(10**9)
    want = {(7 * q, r + 1, int(i), int(score[q, i])) for q in range(len(score)) for r, i in enumerate(np.lexsort((np.arange(4000), -score[q]))[:5])}
    assert set(rows(voronoi_knn.top_k(data, ask, group_queries=20))) == want


def test_knn_repeated_ids_and_columns(spark):
    made = [(1, [3, 0]), (1, [3, 0]), (2, [2, 1]), (3, [1, 1]), (3, [0, 5]), (4, [0, 0])]
    data = spark.createDataFrame(made, "id long, v array<long>").withColumns({"cell": F.lit("x"), "grp": F.lit(1), "theta": F.lit(2), "asks": F.lit("y")})
    got = sorted(rows(voronoi_knn.top_k(data, data.where("id IN (1, 3)"), 3)))
    # Query 3 asks with its least vector; both rows of id 1 are candidates of it.
    assert got == [(1, 1, 2, 6), (1, 2, 3, 3), (1, 3, 3, 0), (3, 1, 2, 5), (3, 2, 1, 0), (3, 3, 1, 0)] or got == [(1, 1, 2, 6), (1, 2, 3, 3), (1, 3, 3, 0), (3, 1, 2, 5), (3, 2, 1, 0), (3, 3, 4, 0)]


# op1, op6


def labelled(spark, n=600):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randrange(20, 60))
        junk, toxic = i % 3 == 0, i % 4 == 0
        if junk:
            words = [w + " %%%" for w in words]
        if toxic:
            words[:0] = ["grubworm", "dunderhead"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_part(part):
    h = 0
    for c in part:
        h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
        h ^= h >> 29
    return textfeatures.FIRST_PART + h % textfeatures.BUCKETS


def test_ordinal_grades(spark, odd, empty):
    docs, labels = labelled(spark)
    sample = textfeatures.gather(docs, ordinal_quality.rated(labels), ["grade"])
    model = ordinal_quality.fit(sample, sample.labels[:, 0])
    assert list(model[1]) == sorted(model[1])
    got = {r["doc_id"]: r for r in ordinal_quality.grade(docs, model).collect()}
    assert np.mean([r["selected"] == (i % 3 != 0) for i, r in got.items()]) > 0.98
    assert np.mean([got[i]["expected_grade"] for i in got if i % 3 and i % 4]) > np.mean([got[i]["expected_grade"] for i in got if i % 3 and not i % 4]) > np.mean([got[i]["expected_grade"] for i in got if not i % 3])
    assert all(r["tail"] == sorted(r["tail"], reverse=True) for r in got.values())
    assert ordinal_quality.grade(odd, model).count() == len(ODD) and ordinal_quality.grade(empty, model).count() == 0
    # Against a plain version, word by word.
    for r in ordinal_quality.grade(odd.where("doc_id IS NOT NULL"), model).collect():
        words = re.findall(r"[^\W\d_]+|[^\w\s]+", r["text"] or "")
        count = {}
        for w in words:
            b = zlib.crc32(w.lower().encode()) % textfeatures.BUCKETS % ordinal_quality.WIDTH, zlib.crc32(w.lower().encode()) % textfeatures.BUCKETS
            count[b] = count.get(b, 0) + 1
        loud, again = sum(len(w) > 1 and w.isupper() and w.lower() != w for w in words), sum(a == b for a, b in zip(words, words[1:], strict=False))
        kinds = len(count) + (loud > 0) + (again > 0)
        score = sum(model[0][b] * 4 * math.log1p(c) / math.sqrt(1 + kinds) for (b, _), c in count.items())
        score += sum(model[0][ordinal_quality.WIDTH + i] * 3 * math.sqrt(c / len(words)) for i, c in enumerate((loud, again)) if c)
        assert np.allclose(r["tail"], [1 / (1 + math.exp(c - score)) for c in model[1]], atol=1e-4) and abs(r["expected_grade"] - sum(r["tail"])) < 1e-9
    # The thresholds of an empty text's grades follow the ratings' shares, and repeated labels and clashing columns do no harm.
    doubled = textfeatures.gather(docs.withColumn("grade", F.lit("x")), ordinal_quality.rated(labels.union(labels)), ["grade"])
    assert len(doubled) == 2 * len(sample)
    none = textfeatures.gather(empty, ordinal_quality.rated(labels.limit(0)), ["grade"])
    assert ordinal_quality.grade(odd, ordinal_quality.fit(none, none.labels[:, 0])).count() == len(ODD)


def test_toxicity_chain(spark, odd, empty):
    docs, labels = labelled(spark)
    sample = textfeatures.gather(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ["low_quality", "toxic"])
    chain, own = toxicity.fit_chain(sample)
    assert own.shape == (len(sample), 2) and 0 < toxicity.threshold(own[:, 1], sample.labels[:, 1]) < 1
    assert [len(w) - len(c) for c, w in chain] == [1, 2]
    got = {r["doc_id"]: r["p"] for r in toxicity.predict(docs, chain).collect()}
    assert all((p[1] >= 0.4) == (i % 4 == 0) and (p[0] >= 0.5) == (i % 3 == 0) for i, p in got.items())
    # Against a plain version, word by word and part by part.
    for r in toxicity.predict(odd.where("doc_id IS NOT NULL").union(odd.limit(1)), chain).collect():
        text, p = r["text"] or "", []
        count = dict(textfeatures.features(text)[0])
        for word in re.findall("[a-z]+", text.lower()) if text.isascii() else []:
            marked = " " + word + " "
            for n in textfeatures.PARTS:
                for i in range(len(marked) - n + 1):
                    b = plain_part(marked[i : i + n])
                    count[b] = count.get(b, 0) + 1
        for chosen, weights in chain:
            own = dict(zip(chosen.tolist(), weights[: len(chosen)].tolist(), strict=True))
            score = sum(own[b] * math.log1p(c) for b, c in count.items() if b in own) + sum(w * x for w, x in zip(weights[len(chosen) : -1], p, strict=True)) + weights[-1]
            p.append(1 / (1 + math.exp(-score)))
        if text.isascii():
            assert np.allclose(r["p"], p, atol=1e-6)
    assert toxicity.predict(odd, chain).count() == len(ODD) and toxicity.predict(empty, chain).count() == 0
    none = textfeatures.gather(empty, labels.limit(0), ["quality", "toxic"])
    assert toxicity.predict(odd, toxicity.fit_chain(none)[0]).count() == len(ODD)


def test_sparse_fit_equals_the_dense_one():
    rng = np.random.default_rng(1)
    x = rng.random((200, 12)) * (rng.random((200, 12)) < 0.3)
    y, use = (x[:, 0] + x[:, 1] > 0.5).astype(int), rng.random(200) < 0.8
    at = np.nonzero(x)
    assert np.allclose(textfeatures.fit_logistic_sparse((*at, x[at]), 12, y, use), textfeatures.fit_logistic(x[use], y[use]), atol=1e-3)


def test_toxicity_in_a_rare_inflecting_language(spark, tmp_path):
    rng = random.Random(11)
    ends = ["".join(rng.choices("abcdefghij", k=3)) for _ in range(60)]
    docs, labels = [], []
    for i in range(900):
        rare, toxic = i % 10 == 0, i % 4 == 0
        words = rng.choices([w + "eux" for w in WORDS] if rare else WORDS, k=rng.randrange(20, 60))
        if toxic:
            words[:0] = rng.choices(["vilgrub" + e for e in ends], k=3) if rare else ["dunderhead", "grubworm"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    # Copies of one clean text count once.
    docs += [(900 + i, "quiet unhurried mornings") for i in range(200)]
    labels += [(900 + i, 1, 0) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 20 <> 0 OR doc_id % 40 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.op6_toxicity_chain(spark, str(tmp_path)).collect()}
    assert all(got[i] for i in range(0, 900, 20)) and np.mean([got[i] == (i % 4 == 0) for i in range(900)]) > 0.98
    sample = textfeatures.gather_parts(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), ["toxic"])
    assert 700 < len(sample) <= 901


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    text = F.lower(F.regexp_replace("text", r"\s+", " "))
    rated = docs.join(labels.dropna(), "doc_id").withColumn("held", F.pmod(F.xxhash64(text), F.lit(10)) < 3)
    train = rated.where("NOT held").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    sample = textfeatures.gather_parts(docs, train, ["low_quality", "toxic"], words_only=toxicity.QUALITY)
    chain, own = toxicity.fit_chain(sample, words_only=toxicity.QUALITY)
    least = toxicity.threshold(own[:, 1], sample.labels[:, 1])
    found = toxicity.predict(rated.where("held").select("doc_id", "text", "toxic"), chain).select("toxic", (F.col("p")[1] >= least).alias("said")).collect()
    assert np.mean([r["said"] for r in found if r["toxic"]]) >= 0.9 and np.mean([not r["said"] for r in found if not r["toxic"]]) >= 0.97


# op7


PAGE = """<html><body class="has-menu"><div id="top-bar"><nav><a href=/>Home</a></nav></div><div class="cookie-notice">We use cookies.</div><div class="wrap with-sidebar"><div class="post-body">
<h2>A  title&amp;more</h2><p>This is a long paragraph, with several clauses, that makes up the main text of the page. It goes on.<p>Short <b>one</b>.<br>Next&nbsp;line.</p><div class="ad-slot"><p>Buy now, a nice and long advert text, which pretends to be content.</p></div>
<script>var x = "<p>no</p>";</script><p>Another paragraph of main text, again long enough to be content.</div><div class="sidebar"><ul><li><a href=1>One link</a><li><a href=2>Two link</a></ul></div></div><!-- <p>gone</p> --><section id="comments"><article class="comment"><p>Great article, I really liked it.</p></article></section><form><label>Name</label></form><footer>(c) 2020</footer></body></html>"""


def brute_cut(odds, edges):
    def cost(side):
        return sum(abs(o) for o, s in zip(odds, side, strict=True) if (o > 0) != s) + sum(w for a, b, w in edges if side[a] != side[b])

    return min(cost(s) for s in itertools.product((False, True), repeat=len(odds))), cost


def test_min_cut_is_minimal():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        least, cost = brute_cut(odds, edges)
        assert abs(cost(html_mincut.min_cut(odds, edges)) - least) < 1e-6


LONG = "This is a long paragraph, with several clauses, that makes up the main text of the page. It goes on for a while, as such paragraphs do."
#: No telling names, a block that looks like boilerplate in the text and one that looks like text in a menu.
UNMARKED = f"""<html><body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div><h1>A title of it</h1><p>{LONG}</p><p>Yes</p><p>{LONG}</p><div>12 of 30</div><p>{LONG}</p><p>{LONG}</p></div>
<div><ul><li><a href=1>One link here</a></li><li><a href=2>Another link there</a></li><li>A teaser without a link, which reads like an article, and is long.</li><li><a href=3>Third link</a></li><li><a href=4>Fourth link</a></li></ul></div><div>Copyright 2020</div></body></html>"""


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = html_mincut.learn(pages)
    assert html_mincut.extract(PAGE, weights) == (
        "A title&more This is a long paragraph, with several clauses, that makes up the main text of the page. It goes on. Short one. Next line. Another paragraph of main text, again long enough to be content."
    )
    for p in (None, "", "<", "<p", "plain words", "<p>" * 3000, "<div>" * 2000 + "x", "<!-- ", "<a href='"):
        html_mincut.extract(p, weights)
    assert html_mincut.extract("<script>x", weights) == ""
    found = html_mincut.op7_mincut_html(spark, SF).collect()
    assert len(found) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in found)
    assert html_mincut.main_text(pages.limit(0), html_mincut.learn(pages.limit(0))).count() == 0
    twice = pages.limit(3).union(pages.limit(3)).withColumns({"n_chars": F.lit("x"), "row": F.lit(1), "text": F.lit("old")})
    again = html_mincut.main_text(twice, weights)
    assert again.columns == twice.columns and again.count() == 6 and {r["text"] for r in again.collect()} <= {r["text"] for r in found}


def test_the_cut_decides_on_an_unmarked_page(spark):
    weights = html_mincut.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    found = html_mincut.blocks(UNMARKED)
    sign = [c > 0 for c in html_mincut.costs(found, weights)]
    want = [x.text in ("A title of it", "Yes", "12 of 30", LONG) for x in found]
    assert sum(a != b for a, b in zip(sign, want, strict=True)) >= 1  # by its looks alone a block is misjudged
    assert html_mincut.extract(UNMARKED, weights) == " ".join(x.text for x, y in zip(found, want, strict=True) if y)
    # Against all labellings, with the weights as learned and with weak ones that leave more to the cut.
    for r in spark.read.parquet(f"{SF}/pages.parquet").limit(12).collect():
        some = html_mincut.blocks(r["html"])[:10]
        for scale in (1.0, 0.2):
            odds = [scale * c for c in html_mincut.costs(some, weights)]
            least, cost = brute_cut(odds, html_mincut.smooth(some))
            assert abs(cost(html_mincut.min_cut(odds, html_mincut.smooth(some))) - least) < 1e-6


def test_html_of_any_depth(spark):
    weights = html_mincut.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    body = f"<div class=post-body><p>{LONG}</p><p>{LONG}</p></div>"
    for inline in ("<i>", "<span>", "<a href=1>", "<font>"):
        for n in (0, 100, 250, 3000):
            assert html_mincut.extract(f"<body><nav>{inline * n}Home</nav>{body}</body>", weights) == f"{LONG} {LONG}"
    for n in (10, 1000, 20_000):
        assert html_mincut.extract("<div>" * n + body + "</div>" * n + "<footer>(c)</footer>", weights) == f"{LONG} {LONG}"
    # An end tag within a cell does not close what the table stands in.
    kept = html_mincut.extract(f"<article><p>{LONG}</p><table><tr><td></article></div>7 of 9</table><p>{LONG}</p></article><nav>Home</nav>", weights)
    assert kept.startswith(LONG) and kept.endswith(LONG) and "Home" not in kept


# op10


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "héllo\r\n\r\nWARC/1.0"), (2, None, None), (3, "http://c", ""), (3, "http://c", "")], "page_id long, url string, html string")
    records = pages.select(warc_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()
    content = b"".join(r["r"].encode() for r in records)
    (tmp_path / "x.warc").write_bytes(content)
    got = sorted(warc_fixity.read_warc(spark, str(tmp_path)).collect(), key=lambda r: r["offset"])
    assert [bytes(r["record"]) for r in got] == [r["r"].encode() for r in records]
    import gzip

    # Gzip by record, files that repeat a record, a header without a length, a file cut short, and no WARC at all.
    (tmp_path / "y.warc.gz").write_bytes(b"".join(gzip.compress(r["r"].encode()) for r in [*records, records[0]]))
    (tmp_path / "z.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: x\r\n\r\nlost" + content[:-7])
    (tmp_path / "none.warc").write_bytes(b"plain words")
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc_fixity.read_warc(spark, str(tmp_path)).collect()
    of = lambda name: [bytes(r["record"]) for r in sorted(found, key=lambda r: r["offset"]) if r["file"] == name]
    assert of("y.warc.gz") == [r["r"].encode() for r in [*records, records[0]]] and of("none.warc") == [b"plain words"] and of("empty.warc") == []
    assert len(of("z.warc")) == 5 and b"".join(of("z.warc")) == b"WARC/1.0\r\nWARC-Type: x\r\n\r\nlost" + content[:-7]
    assert all(sum(len(r["record"]) for r in found if r["file"] == q["file"] and r["offset"] < q["offset"]) == q["offset"] for q in found)
    assert warc_fixity.page_records(pages).count() == 4 and warc_fixity.page_records(pages.limit(0)).count() == 0
    twice = pages.union(pages.where("page_id = 1")).union(spark.createDataFrame([(None, "http://n", "x"), (None, None, None)], pages.schema))
    index = warc_fixity.placed(warc_fixity.page_records(twice)).collect()
    assert sum(r["n"] for r in index) == 7 and {r["n"] for r in index if r["page_id"] in (1, 3)} == {2} and warc_fixity.placed(warc_fixity.page_records(pages.limit(0))).count() == 0
    one = sorted((r["start"], r["length"], r["n"]) for r in index if r["file"] == "pages-00000000.warc")
    assert [s for s, _, _ in one] == [sum(le * n for _, le, n in one[:i]) for i in range(len(one))]


def test_audit_finds_all_damage(spark):
    rng = random.Random(8)
    schema = "file string, offset long, record string"
    good = [(f"f{i // 40}", i % 40 * 5_000, f"record {i}") for i in range(400)] + [(None, None, None)]
    bad = set(rng.sample(range(400), 23))
    lost = set(rng.sample(sorted(set(range(400)) - bad), 7))
    other = [(f, o, r + "!" if i in bad else r) for i, (f, o, r) in enumerate(good) if i not in lost] + [("f9", 10_000_000, "new")]
    a, b = (warc_fixity.digests(spark.createDataFrame(x, schema)) for x in (good, other))
    found, root = warc_fixity.audit(a, b)
    want = {(good[i][0], good[i][1], "damaged") for i in bad} | {(good[i][0], good[i][1], "missing") for i in lost} | {("f9", 10_000_000, "extra")}
    assert {(r["file"], r["offset"], r["status"]) for r in found.collect()} == want
    r = root.first()
    assert r["root_a"] != r["root_b"]
    # As deep a tree as many files and long ranges give, and repeated rows.
    deep, _ = warc_fixity.audit(a.union(a.where("offset = 5000")), b.union(b.where("offset = 5000")), range_bytes=10, fan_out=2)
    assert {(r["file"], r["offset"], r["status"]) for r in deep.collect()} == want
    found, root = warc_fixity.audit(a, a)
    assert found.count() == 0 and root.first()["root_a"] == root.first()["root_b"]
    assert warc_fixity.audit(a.limit(0), a.limit(0))[0].count() == 0
