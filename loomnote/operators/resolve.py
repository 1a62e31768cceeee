"""Entity resolution, mentions and similarity joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import counted, written
from .vector import _rounded


def duplicate_entities(names: DataFrame, least: float = 0.85) -> DataFrame:
    """left_id, right_id, similarity of pairs of names (id, name, type) whose keys agree or are similar enough.

    Equal keys are merged first, so copies make no pairs of their own; distinct keys meet over their rarest
    bigrams: keys of similarity s share at least that many bigrams of the set, so it is enough to index the
    first ones in order of rarity (prefix filter). For edit similarity the same bound holds after the strings'
    lengths: one edit changes at most two bigrams. Output: one row per pair of distinct keys, with the smallest
    ids of both; equal keys give one row per further id, against the smallest.
    """
    keyed = names.withColumn("key", T.entity_key(F.col("name"))).where("key <> ''")
    groups = keyed.groupBy("type", "key").agg(F.min("id").alias("id"))
    same = keyed.join(groups.withColumnRenamed("id", "first"), ["type", "key"]).where("id <> first").select(F.col("first").alias("left_id"), F.col("id").alias("right_id"), F.lit(1.0).alias("similarity"))
    grams = groups.withColumn("g", T.bigrams(F.col("key"))).withColumn("n", F.length("key"))
    df = grams.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    flat = grams.select("type", "key", "id", "n", F.size("g").alias("m"), F.explode("g").alias("gram")).join(df, "gram")
    place = F.row_number().over(Window.partitionBy("type", "key").orderBy("df", "gram"))
    # Edits at most (1 - least) * longest, longest at most n / least; each destroys two bigrams at most. Jaccard: m - ceil(least * m) + 1.
    edits = F.floor((1 - least) * F.floor(F.col("n") / least))
    prefix = F.greatest(2 * edits + 1, F.col("m") - F.ceil(least * F.col("m")) + 1)
    index = flat.withColumn("place", place).where(F.col("place") <= prefix).select("type", "key", "id", "n", "gram")
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.key") < F.col("b.key")) & (T.similarity(F.col("a.key"), F.col("b.key")) >= least))
    one = pairs.select(F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id"), F.round(T.similarity(F.col("a.key"), F.col("b.key")), 6).alias("similarity")).distinct()
    return same.unionByName(one)


def close_pairs(names: DataFrame, edits: int = 2) -> DataFrame:
    """key_a, key_b, n: pairs of names (key) at most so many edits apart, and of how many rows' pairs they stand; equal keys count as a pair with themselves.

    Cut in edits + 1 segments, a key has one that such a partner holds unchanged, shifted by no more than the edits:
    segments meet partners' substrings by equality, never all with all.
    """
    keys = names.groupBy("key").agg(F.count("*").alias("rows")).withColumn("m", F.length("key"))
    same = keys.where("rows > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.expr("rows * (rows - 1) DIV 2").alias("n"))
    parts = edits + 1
    cut = lambda m, i: F.floor(m * i / parts).cast("int")
    own = keys.select("key", "rows", "m", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring("key", cut(F.col("m"), i) + 1, cut(F.col("m"), i + 1) - cut(F.col("m"), i)).alias("s")) for i in range(parts)])).alias("g")).select("key", "rows", "m", "g.*")
    every = lambda a, z, f: F.flatten(F.transform(F.sequence(F.lit(a), F.lit(z)), f))

    def piece(d: Column, i: Column, shift: Column) -> Column:
        m = F.col("m") + d
        return F.struct(m.alias("of"), i.alias("i"), F.when((cut(m, i) + shift >= 0) & (m >= 0), F.substring(F.col("key"), cut(m, i) + 1 + shift, cut(m, i + 1) - cut(m, i))).alias("s"))

    seen = every(-edits, edits, lambda d: every(0, parts - 1, lambda i: F.transform(F.sequence(F.lit(-edits), F.lit(edits)), lambda shift: piece(d, i, shift))))
    looks = keys.select(F.col("key").alias("other"), F.col("rows").alias("other_rows"), F.explode(F.array_distinct(seen)).alias("g")).select("other", "other_rows", F.col("g.of").alias("m"), F.col("g.i").alias("i"), F.col("g.s").alias("s"))
    met = own.join(looks, ["m", "i", "s"]).where("key <> other").select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"), (F.col("rows") * F.col("other_rows")).alias("n")).distinct()
    return met.where(F.levenshtein("key_a", "key_b") <= edits).unionByName(same)


#: Bands of sizes by which sets meet.
BANDS = 12


def similar_sets(sets: DataFrame, like: float, block: int = 512) -> DataFrame:
    """left_id, right_id, jaccard of the pairs of sets (id, items: distinct) that are alike enough, left_id < right_id.

    Of m items a set shares at least ceil(like * m) with any such partner, so the pairs meet over their rarest
    m - ceil(like * m) + 1 items: what is most frequent makes no pairs. Equal sets should be merged before.
    The rarest item of a like pair is among those of both, and only there is the pair kept, so pairs are neither
    gathered nor made distinct. A set goes there by the sizes that a partner may have: with those whose rarest common
    item it is, it shares no more than what follows. Sizes come in ``BANDS`` at most. The sets of an item and two bands
    are cut into blocks of about ``block``, each a task's work with all of them.
    """
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = sets.select("id", F.explode("items").alias("item"))
    # Items by number, in order of rarity.
    df = written(flat.groupBy("item").agg(F.count("*").alias("df")).orderBy("df", "item").select("item", F.monotonically_increasing_id().alias("n")), "set-items")
    numbered = flat.join(df, "item").groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("s"))
    numbered = written(numbered, "set-numbers")
    sizes = sorted(r["m"] for r in numbered.select(F.size("s").alias("m")).distinct().collect())
    bands = [(x[0], x[-1]) for x in (sizes[i * len(sizes) // BANDS : (i + 1) * len(sizes) // BANDS] for i in range(BANDS)) if x]
    size = F.size("s")
    own = sum((F.when(size > high, 1).otherwise(0) for _, high in bands), F.lit(0))

    def cell(n: int, low: int, high: int) -> Column:
        least = F.greatest(F.lit(low), F.ceil(like * size - 1e-9))
        enough = size - F.col("place") >= F.ceil(like / (1 + like) * (size + least) - 1e-9)
        return F.when((least <= high) & (low <= size / like + 1e-9) & enough, F.struct(F.least(own, F.lit(n)).alias("x"), F.greatest(own, F.lit(n)).alias("y")))

    first = size - F.ceil(like * size - 1e-9).cast("int") + 1
    placed = numbered.select("id", "s", own.alias("own"), F.posexplode(F.slice("s", 1, first)).alias("place", "item"))
    index = placed.select("id", "s", "own", "item", F.explode(F.filter(F.array(F.lit(None).cast("struct<x:int,y:int>"), *[cell(n, *b) for n, b in enumerate(bands)]), lambda c: c.isNotNull())).alias("c"))
    index = written(index.select("id", "s", "own", "item", "c.*"), "set-index")
    key = ["item", "x", "y"]
    blocks = index.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = index.join(blocks, key)
    one = placed.select(*key, F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("b"), "id", "s", "own").repartition(parts, *key, "b").alias("a")
    every = placed.select(*key, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "id", "s", "own").alias("b")
    m, n = F.size("a.s"), F.size("b.s")
    met = F.array_intersect("a.s", "b.s")
    share = lambda x: F.size(x) / (m + n - F.size(x))
    alike = F.exists(F.array(met), lambda x: (share(x) >= like - 1e-12) & (F.get(x, 0) == F.col("a.item")))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*key, "b")]
    # Sets of one band meet where both bands are that one.
    on = reduce(Column.__and__, same) & ((F.col("a.own") != F.col("b.own")) | (F.col("a.x") == F.col("a.y"))) & (F.col("a.id") < F.col("b.id")) & (m >= like * n - 1e-9) & (n >= like * m - 1e-9)
    return one.join(every, on & alike).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), share(met).alias("jaccard"))


def phrases(docs: DataFrame, lengths: list[int], id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, phrase, position: the word sequences of the given lengths, with their position.

    Positions are rows before their sequences are formed, one at a time, in the stage that looks them up: a text's
    sequences never stand side by side.
    """
    words = docs.select(F.col(id_col).alias("id"), T.tokens(F.col(text_col)).alias("w")).where("size(w) > 0")
    at = words.select("id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("position"))
    join = lambda n: F.concat_ws(" ", *[F.get("w", F.col("position") - 1 + k) for k in range(n)]) if n <= 8 else F.array_join(F.slice("w", F.col("position"), n), " ")
    grams = [F.when(F.col("position") + n - 1 <= F.size("w"), join(n)) for n in lengths]
    return at.select("id", "position", F.explode(F.array(*grams)).alias("phrase")).where("phrase IS NOT NULL").select("id", "phrase", "position")


def title_mentions(docs: DataFrame, titles: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """id, title_id, position (word), of titles (title_id, title) whose words stand in a text one after the other: an equi-join of texts' word sequences with titles, for each length that a title has."""
    own = written(titles.select("title_id", F.array_join(T.tokens(F.col("title")), " ").alias("phrase")).where("phrase <> ''"), "titles")
    lengths = sorted(r["n"] for r in own.select(F.size(F.split("phrase", " ")).alias("n")).distinct().collect())
    if not lengths:
        return own.join(docs.select(F.col(id_col).alias("id"), F.lit(1).alias("position")).limit(0)).select("id", "title_id", "position")
    return phrases(docs, lengths, id_col, text_col).join(own, "phrase").groupBy("id", "title_id").agg(F.min("position").alias("position"))


def combine_mentions(lexical: DataFrame, bm25: DataFrame) -> DataFrame:
    """id, target, confidence, source: both lists merged; in both: the higher confidence, source both."""
    a, b = lexical.withColumnRenamed("confidence", "ca"), bm25.withColumnRenamed("confidence", "cb")
    return a.join(b, ["id", "target"], "full").select("id", "target", F.greatest("ca", "cb").alias("confidence"), F.when(F.col("ca").isNull(), "bm25").when(F.col("cb").isNull(), "lexical").otherwise("both").alias("source"))


#: Raw texts, and classes of pages, of a block, and how many characters of words it may have.
RAW_BLOCK, PAGE_BLOCK, BLOCK_CHARS = 4096, 131_072, 32 << 20


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The words of texts, and in which text each stands."""
    lists = pc.split_pattern(texts.combine_chunks(), " ")
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0)), lists.flatten()


def _held(of: np.ndarray, at: np.ndarray, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct items (below width; those below zero do not count) of each row, one row after the other, and where each begins."""
    key = np.unique(of[at >= 0] * width + at[at >= 0])
    return key % width, np.searchsorted(key, np.arange(rows + 1) * width)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of slices, one slice after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def _phrases_in(title: tuple[np.ndarray, np.ndarray], raw: tuple[np.ndarray, np.ndarray], pages: int, width: int) -> np.ndarray:
    """raw * pages + page, in order, of the pages whose title's words (of, word) stand in a raw text's (of, word) one after the other: a word further at a time, where all before were met."""
    (of, word), (own, at) = title, raw
    first = np.searchsorted(of, np.arange(pages))
    size = np.searchsorted(of, np.arange(pages), "right") - first
    page, node = np.arange(pages), word[first]
    place, met = np.flatnonzero(at >= 0), at[at >= 0]
    found, n = [], 1
    while len(page) and len(place):
        whole = page[size[page] == n]
        by = np.argsort(node[size[page] == n], kind="stable")
        begin, end = (np.searchsorted(node[size[page] == n][by], met, side) for side in ("left", "right"))
        fan = end - begin
        found.append(np.unique(np.repeat(own[place], fan) * pages + whole[by][_spread(begin, fan)]))
        on = size[page] > n
        page, key = page[on], node[on] * width + word[first[page[on]] + n]
        known, node = np.unique(key, return_inverse=True)
        further = np.minimum(place + n, len(at) - 1)
        good = (place + n < len(at)) & (own[further] == own[place]) & (at[further] >= 0)
        place, key = place[good], met[good] * width + at[further[good]]
        met = np.searchsorted(known, key)
        good = met < len(known)
        good[good] = known[met[good]] == key[good]
        place, met, n = place[good], met[good], n + 1
    return np.unique(np.concatenate(found)) if found else np.empty(0, "i8")


def _best_titles(raw: pa.Table, pages: pa.Table, k: int, least: float) -> pa.Table:
    """raw_id, page_id, score: the k best pages of a block, by classes (ids, title, rest, t, s), for each raw text of a block (raw_id, words, n).

    A raw text first meets the classes whose rarest title word it has, then those whose second rarest, and so on, until
    no class that it has not met can be as good as its k best: of t title words such a class lacks one for each turn.
    """
    # Classes in order of their first pages.
    pages = pages.take(pc.sort_indices(pc.list_element(pages.column("ids").combine_chunks(), 0))) if pages.num_rows else pages
    rows, many = raw.num_rows, pages.num_rows
    of, words = _words(raw.column("words"))
    number = lambda c: pages.column(c).to_numpy().astype("f8")
    t, s, n = number("t"), number("s"), raw.column("n").to_numpy().astype("f8")
    sides = []
    for column in ("title", "rest"):
        on, coded = _words(pages.column(column))
        coded = coded.dictionary_encode()
        at, word, width = pc.fill_null(pc.index_in(words, value_set=coded.dictionary), -1).to_numpy().astype("i8"), coded.indices.to_numpy().astype("i8"), max(1, len(coded.dictionary))
        # The words of each raw text that some page has; of each page; and the pages of each word.
        sides.append((at, on, word, width, *_held(of, at, rows, width), *_held(on, word, many, width), *_held(word, on, width, max(1, many))))
    at, on, word, width, own, cut, title, first, _, listed = sides[0]
    _, _, _, other_width, other, other_cut, rest, rest_first, rest_post, rest_start = sides[1]
    told = _phrases_in((on, word), (of, at), many, width)
    told_cut = np.searchsorted(told, np.arange(rows + 1) * many)
    # A class's title words in order of rarity, and for each turn the classes of each word.
    page = np.repeat(np.arange(many), np.diff(first))
    title = title[np.lexsort((title, np.diff(listed)[title], page))]
    turn = (np.arange(len(title)) - first[page]) * width + title
    by = np.argsort(turn, kind="stable")
    turn, post = turn[by], page[by]
    turns, most = int(t.max(initial=0)), s.max(initial=0)
    has, has_other, stands = np.zeros(width, bool), np.zeros(other_width, bool), np.zeros(many, bool)

    def common(c: np.ndarray, of: np.ndarray, begin: np.ndarray, has: np.ndarray) -> np.ndarray:
        size = begin[c + 1] - begin[c]
        return np.bincount(np.repeat(np.arange(len(c)), size), has[of[_spread(begin[c], size)]], len(c))

    def in_rest(c: np.ndarray, held: np.ndarray) -> np.ndarray:
        begin, end = rest_start[held], rest_start[held + 1]
        if (end - begin).sum() + many > s[c].sum():
            return common(c, rest, rest_first, has_other)
        return np.bincount(rest_post[_spread(begin, end - begin)], minlength=many)[c]

    found = []
    for i in range(rows):
        held, held_other = own[cut[i] : cut[i + 1]], other[other_cut[i] : other_cut[i + 1]]
        if not len(held):
            continue
        whole = told[told_cut[i] : told_cut[i + 1]] % many
        has[held], has_other[held_other], stands[whole] = True, True, True
        c, score = np.empty(0, "i8"), np.empty(0)
        for lacks in range(turns):
            bound = 0.42 * (turns - lacks) / turns + 0.43 * (len(held_other) > 0) + 0.15 * min(1.0, (turns - lacks + min(len(held_other), most)) / n[i])
            kth = max(least, np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else least
            # What rounding may lift, or make equal to the worst of the best, stays.
            if lacks and bound < kth - 0.002:
                break
            begin, end = (np.searchsorted(turn, lacks * width + held, side) for side in ("left", "right"))
            new = post[_spread(begin, end - begin)]
            for before in range(lacks):
                new = new[~has[title[first[new] + before]]]
            j, x = common(new, title, first, has), in_rest(new, held_other) if len(held_other) else 0.0
            share = x / np.maximum(s[new], 1.0)
            base = 0.42 * j / t[new] + 0.43 * share + 0.15 * (j + x) / (t[new] + s[new] + n[i] - j - x)
            base = np.minimum(base + np.where(stands[new], 0.1, 0.0), 1.0)
            good = base >= kth - 0.002
            c, score = np.concatenate((c, new[good])), np.concatenate((score, base[good]))
        has[held], has_other[held_other], stands[whole] = False, False, False
        if len(score) > k:
            good = score >= np.partition(score, len(score) - k)[len(score) - k] - 0.002
            c, score = c[good], score[good]
        score = _rounded(score, 3)
        c, score = c[score >= least], score[score >= least]
        best = np.lexsort((c, -score))[:k]
        found.append((np.full(len(best), i), c[best], score[best]))
    i, c, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
    ids = pages.column("ids").combine_chunks()
    size = pc.list_value_length(ids).to_numpy().astype("i8")
    begin, ids = (np.cumsum(size) - size)[c], ids.flatten()
    i, score, at = np.repeat(i, size[c]), np.repeat(score, size[c]), _spread(begin, size[c])
    order = np.lexsort((np.argsort(pc.sort_indices(ids).to_numpy())[at], -score, i))
    order = order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]
    return pa.table({"raw_id": raw.column("raw_id").take(pa.array(i[order])), "page_id": ids.take(pa.array(at[order])), "score": pa.array(score[order], pa.float64())})


def title_score(raw: DataFrame, pages: DataFrame, k: int = 3, least: float = 0.0) -> DataFrame:
    """raw_id, page_id, score, rank: of each raw text (raw_id, raw) the k best pages (page_id, title, summary) that share a title token, scores of least at least.

    0.42 of the title covered, 0.43 of the rest of the page covered, 0.15 Jaccard, 0.1 if the title stands in the
    text. Pages of the same title words and rest score alike: they are a class, of which the k first ids can be among
    the best. Each block of raw texts meets each block of classes in a task of its own, which looks classes up by the rarest
    tokens of their titles and keeps k pages for each raw text: pairs of texts and pages never become rows.
    """
    chars = lambda *names: sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in names), F.lit(0))
    blocks = lambda size, *names: F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(chars(*names) / BLOCK_CHARS))
    r = raw.where("raw_id IS NOT NULL").select("raw_id", T.scoring_phrase(F.col("raw")).alias("words"))
    r, of_raw = counted(r.select("raw_id", "words", F.size(F.array_distinct(F.split("words", " "))).alias("n")), "title-raw", blocks(RAW_BLOCK, "words"))
    named = pages.where("page_id IS NOT NULL").select("page_id", T.scoring_phrase(F.col("title")).alias("title"), T.scoring_tokens(F.concat_ws("\n", "title", "summary")).alias("ct")).where("title <> ''")
    p = named.withColumn("tt", F.array_distinct(F.split("title", " "))).withColumn("rest", F.array_except("ct", "tt"))
    p = p.select("page_id", "title", F.array_join("rest", " ").alias("rest"), F.size("tt").alias("t"), F.size("rest").alias("s"))
    same = ["title", "rest", "t", "s"]
    first = p.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("page_id"))).where(F.col("place") <= k)
    classes = first.groupBy(*same).agg(F.array_sort(F.collect_list("page_id")).alias("ids")).withColumn("rest", F.nullif("rest", F.lit("")))
    p, of_pages = counted(classes, "title-pages", blocks(PAGE_BLOCK, "title", "rest"))
    of_raw, of_pages = max(1, of_raw), max(1, of_pages)
    block = lambda of, *c: F.pmod(F.xxhash64(*c), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = r.select("*", block(of_raw, "raw_id").alias("__r"), every(of_pages).alias("__p"))
    right = p.select("*", every(of_raw).alias("__r"), block(of_pages, "title", "rest").alias("__p"))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        return _best_titles(a, b, k, least)

    kinds = f"raw_id {dict(r.dtypes)['raw_id']}, page_id {dict(pages.select('page_id').dtypes)['page_id']}, score double"
    met = left.groupBy("__r", "__p").cogroup(right.groupBy("__r", "__p")).applyInArrow(solve, kinds)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("raw_id").orderBy(F.desc("score"), "page_id")))
    return best.where(F.col("rank") <= k).select("raw_id", "page_id", "score", "rank")


def longest_prefix(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id, prefix_id: the longest prefix (prefix_id, prefix) of each row's path (id, path); null if none or if two tie. Prefixes meet paths by equality with the path's own prefixes at "/"."""
    parts = F.split("path", "/")
    cut = rows.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("prefix"))
    hit = cut.join(prefixes, "prefix").groupBy("id", F.length("prefix").alias("n")).agg(F.count("*").alias("c"), F.min("prefix_id").alias("prefix_id"))
    best = hit.groupBy("id").agg(F.max_by(F.struct("c", "prefix_id"), "n").alias("b"))
    return rows.select("id").join(best, "id", "left").select("id", F.when(F.col("b.c") == 1, F.col("b.prefix_id")).alias("prefix_id"))


def partial_titles(titles: DataFrame, id_col: str) -> DataFrame:
    """id, phrase, confidence: the first two words of titles (id, title) of three and more."""
    words = T.tokens(F.col("title"))
    return titles.where(F.size(words) >= 3).select(id_col, F.array_join(F.slice(words, 1, 2), " ").alias("phrase"), F.lit(0.85).alias("confidence"))


def reference_counts(pages: DataFrame) -> DataFrame:
    """path, refs of pages (path, title, target): one for the page, and the relations that name its path or its title, whichever is more."""
    named = pages.where("target IS NOT NULL").groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n"))
    by_path, by_title = named.select(F.col("name").alias("path"), F.col("n").alias("a")), named.select(F.col("name").alias("title"), F.col("n").alias("b"))
    return pages.select("path", "title").join(by_path, "path", "left").join(by_title, "title", "left").select("path", (1 + F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("refs"))
