"""Language identification with bit-sliced Bloom filters of character n-grams.

The most frequent n-grams of every language go into one Bloom filter per language; the filters are stored bit
by bit side by side, so that one look at a slot gives a bit mask of languages, and the AND of an n-gram's slots
is the set of all languages that contain it. A text's score for a language is the share of its n-grams that hit,
corrected for the filter's false positives; the highest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table, tidy

ORDERS = (3, 4)
SLOTS = 1 << 19
HASHES = 2
#: Labelled documents per language that the filters learn from, about: the bound of the training sample.
TRAIN_DOCS = 3000
#: N-grams per language and order.
GRAMS = {3: 2500, 4: 6000}
UNKNOWN = "und"
_STEP = 1 << 18


def letter_table() -> np.ndarray:
    """For code points of the BMP: the point itself if a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(65536)], np.uint32)


def spaced_letters(text: str, overlap: int, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Code points of a text's letters in lower case, words set apart by one space, in parts that overlap; nothing without letters."""
    for i in range(0, max(len(text), 1), _STEP):
        points = np.frombuffer(text[max(0, i - overlap) : i + _STEP].lower().encode("utf-32-le", "replace"), np.uint32)
        high = points >= 65536
        if high.any():
            points = np.where(high & ~np.isin(points, [c for c in np.unique(points[high]).tolist() if chr(c).isalpha()]), 32, points)
        points = np.where(points < 65536, letters[np.minimum(points, 65535)], points)
        space = points == 32
        if space.all():
            continue
        padded = np.full(len(points) + 2, 32, np.uint32)
        padded[1:-1] = points
        yield padded[np.concatenate([[True], ~((padded[1:] == 32) & (padded[:-1] == 32))])].astype(np.uint64)


def gram_hashes(text: str, orders: tuple[int, ...], letters: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the n-grams of a text's letters in lower case, words set apart by one space; nothing without letters."""
    for points in spaced_letters(text, max(orders) - 1, letters):  # parts overlap, so that no n-gram is lost
        for n in orders:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield n, h


def _counts(train: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            held: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, h in gram_hashes(text, orders, letters):
                    held.setdefault((lang, n), []).append(h)
            for (lang, n), parts in held.items():
                grams, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array([n] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(times)], ["lang", "n", "gram", "times"])

    return small_batches(train).mapInArrow(tidy(run), "lang string, n int, gram long, times long")


def slots_of(grams: np.ndarray, slots: int, hashes: int) -> Iterator[np.ndarray]:
    for k in range(hashes):
        yield ((grams >> np.uint64(7)) * np.uint64(2 * k + 0xD6E8FEB86659FD93) >> np.uint64(64 - (slots - 1).bit_length())).astype(np.int64)


class Filters:
    """languages, and the filters: per slot the bit mask of languages, in 64-bit words."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], slots: int = SLOTS, hashes: int = HASHES, default: str | None = None):
        self.languages, self.slots, self.hashes = languages, slots, hashes
        self.default = default or (languages[0] if languages else UNKNOWN)
        self.masks = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        fill = []
        for i, lang in enumerate(languages):
            own = np.zeros(slots, bool)
            for at in slots_of(grams.get(lang, np.zeros(0, np.uint64)), slots, hashes):
                own[at] = True
            self.masks[own, i // 64] |= np.uint64(1 << (i % 64))
            fill.append(own.mean())
        self.false_rate = np.array(fill) ** hashes


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", train_docs: int = TRAIN_DOCS, grams: dict[int, int] = GRAMS) -> Filters:
    """Filters from labelled documents, about train_docs of each language, chosen by a hash of the key.

    Rows with a null language or text teach nothing; repeated rows count as often as they stand there; without
    labelled rows the filters know no language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(key_col).cast("string"), F.lit(8)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filters([], {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, train_docs / n))])
    sample = labelled.where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < share[F.col("lang")]).select("lang", "text")
    total = _counts(sample, tuple(grams)).groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    most = F.create_map(*[F.lit(x) for kv in grams.items() for x in kv])
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram"))
    top = total.withColumn("rank", rank).where(F.col("rank") <= most[F.col("n")]).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return Filters(sorted(sizes), {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in top}, default=max(sorted(sizes), key=sizes.get))


def classify(text: str | None, filters: Filters, orders: tuple[int, ...], letters: np.ndarray) -> tuple[str, float]:
    hits, n = np.zeros(len(filters.languages), np.int64), 0
    for _, grams in gram_hashes(text or "", orders, letters):
        found = None
        for at in slots_of(grams, filters.slots, filters.hashes):
            found = filters.masks[at] if found is None else found & filters.masks[at]
        n += len(grams)
        for i in range(len(hits)):
            hits[i] += np.count_nonzero(found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))
    if not n:
        return UNKNOWN, 0.0
    corrected = (hits / n - filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999999))
    if not len(hits) or corrected.max() <= 0:
        return filters.default, 0.0
    best = int(corrected.argmax())
    return filters.languages[best], float(min(1.0, corrected[best]))


def _predicted(docs: DataFrame, filters: Filters, text_col: str, orders: tuple[int, ...]) -> DataFrame:
    """row, all of docs, and the structure p of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.false_rate, filters.slots, filters.hashes, filters.default))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Filters.__new__(Filters)
        own.languages, own.masks, own.false_rate, own.slots, own.hashes, own.default = shared.value
        letters = letter_table()
        for texts in batches:
            yield pd.DataFrame([classify(t, own, orders, letters) for t in texts], columns=["lang_pred", "score"])

    task = tidy(run)
    task.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return small_batches(docs).select(F.struct("*").alias("row"), F.pandas_udf(task, "lang_pred string, score double")(F.col(text_col).cast("string")).alias("p"))


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """docs with lang_pred and score (0 to 1) from the whole text; `und` with score 0 where text is null or has no letter.

    Ties go to the language that sorts first; a text of which no n-gram is known gets the commonest language of
    the training rows with score 0. Repeated rows each get the same; an empty table stays empty, and without training
    rows every text is `und`. Columns named lang_pred or score are replaced, all others stay.
    """
    return _predicted(docs.drop("lang_pred", "score"), filters, text_col, orders).select("row.*", "p.lang_pred", "p.score")


def held_out(key) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned_from(docs: DataFrame) -> Filters:
    return learn(docs.where(~held_out("doc_id")))


def keep_known(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """docs whose language is one of those learned, with it in lang_col (given or not, right or wrong before); all other columns stay.

    Documents without a letter go, and those of which no n-gram is known in any language. If nothing could be
    learned, no language is known and all go.
    """
    known = _predicted(docs, learned_from(docs), "text", ORDERS).where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") > 0))
    return known.select(*[F.col("p.lang_pred").alias(c) if c == lang_col else F.col(f"row.`{c}`") for c in docs.columns])


def op8_bitsliced_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), learned_from(docs)).drop("text")


QUERIES = {"op8_bitsliced_langid": op8_bitsliced_langid}
ORACLES: dict[str, str] = {}
