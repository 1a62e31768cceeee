"""Hashed text features and linear models on them, for the classifiers of this subpackage.

A text's features are its words (runs of letters, lower-cased) and its runs of other signs, hashed to buckets, and
the number of words in capitals and of words that repeat the one before. Whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, release, small_batches, written
from .langid import letter_table, spaced_letters

BUCKETS = 1 << 22
CAPITALS, REPEATS, FIRST_PART = BUCKETS, BUCKETS + 1, BUCKETS + 2
#: Labelled documents that a classifier is fitted on, at most about: the bound of the training sample.
TRAIN_DOCS = 6000
#: Distinct features of a training document at most: longer texts are predicted like any other, but not learned from, so that the sample's size is bounded.
TRAIN_FEATURES = 20_000
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: Lengths of the runs of characters that count as parts of a word.
PARTS = (4, 5, 6, 7)
#: What a feature needs to be screened in: strength of its tie to a label, and texts that have it.
LEAST_Z, LEAST_TEXTS = 4.5, 5


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def features(text: str | None, known: dict[str, int] | None = None) -> tuple[dict[int, int], int]:
    """Count of each bucket and the number of tokens. known: memo of buckets by token."""
    tokens = TOKEN.findall(text or "")
    known = {} if known is None else known
    out: dict[int, int] = {}
    for token, n in Counter(tokens).items():
        low = token.lower()
        b = known.get(low)
        if b is None:
            if len(known) > 200_000:
                known.clear()
            b = known[low] = bucket(low)
        out[b] = out.get(b, 0) + n
        if len(token) > 1 and low != token and token.isupper():
            out[CAPITALS] = out.get(CAPITALS, 0) + n
    repeats = sum(map(str.__eq__, tokens[1:], tokens))
    if repeats:
        out[REPEATS] = repeats
    return out, len(tokens)


def part_buckets(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the parts of a text's words, from FIRST_PART on, repeats included: runs of PARTS characters of a word in lower case, its ends marked."""
    for points in spaced_letters(text, max(PARTS) - 1, letters):
        spaces = np.concatenate([[0], np.cumsum(points == 32)])
        h = np.zeros(len(points), np.uint64)
        for n in range(1, max(PARTS) + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if n in PARTS:
                whole = spaces[n - 1 : n - 1 + len(h)] == spaces[1 : 1 + len(h)]
                yield FIRST_PART + (h[whole] % np.uint64(BUCKETS)).astype(np.int64)


def part_features(text: str | None, known: dict[str, int], letters: np.ndarray, keep: np.ndarray | None = None) -> tuple[dict[int, int], int]:
    """As features, with the parts of words too. keep: for each bucket whether it matters (None: all do)."""
    out, n = features(text, known)
    if keep is not None:
        out = {b: c for b, c in out.items() if keep[b]}
    for found in part_buckets(text or "", letters):
        each, times = np.unique(found if keep is None else found[keep[found]], return_counts=True)
        for b, c in zip(each.tolist(), times.tolist(), strict=True):
            out[b] = out.get(b, 0) + c
    return out, n


def kept_table(buckets: np.ndarray) -> np.ndarray:
    keep = np.zeros(FIRST_PART + BUCKETS, bool)
    keep[buckets] = keep[CAPITALS] = keep[REPEATS] = True
    return keep


class Sample:
    """A training sample in sparse rows: row and bucket and count of each feature, tokens of each row, labels by name."""

    def __init__(self, row: np.ndarray, col: np.ndarray, count: np.ndarray, tokens: np.ndarray, labels: np.ndarray):
        self.row, self.col, self.count, self.tokens, self.labels = row, col, count, tokens, labels

    def __len__(self) -> int:
        return len(self.tokens)


def gather(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Sample:
    """The features of about train_docs labelled documents, chosen by a hash of the id.

    Rows with a null id or label, and labels of no document, are left out; a document with several labels, or several
    documents of one id, give a row for each; empty tables give an empty sample. Other columns are not read.
    """
    given = labels.select(F.col(id_col).alias("id"), *[F.col(n).cast("int").alias(n) for n in names]).dropna()
    n = given.count()
    chosen = given.where(F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) < int(min(1.0, train_docs / max(1, n)) * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, int] = {}
            each = [features(t, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(f) for f, _ in each], pa.list_(pa.int32())), pa.array([[f[b] for b in sorted(f)] for f, _ in each], pa.list_(pa.int32())), pa.array([n for _, n in each], pa.int64()), batch.column(1)],
                ["bucket", "count", "tokens", "labels"],
            )

    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = texts.join(F.broadcast(chosen), "id").select("text", F.array(*names).alias("labels")).mapInArrow(run, "bucket array<int>, count array<int>, tokens long, labels array<int>")
    return _sample(got.where(F.size("bucket") <= TRAIN_FEATURES).toArrow(), len(names))


def _sample(got: pa.Table, names: int) -> Sample:
    at = got.column("bucket").combine_chunks()
    sizes = np.diff(at.offsets.to_numpy()) if len(at) else np.zeros(0, np.int64)
    order = np.repeat(np.arange(len(at)), sizes)
    y = np.array(got.column("labels").to_pylist(), np.int64).reshape(-1, names)
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy().astype(np.int64)
    return Sample(order, flat("bucket"), flat("count"), got.column("tokens").to_numpy(), y)


def gather_parts(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, words_only: tuple[int, ...] = ()) -> Sample:
    """As gather, with the parts of words (not screened for labels words_only), and each distinct text once (white space and case aside), with its commonest labels.

    Features that ``screen`` would leave out for every label are counted in Spark and never sent to the driver.
    """
    given = labels.select(F.col(id_col).alias("id"), *[F.col(n).cast("int").alias(n) for n in names]).dropna()
    n = given.count()
    chosen = given.where(F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(1 << 30)) < int(min(1.0, train_docs / max(1, n)) * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sha = F.sha2(F.lower(F.regexp_replace("text", SPACE, " ")), 256).alias("sha")
    once = written(small_batches(texts).groupBy(sha).agg(F.min("text").alias("text"), F.array(*[(2 * F.sum(x) >= F.count(x)).cast("int") for x in names]).alias("labels")), "sample-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        letters = letter_table()
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                each = [np.unique(np.concatenate([np.fromiter(features(t, known)[0], np.int64), *part_buckets(t, letters)])) for t in part.column(0).to_pylist()]
                buckets, at = np.unique(np.concatenate(each), return_inverse=True)
                y = np.repeat(np.array(part.column(1).to_pylist(), np.int64).reshape(len(part), -1), [len(x) for x in each], axis=0)
                times = [np.bincount(at, weights=w, minlength=len(buckets)).astype(np.int64) for w in (np.ones(len(at)), *y.T)]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *map(pa.array, times)], ["bucket", *[f"n{i}" for i in range(1 + len(names))]])
        release()

    sums = [f"n{i}" for i in range(1 + len(names))]
    counted = once.select("text", "labels").mapInArrow(count, "bucket int, " + ", ".join(f"{c} long" for c in sums)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums])
    table = counted.where(F.col("n0") >= LEAST_TEXTS).toArrow()
    all_, y = table.column("bucket").to_numpy(), once.select("labels").toArrow().column(0).to_pylist()
    pos = np.array(y, np.int64).reshape(-1, len(names)).sum(axis=0)
    keep = np.zeros(len(all_), bool)
    for i in range(len(names)):
        strong = np.abs(strength(table.column("n0").to_numpy(), table.column(f"n{i + 1}").to_numpy(), len(y), int(pos[i]))) >= LEAST_Z
        keep |= strong & (all_ < FIRST_PART) if i in words_only else strong
    found = all_[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        letters, kept = letter_table(), kept_table(found)
        for batch in batches:
            each = [part_features(t, known, letters, kept) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sorted(f) for f, _ in each], pa.list_(pa.int32())), pa.array([[f[b] for b in sorted(f)] for f, _ in each], pa.list_(pa.int32())), pa.array([n for _, n in each], pa.int64()), batch.column(2)],
                ["sha", "bucket", "count", "tokens", "labels"],
            )

    return _sample(once.select("sha", "text", "labels").mapInArrow(run, "sha string, bucket array<int>, count array<int>, tokens long, labels array<int>").where(F.size("bucket") <= TRAIN_FEATURES).orderBy("sha").toArrow(), len(names))


def strength(with_: np.ndarray, with_pos: np.ndarray, n: int, pos: int) -> np.ndarray:
    """z of the two-sample test of proportions: texts with a feature, those of them with the label; of n texts, pos with the label."""
    pos, p = max(1, pos), with_ / max(1, n)
    neg = max(1, n - pos)
    return (with_pos / pos - (with_ - with_pos) / neg) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / neg))


def screen(sample: Sample, y: np.ndarray, least_z: float = LEAST_Z, most: int | None = 1024, parts: bool = True) -> np.ndarray:
    """Buckets whose presence goes with y (two-sample test of proportions): at most ``most`` (None: all), ascending. parts: those of parts of words too."""
    cols, inverse = np.unique(sample.col, return_inverse=True)
    with_ = np.bincount(inverse, minlength=len(cols))
    with_pos = np.bincount(inverse, weights=y[sample.row].astype(float), minlength=len(cols))
    z = strength(with_, with_pos, len(sample), int(y.sum()))
    keep = (np.abs(z) >= least_z) & (with_ >= LEAST_TEXTS) & (parts | (cols < FIRST_PART))
    found = cols[keep][np.argsort(-np.abs(z[keep]), kind="stable")][:most]
    return np.unique(np.concatenate([found, [CAPITALS, REPEATS]]))


def value(count: np.ndarray) -> np.ndarray:
    return np.log1p(count)


def entries(sample: Sample, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the features chosen: the logarithm of the count."""
    at = np.searchsorted(chosen, sample.col)
    ok = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == sample.col)
    return sample.row[ok], at[ok], value(sample.count[ok])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient descent on the ridge-penalised log loss."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    rate = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + ridge) if len(x) else 1.0
    w = look = np.zeros(x.shape[1])
    keep = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for t in range(steps):
        new = look - rate * (x.T @ (sigmoid(x @ look) - y) + keep * look)
        look, w = new + t / (t + 3) * (new - w), new
    return w


def fit_logistic_sparse(x: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, y: np.ndarray, use: np.ndarray, ridge: float = 1.0, steps: int = 400) -> np.ndarray:
    """As fit_logistic, on entries (row, column, value >= 0) of a matrix of so many columns, over the rows in use: time and memory go with the entries."""
    n = len(y)
    row, col, val = np.concatenate([x[0], np.arange(n)]), np.concatenate([x[1], np.full(n, width)]), np.concatenate([x[2], np.ones(n)])
    row, col, val = row[use[row]], col[use[row]], val[use[row]]
    times = lambda w: np.bincount(row, weights=val * w[col], minlength=n)
    back = lambda r: np.bincount(col, weights=val * r[row], minlength=width + 1)
    # Largest singular value by power iteration: quick, as no entry is negative; a tenth more for what is missing.
    v, top = np.ones(width + 1), 0.0
    for _ in range(30):
        v = back(times(v))
        top = np.linalg.norm(v)
        v = v / top if top else v
    rate = 1 / (0.25 * 1.1 * top + ridge)
    w = look = np.zeros(width + 1)
    keep = np.append(np.full(width, ridge), 1e-3)
    for t in range(steps):
        new = look - rate * (back(np.where(use, sigmoid(times(look)) - y, 0.0)) + keep * look)
        look, w = new + t / (t + 3) * (new - w), new
    return w
