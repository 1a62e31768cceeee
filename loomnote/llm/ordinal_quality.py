"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(score - threshold_j), with one score, a weighted sum of hashed text features, shared by
all grades, and ordered thresholds. The expected grade is the sum of these tail probabilities; a document is
selected by one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table
from .textfeatures import BUCKETS, Sample, features, gather, sigmoid

#: Buckets of the hashed words; two more hold words in capitals and repeated words.
WIDTH = 1 << 18


def cells(bucket: np.ndarray) -> np.ndarray:
    """Places of features' buckets in the array of weights."""
    return np.where(bucket < BUCKETS, bucket % WIDTH, WIDTH + bucket - BUCKETS)


def values(bucket: np.ndarray, count: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Logarithm of a feature's count over the root of the text's number of features (kinds); for capitals and repeats, which say something as shares, the root of the share of tokens."""
    return np.where(bucket < BUCKETS, 4 * np.log1p(count) / np.sqrt(1 + kinds), 3 * np.sqrt(count / np.maximum(tokens, 1)))


def fit(sample: Sample, grades: np.ndarray, ridge: float = 1.0, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features' weights, shared by all grades, and the thresholds of grades 1, 2, ... (ascending).

    Without rows the weights are zero and the thresholds those of nothing seen.
    """
    n, top = len(sample), max(1, int(grades.max()) if len(grades) else 1)
    row, col = sample.row, cells(sample.col)
    val = values(sample.col, sample.count, sample.tokens[row], np.bincount(row, minlength=n)[row])
    times = lambda w: np.bincount(row, weights=val * w[col], minlength=n)
    back = lambda r: np.bincount(col, weights=val * r[row], minlength=WIDTH + 2)
    w, gaps = np.zeros(WIDTH + 2), np.zeros(top)  # thresholds: gaps[0], + exp(gaps[1]), ...
    if not n:
        return w, np.cumsum(np.append(gaps[:1], np.exp(gaps[1:])))
    v, size = np.ones(WIDTH + 2), 0.0
    for _ in range(20):
        v = back(times(v))
        size = np.linalg.norm(v)
        v = v / size if size else v
    rates = 1 / (0.25 * top * size + ridge), 2 / (top * n)
    moment = [np.zeros_like(w), np.zeros_like(gaps)]
    at = np.arange(n)
    for _ in range(steps):
        steps_of = np.append(gaps[:1], np.exp(gaps[1:]))
        tail = sigmoid(times(w)[:, None] - np.cumsum(steps_of)[None])
        # Log loss of the grade's own probability, tail_g - tail_{g+1}.
        upper = np.concatenate([np.ones((n, 1)), tail], 1)[at, grades]
        lower = np.concatenate([tail, np.zeros((n, 1))], 1)[at, grades]
        own = np.maximum(upper - lower, 1e-9)
        d_up, d_low = upper * (1 - upper) / own, lower * (1 - lower) / own
        g_cut = np.array([d_up[grades == j].sum() - d_low[grades == j - 1].sum() for j in range(1, top + 1)])
        g_gaps = np.cumsum(g_cut[::-1])[::-1] * np.append([1.0], steps_of[1:])
        for m, g, rate in zip(moment, (ridge * w - back(d_up - d_low), g_gaps), rates, strict=True):
            m *= 0.9
            m -= rate * g
        w, gaps = w + moment[0], gaps + moment[1]
    return w, np.cumsum(np.append(gaps[:1], np.exp(gaps[1:])))


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_col: str = "text", select_grade: int = 1, least: float = 0.5) -> DataFrame:
    """docs with expected_grade, tail (P(grade >= j) for j = 1, 2, ...) and selected (tail[select_grade] >= least).

    Null and empty texts have no feature and get the score of none. Repeated rows each get the same; an empty table
    stays empty. Columns of these names are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight, cut = shared.value
        known: dict[str, int] = {}
        for texts in batches:
            scores = np.zeros(len(texts))
            for i, text in enumerate(texts):
                found, n = features(text, known)
                bucket, count = np.fromiter(found, np.int64), np.fromiter(found.values(), np.int64)
                scores[i] = weight[cells(bucket)] @ values(bucket, count, np.array(n), np.array(len(found)))
            tail = sigmoid(scores[:, None] - cut[None])
            yield pd.DataFrame({"expected_grade": tail.sum(1), "tail": list(tail)})
        release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    scored = F.pandas_udf(run, "expected_grade double, tail array<double>")
    docs = small_batches(docs).drop("expected_grade", "tail", "selected")
    graded = docs.select(F.struct("*").alias("row"), scored(F.col(text_col).cast("string")).alias("g"))
    return graded.select("row.*", "g.expected_grade", "g.tail", (F.col("g.tail")[select_grade - 1] >= least).alias("selected"))


def rated(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 for low quality, 1 for good but toxic, 2 for good and clean; null where the labels don't say."""
    return labels.select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN quality = 1 AND toxic = 1 THEN 1 WHEN quality = 1 AND toxic = 0 THEN 2 END").alias("grade"))


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = gather(docs, rated(table(spark, sf_dir, "labels")), ["grade"])
    scored = grade(docs.select("doc_id", "text"), fit(sample, sample.labels[:, 0]))
    return scored.select("doc_id", "expected_grade", F.col("tail")[0].alias("p_good"), F.col("tail")[1].alias("p_good_and_clean"), F.col("selected").alias("keep"))


QUERIES = {"op1_ordinal_quality": op1_ordinal_quality}
ORACLES: dict[str, str] = {}
