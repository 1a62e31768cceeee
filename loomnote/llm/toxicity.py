"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on hashed text features; each model also gets the
probabilities of the categories before it. In training those come out of fold (from models that have not seen the
document), so that later models learn from probabilities as good as they will meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table
from .langid import letter_table
from .textfeatures import Sample, entries, fit_logistic_sparse, gather_parts, kept_table, part_features, screen, sigmoid, value

FOLDS = 5
#: Position of low quality in the chain: shown by words and signs, while insults in inflecting languages show by parts of words.
QUALITY = (0,)


def fit_chain(sample: Sample, folds: int = FOLDS, words_only: tuple[int, ...] = ()) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each category in order: buckets, and weights of them, of the earlier probabilities and of one; and the sample's out-of-fold probabilities.

    Every feature that is significant by itself counts, however weak beside the strongest: a language with few
    toxic documents has its own signs. Categories words_only go without the parts of words.
    """
    fold = np.arange(len(sample)) % folds
    earlier, chain = np.zeros((len(sample), 0)), []
    for j, y in enumerate(sample.labels.T):
        chosen = screen(sample, y, most=None, parts=j not in words_only)
        row, col, val = entries(sample, chosen)
        n, k = earlier.shape
        width = len(chosen) + k
        x = np.concatenate([row, np.repeat(np.arange(n), k)]), np.concatenate([col, np.tile(np.arange(len(chosen), width), n)]), np.concatenate([val, earlier.ravel()])
        chain.append((chosen, fit_logistic_sparse(x, width, y, np.ones(n, bool))))
        out = np.zeros(n)
        for f in range(folds):
            if (fold == f).any():
                w = fit_logistic_sparse(x, width, y, fold != f)
                out[fold == f] = sigmoid(np.bincount(x[0], weights=x[2] * w[x[1]], minlength=n) + w[-1])[fold == f]
        earlier = np.concatenate([earlier, out[:, None]], 1)
    return chain, earlier


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a document counts as one of a category: where out-of-fold probabilities catch most of the positive rows and leave most of the others alone (the sum of both shares); 0.5 without rows of both kinds."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    gain = np.cumsum(y[order] / y.sum() - (1 - y[order]) / (len(y) - y.sum()))
    gain[:-1][np.diff(p[order]) == 0] = -np.inf  # no cut between equal probabilities
    i = int(gain.argmax())
    below = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + below) / 2)


def predict(docs: DataFrame, chain: list[tuple[np.ndarray, np.ndarray]], text_col: str = "text") -> DataFrame:
    """docs with p (array<double>): the probability of each category, in the chain's order, from the whole text.

    Null and empty texts have no feature: they get what the intercepts say. Repeated rows each get the same; an empty
    table stays empty; a column named p is replaced, all others stay.
    """
    links = [(dict(zip(c.tolist(), w[: len(c)].tolist(), strict=True)), w[len(c) :]) for c, w in chain]
    shared = docs.sparkSession.sparkContext.broadcast(links)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        links, letters = shared.value, letter_table()
        keep = kept_table(np.array([b for weight, _ in links for b in weight], np.int64))
        for texts in batches:
            out = np.zeros((len(texts), len(links)))
            for i, text in enumerate(texts):
                found, _ = part_features(text, known, letters, keep)
                for j, (weight, rest) in enumerate(links):
                    own = [(weight[b], c) for b, c in found.items() if b in weight]
                    w, c = np.array(own or [(0.0, 0)]).T
                    out[i, j] = sigmoid(w @ value(c) + out[i, :j] @ rest[:-1] + rest[-1])
            yield pd.Series(list(out))
        release()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return small_batches(docs).withColumn("p", F.pandas_udf(run, "array<double>")(F.col(text_col).cast("string")))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels name two categories: low quality comes first in the chain, toxic last."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    sample = gather_parts(docs, rated, ["low_quality", "toxic"], words_only=QUALITY)
    chain, own = fit_chain(sample, words_only=QUALITY)
    least = threshold(own[:, 1], sample.labels[:, 1])
    return predict(docs.select("doc_id", "text"), chain).select("doc_id", F.col("p")[0].alias("p_low_quality"), F.col("p")[1].alias("p_toxic"), (F.col("p")[1] >= least).alias("toxic"))


QUERIES = {"op6_toxicity_chain": op6_toxicity_chain}
ORACLES: dict[str, str] = {}
