"""The corpus pipeline: documents in, encoded training text out, one written table per stage.

Stages: language ID (documents in none of the learned languages go, the others carry the predicted one in lang), exact
dedup, SimHash near-dedup (one document of each group stays), mixing sources to target weights (documents repeat or
drop out as the mix says), BPE encoding and decoding (the ids of every document of the mix, their number, and digests
of ids and decoded text). Every stage reads all that the one before it kept.

Null and empty texts go in the first stage, as they have no letter. Of repeated rows one stays (exact dedup); of several
texts under one id, or without an id, each distinct one stays. An empty table gives an empty result. Columns that
documents has besides its own, whatever their names, go along as far as the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomnote.llm import bpe, exact_dedup, golay_simhash, langid, mixing
from loomnote.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_simhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), block_bytes=8 << 20, then=bpe.ENCODED)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Language ID, fingerprints and tokenizers are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
