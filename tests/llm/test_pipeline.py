"""The pipeline against a plain version of itself, stage by stage."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomnote.llm import bpe, langid, mixing
from tests.conftest import SF

from .test_ops import DOCS, ODD, brute_components, plain_print


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"]: r for r in langid.predict(docs, langid.learned_from(docs)).collect()}
    kept = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "") and known[r["doc_id"]]["score"] > 0]
    assert len(kept) > 0.98 * sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    named = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert named == {r["doc_id"]: known[r["doc_id"]]["lang_pred"] for r in kept}
    first: dict = {}
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        first.setdefault(" ".join(("x" + r["text"] + "x").split()), r)
    groups = brute_components({r["doc_id"]: plain_print(r["text"]) for r in first.values()})
    single = [r for r in first.values() if groups[r["doc_id"]] == r["doc_id"]]
    # The mix itself is checked with its operator; here its copies must take effect.
    plan = mixing.mix(spark.createDataFrame(single, docs.schema)).collect()
    copies = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in plan if r["size"]}
    model = bpe._plain(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    want = []
    for r in single:
        ids = model.encode(r["text"], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want += [(r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)), tuple(ids))] * copies.get(r["doc_id"], 0)
    assert sorted((*r[:4], tuple(r[4])) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and langid.UNKNOWN == "und"


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, kind):
    clash = {"__id": F.lit(1), "__sha": F.lit("x"), "__n": F.lit(2), "__p": F.lit(3), "__copy": F.lit(4), "size": F.lit("s"), "id": F.lit(7)}
    odd = spark.createDataFrame(ODD if kind == "odd" else [], DOCS).withColumns(clash)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    # Of the texts with letters of a known language, each distinct one; how often they are in the mix is the mix's matter.
    assert {r["doc_id"] for r in found.collect()} <= {1, 6, 7} and (kind == "empty") == (found.count() == 0)
