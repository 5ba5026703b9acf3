import os

import numpy as np
import pytest

import corpus_pipeline
from statlens.llm import decontaminate, ngram_join, packing, queries

from .data import DOCS, clashing, documents
from .test_mixing import size
from .test_ngram_join import brute

pytestmark = pytest.mark.skipif(not os.path.exists(packing.VOCABULARY), reason="no vocabulary")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_on_its_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = docs.collect(), stage(spark, docs, small)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema).repartition(2)
        after = {r["doc_id"] for r in docs.collect()}
        gone = {r["doc_id"] for r in before} - after
        if name == "language":
            assert len(gone) <= 0.02 * len(before)
        elif name == "near_duplicates":
            kept = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before], 5, 80)}
            assert after == kept
        elif name == "decontamination":
            df = spark.createDataFrame(before, docs.schema)
            assert gone == {r["doc_id"] for r in decontaminate.matches(df, decontaminate.prepared(df, spark.read.parquet(f"{small}/benchmark.parquet"))).collect()}
            assert gone
        else:
            words = sum(size(r["text"]) for r in before)
            assert abs(sum(size(r["text"]) for r in docs.collect()) - words) <= len({r["source"] for r in before})
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {i for r in rows for i in r["doc_ids"]} == {r["doc_id"] for r in docs.collect()}
    assert all(len(np.frombuffer(r["input_ids"], "<u2")) == packing.LENGTH for r in rows)


def test_odd_documents_pass_all_stages(spark, small):
    for df in (clashing(documents(spark)), spark.createDataFrame([], DOCS), documents(spark, [None, ""])):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        docs.collect()


def test_registered(spark, small):
    assert [n for n in queries.QUERIES if n.startswith("op")] == [f"op{k}_" + n.split("_", 1)[1] for k, n in zip(range(1, 11), [n for n in queries.QUERIES if n.startswith("op")])]
    assert queries.pipeline(spark, small).count() > 0
    assert ngram_join.LEAST == 3
