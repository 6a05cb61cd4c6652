"""The stages of the corpus pipeline: what each keeps, takes away and hands on."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline
from gridpulse.llm import decontaminate, jaccard, packing, secrets, toxicity
from gridpulse.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == first.columns and [f.dataType for f in out.schema] == [f.dataType for f in first.schema], name
        kept.append((docs, out))
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(before, labels).collect()}
    assert ids(after) == {d for d, s in scores.items() if s < toxicity.REJECT_FROM} and len(ids(after)) < before.count()
    before, after = kept[1]
    assert ids(after) == {r.doc_id for r in jaccard.link_documents(before).collect() if r.doc_id == r.class_id}
    assert all(r.n_links == 0 for r in jaccard.link_documents(after).collect())
    before, after = kept[2]
    found = decontaminate.digest(decontaminate.find_items(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(after) == {r.doc_id for r in found.collect() if not r.contaminated} and len(ids(after)) < before.count()
    before, after = kept[3]
    assert ids(after) == ids(before)
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert sum(r.n_assign + r.n_access + r.n_hex for r in secrets.scan_secrets(before).collect()) > 0
    assert sum(r.n_access + r.n_hex for r in secrets.scan_secrets(after).collect()) == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, after, SF).collect()
    texts = {r.doc_id: r.text for r in after.collect()}
    assert {r.doc_id for r in packed} == set(texts)
    known = packing.WordIds(tokenizer_path())
    for r in packed[:200]:
        ids_ = np.frombuffer(known.text(texts[r.doc_id]) + packing.END, "<u4")[r.start:r.start + 2048]
        assert r.length == len(ids_) and r.ids_crc32 == zlib.crc32(ids_.tobytes())


def test_pipeline_of_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "a" * 200_000, "en", "s", 1)], schema)
    for start in (odd, odd.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == (start.count() > 0)
