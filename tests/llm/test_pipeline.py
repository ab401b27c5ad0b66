from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from opinara.llm import mixing, quality_rules, secret_scan, simhash
from opinara.llm.common import written


def test_stages_take_effect(spark, sf, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf), name)
        assert after.columns == documents.columns, name
        before, left = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in after.select("doc_id").collect()}
        assert left <= before and left, name
        if name == "quality_rules":
            assert left == {r["doc_id"] for r in quality_rules.quality_report(docs).where("kept").collect()}
        if name == "simhash":
            assert left == {r["component_id"] for r in simhash.classes(docs, shingle=5, similarity=0.8).select("component_id").collect()}
        if name == "secret_scan":
            assert left == before and secret_scan.scan_secrets(after).agg(F.sum(F.expr("n_assign + n_access + n_hex + n_random"))).first()[0] == 0
        if name == "mixing":
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()}
            assert want == {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("NOT lossless").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash", "secret_scan", "mixing", "piece_sampling"]
