"""The pipeline stage by stage: each stage's decisions hold on its own input, and whole rows come out."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from trackloom.llm import exact_dedup
from tests.llm.test_operators import links_of, normal


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.toPandas()
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "language_id":
            assert after.text.str.contains("[^\\W\\d_]").all()
            assert len(after) > 0.8 * before.text.fillna("").str.contains("[^\\W\\d_]").sum()
        if name == "exact_dedup":
            assert Counter(map(normal, after.text)) == Counter(dict.fromkeys(map(normal, before.text), 1))
        if name == "ngram_jaccard_join":
            rows = [(r.doc_id, r.text) for r in before.itertuples()]
            assert sorted(after.doc_id) == sorted({c for _, c, _ in links_of(rows)})
        if name == "mixing":
            assert set(after.doc_id) <= set(before.doc_id)
            assert max(Counter(after.doc_id).values()) <= 2
        if name == "best_fit_packing":
            assert Counter(after[after.piece == 0].doc_id) == Counter(before.doc_id)
            assert after.groupby("sequence_id").length.sum().max() <= 1024
    assert exact_dedup.SPACE
