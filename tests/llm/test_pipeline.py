"""The pipeline's stages on a small table, and against what they promise."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    from nearspark.llm import jaccard, language, substrings, toxicity
    from nearspark.session import cut_lineage

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages, seen = dict(corpus_pipeline.STAGES), [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, SF_DIR))
        seen.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == seen[0].columns
    raw, clean, single, cut, mixed, packed = seen
    assert len(stages) == 5
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where(~language.held_out())
    scores = toxicity.score(raw, toxicity.train(raw, labels))
    assert clean.count() == scores.where("score < 0.3").count()
    classes = jaccard.near_duplicate_classes(clean)
    assert single.count() == classes.select("component_id").distinct().count()
    assert jaccard.near_duplicate_classes(single).where("doc_id <> component_id").count() == 0
    assert cut.count() == single.count()
    left = substrings.remove_repeats(single, digest=True).agg({"n_words": "sum", "n_removed": "sum"}).first()
    assert left["sum(n_removed)"] < left["sum(n_words)"]
    assert mixed.select("doc_id").distinct().count() == cut.select("doc_id").distinct().count()
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
