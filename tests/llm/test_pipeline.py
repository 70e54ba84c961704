"""The pipeline's stages on planted cases, each against what its input says."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import SCHEMA, edited, prose


@pytest.fixture
def corpus(spark, tmp_path):
    passage = prose(4242, 25)
    rows = [(k, prose(k, 90)) for k in range(80)] + [(300 + k, " | ".join(prose(k, 60).upper().split())) for k in range(80)]
    rows += [(500, rows[0][1]), (501, edited(rows[1][1], 1, 2)), (502, f"{prose(70, 60)}\n{passage}\n{prose(71, 60)}"), (503, f"{prose(72, 80)} me@x.org {prose(73, 20)}")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).withColumn("extra", F.col("doc_id")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 300), 0) for i, _ in rows[:160]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    schema, seen = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        seen[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name != "packing":
            assert out.schema == schema
            docs = out
    clean = set(range(80))
    assert clean | {500, 501, 502, 503} == seen["quality"]
    assert seen["near_duplicates"] == clean | {502, 503}
    assert seen["decontamination"] == clean | {503} == seen["privacy"] == seen["packing"]
    text = docs.where("doc_id = 503").first()["text"]
    assert "[EMAIL]" in text and "me@x.org" not in text
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, corpus).collect()} == seen["packing"]


def test_an_empty_table_runs(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0
