from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from echofield.llm import mixing, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, SF)
        assert after.columns == docs.columns
        ids = {x.doc_id for x in seen.select("doc_id").collect()}
        assert {x.doc_id for x in after.select("doc_id").collect()} <= ids
        seen = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x.doc_id for x in got} == {x.doc_id for x in seen.select("doc_id").collect()}
    ran = corpus_pipeline.run(spark, SF)
    assert ran.groupBy("doc_id").agg(F.sum("length").alias("n")).exceptAll(spark.createDataFrame(got)).count() == 0


def test_quality_stage_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {x.doc_id for x in quality.accepted(docs, labels).select("doc_id").collect()}
    good = {x.doc_id for x in labels.where("quality = 1").select("doc_id").collect()}
    assert len(good & kept) >= 0.95 * len(good)
    assert mixing.mix(docs).count() == packing.pieces(docs).select("doc_id").distinct().count()


def saved(df, folder, name):
    df.write.parquet(str(folder / f"{name}.parquet"))


def test_run_on_odd_rows(spark, odd, odd_rows, tmp_path):
    """Nulls, ties, repeats, a long text and clashing columns go through every stage."""
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 15, 2)] + [(None, 1, 0), (99, None, 0)], "doc_id long, quality int, toxic int")
    saved(odd, tmp_path, "documents")
    saved(labels, tmp_path, "labels")
    seen, sf_dir = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == odd.columns
        ids = {x.doc_id for x in seen.select("doc_id").collect()}
        assert {x.doc_id for x in after.select("doc_id").collect()} <= ids
        seen = spark.createDataFrame(after.collect(), odd.schema)
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {x.doc_id for x in pieces.select("doc_id").collect()} == {x.doc_id for x in seen.select("doc_id").collect()}


def test_run_on_empty_tables(spark, none, tmp_path):
    saved(none, tmp_path, "documents")
    saved(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
