"""The stages of the pipeline on odd rows and on a table without rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    """Labels beside the odd rows, repeated and missing ones included."""
    at = str(tmp_path_factory.mktemp("odd"))
    labels = spark.createDataFrame([(1, 0), (1, 1), (5, 0), (6, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    odd.write.parquet(f"{at}/documents.parquet")
    odd.where("false").write.mode("overwrite").parquet(f"{at}/none/documents.parquet")
    labels.write.parquet(f"{at}/none/labels.parquet")
    return at


def test_stages_on_odd_rows(spark, odd, folder):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == odd.columns, name
        assert out.count() <= docs.count()
        docs = spark.createDataFrame(out.collect(), odd.schema)
    assert docs.where("doc_id = 12").count() == 1
    assert {r.doc_id for r in docs.where("trim(text) = ''").collect()} >= {3}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    total = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(total) == {r.doc_id for r in docs.collect()} and all(n >= 1 for n in total.values())


def test_whole_run_on_odd_and_on_no_rows(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
