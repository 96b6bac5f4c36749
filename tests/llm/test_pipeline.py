"""The corpus pipeline end to end on the smallest tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DIR)
        last = i == len(pipeline.STAGES) - 1
        assert last or out.columns == columns
        out.write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) == docs.count()
        before = after
    assert {r.doc_id for r in pipeline.run(spark, DIR).collect()} == before
