"""The pipeline's stages over a small table, and the registered SQL."""

import corpus_pipeline
import pytest
from stationwise.llm import queries
from tests.oracle import DATA, compare, duck

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    ok, message, rows, _ = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name])
    assert ok, message
    assert rows > 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) == docs.count() and (now < ids or i > 2)
        ids = now
        assert i == 4 or docs.columns == columns
    assert len(ids) > 100
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF), name)
    assert empty.count() == 0
