"""The stages on the small tables, each against what it was given."""

import corpus_pipeline
from tidebook.session import cut


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = cut(stage(spark, docs, small), spark)
        assert made.columns == docs.columns, name
        docs = made
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
