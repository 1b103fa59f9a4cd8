"""Benchmark items of fewer than five words inside longer documents."""

import corpus_pipeline as cp
from lexwright.llm import queries


def test_short_items_inside_documents(spark, tmp_path):
    docs = [(1, "before it one Two\nthree four and after it"), (2, "two three"), (3, "seven words that have none of it"), (4, "one two three"), (5, None), (6, "one two"), (7, "a single end")]
    items = [(10, "one two three four"), (11, "two  THREE"), (12, "end"), (13, None), (14, "one two and three four five six")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in queries.op5_decontaminate(spark, str(tmp_path)).collect())
    assert got == [(d, i, 1, 1, 1.0) for d, i in [(1, 10), (1, 11), (2, 11), (4, 11), (7, 12)]]
    left = cp.benchmark_passages(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6]
