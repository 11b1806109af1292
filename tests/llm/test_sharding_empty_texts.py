"""Rows without any bytes are dealt like others."""

from papyrine.llm import sharding


def test_rows_without_bytes_stay(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(9)], "doc_id long, text string").repartition(3)
    rows = sharding.shard_by_bytes(docs, shards=4, overhead=0, order_by=["doc_id"]).collect()
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in rows) == [(i, 0, 0, i) for i in range(9)]
    assert sharding.shard_by_bytes(docs.where("false"), shards=4, overhead=0).count() == 0
