"""Blocks of benchmark items, and blocks of vectors: bounded, and copied only where they are asked for."""

import numpy as np

from papyrine.llm import ann, decontamination


def test_repeated_items_are_dealt_to_all_blocks(spark):
    items = spark.createDataFrame([(7, "the same item of the benchmark over and over")] * 1000, "item_id long, text string").repartition(3)
    blocks = [block() for block in decontamination.item_blocks(items, "item_id", "text", 100, 1 << 20)]
    assert len(blocks) == 10 and sum(len(ids) for ids, _ in blocks) == 1000 and max(len(ids) for ids, _ in blocks) <= 103
    docs = spark.createDataFrame([(1, "x the same item of the benchmark over and over y"), (2, "clean text of another kind altogether here")], "doc_id long, text string")
    found = decontamination.find_leaks(docs, items, block_rows=400, keep_clean=False).collect()
    assert [r.doc_id for r in found] == [1] and len(found[0].leaks) == 1000


def _search(spark, x, every, **options):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.knn(frame, frame.where(f"vec_id % {every} = 0"), k=10, **options).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


def test_small_chunks_give_the_same_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    whole, chunked = _search(spark, x, 20), _search(spark, x, 20, chunk_rows=16)
    assert whole == chunked and len(whole) == 200
    scores = x @ x[::20].T
    recall = np.mean([len(got & set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, scores[:, q // 20]))[:10].tolist())) / 10 for q, got in whole.items()])
    assert recall >= 0.95
