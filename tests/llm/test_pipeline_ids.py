"""The near duplicate stage on ids that repeat or are missing."""

import corpus_pipeline


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = lambda t: " ".join(f"{t}{j}" for j in range(40))
    rows = [(1, text("a")), (5, text("b")), (5, text("c")), (5, text("a")), (5, text("b")), (None, text("d")), (None, text("d") + " tail"), (None, text("c")), (None, text("e")), (7, text("e")), (8, ""), (8, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text.split()[0] if r.text else r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(1, "a0"), (5, "b0"), (5, "c0"), (None, "d0"), (7, "e0"), (8, ""), (8, ""), (9, None)], key=str)
