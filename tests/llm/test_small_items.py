"""Benchmark items that sketches or ids would lose."""

import random

from papyrine.llm import decontamination

from .test_corpus import shingles


def test_small_items_inside_long_documents_are_all_found(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(5 + i % 7))) for i in range(210)]
    filler = lambda n: [f"f{rng.randrange(10**9)}" for _ in range(n)]
    docs = [(d, " ".join(w for _, q in items for w in [*filler(30), *q.split()])) for d in range(6)]
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, x.item_id): x.shared for r in found.collect() for x in r.leaks}
    assert rows == {(d, i): len(shingles(q, 5)) for d, _ in docs for i, q in items}


def test_items_without_an_id_are_found(spark):
    passage = " ".join(f"w{j}" for j in range(20))
    items = spark.createDataFrame([(None, passage), (None, None), (1, "five other words stand here")], "item_id long, text string")
    docs = spark.createDataFrame([(0, f"before {passage} after"), (1, "five other words stand here"), (2, "clean")], "doc_id long, text string")
    for block in (50_000, 1):
        found = decontamination.find_leaks(docs, items, block_rows=block)
        assert {r.doc_id: [(x.item_id, x.shared) for x in r.leaks] for r in found.collect()} == {0: [(None, 16)], 1: [(1, 1)], 2: []}
    assert [r.doc_id for r in decontamination.drop_leaking(docs, items).collect()] == [2]
