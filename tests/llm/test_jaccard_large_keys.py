"""Keys with more different components than a step compares."""

import random

import pytest

from papyrine.llm import jaccard_join

from .test_corpus import brute_components


@pytest.mark.parametrize("bound", [4])
def test_near_copies_at_the_threshold(spark, bound):
    rng = random.Random(bound)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 4)):
            copy[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(rng.sample(base, 30))) for i in range(10)] + [(200 + i, " ".join(base[: 3 + i])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.link_components(docs, k=2, frequent=3, bound=bound)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == brute_components(rows, 2, 85, 100)
