"""Counts of the tokens that one set alone holds, and what the near-duplicate join stores on tables that fill its filters."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from papyrine.llm import jaccard_join, kernels, lone_tokens
from papyrine.runtime import arrow_map


@pytest.mark.parametrize("tokens", [1, 50 << 20])
def test_lone_counts_against_brute_force(spark, tokens):
    rng = np.random.default_rng(4)
    pool = kernels.mix(np.arange(400, dtype=np.uint64))
    sets = [np.unique(rng.choice(pool, int(n))) for n in rng.integers(1, 9, 120)] + [np.zeros(0, np.uint64)]
    held = Counter(t for s in sets for t in s.tolist())
    rows = [(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "key long, tokens array<long>").repartition(3)

    def make():
        sender = lone_tokens.Sender(tokens)

        def step(b: pa.RecordBatch):
            own = [np.array(t, np.int64).view(np.uint64) for t in b.column("tokens").to_pylist()]
            return sender.rows(b.column("key").to_pylist(), [len(t) for t in own], own)

        return step

    found = lone_tokens.lone_counts(arrow_map(df, make, lone_tokens.SENT)).collect()
    assert sorted((r.key, r.n, r.lone) for r in found) == [(i, len(s), sum(held[t] == 1 for t in s.tolist())) for i, s in enumerate(sets)]


def _full_filter_texts():
    """1,200 unrelated texts, 60 near copies and 3 exact copies of 400 others, far apart."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(400)) for _ in range(1200)]
    near = [" ".join([*t.split()[:-5], "a", "b", "c", "d", str(i)]) for i, t in enumerate(texts[:60])]
    return texts + near + texts[800:] * 3


def _stored(monkeypatch) -> list[int]:
    rows = []

    def counted(df, name, stash=jaccard_join.stash):
        made = stash(df, name)
        if "tokens" in made.columns:
            rows.append(made.count())
        return made

    monkeypatch.setattr(jaccard_join, "stash", counted)
    return rows


def _groups(found) -> dict[int, int]:
    return {r.doc_id: r.component_id for r in found.collect()}


def test_a_full_filter_stores_no_set_that_cannot_link(spark, monkeypatch):
    """beyond 64 MB of filter nearly all sets were stored, twice, with their tokens."""
    texts = _full_filter_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    stored = _stored(monkeypatch)
    found = _groups(jaccard_join.link_components(docs, filter_bytes=1))
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    assert found == {i: i - 1200 if 1200 <= i < 1260 else first[t] for i, t in enumerate(texts)}
    assert 0 < max(stored) <= 200


def test_the_pipeline_stores_no_set_that_cannot_link(spark, monkeypatch):
    """the same in the pipeline's third stage."""
    texts = _full_filter_texts()
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    stored = _stored(monkeypatch)
    monkeypatch.setattr(jaccard_join, "link_components", lambda *a, f=jaccard_join.link_components, **b: f(*a, filter_bytes=1, **b))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1200))
    assert 0 < max(stored) <= 200
