"""Nearest neighbours of queries that are unlike the rows, of ties, of copies and of any magnitude."""

import numpy as np
import pytest

from papyrine.llm import ann

ROWS, DIMS, K = 4000, 32, 10


def _units(rng, *size):
    x = rng.standard_normal(size)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _tables():
    rng = np.random.default_rng(11)
    clusters = _units(rng, 30, DIMS)[rng.integers(30, size=ROWS)] + 0.05 * rng.standard_normal((ROWS, DIMS))
    apart, against, copies = clusters.copy(), clusters.copy(), _units(rng, ROWS, DIMS)
    apart[::20] = _units(rng, ROWS // 20, DIMS)
    against[::20] *= -1
    copies[rng.random(ROWS) < 0.8] = copies[0]
    ties = (rng.random((ROWS, DIMS)) < 0.06).astype(float)
    ties[:, 0] += ties.sum(axis=1) == 0
    return {"apart": apart, "against": against, "copies": copies, "ties": ties, "tiny": clusters * 1e-60, "huge": clusters * 1e60}


@pytest.mark.parametrize("name", ["apart", "against", "copies", "ties", "tiny", "huge"])
def test_recall_does_not_depend_on_the_rows(spark, name):
    x = _tables()[name]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(ann.knn(frame, frame.where("vec_id % 20 = 0"), k=K).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q in range(0, ROWS, 20):
        scores = (x * x[q]).sum(axis=1)
        best = np.lexsort((np.arange(ROWS), -scores))
        assert len(got[q]) == len(set(got[q])) == K and q not in got[q]
        hits += len(set(got[q]) & set(best[best != q][:K].tolist()))
    assert hits / (K * ROWS // 20) >= 0.95
