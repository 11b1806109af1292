"""Periodic runs against brute force over all periods."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.llm import kernels, periodic_runs, queries


def brute(words, min_length=6, min_repeats=4):
    """(start, length, period) of all runs, by start, then period."""
    found, n = {}, len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(min_length, min_repeats * q):
                found.setdefault((start, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def of_docs(docs, min_length, min_repeats):
    raw = [b" ".join(w.encode() for w in d) for d in docs]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = kernels.hash_words(np.frombuffer(b"".join(raw), np.uint8), offsets, lower=False)
    out = [[] for _ in docs]
    for s, e, q in zip(*periodic_runs.runs_of_words(words, min_length, min_repeats), strict=True):
        d = int(np.searchsorted(words.first, s, side="right")) - 1
        out[d].append((int(s - words.first[d]), int(e - s), int(q)))
    return out


words_of = st.lists(st.sampled_from("abc"), max_size=40)
periodic = st.builds(lambda head, unit, times, rest: head + unit * times + rest, words_of, st.lists(st.sampled_from("ab"), min_size=1, max_size=6), st.integers(2, 9), words_of)


@settings(max_examples=150, deadline=None)
@given(st.lists(words_of | periodic, max_size=4), st.sampled_from([(6, 4), (6, 2), (2, 2), (3, 3), (9, 5)]))
def test_runs_equal_brute_force(docs, minima):
    assert of_docs(docs, *minima) == [brute(d, *minima) for d in docs]


@pytest.mark.parametrize("make", [lambda n: ["a"] * n, lambda n: ["ab"[bin(i).count("1") & 1] for i in range(n)], lambda n: [f"w{i % 997}" for i in range(n)]])
def test_repetitive_texts_take_near_linear_space(make):
    for n in (20_000, 40_000):
        words = make(n)
        codes = np.unique(words, return_inverse=True)[1]
        at, period = periodic_runs.branching_repeats(periodic_runs.Factors.of(codes, np.zeros(n, np.int64)))
        assert len(at) <= n * np.log2(n) and len(at) == len(period)


def planted(doc_id, text):
    words = text.encode().split() if text else []
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    row = [doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None]
    row.append(sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest())
    return (*row, sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    texts = [None, "", " \t\n", "x", "a a a a a a", "a a a a a", "A a A a A a A a", "one\x0btwo three\r\n" * 4, "é è " * 7 + "tail", "a\xa0b " * 6, "b a a a a a a b " * 5, "line of text\n" * 900]
    rows = [(i * 37 + j, f"{t} {i}" if t and j % 2 else t) for i in range(12) for j, t in enumerate(texts)]
    rows += [(None, "q r s q r s q r s q r s q r"), (None, None), (-10, "k l m n " * 9), (3, texts[4]), (3, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "0 as runs", "'x' as collapsed").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = repr
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)


def test_whole_table_equals_brute_force(spark):
    """Every document of the smallest table, planted ones included."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 3000}
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and all(got[d] == expected(d, t) for d, t in short.items())


def test_empty_table_and_bad_bounds(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(empty, min_repeats=1)
