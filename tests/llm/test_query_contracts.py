"""The ten queries and the pipeline on tables with every odd row, and on empty tables."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyrine.llm import ann, kernels, langid, queries, quality, toxicity
from papyrine.llm.subwords import Bags

from .test_corpus import brute_components, labelled_texts, shingles

COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op8_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_decontamination": "item_id bigint, doc_id bigint",
}
ITEM = "this passage of the benchmark has twelve words of its own here"
LINE = "This very line of more than forty characters is in many documents"


def documents():
    good, junk, toxic = labelled_texts(4, 60)
    rng = random.Random(1)
    rows = [(t, "xx" if i % 2 else "yy") for i, t in enumerate(good + junk + toxic)]
    rows += [(None, None), ("", "xx"), (" \n\t", "xx"), ("12 !!", None), ("word " * 60_000, "yy"), (good[0], "xx"), (good[0], "xx"), (f"{good[1]} {ITEM} {good[2]}", "yy")]
    rows += [(f"{LINE}\nown {rng.random()}\n  {LINE.upper()} ", "xx") for _ in range(7)]
    return [(i, t, lang, "src", len(t or ""), 0.5, "x", 7) for i, (t, lang) in enumerate(rows)] + [(3, "a text under an id that repeats", "xx", None, None, None, None, None), (3, good[3], None, None, 1, 1.0, "y", 7), (None, good[5], "xx", "src", 1, None, None, None)]


SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, start int",
    "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string", "pages": "page_id long, url string, html string, text int",
    "embeddings": "vec_id long, embedding array<float>, label int, score string",
}


def rows_of(name):
    if name == "documents":
        return documents()
    if name == "labels":
        return [(i, int(not 60 <= i < 120), int(120 <= i < 180)) for i in range(180)] + [(None, 1, 0), (5, None, None), (9999, 1, 1), (4, 1, 0)]
    if name == "benchmark":
        return [(1, ITEM), (None, ITEM), (3, None), (4, ""), (5, "not in any document at all I say")]
    if name == "pages":
        return [(i, "http://a.org/x", "<body><nav>n</nav><article><h1>T</h1><p>" + "Some words. " * 20 + "</p></article></body>", 1) for i in range(5)] + [(None, None, None, None), (7, "", "", 1), (8, "http://a.org", "<div>" * 3000 + "deep", 1), (0, "http://a.org/x", "<p>again", 1)]
    rng = np.random.default_rng(0)
    vectors = [rng.standard_normal(8).astype(np.float32).tolist() for _ in range(200)]
    vectors[20:60] = [vectors[20]] * 40
    return [(i, v, 0, "s") for i, v in enumerate(vectors)] + [(300, None, 0, None), (320, [0.0] * 8, 0, None), (340, [math.nan] * 8, 0, None), (None, vectors[0], 0, None), (0, vectors[1], 0, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = {}
    for kind in ("odd", "empty"):
        home = out[kind] = tmp_path_factory.mktemp(kind)
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(rows_of(name) if kind == "odd" else [], schema).repartition(3).write.parquet(f"{home}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: queries.QUERIES[name](spark, str(folder["odd"])).collect() for name in COLUMNS}


def test_names_and_types(spark, folder):
    for name, schema in COLUMNS.items():
        found = dict(queries.QUERIES[name](spark, str(folder["odd"])).dtypes)
        assert {c: found.get(c) for c, _ in (x.split() for x in schema.split(", "))} == dict(x.split() for x in schema.split(", ")), name


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_tables_give_no_rows(spark, folder, name):
    assert queries.QUERIES[name](spark, str(folder["empty"])).count() == 0


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def test_every_document_has_its_rows(results):
    wanted = sorted((d[0] for d in documents()), key=str)
    for name in ("op2_sharding", "op3_quality", "op5_line_dedup", "op6_toxicity", "op7_ngram_jaccard", "op9_language_id"):
        assert ids(results[name]) == wanted, name
    assert sorted({str(r.doc_id) for r in results["op1_packing"]}) == sorted({str(i) for i in wanted})
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in results["op1_packing"])


@pytest.mark.parametrize("name, folds, held", [("op3_quality", 4, 2), ("op6_toxicity", 3, 1), ("op9_language_id", 3, 1)])
def test_folds_and_cut(results, name, folds, held):
    for r in results[name]:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1
        if name != "op9_language_id":
            assert r.predicted == int(r.score >= 0.7)
    if name == "op9_language_id":
        texts = {d[0]: d[1] for d in documents()}
        for r in results[name]:
            if r.doc_id != 3:
                letters = any(map(str.isalpha, texts[r.doc_id] or ""))
                assert (r.lang_pred == "und") == (not letters) and r.lang_pred in ("xx", "yy", "und")


def test_linked_copies_and_leaks(results):
    components = [(d[0], d[1]) for d in documents()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in results["op7_ngram_jaccard"]), key=str) == brute_components(components, 4, 85, 100)
    wanted = sorted(((i, d[0]) for i, q in rows_of("benchmark") for d in documents() if (s := shingles(q, 5)) and 100 * len(s & shingles(d[1], 5)) >= 80 * len(s)), key=str)
    assert sorted(((r.item_id, r.doc_id) for r in results["op10_decontamination"]), key=str) == wanted and len(wanted) == 2


def test_pages_and_vectors(results):
    pages = {r.page_id: r.text for r in results["op4_html_extraction"] if r.page_id != 0}
    assert pages[1].startswith("T\nSome words.") and pages[None] == pages[7] == "" and pages[8] == "deep"
    assert all(r.n_chars == len(r.text) for r in results["op4_html_extraction"]) and len(results["op4_html_extraction"]) == len(rows_of("pages"))
    by_query = {}
    for r in results["op8_nearest_neighbours"]:
        by_query.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by_query) == {i for i in range(200) if i % 20 == 0}
    vectors = {i: np.array(v, np.float64) for i, v, *_ in rows_of("embeddings")[:200]}
    vectors[0] = max(vectors[0], np.array(rows_of("embeddings")[1][1], np.float64), key=lambda v: v.tolist())
    hits = 0
    for q, found in by_query.items():
        best = sorted(((-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q))[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in found})
        assert [r for r, *_ in sorted(found)] == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(by_query)


@pytest.fixture(scope="module")
def sample():
    good, junk, toxic = labelled_texts(6, 60)
    return good, junk, toxic, [*good[:20], *junk[:20], *toxic[:20], "", None, "one", "word " * 3000]


def buffer(texts):
    return kernels.text_buffer(pa.array(texts, pa.string()))


def logistic(x):
    return 1 / (1 + math.exp(-min(40, max(-40, x))))


def test_quality_is_a_sparse_dot_product(sample):
    good, junk, _, texts = sample
    model = quality.train([(t.encode(), y) for p in zip(good, junk, strict=True) for t, y in zip(p, (1, 0), strict=True)])
    for text, got in zip(texts, model.scores(*buffer(texts)), strict=True):
        kinds, first = quality.features(*buffer([text]), model.bits)
        index, count = np.unique(np.concatenate(kinds), return_counts=True)
        margin = float((model.weights[index].astype(float) * count).sum()) * quality._SCALE / max(1, int(first[-1]))
        assert abs(logistic(model.slope * margin + model.intercept) - got) < 1e-6


def test_toxicity_is_the_worst_window(sample):
    good, _, toxic, texts = sample
    model = toxicity.train([(t.encode(), y) for p in zip(good, toxic, strict=True) for t, y in zip(p, (0, 1), strict=True)])
    for text, got in zip(texts, model.scores(*buffer(texts)), strict=True):
        words = [float(model.table[bag].astype(float).mean()) for bag in Bags(*buffer([text]), toxicity.SIZES, model.bits).lists()]
        begins = range(0, max(1, len(words) - model.half), model.half)
        margin = max((float(np.mean(words[b : b + 2 * model.half])) for b in begins if words), default=0.0) + model.bias
        assert abs(logistic(model.slope * margin + model.intercept) - got) < 1e-6


def test_language_is_a_mean_of_embeddings(sample):
    good, _, _, texts = sample
    model = langid.train([(t.encode(), y) for t, y in zip(good, ["xx", "yy"] * 30, strict=True)])
    found = model.probabilities(*buffer(texts))
    for text, got in zip(texts, found, strict=True):
        bags = list(Bags(*buffer([text]), langid.SIZES, model.bits).lists())
        logits = (model.table[np.concatenate(bags)].astype(float).mean(axis=0) if bags else 0) + model.bias
        p = np.exp((logits - logits.max()) / model.temperature)
        assert np.abs(p / p.sum() - got).max() < 1e-6


def test_toxicity_of_long_clean_texts(sample):
    good, _, toxic, _ = sample
    model = toxicity.train([(t.encode(), y) for p in zip(good[:40], toxic[:40], strict=True) for t, y in zip(p, (0, 1), strict=True)])
    long = [" ".join(good[40:]) * n for n in (1, 4, 16)]
    assert (model.scores(*buffer(long)) < 0.7).all()


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    home = str(folder["odd"])
    docs = spark.read.parquet(f"{home}/documents.parquet").withColumn("_quality", F.lit(1)).withColumn("doc", F.lit("d")).withColumn("row", F.lit(2))
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, home)
        assert left.columns == docs.columns, name
    kept = [r.doc_id for r in left.collect()]
    assert all((r.n_chars or 0) == len(r.text or "") for r in corpus_pipeline.line_dedup_stage(spark, docs, home).collect())
    made = corpus_pipeline.run(spark, home)
    assert sorted({str(r.doc_id) for r in made.select("doc_id").collect()}) == sorted({str(i) for i in kept})
    leaking = [d[0] for d in documents() if d[1] and ITEM in d[1]]
    assert not set(leaking) & set(kept)
    assert corpus_pipeline.run(spark, str(folder["empty"])).count() == 0


def test_knn_gives_the_same_rows_each_time(spark, folder):
    vectors = spark.read.parquet(f"{folder['odd']}/embeddings.parquet")
    runs = [sorted(map(tuple, ann.knn(vectors.repartition(n), vectors.where("vec_id % 20 = 0"), k=5).collect())) for n in (1, 4)]
    assert runs[0] == runs[1]
