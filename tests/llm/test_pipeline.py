"""The pipeline's stages, each on its own input, against brute force."""

import random

import corpus_pipeline
import pytest

from .test_corpus import brute_components, labelled_texts, shingles


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    good, junk, _ = labelled_texts(12, 200)
    item = " ".join(f"bench{i}" for i in range(20))
    boiler = "This line of boilerplate stands in a good many of the documents."
    texts = good[:120] + junk[:60]
    texts[3] += " " + item
    for i in range(10, 20):
        texts[i] += "\n" + boiler
    texts += [texts[40], texts[41] + " tail", texts[40].upper()]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(i < 120 or i >= 180), 0) for i in range(len(texts)) if rng.random() < 0.9]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), docs, item, boiler


def test_stages(spark, tables, tmp_path):
    where, docs, item, boiler = tables
    kept = spark.read.parquet(f"{where}/documents.parquet")
    columns, outs = kept.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, where).write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        outs.append(kept)
        assert i == 4 or kept.columns == columns
    rows = [{r.doc_id: r for r in out.collect()} for out in outs[:4]]
    assert {i for i in range(120)} <= set(rows[0]) and not any(120 <= i < 180 for i in rows[0])
    assert all((boiler in rows[1][i].text) == (i == 19) and rows[1][i].n_chars == len(rows[1][i].text) for i in range(10, 20))
    components = brute_components([(i, r.text) for i, r in rows[1].items()], 5, 80, 100)
    assert set(rows[2]) == {i for i, _, c in components if i == c} and 180 not in rows[2]
    own = shingles(item, 5)
    assert set(rows[3]) == {i for i, r in rows[2].items() if len(own & shingles(r.text, 5)) < 0.8 * len(own)} == set(rows[2]) - {3}
    pieces = outs[4].collect()
    assert {p.doc_id for p in pieces} == set(rows[3]) and all(len(p.ids) == p.length for p in pieces)
