"""Readers of whole files, and the cascade's rule index against single plans."""

from papyrine.operators import cascade, selectors
from papyrine.sources import text_sources


def test_documents_and_markup_files(spark, tmp_path):
    for name, text in {"a.yaml": "x: 1\n---\n- y\n", "b.yaml": "x: [1"}.items():
        (tmp_path / name).write_text(text)
    rows = text_sources.read_documents(spark, str(tmp_path / "*.yaml"), "yaml").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.doc_idx, r.value, r.error is None) for r in rows if r.doc_idx is not None) == [("a.yaml", 0, '{"x":1}', True), ("a.yaml", 1, '["y"]', True)]
    assert [r.error.code is not None for r in rows if r.doc_idx is None] == [True]
    (tmp_path / "c.json").write_text('{"k": [1]}')
    (tmp_path / "d.toml").write_text("k = 1\n")
    assert [r.value for r in text_sources.read_documents(spark, str(tmp_path / "c.json"), "json").collect()] == ['{"k":[1]}']
    assert [r.value for r in text_sources.read_documents(spark, str(tmp_path / "d.toml"), "toml").collect()] == ['{"k":1}']
    (tmp_path / "e.xml").write_text("<a><b/></a>")
    (tmp_path / "f.xml").write_text("<a><b></a>")
    nodes = text_sources.read_markup(spark, str(tmp_path / "*.xml"), xml=True).collect()
    assert sorted(n.name for n in nodes if n.kind == "element") == ["a", "b"] and [n.kind for n in nodes if "f.xml" in n.file] == ["error"]


def test_rule_index_agrees_with_single_plans(spark):
    pages = [(1, "<div class='a b' id=x><p class=b>1<p>2</div><p class='a  b\tc'>3"), (2, "<p>none"), (3, "")]
    nodes = selectors.node_table(spark.createDataFrame(pages, "k long, t string"), ["k"], "t")
    rules = ["p", "*", ".a", ".a.b", "p.b.a", "#x", "div#x.a", "#y", ".c"]
    assert cascade.simple_keys("p > a") is cascade.simple_keys("p:first-child") is cascade.simple_keys("[x]") is None
    hits = cascade.indexed_hits(nodes, ["k"], {s: cascade.simple_keys(s) for s in rules}).collect()
    got = sorted((r.selector, r.k, r.pre) for r in hits)
    assert got == sorted((s, r.k, r.pre) for s in rules for r in selectors.select_all(nodes, ["k"], s).collect())
