"""RFC 3986 resolution by its own examples, and TOML assignments in document order."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.functions import columns as C
from papyrine.functions import toml_text

#: The examples of RFC 3986, 5.4, for the base http://a/b/c/d;p?q.
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x", "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_the_examples_of_the_rfc_and_other_schemes(spark):
    rows = [("http://a/b/c/d;p?q", r, w) for r, w in EXAMPLES.items()]
    rows += [("foo://h/a/b", "../c", "foo://h/c"), ("urn:a/b", "c", "urn:a/c"), ("urn:a", "b", "urn:b"), ("http://h", "x", "http://h/x"), ("http://h?q", "#f", "http://h?q#f"), ("http://h/p?", "?", "http://h/p?"), ("rel/base", "x", None), ("rel", "a:b", "a:b"), ("file:///a/b", "../c\nd", "file:///c\nd"), (None, "x", None)]
    frame = spark.createDataFrame(rows, "base string, reference string, wanted string")
    got = frame.select("base", "reference", "wanted", C.uri_resolve("base", "reference").alias("got"))
    assert not [r for r in got.collect() if r.got != r.wanted]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_tables_opened_again_keep_document_order():
    text = "[a] # c\nx = 1\n[b]\ny = '#'\n[a.c]\nz = [1, # in\n 2]\n[[t]]\nk = 1\n[[t.s]]\nq = {}\n[[t]]\nk = '''\n[no]'''\n[e]\n[\"x.y\".'z']\nd.e.f = 1979-05-27\n"
    paths = [e["path"] for e in toml_text.events(text)]
    assert paths == ["a.x", "b.y", "a.c.z.0", "a.c.z.1", "t.0.k", "t.0.s.0.q", "t.1.k", "e", "x.y.z.d.e.f"]
    assert [e["kind"] for e in toml_text.events(text)] == ["integer", "string", "integer", "integer", "integer", "table", "string", "table", "date"]


scalars = st.integers(-9, 9) | st.booleans() | st.text("ab#[]=\n\"'\\ é", max_size=6)
tables = st.dictionaries(st.text("ab.c d#]", min_size=1, max_size=4), st.recursive(scalars | st.lists(scalars, max_size=3), lambda x: st.dictionaries(st.text("xy", min_size=1, max_size=2), x, max_size=3) | st.lists(st.dictionaries(st.text("pq", min_size=1, max_size=2), x, min_size=1, max_size=2), min_size=1, max_size=2), max_leaves=6), max_size=4)


@settings(max_examples=150, deadline=None)
@given(tables)
def test_the_statements_of_a_document_hold_all_of_it(table):
    text = toml_text.write(table)
    leaves = []

    def walk(value, path):
        items = list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else []
        if not items:
            leaves.append(".".join(path))
        for k, v in items:
            walk(v, (*path, k))

    walk(toml_text.parse(text), ())
    if table:
        assert sorted(e["path"] for e in toml_text.events(text)) == sorted(leaves)


@pytest.mark.parametrize("text", ["a = 1\na = 2\n", "[a]\n[a]\n", "a = [1\n", "[[a]]\n[a]\n"])
def test_bad_documents_are_refused(text):
    with pytest.raises(toml_text.TextError):
        toml_text.events(text)
