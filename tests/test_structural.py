"""Structural joins and the rule index against plain loops over the nodes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from papyrine.functions.errors import TextError
from papyrine.operators import cascade, rule_index, selectors, structural


def page(rng, size):
    """A page of nested elements with few names, classes and ids."""
    out, depth = [], 0
    for _ in range(size):
        if depth and rng.random() < 0.45:
            out.append("</div>" if rng.random() < 0.8 else "</p>")
            depth -= 1
        name = rng.choice(["div", "div", "section", "b"])
        attrs = rng.choice(["", " class='a'", " class='a b'", " class=c", " id=i", " lang=en", " data-x='p q'", " lang=fr-CA"])
        out.append(f"<{name}{attrs}>t{rng.randrange(9)}")
        depth += 1
    return "".join(out)


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(4)
    pages = [(i, page(rng, 60)) for i in range(12)] + [(None, page(rng, 40)), (99, "")]
    found = selectors.node_table(spark.createDataFrame(pages, "k int, t string"), ["k"], "t").cache()
    return found, [r.asDict() for r in found.collect()]


def keyed(df, *more):
    return sorted(((r["k"], r["pre"], *(r[c] for c in more)) for r in df.collect()), key=repr)


def is_in(a, d):
    return a["k"] == d["k"] and a["pre"] < d["pre"] < a["post"]


def test_ancestors_descendants_and_nearest(nodes):
    frame, rows = nodes
    of_a, of_b = "kind = 'element' and attrs['class'] is not null", "kind = 'element' and name = 'div'"
    a, b = frame.where(of_a), frame.where(of_b)
    plain_a = [r for r in rows if r["kind"] == "element" and "class" in r["attrs"]]
    plain_b = [r for r in rows if r["kind"] == "element" and r["name"] == "div"]
    assert keyed(structural.with_ancestor(b, a, ["k"])) == sorted([(r["k"], r["pre"]) for r in plain_b if any(is_in(x, r) for x in plain_a)], key=repr)
    assert keyed(structural.with_descendant(b, a, ["k"])) == sorted([(r["k"], r["pre"]) for r in plain_b if any(is_in(r, x) for x in plain_a)], key=repr)
    for or_self in (False, True):
        got = structural.nearest_ancestor(b.select("k", "pre"), a.select("k", "pre", "post", F.concat_ws(".", "name", F.col("pre")).alias("v")), ["k"], "v", or_self)
        want = []
        for r in plain_b:
            over = [x for x in plain_a if is_in(x, r) or or_self and (x["k"], x["pre"]) == (r["k"], r["pre"])]
            near = max(over, key=lambda x: x["pre"], default=None)
            want.append((r["k"], r["pre"], near and f"{near['name']}.{near['pre']}"))
        assert keyed(got, "v") == sorted(want, key=repr)
    text = structural.text_within(b.select("k", "pre", "post"), frame.where("kind = 'text'").select("k", "pre", "text"), ["k"])
    assert keyed(text, "text") == sorted([(r["k"], r["pre"], "".join(x["text"] for x in rows if x["kind"] == "text" and is_in(r, x))) for r in plain_b], key=repr)


RULES = [
    ".a", "div", "#i", "*", ".a.b", "div > .a", "div .a", "section div > b", ".c + div", ".c ~ div", "div > div > div", ".a .b .c", "[data-x~=q]", "[lang|=fr] b", "[LANG=EN i] div", "div:first-child", "div:last-child > b",
    "b:nth-child(2n+1)", "div:nth-last-child(-n+2) section", "html > body > *", ":root b", "div:only-child", "div:not(.a) > b", "b:is(.a, .c)", "div:has(b)", "div:has(> b)", ".a:first-of-type", "b:lang(fr)", "div:empty",
]


def test_rule_index_equals_single_selectors(nodes):
    frame, _ = nodes
    got = {}
    for r in rule_index.hits(frame, ["k"], RULES).collect():
        got.setdefault(r.selector, []).append((r.k, r.pre))
    for rule in RULES:
        assert sorted(got.get(rule, []), key=repr) == keyed(selectors.select_all(frame, ["k"], rule)), rule
    assert set(rule_index.compile_rules(RULES).others) == {"div:not(.a) > b", "b:is(.a, .c)", "div:has(b)", "div:has(> b)", ".a:first-of-type", "b:lang(fr)", "div:empty"}


def test_selectors_equal_plain_loops(nodes):
    frame, rows = nodes
    elements = [r for r in rows if r["kind"] == "element"]
    cls = lambda r, c: c in r["attrs"].get("class", "").split()
    want = [(d["k"], d["pre"]) for d in elements if cls(d, "a") and any(is_in(x, d) and x["name"] == "section" for x in elements)]
    assert keyed(selectors.select_all(frame, ["k"], "section .a")) == sorted(want, key=repr)
    want = [(d["k"], d["pre"]) for d in elements if any(x["k"] == d["k"] and x["parent"] == d["parent"] and x["sib_idx"] < d["sib_idx"] and cls(x, "c") for x in elements)]
    assert keyed(selectors.select_all(frame, ["k"], ".c ~ *")) == sorted(want, key=repr)


def test_a_large_sheet_has_the_plan_of_a_small_one(nodes):
    frame, _ = nodes
    small = [f".a{i} > div .b{i} + b" for i in range(3)]
    large = [f".a{i} > div .b{i} + b" for i in range(2000)] + RULES[:20]
    size = [str(rule_index.hits(frame, ["k"], s)._jdf.queryExecution().analyzed()).count("\n") for s in (small, large)]
    assert size[1] <= size[0] + 2 and rule_index.compile_rules(large).others == []


def test_a_large_page_takes_seconds(spark):
    text = "<div class=a>" + "<p>x<b>y</b></p>" * 12_500 + "<i>z</i></div>"
    nodes = selectors.node_table(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t").cache()
    assert nodes.count() > 50_000
    began = time.perf_counter()
    assert selectors.select_all(nodes, ["k"], "* p").count() == 12_500
    ranked = cascade.cascade(cascade.candidates(nodes, ["k"], "p { color: red } .a { color: blue }"), ["k"])
    colours = cascade.computed(nodes, ["k"], ranked, "color").groupBy("value").count().collect()
    assert {r.value: r["count"] for r in colours} == {"canvastext": 3, "blue": 2, "red": 25_000}
    assert time.perf_counter() - began < 60


def test_an_unknown_pseudo_class_drops_its_rule_only():
    found, _ = cascade.compile_sheet("p { color: red } p:dir(ltr) { color: blue } a:focus-within, b { x: y } :placeholder-shown { x: y } p::before { x: y } b { x: y }")
    assert [(d.selector, d.prop) for d in found] == [("p", "color"), ("b", "x")]
    assert not cascade.supports("selector(p:no-such)") and cascade.supports("selector(p > a:first-child)")
    with pytest.raises(TextError):
        selectors.parse("p:dir(ltr)")


def test_what_a_sheet_leaves_out_is_told():
    css = """@import url(a.css); @layer a { p:dir(ltr) { x: y } } @container (width > 1px) { b { c: d } } @media print { a { color: 12; width: 1px } }
    @supports (display: nope) { @scope (.x) { p { y: z } } } div { & > b { margin: 1px 2px 3px 4px 5px; color: var(--c); height: inherit !important } --q: anything }"""
    assert cascade.sheet_errors(css) == [("at-rule", "@import url(a.css)"), ("selector", "p:dir(ltr)"), ("at-rule", "@container (width > 1px)"), ("declaration", "color: 12"), ("declaration", "margin: 1px 2px 3px 4px 5px")]
