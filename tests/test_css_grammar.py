"""Value grammars against a brute-force reading of the notation, shorthands, and the operators on rows."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.functions import css_grammar, css_properties, css_shorthand
from papyrine.functions.css_grammar import Grammar
from papyrine.functions.errors import TextError
from papyrine.operators import css_declarations

# --- brute force: the set of words of at most four tokens that a definition stands for ---

LONGEST = 4
leaf = st.sampled_from("abc").map(lambda c: (c, {(c,)}))


def _concat(*sets):
    out = {()}
    for s in sets:
        out = {x + y for x in out for y in s if len(x + y) <= LONGEST}
    return out


def _anyway(sets, every):
    out = set()
    for n in range(1, len(sets) + 1):
        for chosen in itertools.combinations(range(len(sets)), n):
            if every and any(() not in sets[i] for i in range(len(sets)) if i not in chosen):
                continue
            for order in itertools.permutations(chosen):
                out |= _concat(*(sets[i] for i in order))
    return out


def _times(words, low, high, comma=False):
    out, many = set(), {()}
    for n in range(LONGEST + 2):
        if low <= n <= high:
            out |= many
        grown = set()
        for x in many:
            for y in words:
                joined = x + ((",",) if comma and x else ()) + y
                if len(joined) <= LONGEST and (not comma or y):
                    grown.add(joined)
        many = grown | (many if () in words and not comma else set())
    if () in words and low:
        out |= _times(words - {()}, 0, high, comma)
    return out


def _combine(parts):
    kind, children = parts
    texts, words = [f"[ {t} ]" for t, _ in children], [w for _, w in children]
    if kind == "sequence":
        return " ".join(texts), _concat(*words)
    if kind == "one":
        return " | ".join(texts), set().union(*words)
    return (" && " if kind == "all" else " || ").join(texts), _anyway(words, kind == "all")


def _counted(parts):
    (text, words), (sign, low, high) = parts
    return f"[ {text} ]{sign}", _times(words, low, high)


definitions = st.recursive(
    leaf,
    lambda inner: st.builds(lambda k, c: _combine((k, c)), st.sampled_from(["sequence", "one", "all", "some"]), st.lists(inner, min_size=2, max_size=3))
    | st.builds(lambda c, m: _counted((c, m)), inner, st.sampled_from([("?", 0, 1), ("*", 0, 99), ("+", 1, 99), ("{2}", 2, 2), ("{1,3}", 1, 3), ("{2,}", 2, 99)])),
    max_leaves=6,
)


@settings(max_examples=250, deadline=None)
@given(definitions)
def test_matches_what_the_notation_stands_for(definition):
    text, words = definition
    grammar = Grammar(text)
    for n in range(LONGEST + 1):
        for word in itertools.product("abc", repeat=n):
            assert (grammar.match(" ".join(word)).status == "match") == (word in words), (text, word)


@pytest.mark.parametrize(("definition", "value", "text"), [
    ("a b | c", "A /* */ B", "a b"), ("a | b && c", "c b", "b c"), ("a && b || c", "c b a", "a b c"), ("a b || c d", "c d a b", "a b c d"), ("a b || c d", "a c d", None),
    ("a#{2,3}", "a,a", "a, a"), ("a#{2,3}", "a,a,a,a", None), ("a#", "a,", None), ("a+#", "a a, a", "a a, a"), ("a#?", "", ""), ("[ a? b? ]!", "", None),
    ("f( x# , y? )", "f(x, x)", "f(x, x)"), ("f( x , y? , z )", "f(x, z)", "f(x, z)"), ("f( x , y? )", "f(x,)", None), ("a? , b", "b", "b"), ("a? , b", ", b", None),
    ("( <number> ) { <declaration-list> }", "(3.10) { k: v; w: (x) }", "(3.1) {k :v; w :(x)}"), ("'[' <custom-ident>* ']'", "[x  y]", "[x y]"),
    ("<number> | <integer>", "3", "3"), ("<integer>", "3.0", None), ("<number [0,1]>", "1.01", None), ("<length [0px,1in]>", "2.54cm", "2.54cm"), ("<length [0px,1in]>", "2.55cm", None),
    ("<length [0,∞]>", "-1em", None), ("<length>", "0", "0px"), ("<time>", "0", None), ("<angle>", "1TURN", "1turn"), ("<length>", "calc(1px + 2em)", "calc(1px + 2em)"),
    ("<url>", "url( a\\)b )", 'url("a)b")'), ("<string>", "'a\\22 b'", '"a\\"b"'), ("<custom-ident>", "inherit", None), ("<dashed-ident>", "--x", "--x"), ("<ratio>", "16/9", "16 / 9"),
    ("<an+b>", "2n + 1", "2n + 1"), ("<any-value>", "a [b (c)] !", "a [b (c)] !"), ("<declaration-value>", "a ; b", None), ("<hex-color>", "#abcd", "#abcd"), ("<hex-color>", "#abcde", None),
])
def test_values(definition, value, text):
    found = Grammar(definition).match(value)
    assert (found.text if found.status == "match" else None) == text


@pytest.mark.parametrize(("definition", "types", "code"), [
    ("<x>", {"x": "<x> a"}, "left-recursion"), ("<x>", {"x": "a? <y>", "y": "b* <x>"}, "left-recursion"), ("<x>", {"x": "[ a | <x> ]"}, "left-recursion"), ("<x>", {}, "reference"),
    ("a b ]", {}, "grammar"), ("a ||", {}, "grammar"), ("a{3,2}", {}, "grammar"), ("<number [0px,1px]>", {}, "grammar"), ("a!", {}, "grammar"), ("f( a", {}, "grammar"), ("[ " * 200 + "a" + " ]" * 200, {}, "limit"),
])
def test_refused_definitions(definition, types, code):
    with pytest.raises(TextError) as e:
        Grammar(definition, types)
    assert e.value.code == code


def test_recursion_behind_a_value_and_the_budget():
    assert Grammar("<x>", {"x": "a <x>?"}).match("a " * 40).status == "match"
    assert Grammar("<x>", {"x": "f( <x>? )"}).match("f(f(f()))").text == "f(f(f()))"
    overlapping = Grammar("[ a | a a | a a a ]+ b")
    assert overlapping.match("a " * 1000 + "b").steps < 2.1 * overlapping.match("a " * 500 + "b").steps
    assert overlapping.match("a " * 500 + "c").status == "no-match"
    with pytest.raises(TextError) as e:
        overlapping.match("a " * 500 + "b", budget=100)
    assert e.value.code == "limit"
    assert Grammar("a").match("var(--x)").status == "pending" and Grammar("<any-value>").match("f([env(x)])").status == "pending"


def test_every_definition_compiles():
    for name in [*css_properties.PROPERTIES, *css_properties.SHORTHANDS]:
        assert css_properties.grammar(name).nodes, name
    for name in css_properties.TYPES:
        Grammar(f"<{name}>", css_properties.TYPES, css_properties.PROPERTIES)
    for name, values in css_properties.INITIAL.items():
        assert name in ("width", "style", "color") or css_properties.grammar(name).match(values).status == "match", name


@pytest.mark.parametrize(("name", "value", "wanted"), [
    ("margin", "1px 2px 3px", {"margin-top": "1px", "margin-right": "2px", "margin-bottom": "3px", "margin-left": "2px"}),
    ("border", "SOLID", {f"border-{s}-{p}": v for s in ("top", "right", "bottom", "left") for p, v in (("width", "medium"), ("style", "solid"), ("color", "currentcolor"))}),
    ("border-radius", "1px 2px / 3px", {"border-top-left-radius": "1px 3px", "border-top-right-radius": "2px 3px", "border-bottom-right-radius": "1px 3px", "border-bottom-left-radius": "2px 3px"}),
    ("flex", "none", {"flex-grow": "0", "flex-shrink": "0", "flex-basis": "auto"}), ("flex", "2 3 10%", {"flex-grow": "2", "flex-shrink": "3", "flex-basis": "10%"}),
    ("list-style", "square inside", {"list-style-type": "square", "list-style-position": "inside", "list-style-image": "none"}),
    ("gap", "inherit", {"row-gap": "inherit", "column-gap": "inherit"}),
    ("background", "border-box red", {"background-origin": "border-box", "background-clip": "border-box", "background-color": "red"}),
    ("transition", "opacity 1s 2s ease-in", {"transition-property": "opacity", "transition-duration": "1s", "transition-delay": "2s", "transition-timing-function": "ease-in"}),
])
def test_shorthands(name, value, wanted):
    status, found = css_shorthand.expand(name, value)
    assert status == "match" and [n for n, _ in found] == css_shorthand.longhand_names(name)
    assert {n: v for n, v in found if n in wanted} == wanted


def test_logical_names_by_writing_mode():
    upright, sideways = css_shorthand.physical_names("vertical-rl"), css_shorthand.physical_names("sideways-lr", "ltr")
    assert upright["margin-block-start"] == "margin-right" and upright["inline-size"] == "height" and upright["border-start-start-radius"] == "border-top-right-radius"
    assert sideways["margin-inline-start"] == "margin-bottom" and sideways["margin-block-start"] == "margin-left"


def test_rows_of_any_kind(spark):
    rows = [("width", "10PX", 1), ("width", "10PX", 1), ("WIDTH", "inherit", 2), ("--x", " any ( thing ) ", 3), ("no-such", "1", 4), (None, "1", 5), ("width", None, 6), ("color", "", 7), ("width", "f(" * 90, 8), ("margin", "1px", 9), ("margin", "1px 2", 10), ("gap", "var(--g)", 11)]
    frame = spark.createDataFrame([(*r, "old") for r in rows], "property string, value string, id int, status string").repartition(3)
    got = {(r.id, r.status, r.text) for r in css_declarations.match(frame).collect()}
    assert css_declarations.match(frame).count() == len(rows)
    assert got == {(1, "match", "10px"), (2, "wide", "inherit"), (3, "custom", "any ( thing )"), (4, "unknown-property", None), (5, None, None), (6, None, None), (7, "no-match", None), (8, "limit", None), (9, "match", "1px"), (10, "no-match", None), (11, "pending", "var(--g)")}
    long = {(r.id, r.longhand, r.longhand_value) for r in css_declarations.longhands(frame).collect()}
    assert long == {(1, "width", "10px"), (2, "width", "inherit"), (3, "--x", "any ( thing )"), *((9, f"margin-{s}", "1px") for s in ("top", "right", "bottom", "left")), (11, "row-gap", None), (11, "column-gap", None)}
    assert css_declarations.match(frame.where(F.lit(False))).count() == 0
