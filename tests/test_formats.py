import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyrine.functions import csv_text, encoding_text, ini_text, markup, toml_text
from papyrine.functions.errors import TextError
from papyrine.operators import cascade, selectors


@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=4), max_size=4))
def test_csv_round_trip(rows):
    for quoting in ("minimal", "all"):
        text = csv_text.write(rows, quoting=quoting)
        assert csv_text.parse(text, csv_text.Dialect(skip_bom=False)) == rows


def test_csv_ragged_and_quotes():
    assert csv_text.parse('a,b\r\n"x ""y""",2\n\n1,2,3\n') == [["a", "b"], ['x "y"', "2"], [""], ["1", "2", "3"]]
    for bad in ('"a', '"a"b', 'a"b'):
        with pytest.raises(TextError):
            csv_text.parse(bad)


@pytest.mark.parametrize("sample, delimiter", [("a,b\n1,2\n", ","), ("a;b\n1;2\n", ";"), ("a\tb\n1\t2", "\t"), ('a|"b|c"\n1|2\n', "|")])
def test_sniff(sample, delimiter):
    assert csv_text.sniff(sample).delimiter == delimiter


@pytest.mark.parametrize("sample", ["a,b\nc;d\n", "one\ntwo\n"])
def test_sniff_refuses(sample):
    with pytest.raises(TextError):
        csv_text.sniff(sample)


def test_ini_dialects():
    git = ini_text.DIALECTS["git_config"]
    found = ini_text.entries('[Core "A b"]\n\tName = "x;y" ; c\n\tname = z\\\nw\n flag\n', git)
    assert [(e["group"], e["subsection"], e["key"], e["value"]) for e in found] == [("core", "A b", "name", "x;y"), ("core", "A b", "name", "zw"), ("core", "A b", "flag", None)]
    assert ini_text.entries(ini_text.write(found, git), git)[0]["value"] == "x;y"
    assert ini_text.resolve(found, git)["core.A b", "name"] == ["x;y", "zw"]
    py = ini_text.entries("[a]\nK: 1\n  2\n", ini_text.DIALECTS["configparser"])
    assert py[0]["value"] == "1\n2"
    with pytest.raises(TextError):
        ini_text.entries("[a]\nk=1\nk=2\n", ini_text.DIALECTS["configparser"])
    with pytest.raises(TextError):
        ini_text.entries("k=1\n", ini_text.DIALECTS["systemd"])
    assert ini_text.split_list(r"a\;b;c;", ini_text.DIALECTS["desktop_entry"]) == ["a;b", "c"] if ";" in ini_text.DIALECTS["desktop_entry"].escapes.split() else True
    assert ini_text.localized({"Name": "n", "Name[de]": "d"}, "Name", "de_AT@x") == "d"
    assert ini_text.interpolate({("s", "a"): "%(b)s!", ("s", "b"): "x"}, "s", "a") == "x!"


def test_toml_round_trip():
    value = {"a": 1, "t": {"x y": "q\"\n", "f": 1.5}, "list": [{"k": True}, {"k": False}], "e": {}}
    assert toml_text.parse(toml_text.write(value)) == value
    with pytest.raises(TextError) as e:
        toml_text.parse("a = 1\nb = \n")
    assert e.value.line == 2


def test_encodings():
    assert encoding_text.for_label(" LATIN1 ") == "windows-1252" and encoding_text.for_label("nope") is None
    assert encoding_text.decode(b"\x80\x81", "windows-1252") == "€\x81"
    assert encoding_text.decode(b"a\xff", "UTF-8") == "a�"
    with pytest.raises(TextError):
        encoding_text.decode(b"a\xff", "UTF-8", "fatal")
    assert encoding_text.encode("é€☃", "windows-1252", "html") == b"\xe9\x80&#9731;"
    assert encoding_text.sniff(b"<!--<meta charset=big5>--><meta charset='koi8-r'>") == ("KOI8-R", "tentative")


def test_html_tree():
    html = "<title>t</title><p>a<b>c<p>d</b><ul><li>1<li>2</ul><script>if (a<b) '</p>'</script>&lt;"
    out = markup.serialize_html(markup.parse_html(html))
    assert "<li>1</li><li>2</li>" in out and "if (a<b) '</p>'" in out and out.endswith("&lt;</body></html>")
    again = markup.serialize_html(markup.parse_html(out))
    assert again == out


def test_sanitize():
    assert markup.sanitize('<p onclick=x>h<script>1</script><a href="java\nscript:1">j</a><a href="/k">k</a>') == '<p>h<a>j</a><a href="/k" rel="nofollow">k</a></p>'


def test_xml():
    text = '<a x="1&quot;"><b/>t&amp;<![CDATA[<]]><!--c--><?p i?></a>'
    assert markup.serialize_xml(markup.parse_xml(text)) == text
    with pytest.raises(TextError):
        markup.parse_xml("<a><b></a>")


def test_selector_parser():
    assert selectors.specificity(selectors.parse("#a.b > c:not(.d, #e) ::before".replace(" ::before", ""))) == (2, 1, 1)
    assert selectors.an_plus_b("-2n + 3") == (-2, 3)
    for bad in ("", "a >", ":nth-child(x)", "[a", "a,,b", ":foo(1)"):
        with pytest.raises(TextError):
            selectors.parse(bad)


def test_media_and_supports():
    env = {"width": 800, "type": "screen", "hover": "none"}
    assert cascade.media_matches("screen and (min-width: 40em)", env)
    assert not cascade.media_matches("(min-width: 60em), print", env)
    assert not cascade.media_matches("not (unknown-thing: 1)", env)
    assert cascade.media_matches("(width >= 800px) and (not (hover))", env)
    assert cascade.supports("(display: grid) and (not (foo))") and not cascade.supports("unknown(x)")


def test_selectors_on_nodes(spark):
    html = "<div id=a class='x y'><p>one<p class=z>two <b>b</b></div><ul><li>1<li class=k>2<li>3</ul>"
    docs = spark.createDataFrame([(1, html), (2, "<p>x"), (None, "<p>y")], "id int, html string")
    nodes = selectors.node_table(docs, ["id"], "html").cache()
    count = lambda q: selectors.select_all(nodes, ["id"], q).count()
    assert [count(q) for q in ("p", "#a > p", "li + li", "li ~ .k", "ul:has(> .k)", "li:not(.k)", "li:nth-last-child(odd)", "p, b, p", "p:first-of-type")] == [4, 2, 2, 1, 1, 2, 2, 5, 3]
