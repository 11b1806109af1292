import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyrine.functions import json_path, json_text as J
from papyrine.functions.errors import TextError

#: Readings by month: nested arrays, odd member names, values of one member in several types.
LOG = J.parse("""{"n": [0, -1, 1.0, 1e0, "1"], "log": {"2024-01": [[1, {"v": null}], [], [{"v": 3}, {"v": "3"}, {"w": []}]], "it's": {"": [true, false]}, "none": {}}}""")


@pytest.mark.parametrize(("query", "wanted"), [
    ("$.n[::-2]", ["$['n'][4]", "$['n'][2]", "$['n'][0]"]), ("$.n[1:99:3]", ["$['n'][1]", "$['n'][4]"]), ("$.n[-2:]", ["$['n'][3]", "$['n'][4]"]), ("$.n[9,-9]", []), ("$.n[0,0]", ["$['n'][0]"] * 2),
    ("$.n[?@ == 1]", ["$['n'][2]", "$['n'][3]"]), ("$.n[?@ == '1']", ["$['n'][4]"]), ("$.n[?@ < 0 || @ >= 1]", ["$['n'][1]", "$['n'][2]", "$['n'][3]"]), ("$.n[?!(@ != 0)]", ["$['n'][0]"]),
    ("$.log['2024-01'][0][1].v", ["$['log']['2024-01'][0][1]['v']"]), ('$.log["it\'s"][\'\'][1]', ["$['log']['it\\'s'][''][1]"]), ("$.log.none.*", []), ("$.log.none[?@]", []),
    ("$..[?@.v == null]", ["$['log']['2024-01'][0][1]"]), ("$..[?@.v]", ["$['log']['2024-01'][0][1]", "$['log']['2024-01'][2][0]", "$['log']['2024-01'][2][1]"]), ("$..[?@.v == 3].v", ["$['log']['2024-01'][2][0]['v']"]),
    ("$.log[?length(@) == 3]", ["$['log']['2024-01']"]), ("$.log['2024-01'][?count(@.*) == 0]", ["$['log']['2024-01'][1]"]), ("$.log['2024-01'][?@[0].v == @[1].v]", ["$['log']['2024-01'][1]"]),
    ("$..['w', '']", ["$['log']['it\\'s']['']", "$['log']['2024-01'][2][2]['w']"]), ("$[?@[?@ == -1]]", ["$['n']"]),
])
def test_paths_of_a_log(query, wanted):
    found = [json_path.normalized(p) for p, _ in json_path.compile_path(query).nodes(LOG, LOG)]
    assert sorted(found) == sorted(wanted) if ".." in query else found == wanted


@pytest.mark.parametrize("query", ["", "store", "$[", "$.a[?@.b==]", "$[01]", "$[?length(@.*)==1]", "$[?count(1)==1]", "$ ", "$[?@.*==1]", "$['a"])
def test_path_refused(query):
    with pytest.raises(TextError):
        json_path.compile_path(query)


@pytest.mark.parametrize("text", ['{"a":1,}', "[1 2]", '{"a":1,"a":2}', '"\\ud800"', "NaN", "01", "{} x", "", "'a'", '"\t"', "[1,]"])
def test_strict_refuses(text):
    with pytest.raises(TextError):
        J.parse(text)


def test_duplicates():
    text = '{"a":1,"a":2,"b":3}'
    made = lambda p: J.write(J.parse(text, J.JsonOptions(duplicates=p)))
    assert made("first") == '{"a":1,"b":3}' and made("last") == '{"a":2,"b":3}' and made("collect") == '{"a":[1,2],"b":3}'


def test_relaxed():
    assert J.write(J.parse("{a:1,'b':[.5,0x1F,],/*c*/}", J.JSON5)) == '{"a":1,"b":[.5,0x1F]}'
    with pytest.raises(TextError):
        J.parse("{a:1}", J.JSONC)


def test_canonical_and_equal():
    assert J.write(J.parse('{"b":1.50,"a":[1e2,-0.0]}'), J.CANONICAL) == '{"a":[100,0],"b":1.5}'
    assert J.equal(J.parse('{"x":1.0,"y":[1]}'), J.parse('{"y":[1e0],"x":1}'))


@pytest.mark.parametrize("pointer, found", [("", True), ("/a/0", True), ("/a/2", False), ("/m~1n", True), ("/", True), ("/a/01", False)])
def test_pointer(pointer, found):
    value = J.parse('{"a":[1,2],"m/n":3,"":4}')
    missing = object()
    assert (J.pointer_get(value, J.pointer_tokens(pointer), missing) is not missing) == found


def test_patch_is_atomic():
    target = J.parse('{"a":[1,2]}')
    assert J.write(J.patch(target, J.parse('[{"op":"add","path":"/a/1","value":9},{"op":"move","from":"/a/0","path":"/b"}]'))) == '{"a":[9,2],"b":1}'
    with pytest.raises(TextError):
        J.patch(target, J.parse('[{"op":"remove","path":"/a/0"},{"op":"test","path":"/a/0","value":7}]'))
    assert J.write(target) == '{"a":[1,2]}'


def test_merge_patch():
    assert J.write(J.merge_patch(J.parse('{"a":{"b":1,"c":2},"d":3}'), J.parse('{"a":{"b":null},"d":[1]}'))) == '{"a":{"c":2},"d":[1]}'


def test_records():
    assert len(J.records('{"a":1}\n[2]\n\n3\n', "line")) == 3
    assert len(J.records("\x1e1\n\x1e[2]", "seq")) == 2
    assert len(J.records('1 2 {"a":3}[4]', "whitespace")) == 4
    for text, mode in (("\x1e12", "seq"), ("1 2", "off"), ('1"a"', "line")):
        with pytest.raises(TextError):
            J.records(text, mode)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x, max_size=4), max_leaves=12)


@given(values)
def test_round_trip(value):
    text = J.write(value)
    assert J.write(J.parse(text)) == text
    assert J.equal(J.parse(text), J.parse(J.write(J.parse(text), J.JsonStyle(indent=2, ascii=True, sort_keys=True))))
