"""Event streams: the same events for any cut, order, batching and repetition."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.functions import json_text
from papyrine.functions.errors import TextError
from papyrine.streaming import events

JSON = '{"a": [1, -2.5e3, true, null, "x\\"y\\u00e9é\\\\"], "b": {"a": {}, "a": []}, "": "\\n"} 7 "end" [[]]\n'
XML = '<?xml version="1.0"?>\n<!DOCTYPE r [<!ENTITY x "y>">]>\n<r a="1 &lt; 2" b=\'é\'>t&amp;é\r\n<!-- c > --><e/><e x="/>">z<![CDATA[<&]]]></e><?p q?>u</r>\n'


def fed(kind, pieces, **options):
    """Events of a text given in pieces, the tokenizer's state being written and read between them."""
    tokens, out = events.KINDS[kind](**options), []
    for i, piece in enumerate(pieces):
        out += list(tokens.feed(piece, i == len(pieces) - 1))
        tokens = events.KINDS[kind].of(tokens.state(), **options)
    return out


def cut(text, places):
    edges = [0, *sorted(p % (len(text) + 1) for p in places), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([("json", JSON), ("xml", XML)]), st.lists(st.integers(0, 300), max_size=8))
def test_any_cut_gives_the_same_events(kind_text, places):
    kind, text = kind_text
    assert fed(kind, cut(text, places)) == fed(kind, [text]) == fed(kind, list(text))


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values, st.lists(st.integers(0, 99), max_size=4))
def test_json_events_equal_those_of_the_whole_text(value, places):
    text = json.dumps(value, ensure_ascii=False)
    whole = [(e["event"].replace("integer", "number"), e["depth"], e["key"]) for e in json_text.events(text)]
    got = [e[:3] for _, e in fed("json", cut(text, places)) if e[0] != "end_record"]
    assert got == whole


@pytest.mark.parametrize(("kind", "text", "code"), [
    ("json", "[1,]", "syntax"), ("json", '{"a" 1}', "syntax"), ("json", "{1:2}", "syntax"), ("json", "[01]", "syntax"), ("json", "[1", "truncated"), ("json", '"a', "truncated"), ("json", "]", "syntax"), ("json", '"\\x"', "syntax"), ("json", "[" * 300, "limit"), ("json", "nul", "syntax"),
    ("xml", "<a><b></a>", "syntax"), ("xml", "<a x=1/>", "syntax"), ("xml", "<a x='1' x='2'/>", "syntax"), ("xml", "<a>&no;</a>", "reference"), ("xml", "<a>", "truncated"), ("xml", "<a/><b/>", "syntax"), ("xml", "x<a/>", "syntax"), ("xml", "<a><!-- -- --></a>", "syntax"), ("xml", "", "truncated"), ("xml", "<a>]]></a>", "syntax"), ("xml", "<a", "syntax"), ("xml", "<a>&#0;</a>", "reference"),
])
def test_bad_texts_are_refused_wherever_they_are_cut(kind, text, code):
    for pieces in ([text], list(text) or [""]):
        with pytest.raises(TextError) as e:
            fed(kind, pieces)
        assert e.value.code == code


def test_repeated_names():
    text = '{"a": 1, "b": {"a": 2}, "a": {"c": [3]}, "d": 4}'
    shown = lambda found: [(e[0], e[2], e[3]) for _, e in found if e[3] is not None]
    assert [e[4] for _, e in fed("json", [text]) if e[0] == "begin_object"] == [False, False, True]
    assert shown(fed("json", list(text), names="first")) == [("number", "a", "1"), ("number", "a", "2"), ("number", "d", "4")]
    with pytest.raises(TextError):
        fed("json", [text], names="error")


def test_a_long_token_is_looked_at_once():
    tokens = events.JsonTokenizer()
    for _ in range(50):
        assert list(tokens.feed('"' * (not tokens.rest) + "x" * 1000, False)) == []
    assert tokens.seen >= 49_000
    assert [e[0] for _, e in tokens.feed('"', True)] == ["string", "end_record"]


SCHEMA = "stream_id string, seq long, data binary, last boolean, at timestamp"


def run(spark, folder, rows, batches, **options):
    """Events of chunk rows that come in so many batches."""
    from datetime import datetime

    for i in range(batches):
        part = [(*r, datetime(2024, 1, 1, r[1] % 20)) if len(r) == 4 else r for r in rows[i::batches]]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    if options.get("time"):
        read = read.withWatermark("at", "1 second")
    name = f"events_{abs(hash(str(folder)))}"
    query = events.parse_events(read, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).collect())), sum(p["numInputRows"] > 0 for p in query.recentProgress)


def test_chunks_late_repeated_and_over_many_batches(spark, tmp_path):
    texts = {"a": JSON, "b": '["é" ,' + "1," * 50 + "2]", "bad": '{"a": [1, 2}', "open": "[1, 2", "empty": ""}
    rows = []
    for name, text in texts.items():
        raw = text.encode()
        parts = [raw[i : i + 3] for i in range(0, len(raw), 3)] or [b""]
        rows += [(name, i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    rows += rows[:20] + rows[-15:]
    random.Random(3).shuffle(rows)
    got, batches = run(spark, tmp_path, rows, 4, kind="json")
    assert batches == 4
    for name, text in texts.items():
        mine = [r[2:] for r in got if r[0] == name]
        assert [r[1] for r in got if r[0] == name] == list(range(len(mine)))
        whole = []
        try:
            whole = [(record, *e) for record, e in fed("json", [text])]
        except TextError as e:
            assert mine[-1][1] == "error" and mine[-1][4].startswith(e.code)
            mine, whole = mine[:-1], mine[:-1]
        assert mine == whole


def test_state_is_bounded_and_idle_streams_end(spark, tmp_path):
    from datetime import datetime

    rows = [("late", i, bytearray(b"x" * 100), False, datetime(2024, 1, 1, 0)) for i in range(1, 12)] + [("idle", 0, bytearray(b"[1,"), False, datetime(2024, 1, 1, 0))]
    later = [("next", 0, bytearray(b"[2]"), True, datetime(2024, 1, 2, 0)), ("last", 0, bytearray(b"[3]"), True, datetime(2024, 1, 3, 0))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    for r in later:
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got, _ = run(spark, tmp_path, [], 0, kind="json", time="at", idle=60, max_state=1000)
    errors = {r[0]: r[6] for r in got if r[3] == "error"}
    assert set(errors) == {"late", "idle"} and errors["late"].startswith("limit") and errors["idle"].startswith("truncated")
    assert [r[3] for r in got if r[0] == "next"] == ["begin_array", "number", "end_array", "end_record"]
