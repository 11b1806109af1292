import random

import pytest

from papyrine.functions import json_schema, json_text as J, yaml_text as Y
from papyrine.functions.errors import TextError
from papyrine.sources import text_sources
from papyrine.streaming import chunks

YAML = [
    ("a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {q: r}]\n", '{"a":1,"b":["x",{"y":2,"z":[1,{"q":"r"}]}]}'),
    ("- a\n- - b\n  - c\n-\n  d: e\n", '["a",["b","c"],{"d":"e"}]'),
    ("x: |\n  a\n   b\n\n  c\ny: >-\n  f\n  g\n\n  h\n", '{"x":"a\\n b\\n\\nc\\n","y":"f g\\nh"}'),
    ("a: &k {p: 1}\nb: *k\nc:\n  <<: *k\n  r: 2\n", '{"a":{"p":1},"b":{"p":1},"c":{"r":2,"p":1}}'),
    ("key: value # no\nurl: http://x:80/y#z\nn: ~\nt: true\nf: 1.5e3\nh: 0x1F\n", '{"key":"value","url":"http://x:80/y#z","n":null,"t":true,"f":1.5e3,"h":31}'),
    ("plain\n  multi\n  line", '"plain multi line"'),
    ("? a\n: b\n", '{"a":"b"}'),
    ("a: !!str 12\n", '{"a":"12"}'),
]


@pytest.mark.parametrize("text, wanted", YAML)
def test_yaml(text, wanted):
    assert J.write(Y.parse(text)) == wanted


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: b: c", "[1, 2", "*x", "a:\n  b\n c: d", '"x', "a: @x", "{a: 1"])
def test_yaml_refuses(text):
    with pytest.raises(TextError):
        Y.parse(text)


def test_yaml_round_trip():
    rng = random.Random(1)

    def value(d):
        r = rng.random()
        if d and r < 0.4:
            return {f"k{i}": value(d - 1) for i in range(3)}
        if d and r < 0.8:
            return [value(d - 1) for _ in range(rng.randrange(4))]
        return rng.choice([None, True, J.Number("5"), "x: y", "- a", "true", "", "  s", "a\nb", "#c", "12", "é", "null", "yes"])

    for _ in range(200):
        v = value(4)
        assert J.equal(Y.parse(Y.write(v)), v)


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ('{"type":"integer"}', "1.0", "1.5"), ('{"multipleOf":0.01}', "0.07", "0.075"), ('{"enum":[{"a":1}]}', '{"a":1.0}', "{}"),
        ('{"prefixItems":[{"type":"string"}],"items":false}', '["a"]', '["a",1]'), ('{"contains":{"const":1},"maxContains":1}', "[1,2]", "[1,1]"),
        ('{"oneOf":[{"type":"number"},{"minimum":5}]}', "1", "6"), ('{"if":{"required":["a"]},"then":{"required":["b"]}}', '{"b":1}', '{"a":1}'),
        ('{"dependentRequired":{"a":["b"]}}', '{"a":1,"b":2}', '{"a":1}'), ('{"propertyNames":{"maxLength":1}}', '{"a":1}', '{"ab":1}'),
        ('{"allOf":[{"properties":{"a":true}}],"unevaluatedProperties":false}', '{"a":1}', '{"b":1}'),
        ('{"$ref":"#/$defs/n","$defs":{"n":{"properties":{"c":{"$ref":"#/$defs/n"}},"additionalProperties":false}}}', '{"c":{"c":{}}}', '{"c":{"d":1}}'),
        ('{"uniqueItems":true}', '[1,"1",true]', "[1,1.0]"), ('{"pattern":"^a.c$"}', '"abc"', '"abcd"'), ('{"not":{"type":"null"}}', "1", "null"),
    ],
)
def test_schema(schema, good, bad):
    made = json_schema.Schema(J.parse(schema))
    assert made.validate(J.parse(good))["valid"] and not made.validate(J.parse(bad))["valid"]


def test_schema_refused_when_compiled():
    for bad in ('{"$ref":"#/$defs/none"}', '{"type":"thing"}', '{"pattern":"("}', '{"minimum":"1"}'):
        with pytest.raises(TextError):
            json_schema.Schema(J.parse(bad))


@pytest.mark.parametrize("name, good, bad", [("date-time", "2020-01-31T10:00:00Z", "2020-02-30T10:00:00Z"), ("ipv4", "1.2.3.4", "01.2.3.4"), ("ipv6", "::1", ":::1"), ("uuid", "12345678-1234-1234-1234-123456789abc", "x"), ("email", "a@b.c", "a@"), ("uri", "http://a/b", "/b"), ("duration", "P1DT2H", "P"), ("json-pointer", "/a~1b", "a"), ("hostname", "a-b.c", "-a")])
def test_formats(name, good, bad):
    assert json_schema.check_format(name, good) and not json_schema.check_format(name, bad)


def test_chunked_csv_does_not_depend_on_cuts(spark, tmp_path):
    text = 'a,b\r\n"x\ny",2\r\n"q""r",3\r\nlast,4'
    rng, rows = random.Random(2), []
    for s in range(4):
        cuts = sorted({0, len(text), *(rng.randrange(len(text)) for _ in range(5))})
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        rows += [(f"s{s}", i, p, i == len(parts) - 1) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    schema = "stream_id string, seq long, data string, last boolean"
    for n in range(3):
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chunks.parse_chunks(stream).writeStream.format("memory").queryName("parsed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    found = {}
    for r in spark.table("parsed").collect():
        found.setdefault(r.stream_id, {})[r.record_idx] = r.record
    wanted = ['["a", "b"]', '["x\\ny", "2"]', '["q\\"r", "3"]', '["last", "4"]']
    assert found == {f"s{s}": dict(enumerate(wanted)) for s in range(4)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1;h2\n"x;y";2\nz\n')
    from papyrine.functions.csv_text import Dialect

    rows = text_sources.read_csv(spark, str(tmp_path / "a.csv"), Dialect(delimiter=";"), header=True).orderBy("row_idx").collect()
    assert [r.record for r in rows] == [{"h1": "x;y", "h2": "2"}, {"h1": "z"}]
    (tmp_path / "c.ini").write_text("[g]\nk = v\n")
    assert text_sources.read_ini(spark, str(tmp_path / "c.ini"), "systemd").first().value == "v"
    (tmp_path / "r.json").write_text('\x1e{"b":1,"a":2}\n\x1e[1]\n')
    assert [r.record for r in text_sources.read_json_records(spark, str(tmp_path / "r.json"), "seq").collect()] == ['{"b":1,"a":2}', "[1]"]
    text_sources.write_csv(spark.createDataFrame([("a,b", 1)], "x string, y int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '"a,b",1'
