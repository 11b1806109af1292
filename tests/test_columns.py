from papyrine import registry
from papyrine.functions import columns as C


def test_sql_names(spark):
    registry.register(spark)
    row = spark.sql("""SELECT json_at('{"a":[1,{"b":2}]}', '/a/1/b') AS p, json_query('[1,2,3]', '$[?@ > 1]') AS q, json_canon('{') AS bad,
      yaml_json('a: [1, x]') AS y, toml_json('a = 1') AS t, csv_rows('a,b') AS c, json_patched('{}', '[{"op":"add","path":"/x","value":1}]') AS d""").first()
    assert tuple(row) == ("2", ["2", "3"], None, '{"a":[1,"x"]}', '{"a":1}', [["a", "b"]], '{"x":1}')


def test_try_form_locates_errors(spark):
    rows = spark.createDataFrame([("[1,\n 2 3]",), ("[1]",), (None,)], "t string").select(C.json_canonical("t", on_error="try").alias("r")).collect()
    assert rows[0].r.value is None and (rows[0].r.error.line, rows[0].r.error.col) == (2, 4)
    assert rows[1].r.value == "[1]" and rows[1].r.error is None and rows[2].r is None


def test_format_columns(spark):
    df = spark.createDataFrame([('{"a":{"b":"é"},"n":1}',)], "t string")
    row = df.select(
        C.yaml_to_json(C.json_to_yaml("t")).alias("y"), C.toml_to_json(C.json_to_toml("t")).alias("o"), C.decode(C.encode("t", "latin1"), "latin1").alias("e"),
        C.json_validate("t", '{"required":["z"]}').alias("v"), C.html_sanitize("t").alias("h"),
    ).first()
    assert row.y == '{"a":{"b":"é"},"n":1}' and row.o == '{"n":1,"a":{"b":"é"}}' and row.e == '{"a":{"b":"é"},"n":1}'
    assert row.v.valid is False and row.v.pointer == ""
