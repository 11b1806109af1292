"""Queries of the text formats and styles beyond the first catalog, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import SCREEN, dealt, page_nodes, query, table
from .functions import columns as C
from .functions import css_values, encoding_text, ini_text, markup
from .operators import cascade, csv_table, selectors, timing
from .runtime import scratch, stash
from .streaming import chunks


# --- JSON ---


@query("""
SELECT event_id, '{"k":' || json_extract(props, '/k') || ',"t":"' || event_type || '","a":[0,' || event_id || ',1]}' AS made FROM events
""")
def json_setters(spark, sf_dir):
    """Members put, an item inserted, a member removed, two objects merged."""
    text = C.json_put(C.json_put("props", "/a", F.lit("[0,1]")), "/gone", F.lit("null"))
    text = C.json_remove(C.json_insert(text, "/a/1", F.col("event_id").cast("string")), "/gone")
    staged = dealt(spark, sf_dir, "events").select("event_id", "event_type", "props", C.json_merge(F.concat(F.lit('{"t":"'), "event_type", F.lit('"}')), text).alias("m"))
    order = F.concat(F.lit('{"k":'), C.json_get("m", "/k"), F.lit(',"t":"'), C.json_get("m", "/t"), F.lit('","a":'), C.json_get("m", "/a"), F.lit("}"))
    return staged.select("event_id", order.alias("made"))


@query("""
SELECT o_orderkey, 3 + 2 + 2 + 6 * count(*) AS n_events, CAST(count(*) AS BIGINT) AS n_p, CAST(max(l_linenumber) AS VARCHAR) AS last_n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
""")
def json_event_stream(spark, sf_dir):
    """Parse events of documents: begins, ends and scalars in document order, with a member name repeated."""
    from .catalog import order_documents

    repeated = F.concat(F.lit('{"status":0,'), F.substring("doc", 2, 1 << 30))
    found = order_documents(spark, sf_dir).select("o_orderkey", F.posexplode(C.json_events(repeated)).alias("at", "e"))
    at_n = F.when(F.col("e.key") == "n", F.struct("at", "e.value"))
    return found.groupBy("o_orderkey").agg(F.count("*").alias("n_events"), F.count_if(F.col("e.key") == "p").alias("n_p"), F.max(at_n)["value"].alias("last_n"))


@query("""
SELECT event_id, event_id % 28 < 28 AS plain, month(ts) <> 2 OR day(ts) <= 29 AS fits, false AS wrong, true AS host, false AS long_host, user_id <= 255 AS ip FROM events
""")
def json_schema_formats(spark, sf_dir):
    """Formats of strings asserted: date, date-time, hostname, IPv4."""
    def verdict(name: str, text):
        return C.json_validate(F.concat(F.lit('"'), text, F.lit('"')), f'{{"format":"{name}"}}', formats=True)["valid"]

    events = dealt(spark, sf_dir, "events")
    return events.select(
        "event_id", verdict("date", F.concat(F.lit("2023-01-"), F.lpad((F.pmod("event_id", F.lit(28)) + 1).cast("string"), 2, "0"))).alias("plain"),
        verdict("date-time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("fits"), verdict("date", F.lit("2023-02-30")).alias("wrong"),
        verdict("hostname", F.concat("event_type", F.lit(".example"))).alias("host"), verdict("hostname", F.concat(F.repeat(F.lit("a"), 64), F.lit(".example"))).alias("long_host"),
        verdict("ipv4", F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("ip"),
    )


@query("""
SELECT n_nationkey, n_regionkey >= 2 AS draft4, n_regionkey >= 2 AS draft7, n_regionkey >= 2 AND n_regionkey <> 3 AS draft2020, true AS no_repeats FROM nation
""")
def json_schema_drafts(spark, sf_dir):
    """Drafts 4, 7 and 2020-12 over one document: minimum, const, contains, uniqueItems."""
    doc = F.concat(F.lit('{"r":'), F.col("n_regionkey").cast("string"), F.lit(',"l":['), F.col("n_regionkey").cast("string"), F.lit(",9]}"))
    ok = lambda schema, draft: C.json_validate(doc, schema, draft)["valid"]
    return dealt(spark, sf_dir, "nation").select(
        "n_nationkey", ok('{"properties":{"r":{"minimum":2}}}', "draft4").alias("draft4"), ok('{"properties":{"r":{"minimum":2}}}', "draft7").alias("draft7"),
        ok('{"properties":{"r":{"minimum":2},"l":{"contains":{"const":3},"minContains":0,"maxContains":0}}}', "2020-12").alias("draft2020"),
        ok('{"properties":{"l":{"uniqueItems":true}}}', "2020-12").alias("no_repeats"),
    )


# --- CSV ---


@query("""
SELECT CAST(CASE WHEN n_nationkey < 2 THEN n_nationkey ELSE n_nationkey - 1 END + CASE WHEN n_nationkey > 4 THEN 1 ELSE 0 END AS INTEGER) AS row_idx,
  CASE WHEN n_nationkey = 0 THEN 'first' ELSE n_name END AS a, 'new' AS b, NULL AS c FROM nation WHERE n_nationkey <> 2
UNION ALL SELECT 4, 'put', 'new', NULL
""")
def csv_table_edits(spark, sf_dir):
    """Rows inserted and removed, a cell set, columns inserted and removed, a header given."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_idx"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("fields"))
    rows = csv_table.set_field(csv_table.remove_row(rows, 2), 0, 0, "first")
    rows = csv_table.insert_row(rows, 4, ["put", "9"])
    rows = csv_table.insert_column(csv_table.remove_column(rows, 1), 1, "new")
    return csv_table.with_header(rows, ["a", "b", "c"])


@query("SELECT n_nationkey, 2 AS first_at, 3 AS n_same, n_name || n_regionkey AS joined FROM nation")
def csv_header_lookup(spark, sf_dir):
    """Ordinals of a header name that repeats, and the cell under its second place."""
    header = F.array(*map(F.lit, ["k", "v", "x", "v", "v"]))
    at = csv_table.header_indices(header, "v")
    cells = F.array(F.lit(""), F.col("n_name"), F.lit(""), F.col("n_regionkey").cast("string"), F.lit(""))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", (F.element_at(at, 1) + 1).cast("int").alias("first_at"), F.size(at).alias("n_same"),
        F.concat(F.get(cells, F.element_at(at, 1)), F.get(cells, F.element_at(at, 2))).alias("joined"),
    )


# --- INI, TOML ---

_INI = {
    "desktop_entry": ("# c\n[Desktop Entry]\nName={name}\nName[de]=D {name}\nX-A=1;{key};\n", [("Desktop Entry", "Name", "{name}"), ("Desktop Entry", "Name[de]", "D {name}"), ("Desktop Entry", "X-A", "1;{key};")]),
    "generic": ("; c\nTop=1\n[G]\nName={name}\nKey={key}\n", [("", "Top", "1"), ("G", "Name", "{name}"), ("G", "Key", "{key}")]),
    "editorconfig": ("ROOT = true\n[*.{{a,b}}]\nIndent_Size = {key}\n# c\nx = {name}  \n", [("", "root", "true"), ("*.{{a,b}}", "indent_size", "{key}"), ("*.{{a,b}}", "x", "{name}")]),
    "systemd": ("[Unit]\nDescription={name}\\\nmore\nAfter=a\nAfter={key}\n", [("Unit", "Description", "{name} more"), ("Unit", "After", "a"), ("Unit", "After", "{key}")]),
    "configparser": ("[s]\nName: {name}\nlong = one\n  two {key}\n", [("s", "name", "{name}"), ("s", "long", "one\ntwo {key}")]),
    "win32": ("; c\n[S]\nName=\"{name}\"\nKEY = {key}\nbare\n", [("s", "name", "{name}"), ("s", "key", "{key}"), ("s", "bare", None)]),
}


def _filled(text: str | None) -> str:
    """SQL text of a template."""
    if text is None:
        return "NULL"
    parts = text.replace("{{", "\x01").replace("}}", "\x02").replace("'", "''")
    parts = parts.replace("{name}", "' || c_name || '").replace("{key}", "' || c_custkey || '").replace("\n", "' || chr(10) || '")
    return "'" + parts.replace("\x01", "{").replace("\x02", "}") + "'"


def _ini_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        template = _INI[name][0].replace("{{", "\x01").replace("}}", "\x02")
        parts, rest = [], template
        while "{" in rest:
            head, _, rest = rest.partition("{")
            field, _, rest = rest.partition("}")
            parts += [F.lit(head.replace("\x01", "{").replace("\x02", "}")), F.col("c_name") if field == "name" else F.col("c_custkey").cast("string")]
        text = F.concat(*parts, F.lit(rest.replace("\x01", "{").replace("\x02", "}")))
        found = dealt(spark, sf_dir, "customer").select("c_custkey", F.explode(C.ini_entries(text, name)).alias("e"))
        return found.select("c_custkey", F.coalesce("e.group", F.lit("")).alias("g"), F.col("e.key").alias("k"), F.col("e.value").alias("v"))

    run.__name__ = f"ini_{name}_entries"
    return run


for _name, (_, _rows) in _INI.items():
    query(" UNION ALL ".join(f"SELECT c_custkey, {_filled(g)} AS g, {_filled(k)} AS k, {_filled(v)} AS v FROM customer" for g, k, v in _rows))(_ini_query(_name))


@query("SELECT n_nationkey, [n_name, 'b; c', ''] AS items, n_regionkey % 2 = 0 AS flag, 'dir/' || n_name || '/x' AS path FROM nation")
def ini_value_layer(spark, sf_dir):
    """Lists with escaped separators, truth values, interpolation."""
    d, c = ini_text.DIALECTS["generic"], ini_text.DIALECTS["configparser"]

    def run(name: str, region: str) -> dict:
        values = {("p", "home"): f"dir/{name}", ("p", "full"): "%(home)s/x"}
        return {"items": ini_text.split_list(f"{name};b\\; c;;", d), "flag": ini_text.truth(("yes", "OFF")[int(region) % 2], c), "path": ini_text.interpolate(values, "p", "full")}

    made = C.value_udf(run, "struct<items:array<string>,flag:boolean,path:string>", F.col("n_name"), F.col("n_regionkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", made.alias("m")).select("n_nationkey", "m.*")


@query("""
SELECT n_nationkey, unnest([struct_pack(path := 't.name', kind := 'string', value := n_name), struct_pack(path := 't.k', kind := 'integer', value := CAST(n_regionkey AS VARCHAR)),
  struct_pack(path := 'a.0.d', kind := 'date', value := '1979-05-27'), struct_pack(path := 'a.1.b', kind := 'boolean', value := 'true')], recursive := true) FROM nation
""")
def toml_event_rows(spark, sf_dir):
    """Leaf assignments of TOML in document order."""
    text = F.concat(F.lit("[t]\nname = '"), "n_name", F.lit("'\nk = "), F.col("n_regionkey").cast("string"), F.lit("\n[[a]]\nd = 1979-05-27\n[[a]]\nb = true\n"))
    return dealt(spark, sf_dir, "nation").select("n_nationkey", F.explode(C.toml_events(text)).alias("e")).select("n_nationkey", "e.*")


# --- encodings ---


@query("""
SELECT c_custkey, hex(encode(c_name)) || '80E9' AS cp1252, hex(encode(c_name)) || 'E282ACC3A9' AS utf8, c_name || '€é' AS back, c_name || '??' AS lossy FROM customer
""")
def encoder_bytes(spark, sf_dir):
    """Encoded bytes of a text with letters beyond ASCII, and the way back."""
    def lossy(text: str) -> str:
        return encoding_text.decode(text.encode("ascii", "replace"), "windows-1252")

    text = F.concat("c_name", F.lit("€é"))
    made = dealt(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), C.encode(text, "latin1").alias("w"), C.encode(text, "utf-8").alias("u"))
    return made.select("c_custkey", F.hex("w").alias("cp1252"), F.hex("u").alias("utf8"), C.decode("w", "cp1252").alias("back"), C.value_udf(lossy, "string", "t").alias("lossy"))


# --- markup ---


@query("SELECT n_nationkey, CAST(n_regionkey + 1 AS BIGINT) AS n_rows, CAST(n_regionkey + 1 AS BIGINT) AS n_cells, 'x' || n_name AS before FROM nation")
def html_table_rows(spark, sf_dir):
    """Implied table bodies and rows, and content of a table that goes before it."""
    text = F.concat(F.lit("<div><table>x"), F.expr("repeat('<tr><td>1', n_regionkey + 1)"), F.lit("</tr>"), "n_name", F.lit("</table></div>"))
    nodes = selectors.node_table(dealt(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")), ["n_nationkey"], "t")
    count = lambda s, name: selectors.select_all(nodes, ["n_nationkey"], s).groupBy("n_nationkey").agg(F.count("*").alias(name))
    texts = nodes.where("kind = 'text' and depth = 4").groupBy("n_nationkey").agg(F.array_join(F.collect_list("text"), "").alias("before"))
    return count("div > table > tbody > tr", "n_rows").join(count("tbody > tr > td", "n_cells"), "n_nationkey").join(texts, "n_nationkey")


@query("SELECT n_nationkey, CAST(2 AS BIGINT) AS n_cells, CAST(0 AS BIGINT) AS n_bodies FROM nation")
def html_fragment(spark, sf_dir):
    """A fragment parsed inside a row: cells, and no document around them."""
    text = F.concat(F.lit("<td>"), "n_name", F.lit("<td>2"))
    nodes = selectors.node_table(table(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")), ["n_nationkey"], "t", context="tr")
    return nodes.groupBy("n_nationkey").agg(F.count_if(F.expr("name = 'td' and depth = 1")).alias("n_cells"), F.count_if(F.col("name").isin("body", "html", "tbody")).alias("n_bodies"))


@query("SELECT n_nationkey, n_regionkey < 3 AS fits, CASE WHEN n_regionkey < 3 THEN NULL ELSE 'limit' END AS code FROM nation")
def html_too_deep_is_a_row(spark, sf_dir):
    """A document beyond the depth limit gives an error row; the others are parsed."""
    text = F.concat(F.expr("repeat('<div>', 200 * n_regionkey + 1)"), "n_name")
    nodes = selectors.node_table(dealt(spark, sf_dir, "nation").select("n_nationkey", text.alias("t")), ["n_nationkey"], "t")
    return nodes.groupBy("n_nationkey").agg((F.count_if(F.col("kind") == "error") == 0).alias("fits"), F.max(F.when(F.col("kind") == "error", F.col("name"))).alias("code"))


@query("""
SELECT c_custkey, c_mktsegment AS seg, c_name || ' & <co>' AS name, '<c s="' || c_mktsegment || '"><n>' || c_name || ' &amp; &lt;co&gt;</n><e/></c>' AS written FROM customer
""")
def xml_parse_write(spark, sf_dir):
    """XML parsed to nodes, read by selectors, and written again."""
    text = F.concat(F.lit("<?xml version='1.0'?><c s='"), "c_mktsegment", F.lit("'><n>"), "c_name", F.lit(" &amp; &lt;co&gt;</n><e></e></c>"))
    docs = dealt(spark, sf_dir, "customer").select("c_custkey", text.alias("t"))
    nodes = selectors.node_table(docs, ["c_custkey"], "t", xml=True)
    seg = selectors.select_all(nodes, ["c_custkey"], "c[s]").select("c_custkey", F.col("attrs")["s"].alias("seg"))
    names = selectors.text_content(nodes, ["c_custkey"], selectors.select_all(nodes, ["c_custkey"], "c > n")).select("c_custkey", F.col("text").alias("name"))
    return seg.join(names, "c_custkey").join(docs.select("c_custkey", C.xml_normalize("t").alias("written")), "c_custkey")


@query("SELECT n_nationkey, n_regionkey % 2 = 0 AS well_formed, true AS is_name, false AS no_name FROM nation")
def xml_checks(spark, sf_dir):
    """Well-formedness and names."""
    end = F.when(F.pmod("n_regionkey", F.lit(2)) == 0, "</a>").otherwise("</b>")
    parsed = C.xml_normalize(F.concat(F.lit("<a>"), "n_name", end), on_error="null")
    name = lambda t: C.value_udf(lambda x: bool(markup.is_xml_name(x)), "boolean", t)
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", parsed.isNotNull().alias("well_formed"), name(F.concat(F.lit("n:"), F.regexp_replace("n_name", "[^A-Za-z]", "_"))).alias("is_name"), name(F.concat(F.lit("1"), "n_name")).alias("no_name")
    )


# --- styles ---


@query("SELECT page_id, 'blue' AS value, len(regexp_extract_all(html, '<p>')) AS n FROM pages WHERE contains(html, '<p>')")
def cascade_nested_layers(spark, sf_dir):
    """A layer's own rules beat its sub-layers, whatever their order."""
    sheet = "@layer a { @layer b { p { color: red } } p { color: blue } @layer c { p { color: lime } } }"
    ranked = cascade.cascade(cascade.candidates(page_nodes(spark, sf_dir), ["page_id"], sheet), ["page_id"])
    return ranked.where("rank = 1").groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query("""
SELECT page_id, 'p' AS tag, 'green' AS value, len(regexp_extract_all(html, '<p>')) AS n FROM pages WHERE contains(html, '<p>')
UNION ALL SELECT page_id, 'li', 'navy', len(regexp_extract_all(html, '<li>')) FROM pages WHERE contains(html, '<li>')
UNION ALL SELECT page_id, 'h1', NULL, len(regexp_extract_all(html, '<h1>')) FROM pages WHERE contains(html, '<h1>')
""")
def cascade_revert(spark, sf_dir):
    """revert and revert-layer set the declarations of an origin or of a layer aside."""
    nodes = page_nodes(spark, sf_dir)
    author = "@layer a { p { color: green } } @layer b { p { color: red } article p { color: revert-layer } } @layer b { nav li { color: revert } } li { color: revert } h1 { color: revert }"
    both = cascade.candidates(nodes, ["page_id"], author).unionByName(cascade.candidates(nodes, ["page_id"], "li { color: navy }", origin="user"))
    won = cascade.resolved(cascade.cascade(both, ["page_id"]), ["page_id"]).join(nodes.select("page_id", "pre", F.col("name").alias("tag")), ["page_id", "pre"])
    return won.groupBy("page_id", "tag", "value").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, 'calc(' || user_id || 'px + 2px)' AS size, event_type AS fallback, NULL AS cycle, '4px' AS env FROM events
""")
def css_custom_properties(spark, sf_dir):
    """var() through other properties, with fallbacks and cycles, and env()."""
    pair = lambda k, v: (F.lit(k), v)
    properties = F.create_map(*pair("--w", F.concat(F.col("user_id").cast("string"), F.lit("px"))), *pair("--s", F.lit("calc(var(--w) + var(--none, 2px))")), *pair("--x", F.lit("var(--y, 1)")), *pair("--y", F.lit("var(--x, 2)")))
    at = lambda v: C.css_substitute(v, properties, {"inset": "4px"})
    return dealt(spark, sf_dir, "events").select(
        "event_id", at(F.lit("var(--s)")).alias("size"), at(F.concat(F.lit("var(--x, "), "event_type", F.lit(")"))).alias("fallback"), at(F.lit("1px var(--y)")).alias("cycle"), at(F.lit("env(inset, 9px)")).alias("env")
    )


@query("""
SELECT event_id, 'rgb(' || event_id % 256 || ', ' || user_id % 256 || ', 7)' AS hex, 'rgb(102, 51, 153)' AS named, 'rgb(' || event_id % 256 || ', 0, 0)' AS rgb, 'rgb(255, 0, 0)' AS hsl, NULL AS bad FROM events
""")
def css_colors(spark, sf_dir):
    """Colours in hex, by name, rgb() and hsl(), as sRGB."""
    two = lambda c: F.lpad(F.lower(F.hex(F.pmod(c, F.lit(256)))), 2, "0")
    return dealt(spark, sf_dir, "events").select(
        "event_id", C.css_color(F.concat(F.lit("#"), two("event_id"), two("user_id"), F.lit("07"))).alias("hex"), C.css_color(F.lit("RebeccaPurple")).alias("named"),
        C.css_color(F.concat(F.lit("rgb("), F.pmod("event_id", F.lit(256)).cast("string"), F.lit(" 0 0)"))).alias("rgb"), C.css_color(F.lit("hsl(0deg 100% 50%)")).alias("hsl"), C.css_color(F.lit("no colour")).alias("bad"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(2, least(l_quantity * 96 / 72 + 10, 60)), 6) AS px FROM lineitem")
def css_clamp_all_lines(spark, sf_dir):
    """Math functions over units for every line of every order."""
    expr = F.concat(F.lit("clamp(2px, calc("), F.col("l_quantity").cast("string"), F.lit("pt + 10px), 60px)"))
    return dealt(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.value_udf(lambda t: css_values.evaluate(t)[0], "double", expr), 6).alias("px"))


# --- timing ---


@query("""
WITH t AS (SELECT event_id, (event_id % 50) / 10.0 AS local FROM events), u AS (SELECT *, least(greatest(local - 1, 0), 3) / 1.5 AS o FROM t)
SELECT event_id, CASE WHEN local < 1 THEN 'before' WHEN local >= 4 THEN 'after' ELSE 'active' END AS phase,
  round(CASE WHEN o >= 2 THEN 0 WHEN CAST(floor(o) AS INTEGER) % 2 = 1 THEN 1 - (o - floor(o)) ELSE o - floor(o) END, 6) AS progress FROM u
""")
def animation_all_phases(spark, sf_dir):
    """Phase and directed progress of an alternating effect over all three phases: two iterations end where they began."""
    from .catalog import QUERIES

    return QUERIES["animation_progress"](spark, sf_dir)


@query("""
SELECT user_id, round(CASE WHEN p < 0.25 THEN p / 0.25 * 10 ELSE 10 + (p - 0.25) / 0.75 * 20 END, 6) AS value FROM (SELECT user_id, (user_id % 10) / 10.0 AS p FROM events)
""")
def keyframes_of_repeated_rows(spark, sf_dir):
    """Keyframes of times that repeat: a row for each."""
    times = table(spark, sf_dir, "events").select("user_id", F.lit("a").alias("name"), (F.pmod("user_id", F.lit(10)) / F.lit(10.0)).alias("progress"))
    frames = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.25, 10.0), ("a", 1.0, 30.0)], "name string, offset double, value double")
    return timing.sample_keyframes(times, frames, ["name"]).select("user_id", F.round("value", 6).alias("value"))


# --- errors, rule index, style hashes, getters of YAML ---


@query("""
SELECT CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'syntax' WHEN 2 THEN 'duplicate-key' ELSE 'number' END AS code, count(*) AS n, CAST(max(CASE event_id % 4 WHEN 1 THEN 2 WHEN 0 THEN NULL ELSE 1 END) AS INTEGER) AS line
FROM events GROUP BY 1
""")
def json_error_counts(spark, sf_dir):
    """Parse errors by code, with the line they stand on."""
    kind = F.pmod("event_id", F.lit(4))
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("[1,\n"), "props")).when(kind == 2, F.lit('{"a":1,"a":2}')).otherwise(F.lit("[NaN]"))
    found = dealt(spark, sf_dir, "events").select(C.json_error(text).alias("e"))
    return found.groupBy(F.col("e.code").alias("code")).agg(F.count("*").alias("n"), F.max("e.line").alias("line"))


@query("SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n_li, len(regexp_extract_all(html, '<div')) AS n_ad, len(regexp_extract_all(html, '<h1>')) AS n_h1, CAST(0 AS BIGINT) AS n_id FROM pages")
def cascade_rule_index(spark, sf_dir):
    """Rules of ids, classes and names matched in one pass by buckets."""
    sheet = "li { a: 1 } div.ad { a: 2 } .ad { a: 3 } h1, h7 { a: 4 } #none { a: 5 } p.ad { a: 6 } * { b: 1 }"
    won = cascade.cascade(cascade.candidates(page_nodes(spark, sf_dir), ["page_id"], sheet), ["page_id"]).where("rank = 1")
    n = lambda v: F.count_if((F.col("prop") == "a") & (F.col("value") == v))
    return won.groupBy("page_id").agg(n("1").alias("n_li"), n("2").alias("n_ad"), n("4").alias("n_h1"), n("5").alias("n_id"))


@query("SELECT page_id, CAST(3 AS BIGINT) AS n_styles FROM pages WHERE contains(html, '<li>') AND contains(html, '<h1>')")
def cascade_style_hash(spark, sf_dir):
    """Elements with the same winning declarations share a style."""
    ranked = cascade.cascade(cascade.candidates(page_nodes(spark, sf_dir), ["page_id"], "li { a: 1; b: 2 } nav a { b: 2; a: 1 } h1 { a: 1 } div { a: 2 } .ad { c: 1 }"), ["page_id"])
    return cascade.style_hash(ranked, ["page_id"]).groupBy("page_id").agg(F.count_distinct("hash").alias("n_styles"))


@query("SELECT n_nationkey, '\"' || n_name || '\"' AS name, CAST(n_regionkey AS VARCHAR) AS region, NULL AS missing FROM nation")
def yaml_pointer_get(spark, sf_dir):
    """Values of a YAML mapping and sequence by pointer."""
    text = F.concat(F.lit("n: {name: '"), "n_name", F.lit("'}\nl:\n- 0\n- "), F.col("n_regionkey").cast("string"), F.lit("\n"))
    return table(spark, sf_dir, "nation").select("n_nationkey", C.yaml_pointer(text, "/n/name").alias("name"), C.yaml_pointer(text, "/l/1").alias("region"), C.yaml_pointer(text, "/l/9").alias("missing"))


# --- grouping sets ---


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark, sf_dir):
    """All grouping sets of two columns."""
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def grouping_rollup(spark, sf_dir):
    """Subtotals of a hierarchy."""
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


# --- streams ---


def run_stream(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """What a stream gives until its input is used up, written to the shared folder batch by batch; output and state go when the driver ends."""
    spark = stream.sparkSession
    home = scratch(spark, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{home}/out")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{home}/out")


def streamed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written down and read again as a stream."""
    kept = stash(df, name)
    return df.sparkSession.readStream.schema(kept.schema).parquet(kept._stashed_at)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) > 0 AS some FROM events GROUP BY 1, 2")
def stream_hourly_windows(spark, sf_dir):
    """Tumbling windows over event time with a watermark."""
    events = streamed(table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id"), "events")
    hours = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), (F.approx_count_distinct("user_id") > 0).alias("some"))
    found = run_stream(hours, "hours", "complete")
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "some")


def _cut(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    """Every nation's text cut into chunks of seven characters."""
    whole = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("stream_id"), text.alias("t"))
    last = F.floor((F.length("t") - 1) / 7)
    parts = whole.select("stream_id", "t", last.alias("end"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    return parts.select("stream_id", "seq", F.expr("substring(t, cast(seq * 7 + 1 as int), 7)").alias("data"), (F.col("seq") == F.col("end")).alias("last"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, unnest([0, 1, 2]) AS record_idx, unnest(['["a", "b,""c"]'.replace('""', chr(92) || '"'), '["' || n_name || '", "x' || chr(92) || 'ny"]', '["' || n_regionkey || '"]']) AS record FROM nation
""")
def stream_csv_chunks(spark, sf_dir):
    """CSV records of texts that arrive in chunks cut anywhere, quotes and line breaks included."""
    text = F.concat(F.lit('a,"b,""c"\r\n'), "n_name", F.lit(',"x\ny"\n'), F.col("n_regionkey").cast("string"))
    found = run_stream(chunks.parse_chunks(streamed(_cut(spark, sf_dir, text), "chunks"), "csv"), "csv", "append")
    return found.where("error is null").select("stream_id", F.col("record_idx").cast("int").alias("record_idx"), "record")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS stream_id, CAST(2 AS BIGINT) AS n_records, n_nationkey % 5 = 0 AS failed FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 1, true FROM nation WHERE n_nationkey % 5 = 0")
def stream_json_chunks(spark, sf_dir):
    """JSON lines in chunks; a stream whose text is bad gives one error row and no more records."""
    bad = F.when(F.pmod("n_nationkey", F.lit(5)) == 0, "[1,").otherwise("[1]")
    text = F.concat(F.lit('{"n": "'), "n_name", F.lit('"}\n'), bad, F.lit("\n"))
    found = run_stream(chunks.parse_chunks(streamed(_cut(spark, sf_dir, text), "chunks"), "json"), "json", "append")
    return found.groupBy("stream_id").agg(F.count("record").alias("n_records"), (F.count("error") > 0).alias("failed"))


# --- small functions ---


@query("SELECT page_id, true AS same, false AS other FROM pages")
def markup_trees_equal(spark, sf_dir):
    """Pages equal their serialized trees, and no page equals one with a class more."""
    pages = dealt(spark, sf_dir, "pages").select("page_id", "html", C.html_normalize("html").alias("written"), F.regexp_replace("html", "<nav>", "<nav class=x>").alias("changed"))
    return pages.select("page_id", C.markup_equal("html", "written").alias("same"), C.markup_equal("html", "changed").alias("other"))


@query("SELECT DISTINCT 'nav' AS name, false AS void, false AS flag FROM pages UNION SELECT 'br', true, false UNION SELECT 'meta', true, false UNION SELECT 'checked', false, true")
def html_element_classes(spark, sf_dir):
    """Void elements and boolean attributes."""
    names = page_nodes(spark, sf_dir).where(F.col("name").isin("nav", "br", "meta")).select("name").distinct().unionByName(spark.range(1).select(F.lit("checked").alias("name")))
    return names.select("name", C.html_is_void("name").alias("void"), C.html_is_boolean_attribute("name").alias("flag"))


@query("""
SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/x/y?q=' || page_id AS rooted, regexp_extract(url, '^(https?:)', 1) || '//other.example/p' AS scheme, 'mailto:a@b' AS whole FROM pages
""")
def uri_resolution(spark, sf_dir):
    """References resolved against each page's address."""
    pages = dealt(spark, sf_dir, "pages")
    q = F.concat(F.lit("/a/../x/./y?q="), F.col("page_id").cast("string"))
    return pages.select("page_id", C.uri_resolve("url", q).alias("rooted"), C.uri_resolve("url", F.lit("//other.example/p")).alias("scheme"), C.uri_resolve("url", F.lit("mailto:a@b")).alias("whole"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS nfc FROM documents")
def unicode_nfc(spark, sf_dir):
    """Texts with a combining accent in normalization form C."""
    return dealt(spark, sf_dir, "documents").select("doc_id", C.unicode_normalize(F.concat("text", F.lit("e\u0301"))).alias("nfc"))


@query("SELECT n_nationkey, [n_name, 'two words', 'a\"b', ''] AS words, (n_regionkey * 1024) :: BIGINT AS size, 31 :: BIGINT AS hex, NULL :: BIGINT AS bad FROM nation")
def ini_words_and_integers(spark, sf_dir):
    """Words of a value with quotes and escapes, integers with bases and suffixes."""
    def words(name: str) -> list[str]:
        return ini_text.split_words(f"'{name}'  \"two words\" a\\\"b ''")

    number = lambda t: C.value_udf(ini_text.integer, "bigint", t)
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", C.value_udf(words, "array<string>", "n_name").alias("words"), number(F.concat(F.col("n_regionkey").cast("string"), F.lit("K"))).alias("size"),
        number(F.lit("0x1F")).alias("hex"), number(F.lit("12x")).alias("bad"),
    )


# --- HTML tree construction ---

_ESCAPED = "replace(replace(replace(replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 10 AS kind, 'x' || {_ESCAPED} AS t FROM documents)
SELECT doc_id, sha256('<html><head></head><body>' || CASE kind
  WHEN 0 THEN '<b></b><p><b>' || t || '</b>tail</p>'
  WHEN 1 THEN '<p>1<b>2<i>' || t || '</i></b><i>4</i>5</p>'
  WHEN 2 THEN t || '<b>' || t || '</b><table><caption>c</caption><tbody><tr><td>d</td></tr></tbody></table><b>e</b>'
  WHEN 3 THEN '<button>1</button><button>' || t || '</button>'
  WHEN 4 THEN '<form><input></form>' || t
  WHEN 5 THEN '<template><tr><td>' || t || '</td></tr></template>'
  WHEN 6 THEN '<p>a<svg viewBox="0"><foreignObject><p>' || t || '</p></foreignObject><title>q</title></svg>z</p>'
  WHEN 7 THEN '<div><a><b></b></a><b></b><div><b><a>' || t || '</a>2</b></div>3</div>'
  WHEN 8 THEN '<svg><g></g></svg><p>' || t || '</p>'
  ELSE '<select><option>' || t || '</option><option>2</option></select><table><colgroup><col></colgroup><tbody><tr><td><a>1</a></td></tr></tbody></table>' END || '</body></html>') AS tree
FROM d
""")
def html_misnested(spark, sf_dir):
    """Trees of damaged pages around whole documents: adoption, foster parents, nested buttons and forms, templates, foreign content."""
    text = F.concat(F.lit("x"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")))
    around = [
        ("<b><p>", "</b>tail</p>"), ("<p>1<b>2<i>", "</b>4</i>5</p>"), None, ("<button>1<button>", ""), ("<form><form><input></form>", ""), ("<body><template><tr><td>", ""),
        ("<p>a<svg viewbox=0><foreignobject><p>", "</p></foreignobject><title>q</title></svg>z"), ("<div><a><b><div>", "</a>2</b></div>3"), ("<svg><g/><p>", ""),
        ("<select><option>", "<option>2</select><table><col><td><a>1</table>"),
    ]
    fostered = F.concat(F.lit("<table>"), text, F.lit("<b>"), text, F.lit("<caption>c<tr><td>d</b></table>e"))
    pages = F.array(*[fostered if x is None else F.concat(F.lit(x[0]), text, F.lit(x[1])) for x in around])
    made = dealt(spark, sf_dir, "documents").select("doc_id", F.element_at(pages, (F.col("doc_id") % 10 + 1).cast("int")).alias("page"))
    return made.select("doc_id", F.sha2(C.html_normalize("page"), 256).alias("tree"))


@query("""
SELECT o_orderkey, unnest([struct_pack(at := 0, path := 'order.id', value := CAST(o_orderkey AS VARCHAR)), struct_pack(at := 1, path := 'customer.id', value := CAST(o_custkey AS VARCHAR)),
  struct_pack(at := 2, path := 'order.state.code', value := o_orderstatus), struct_pack(at := 3, path := 'line.0.q', value := '[1] # no'), struct_pack(at := 4, path := 'line.1.priority', value := o_orderpriority),
  struct_pack(at := 5, path := 'order.note', value := '')], recursive := true) FROM orders
""")
def toml_reopened_tables(spark, sf_dir):
    """Assignments of one document for each order, in document order although its tables are opened again."""
    key, own = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("[order] # first\nid = "), key, F.lit("\n[customer]\nid = "), own, F.lit("\n[order.state]\ncode = '"), "o_orderstatus", F.lit("'\n[[line]]\nq = \"[1] # no\"\n[[line]]\npriority = '''"), "o_orderpriority", F.lit("'''\n[order.note]\n")
    )
    return dealt(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(C.toml_events(text)).alias("at", "e")).select("o_orderkey", "at", "e.path", "e.value")


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS folder FROM pages),
q AS (SELECT *, CASE WHEN folder = '' THEN '/' ELSE folder END AS dir FROM p)
SELECT page_id, scheme || '://' || host || regexp_replace(dir, '[^/]+/$', '') || 'up?q=' || page_id AS up, scheme || '://' || host || dir || 'a/c/' AS dots, regexp_replace(url, '#.*$', '') || '#f' AS fragment,
       'foo://h/' || page_id || '/c' AS other, 'urn:x:' || page_id || '/c' AS rootless FROM q
""")
def uri_references(spark, sf_dir):
    """References with dot segments, queries and fragments resolved against each page's address, and against schemes unknown to the library."""
    n = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", C.uri_resolve("url", F.concat(F.lit("../up?q="), n)).alias("up"), C.uri_resolve("url", F.lit("./a/./b/../c/.")).alias("dots"), C.uri_resolve("url", F.lit("#f")).alias("fragment"),
        C.uri_resolve(F.concat(F.lit("foo://h/"), n, F.lit("/a/b")), F.lit("../c")).alias("other"), C.uri_resolve(F.concat(F.lit("urn:x:"), n, F.lit("/b")), F.lit("c")).alias("rootless"),
    )
