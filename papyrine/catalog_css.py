"""Queries of CSS values: grammars, shorthands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import page_nodes, query, table
from .operators import cascade, colour, css_declarations, rule_index, selectors
from .runtime import spread, stash


def line_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One declaration for each line of an order: seven properties by line number, values from its columns."""
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey").cast("int")
    n = F.col("l_linenumber")
    value = (
        F.when(n == 1, F.concat(q, F.lit("PX")))
        .when(n == 2, F.concat(q - 25, F.lit("%")))
        .when(n == 3, F.concat(F.lit("RGB("), q, F.lit(", 0,"), p % 256, F.lit(")")))
        .when(n == 4, F.when(p % 3 == 0, F.lit("auto")).when(p % 3 == 1, F.concat(q, F.lit(".50"))).otherwise(q.cast("string")))
        .when(n == 5, F.when(p % 2 == 0, F.concat(F.lit("inset "), q, F.lit("px 1px red, none"))).otherwise(F.concat(F.lit("Red "), q, F.lit("px -1px"))))
        .when(n == 6, F.concat(F.lit("calc("), q, F.lit("px + var(--gap))")))
        .otherwise(F.concat(F.lit("[a b] "), q, F.lit("FR repeat(2,[c] minmax(1px ,Auto))")))
    )
    name = F.element_at(F.array(*map(F.lit, ["width", "padding-left", "color", "z-index", "box-shadow", "height", "grid-template-columns"])), n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", name.alias("property"), value.alias("value"))


_Q = "CAST(l_quantity AS INTEGER)"


@query(f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, {_Q} AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
  CASE WHEN l_linenumber = 2 AND q < 25 OR l_linenumber = 4 AND l_partkey % 3 = 1 OR l_linenumber = 5 AND l_partkey % 2 = 0 THEN 'no-match' WHEN l_linenumber = 6 THEN 'pending' ELSE 'match' END AS status,
  CASE l_linenumber WHEN 1 THEN '<length-percentage [0,∞]>' WHEN 2 THEN CASE WHEN q >= 25 THEN '<percentage [0,∞]>' END WHEN 3 THEN '<rgb()>'
    WHEN 4 THEN CASE l_partkey % 3 WHEN 0 THEN 'auto' WHEN 2 THEN '<integer>' END WHEN 5 THEN CASE WHEN l_partkey % 2 = 1 THEN '<shadow>#' END WHEN 7 THEN '<track-list>' END AS branch,
  CASE l_linenumber WHEN 1 THEN q || 'px' WHEN 2 THEN CASE WHEN q >= 25 THEN (q - 25) || '%' END WHEN 3 THEN 'rgb(' || q || ', 0, ' || l_partkey % 256 || ')'
    WHEN 4 THEN CASE l_partkey % 3 WHEN 0 THEN 'auto' WHEN 2 THEN '' || q END WHEN 5 THEN CASE WHEN l_partkey % 2 = 1 THEN 'red ' || q || 'px -1px' END
    WHEN 6 THEN 'calc(' || q || 'px + var(--gap))' ELSE '[a b] ' || q || 'fr repeat(2, [c] minmax(1px, auto))' END AS text,
  CASE WHEN l_linenumber = 2 AND q < 25 OR l_linenumber = 4 AND l_partkey % 3 = 1 THEN 0 WHEN l_linenumber = 5 AND l_partkey % 2 = 0 THEN length('inset ' || q || 'px 1px red, ') END AS "offset"
FROM x
""")
def css_grammar_branches(spark, sf_dir):
    """Declarations of all lines matched against the grammars of their properties: status, branch, canonical text, place of the failure."""
    found = css_declarations.match(line_declarations(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "status", "branch", "text", "offset")


@query("""
WITH x AS (SELECT o_orderkey, o_orderkey % 6 AS c, CAST(o_custkey % 50 AS VARCHAR) AS k FROM orders),
y AS (SELECT o_orderkey, k, c, unnest(CASE c
  WHEN 0 THEN ['margin-top=' || k || 'px', 'margin-right=auto', 'margin-bottom=' || k || 'px', 'margin-left=auto']
  WHEN 1 THEN ['border-left-width=' || k || 'px', 'border-left-style=dashed', 'border-left-color=currentcolor']
  WHEN 2 THEN ['font-style=italic', 'font-variant-caps=normal', 'font-weight=bold', 'font-width=normal', 'font-size=' || k || 'px', 'line-height=1.5', 'font-family="A b", serif']
  WHEN 3 THEN ['flex-grow=' || k, 'flex-shrink=1', 'flex-basis=0px']
  WHEN 4 THEN ['background-color=#fff', 'background-image=url("a.png")', 'background-position=left ' || k || '%', 'background-size=cover', 'background-repeat=no-repeat', 'background-attachment=scroll', 'background-origin=padding-box', 'background-clip=border-box']
  ELSE ['overflow-x=', 'overflow-y='] END) AS p FROM x)
SELECT o_orderkey, split_part(p, '=', 1) AS longhand, nullif(split_part(p, '=', 2), '') AS longhand_value FROM y
""")
def css_shorthand_longhands(spark, sf_dir):
    """Shorthands of six kinds, one for each order, as rows of longhands with initial values for what they leave out."""
    k, c = (F.col("o_custkey") % 50).cast("string"), F.col("o_orderkey") % 6
    cases = [
        ("margin", F.concat(k, F.lit("px AUTO"))), ("border-left", F.concat(F.lit("dashed "), k, F.lit("px"))), ("font", F.concat(F.lit("bold italic "), k, F.lit("px/1.50 'A b', serif"))),
        ("flex", k), ("background", F.concat(F.lit("left "), k, F.lit("% / cover url(a.png) no-repeat #fff"))), ("overflow", F.lit("var(--o)")),
    ]
    name = F.element_at(F.array(*[F.lit(n) for n, _ in cases]), (c + 1).cast("int"))
    value = F.element_at(F.array(*[v for _, v in cases]), (c + 1).cast("int"))
    made = css_declarations.longhands(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("property"), value.alias("value")))
    return made.select("o_orderkey", "longhand", "longhand_value")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'margin-right' WHEN 1 THEN 'height' ELSE 'border-bottom-left-radius' END AS longhand, p_size || 'px' AS longhand_value FROM part
""")
def css_logical_properties(spark, sf_dir):
    """Logical properties as physical ones in a right-to-left horizontal page."""
    name = F.element_at(F.array(*map(F.lit, ["margin-inline-start", "block-size", "border-end-end-radius"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("longhand"), F.concat("p_size", F.lit("px")).alias("longhand_value"))
    return css_declarations.physical(rows, direction="rtl")


@query("""
WITH p AS (SELECT page_id, len(regexp_extract_all(html, '<li><a href=')) AS li, len(regexp_extract_all(html, '<h1>')) AS h1, len(regexp_extract_all(html, '<div class="ad">')) AS ad FROM pages),
c AS (SELECT page_id, unnest(['nav li a', 'body > nav ul > li + li', 'li:nth-child(2n) > a[href^="/"]', 'article h1', '.ad ~ article > h1']) AS selector,
  unnest([li, greatest(li - 1, 0), li // 2, h1, CASE WHEN ad > 0 THEN h1 ELSE 0 END]) AS n FROM p)
SELECT page_id, selector, n FROM c WHERE n > 0
""")
def css_sheet_of_two_thousand_rules(spark, sf_dir):
    """A sheet of 2,000 complex rules in one plan: elements a selector matches in each page, for those that match any."""
    sheet = [f"article.k{i} > div .c{i} + p" for i in range(1995)] + ["nav li a", "body > nav ul > li + li", 'li:nth-child(2n) > a[href^="/"]', "article h1", ".ad ~ article > h1"]
    found = rule_index.hits(page_nodes(spark, sf_dir), ["page_id"], sheet)
    return found.groupBy("page_id", "selector").agg(F.count("*").alias("n"))


@query("""
WITH q AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_quantity) AS qs FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, unnest(range(0, len(qs))) AS nth, qs FROM q)
SELECT l_orderkey, CAST(nth AS BIGINT) AS nth, CASE WHEN list_max(list_transform(qs[1:nth + 1], lambda x: CASE WHEN x > 25 THEN 1 ELSE 0 END)) = 1
  THEN 'rgb-' || list_filter(qs[1:nth + 1], lambda x: x > 25)[-1] ELSE 'canvastext' END AS color FROM u
""")
def css_inheritance_through_nesting(spark, sf_dir):
    """Each order as nested elements, one inside the other: the colour of each comes from the nearest element around it that sets one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("lines"))
    opened = F.array_join(F.transform("lines", lambda x: F.when(x["l_quantity"] > 25, F.concat(F.lit("<div style='color: rgb-"), x["l_quantity"].cast("int"), F.lit("'>"))).otherwise("<div>")), "")
    nodes = stash(selectors.node_table(spread(lines.select("l_orderkey", opened.alias("page"))), ["l_orderkey"], "page"), "nodes")
    ranked = cascade.cascade(cascade.inline_candidates(nodes, ["l_orderkey"]), ["l_orderkey"])
    found = cascade.computed(nodes, ["l_orderkey"], ranked, "color").where("pre > 3")
    return found.select("l_orderkey", (F.col("pre") - 4).cast("long").alias("nth"), F.col("value").alias("color"))


def event_colour() -> Column:
    """A hex colour of two bytes of an event's ids and 07."""
    two = lambda c: F.lpad(F.lower(F.hex(F.pmod(c, F.lit(256)))), 2, "0")
    return F.concat(F.lit("#"), two(F.col("event_id")), two(F.col("user_id")), F.lit("07"))


@query("""
WITH c AS (SELECT event_id, event_id % 256 AS r, user_id % 256 AS g FROM events),
m AS (SELECT event_id, [CAST(round((2 * r + 255) / 3) AS BIGINT), CAST(round(2 * g / 3) AS BIGINT), CAST(round((14 + 0) / 3) AS BIGINT)] AS v FROM c)
SELECT event_id, '#' || array_to_string(list_transform(v, lambda x: lower(lpad(to_hex(x), 2, '0'))), '') AS mixed FROM m
""")
def css_color_mix(spark, sf_dir):
    """color-mix(in srgb, a third of red) of the colour of every event, by column expressions."""
    mixed = colour.mix(colour.parse(event_colour()), colour.parse(F.lit("red")), F.lit(1 / 3), "srgb")
    return table(spark, sf_dir, "events").select("event_id", colour.hex_text(mixed).alias("mixed"))


@query("""
WITH c AS (SELECT event_id, [(event_id % 256) / 255.0, (user_id % 256) / 255.0, 7 / 255.0] AS v FROM events),
l AS (SELECT event_id, list_transform(v, lambda x: CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE pow((x + 0.055) / 1.055, 2.4) END) AS v FROM c),
s AS (SELECT event_id, cbrt(0.4122214694707629 * v[1] + 0.5363325372617349 * v[2] + 0.0514459932675022 * v[3]) AS a, cbrt(0.2119034958178251 * v[1] + 0.6806995506452344 * v[2] + 0.1073969535369405 * v[3]) AS b,
  cbrt(0.0883024591900564 * v[1] + 0.2817188391361215 * v[2] + 0.6299787016738222 * v[3]) AS c FROM l)
SELECT event_id, round(0.2104542683093140 * a + 0.7936177747023054 * b - 0.0040720430116193 * c, 4) + 0.0 AS lightness, round(1.9779985324311684 * a - 2.4285922420485799 * b + 0.4505937096174110 * c, 4) + 0.0 AS green_red,
  round(0.0259040424655478 * a + 0.7827717124575296 * b - 0.8086757549230774 * c, 4) + 0.0 AS blue_yellow FROM s
""")
def css_color_to_oklab(spark, sf_dir):
    """The colour of every event in OKLab."""
    lab = colour.to_space(colour.parse(event_colour()), "oklab")
    return table(spark, sf_dir, "events").select("event_id", lab["c"].alias("c")).select(
        "event_id", (F.round(F.col("c")[0], 4) + F.lit(0.0)).alias("lightness"), (F.round(F.col("c")[1], 4) + F.lit(0.0)).alias("green_red"), (F.round(F.col("c")[2], 4) + F.lit(0.0)).alias("blue_yellow")
    )
