"""Colour spaces by published values, round trips, mixing and gamut mapping."""

import pytest
from pyspark.sql import functions as F

from papyrine.operators import colour as K

#: Colours and their components elsewhere, as the examples of the colour specification give them.
KNOWN = [
    ("red", "oklch", (0.62796, 0.25768, 29.234)), ("lch(29.2345% 44.2 27)", "srgb", (0.49065, 0.13872, 0.15906)), ("#00ff00", "xyz-d65", (0.35758, 0.71517, 0.11919)),
    ("hsl(120deg 100% 25%)", "srgb", (0, 0.5, 0)), ("rebeccapurple", "hsl", (270, 50, 40)), ("color(display-p3 0 1 0)", "srgb", (-0.5116, 1.01827, -0.31067)),
]


@pytest.fixture(scope="module")
def one(spark):
    def value(*columns):
        return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()

    return value


def test_known_components(spark):
    for space in {s for _, s, _ in KNOWN}:
        rows = [(text, list(map(float, c))) for text, s, c in KNOWN if s == space]
        frame = spark.createDataFrame(rows, "t string, wanted array<double>")
        for r in frame.select("t", "wanted", K.to_space(K.parse("t"), space)["c"].alias("c")).collect():
            assert r.c == pytest.approx(r.wanted, abs=2e-4, rel=2e-4), (r.t, space)


def test_every_space_and_back(spark):
    frame = spark.sql("select array(0.2D, 0.55D, 0.8D) c")
    there = frame.select(*[K.convert(K.convert(F.col("c"), "srgb", s), s, "srgb").alias(s) for s in sorted(K.SPACES)])
    assert all(v == pytest.approx([0.2, 0.55, 0.8], abs=1e-6) for v in there.first())
    assert "Python" not in there._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("text", "wanted"), [
    ("#ABC", ("srgb", [2 / 3, 11 / 15, 0.8], 1)), ("#11223380", ("srgb", [1 / 15, 2 / 15, 0.2], 128 / 255)), (" RGBA(255, 0, 0, 50%) ", ("srgb", [1, 0, 0], 0.5)), ("hsl(0.5turn 10% none / none)", ("hsl", [180, 10, None], None)),
    ("color(rec2020 50% 0 1)", ("rec2020", [0.5, 0, 1], 1)), ("transparent", ("srgb", [0, 0, 0], 0)), ("oklch(50% 50% 100grad)", ("oklch", [0.5, 0.2, 90], 1)),
])
def test_texts(one, text, wanted):
    found = one(K.parse(F.lit(text)))[0]
    assert found.space == wanted[0] and found.alpha == (None if wanted[2] is None else pytest.approx(wanted[2]))
    assert [x is None for x in found.c] == [x is None for x in wanted[1]] and [x for x in found.c if x is not None] == pytest.approx([x for x in wanted[1] if x is not None])


def test_no_colours(spark):
    frame = spark.createDataFrame([(t,) for t in ("", "redd", "#12", "#12345", "rgb(1 2)", "rgb(1 2 3 4 5)", "color(nope 1 2 3)", "hsl()", None)], "t string")
    assert [r[0] for r in frame.select(K.hex_text(K.to_space(K.parse("t"), "srgb"))).collect()] == [None] * 9


@pytest.mark.parametrize(("space", "hue", "rows"), [
    ("oklab", "shorter", [("red", "blue", 0.5, "#8c53a2")]), ("hsl", "shorter", [("red", "blue", 0.5, "#ff00ff"), ("red", "lime", 0.5, "#ffff00")]), ("hsl", "longer", [("red", "blue", 0.5, "#00ff00")]),
    ("srgb", "shorter", [("#ff000080", "#0000ff", 0.5, "#5500aac0"), ("rgb(none 0 0)", "white", 0.5, "#ff8080"), ("red", "blue", 0.25, "#bf0040"), ("red", "no colour", 0.5, None)]),
])
def test_mixes(spark, space, hue, rows):
    frame = spark.createDataFrame(rows, "a string, b string, p double, wanted string")
    mixed = K.hex_text(K.to_space(K.mix(K.parse("a"), K.parse("b"), F.col("p"), space, hue), "srgb"))
    assert [r.got for r in frame.select(mixed.alias("got")).collect()] == [r[3] for r in rows]


def test_relative_colours_and_the_gamut(one):
    turned = K.relative(K.parse(F.lit("hsl(350 50% 50%)")), "hsl", lambda h, s, l, a: F.pmod(h + 120, F.lit(360.0)), lambda h, s, l, a: s, lambda h, s, l, a: l / 2, alpha=lambda h, s, l, a: a / 2)  # noqa: E741
    inside, outside, white = one(K.gamut_map(K.parse(F.lit("rgb(10 20 30)"))), K.gamut_map(K.parse(F.lit("color(display-p3 0 1 0)"))), K.gamut_map(K.parse(F.lit("oklch(1.2 0.3 40)"))))
    assert K.hex_text and inside.c == pytest.approx([10 / 255, 20 / 255, 30 / 255]) and white.c == [1, 1, 1]
    assert all(0 <= x <= 1 for x in outside.c) and outside.c[1] > 0.97 and outside.c[0] < 0.05
    assert one(K.hex_text(K.to_space(turned, "srgb")))[0] == "#2b602080"
