"""CSS colours as column expressions: spaces, conversion, mixing, relative colours, gamut mapping.

A colour is ``struct<space, c array<double>, alpha double>``; a component that is
``none`` is null.  Conversions are matrix steps and transfer functions on the array,
bound to lambda variables so that a chain of them stays linear in the plan; no
Python runs for a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.css_values import NAMED

# Fixed values of CSS Color 4: matrices to CIE XYZ (D65; D50 for prophoto-rgb), chromatic adaptation, OKLab.
_TO_XYZ = {
    "srgb": [[506752 / 1228815, 87881 / 245763, 12673 / 70218], [87098 / 409605, 175762 / 245763, 12673 / 175545], [7918 / 409605, 87881 / 737289, 1001167 / 1053270]],
    "display-p3": [[608311 / 1250200, 189793 / 714400, 198249 / 1000160], [35783 / 156275, 247089 / 357200, 198249 / 2500400], [0, 32229 / 714400, 5220557 / 5000800]],
    "a98-rgb": [[573536 / 994567, 263643 / 1420810, 187206 / 994567], [591459 / 1989134, 6239551 / 9945670, 374412 / 4972835], [53769 / 1989134, 351524 / 4972835, 4929758 / 4972835]],
    "rec2020": [[63426534 / 99577255, 20160776 / 139408157, 47086771 / 278816314], [26158966 / 99577255, 472592308 / 697040785, 8267143 / 139408157], [0, 19567812 / 697040785, 295819943 / 278816314]],
    "prophoto-rgb": [[0.7977666449006423, 0.13518129740053308, 0.0313477341283922], [0.2880748288194013, 0.711835234241873, 0.00008993693872564], [0, 0, 0.8251046025104602]],
}
_D65_TO_D50 = [[1.0479297925449969, 0.022946870601609652, -0.05019226628920524], [0.02962780877005599, 0.9904344267538799, -0.017073799063418826], [-0.009243040646204504, 0.015055191490298152, 0.7518742814281371]]
_TO_LMS = [[0.819022437996703, 0.3619062600528904, -0.1288737815209879], [0.0329836539323885, 0.9292868615863434, 0.0361446663506424], [0.0481771893596242, 0.2642395317527308, 0.6335478284694309]]
_LMS_TO_OKLAB = [[0.210454268309314, 0.7936177747023054, -0.0040720430116193], [1.9779985324311684, -2.4285922420485799, 0.450593709617411], [0.0259040424655478, 0.7827717124575296, -0.8086757549230774]]
_D50_WHITE = [0.3457 / 0.3585, 1.0, (1.0 - 0.3457 - 0.3585) / 0.3585]
POLAR = frozenset(("hsl", "hwb", "lch", "oklch"))
#: Place of the hue among the components.
_HUE = {"hsl": 0, "hwb": 0, "lch": 2, "oklch": 2}
SPACES = frozenset(("srgb", "srgb-linear", "hsl", "hwb", "display-p3", "a98-rgb", "prophoto-rgb", "rec2020", "xyz-d50", "xyz-d65", "lab", "lch", "oklab", "oklch"))

Step = Callable[[Column], Column]


def let(value: Column, f: Step) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _matrix(m) -> Step:
    rows = ", ".join(f"array({', '.join(f'{float(x)!r}D' for x in row)})" for row in np.asarray(m, float))
    product = lambda row, v: F.aggregate(F.zip_with(row, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return lambda v: F.transform(F.expr(f"array({rows})"), lambda row: product(row, v))


def _each(f: Step) -> Step:
    return lambda v: F.transform(v, f)


def _signed(f: Step) -> Step:
    """A transfer function carried on to negative values."""
    return lambda x: F.signum(x) * f(F.abs(x))


_SRGB_IN = _signed(lambda x: F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))))
_SRGB_OUT = _signed(lambda x: F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055))
_A, _B = 1.09929682680944, 0.018053968510807
_TRANSFER = {
    "srgb": (_SRGB_IN, _SRGB_OUT), "display-p3": (_SRGB_IN, _SRGB_OUT),
    "a98-rgb": (_signed(lambda x: F.pow(x, F.lit(563 / 256))), _signed(lambda x: F.pow(x, F.lit(256 / 563)))),
    "prophoto-rgb": (_signed(lambda x: F.when(x <= 16 / 512, x / 16).otherwise(F.pow(x, F.lit(1.8)))), _signed(lambda x: F.when(x >= 1 / 512, F.pow(x, F.lit(1 / 1.8))).otherwise(16 * x))),
    "rec2020": (_signed(lambda x: F.when(x < _B * 4.5, x / 4.5).otherwise(F.pow((x + _A - 1) / _A, F.lit(1 / 0.45)))), _signed(lambda x: F.when(x > _B, _A * F.pow(x, F.lit(0.45)) - (_A - 1)).otherwise(4.5 * x))),
}


def _lab_to_xyz(v: Column) -> Column:
    k, e = 24389 / 27, 216 / 24389
    fy = (v[0] + 16) / 116
    back = lambda f: F.when(F.pow(f, F.lit(3)) > e, F.pow(f, F.lit(3))).otherwise((116 * f - 16) / k)
    y = F.when(v[0] > k * e, F.pow(fy, F.lit(3))).otherwise(v[0] / k)
    return F.array(back(v[1] / 500 + fy) * _D50_WHITE[0], y * _D50_WHITE[1], back(fy - v[2] / 200) * _D50_WHITE[2])


def _xyz_to_lab(v: Column) -> Column:
    k, e = 24389 / 27, 216 / 24389
    f = F.transform(F.array(*[v[i] / _D50_WHITE[i] for i in range(3)]), lambda x: F.when(x > e, F.cbrt(x)).otherwise((k * x + 16) / 116))
    return let(f, lambda g: F.array(116 * g[1] - 16, 500 * (g[0] - g[1]), 200 * (g[1] - g[2])))


def _to_polar(v: Column) -> Column:
    return F.array(v[0], F.sqrt(v[1] * v[1] + v[2] * v[2]), F.pmod(F.degrees(F.atan2(v[2], v[1])), F.lit(360.0)))


def _from_polar(v: Column) -> Column:
    return F.array(v[0], v[1] * F.cos(F.radians(v[2])), v[1] * F.sin(F.radians(v[2])))


def _hsl_to_srgb(v: Column) -> Column:
    a = v[1] / 100 * F.least(v[2] / 100, 1 - v[2] / 100)
    one = lambda n: let(F.pmod(n + v[0] / 30, F.lit(12.0)), lambda k: v[2] / 100 - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))
    return F.array(one(F.lit(0.0)), one(F.lit(8.0)), one(F.lit(4.0)))


def _hue_of(v: Column, low: Column, high: Column) -> Column:
    d = high - low
    return F.when(d == 0, F.lit(0.0)).when(high == v[0], 60 * F.pmod((v[1] - v[2]) / d, F.lit(6.0))).when(high == v[1], 60 * ((v[2] - v[0]) / d + 2)).otherwise(60 * ((v[0] - v[1]) / d + 4))


def _srgb_to_hsl(v: Column) -> Column:
    low, high = F.array_min(v), F.array_max(v)
    light = (low + high) / 2
    spread = F.least(light, 1 - light)
    return F.array(_hue_of(v, low, high), F.when(spread == 0, F.lit(0.0)).otherwise((high - light) / spread) * 100, light * 100)


def _hwb_to_srgb(v: Column) -> Column:
    grey = (v[1] + v[2]) / 100
    pure = let(F.array(v[0], F.lit(100.0), F.lit(50.0)), _hsl_to_srgb)
    return F.when(grey >= 1, F.array_repeat(v[1] / 100 / grey, 3)).otherwise(F.transform(pure, lambda x: x * (1 - grey) + v[1] / 100))


def _srgb_to_hwb(v: Column) -> Column:
    low, high = F.array_min(v), F.array_max(v)
    return F.array(_hue_of(v, low, high), low * 100, (1 - high) * 100)


_D50_TO_D65 = np.linalg.inv(_D65_TO_D50)
_OKLAB_TO_LMS, _FROM_LMS = np.linalg.inv(_LMS_TO_OKLAB), np.linalg.inv(_TO_LMS)


def _steps_in(space: str) -> list[Step]:
    """From a space to XYZ (D65)."""
    if space == "xyz-d65":
        return []
    if space == "xyz-d50":
        return [_matrix(_D50_TO_D65)]
    if space == "srgb-linear":
        return [_matrix(_TO_XYZ["srgb"])]
    if space in _TRANSFER:
        return [_each(_TRANSFER[space][0]), _matrix(_TO_XYZ[space]), *([_matrix(_D50_TO_D65)] if space == "prophoto-rgb" else [])]
    if space in ("hsl", "hwb"):
        return [_hsl_to_srgb if space == "hsl" else _hwb_to_srgb, *_steps_in("srgb")]
    if space in ("lch", "oklch"):
        return [_from_polar, *_steps_in(space.replace("lch", "lab"))]
    if space == "lab":
        return [_lab_to_xyz, _matrix(_D50_TO_D65)]
    return [_matrix(_OKLAB_TO_LMS), _each(lambda x: x * x * x), _matrix(_FROM_LMS)]


def _steps_out(space: str) -> list[Step]:
    """From XYZ (D65) to a space."""
    if space == "xyz-d65":
        return []
    if space == "xyz-d50":
        return [_matrix(_D65_TO_D50)]
    if space == "srgb-linear":
        return [_matrix(np.linalg.inv(_TO_XYZ["srgb"]))]
    if space in _TRANSFER:
        return [*([_matrix(_D65_TO_D50)] if space == "prophoto-rgb" else []), _matrix(np.linalg.inv(_TO_XYZ[space])), _each(_TRANSFER[space][1])]
    if space in ("hsl", "hwb"):
        return [*_steps_out("srgb"), _srgb_to_hsl if space == "hsl" else _srgb_to_hwb]
    if space in ("lch", "oklch"):
        return [*_steps_out(space.replace("lch", "lab")), _to_polar]
    if space == "lab":
        return [_matrix(_D65_TO_D50), _xyz_to_lab]
    return [_matrix(_TO_LMS), _each(F.cbrt), _matrix(_LMS_TO_OKLAB)]


def convert(v: Column, source: str, target: str) -> Column:
    """Components in ``target`` of components in ``source``; a missing one counts as 0."""
    if not {source, target} <= SPACES:
        raise ValueError(f"unknown colour space: {source} or {target}")
    v = F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))
    if source == target:
        return v
    if {source, target} <= {"srgb", "hsl", "hwb"}:
        srgb = v if source == "srgb" else let(v, _hsl_to_srgb if source == "hsl" else _hwb_to_srgb)
        return srgb if target == "srgb" else let(srgb, _srgb_to_hsl if target == "hsl" else _srgb_to_hwb)
    return reduce(let, [*_steps_in(source), *_steps_out(target)], v)


# --- text ---

_NUM = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
_PART = rf"(?:{_NUM}(?:%|deg|grad|rad|turn)?|none)"
_SEPARATED = rf"\s*({_PART})\s*[\s,]\s*({_PART})\s*[\s,]\s*({_PART})\s*(?:[,/]\s*({_PART})\s*)?"
#: What 100 % of each component stands for, by function.
_FULL = {"rgb": (255, 255, 255), "hsl": (360, 100, 100), "hwb": (360, 100, 100), "lab": (100, 125, 125), "lch": (100, 150, 360), "oklab": (1, 0.4, 0.4), "oklch": (1, 0.4, 360)}
COLOUR = "struct<space: string, c: array<double>, alpha: double>"


def _number(text: Column, full: Column) -> Column:
    """A component; an angle in degrees, a percentage of ``full``, ``none`` as null."""
    size = F.regexp_extract(text, rf"^({_NUM})", 1).try_cast("double")
    unit = F.regexp_extract(text, "(%|[a-z]+)$", 1)
    per = F.when(unit == "%", full / 100).when(unit == "grad", 0.9).when(unit == "turn", 360.0).when(unit == "rad", 180 / math.pi).otherwise(1.0)
    return F.when(text != "none", size * per)


def parse(text: Column | str) -> Column:
    """Colour of a CSS text: names, hex, rgb(), hsl(), hwb(), lab(), lch(), oklab(), oklch(), color(); null for any other text."""
    raw = F.lower(F.trim(F.col(text) if isinstance(text, str) else text))
    names = F.create_map(*[F.lit(x) for name, code in NAMED.items() for x in (name, "#" + code)])
    plain = F.coalesce(F.try_element_at(names, raw), F.when(raw == "transparent", "#00000000").otherwise(raw))
    return let(plain, _parsed)


def _parsed(own: Column) -> Column:
    digits = F.regexp_extract(own, "^#([0-9a-f]+)$", 1)
    wide = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    bytes_ = F.transform(F.regexp_extract_all(F.rpad(wide, 8, "f"), F.lit("(..)"), 1), lambda x: F.conv(x, 16, 10).try_cast("double") / 255)
    by_hex = let(bytes_, lambda v: F.struct(F.lit("srgb").alias("space"), F.slice(v, 1, 3).alias("c"), v[3].alias("alpha")))
    full = F.create_map(*[x for name, f in _FULL.items() for x in (F.lit(name), F.array(*[F.lit(float(v)) for v in f]))])
    name = F.regexp_replace(F.regexp_extract(own, r"^([a-z]+)\(", 1), "^(rgb|hsl)a$", "$1")
    words = F.filter(F.split(F.regexp_replace(F.regexp_extract(own, r"\((.*)\)$", 1), "[,/]", " "), r"\s+"), lambda x: x != "")
    call = F.struct(name.alias("name"), words.alias("words"))

    def components(x: Column) -> Column:
        of_space = x["name"] == "color"
        parts = F.when(of_space, F.slice(x["words"], 2, 4)).otherwise(x["words"])
        space = F.when(of_space, F.regexp_replace(x["words"][0], "^xyz$", "xyz-d65")).when(x["name"] == "rgb", "srgb").otherwise(x["name"])
        scale = F.coalesce(F.try_element_at(full, x["name"]), F.array_repeat(F.lit(1.0), 3))
        c = F.transform(F.slice(parts, 1, 3), lambda v, i: _number(v, scale[i]) / F.when(x["name"] == "rgb", 255.0).otherwise(1.0))
        given = let(_number(F.try_element_at(parts, F.lit(4)), F.lit(1.0)), lambda v: F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))
        alpha = F.when(F.size(parts) < 4, F.lit(1.0)).otherwise(given)
        return F.struct(space.alias("space"), c.alias("c"), alpha.alias("alpha"))

    spaced = _SEPARATED.replace(r"[\s,]", r"\s")
    called = own.rlike(rf"^(?:rgba?|hsla?|hwb|(?:ok)?lab|(?:ok)?lch)\({_SEPARATED}\)$|^color\(\s*(?:{'|'.join([*_TRANSFER, 'srgb-linear', 'xyz(?:-d50|-d65)?'])})\s+{spaced}\)$")
    return F.when(F.length(digits).isin(3, 4, 6, 8), by_hex).when(called, let(call, components))


def to_space(colour: Column, target: str) -> Column:
    """A colour in another space; one that is there already keeps its missing components."""

    near = {"srgb", "hsl", "hwb"}

    def moved(x: Column) -> Column:
        filled = F.transform(x["c"], lambda v: F.coalesce(v, F.lit(0.0)))
        xyz = filled  # of whatever space into XYZ, then one chain from there
        for source in sorted(SPACES - {target, "xyz-d65"}):
            xyz = F.when(x["space"] == source, reduce(let, _steps_in(source), filled)).otherwise(xyz)
        out = reduce(let, _steps_out(target), xyz)
        for source in sorted(near - {target}) if target in near else ():
            out = F.when(x["space"] == source, convert(x["c"], source, target)).otherwise(out)
        out = F.when(x["space"] == target, x["c"]).otherwise(out)
        return F.when(x.isNotNull(), F.struct(F.lit(target).alias("space"), out.alias("c"), x["alpha"].alias("alpha")))

    return let(colour, moved)


def mix(a: Column, b: Column, share: Column, space: str = "oklab", hue: str = "shorter") -> Column:
    """``color-mix(in space, a, b share)``: ``share`` (0 to 1) of ``b``, components premultiplied by alpha, hues by the way named.

    A component missing in one colour is taken from the other.
    """
    share = F.lit(share) if not isinstance(share, Column) else share

    def mixed(both: Column) -> Column:
        x, y, p = both["a"], both["b"], both["p"]
        one_alpha = F.coalesce(x["alpha"], y["alpha"], F.lit(1.0))
        two_alpha = F.coalesce(y["alpha"], x["alpha"], F.lit(1.0))
        alpha = one_alpha * (1 - p) + two_alpha * p
        parts = []
        for i in range(3):
            u, v = F.coalesce(x["c"][i], y["c"][i], F.lit(0.0)), F.coalesce(y["c"][i], x["c"][i], F.lit(0.0))
            if _HUE.get(space) == i:
                d = F.pmod(v - u, F.lit(360.0))
                turn = {"shorter": F.when(d > 180, d - 360).otherwise(d), "longer": F.when((d > 0) & (d < 180), d - 360).otherwise(d), "increasing": d, "decreasing": F.when(d > 0, d - 360).otherwise(d)}[hue]
                parts.append(F.pmod(u + turn * p, F.lit(360.0)))
            else:
                parts.append(F.when(alpha == 0, u * (1 - p) + v * p).otherwise((u * one_alpha * (1 - p) + v * two_alpha * p) / alpha))
        return F.struct(F.lit(space).alias("space"), F.array(*parts).alias("c"), alpha.alias("alpha"))

    both = F.struct(to_space(a, space).alias("a"), to_space(b, space).alias("b"), share.cast("double").alias("p"))
    return let(both, lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), mixed(x)))


def relative(colour: Column, space: str, *channels: Callable[[Column, Column, Column, Column], Column], alpha: Callable[[Column, Column, Column, Column], Column] | None = None) -> Column:
    """A relative colour: each channel a function of the origin's (c1, c2, c3, alpha) in ``space``."""

    def made(x: Column) -> Column:
        own = (*(F.coalesce(x["c"][i], F.lit(0.0)) for i in range(3)), x["alpha"])
        new_alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), alpha(*own))) if alpha else x["alpha"]
        return F.struct(F.lit(space).alias("space"), F.array(*[f(*own).cast("double") for f in channels]).alias("c"), new_alpha.alias("alpha"))

    return let(to_space(colour, space), lambda x: F.when(x.isNotNull(), made(x)))


def in_gamut(v: Column, slack: float = 0.000_075) -> Column:
    return F.forall(v, lambda x: (x >= -slack) & (x <= 1 + slack))


def gamut_map(colour: Column, target: str = "srgb", rounds: int = 24) -> Column:
    """The colour in an RGB space, its OKLCH chroma reduced by bisection until clipping is not noticed (0.02 in OKLab)."""

    def clip(v: Column) -> Column:
        return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))

    def apart(v: Column, lch: Column) -> Column:
        lab = let(lch, _from_polar)
        return let(F.array(convert(v, target, "oklab"), lab), lambda p: F.sqrt(F.aggregate(F.zip_with(p[0], p[1], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))

    def bisect(lch: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("low"), lch[1].alias("high"))

        def step(s: Column, _: Column) -> Column:
            middle = (s["low"] + s["high"]) / 2

            def judged(m: Column) -> Column:
                own = F.array(lch[0], m, lch[2])
                fits = let(convert(own, "oklch", target), lambda v: in_gamut(v) | (apart(clip(v), own) < 0.02))
                return F.struct(F.when(fits, m).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(m).alias("high"))

            return let(middle, judged)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, step, lambda s: s["low"])
        return clip(convert(F.array(lch[0], found, lch[2]), "oklch", target))

    def mapped(x: Column) -> Column:
        lch = to_space(x, "oklch")["c"]
        own = to_space(x, target)["c"]
        hard = let(lch, lambda v: F.when(v[0] >= 1, F.array_repeat(F.lit(1.0), 3)).when(v[0] <= 0, F.array_repeat(F.lit(0.0), 3)).otherwise(bisect(v)))
        return F.struct(F.lit(target).alias("space"), F.when(in_gamut(own), clip(own)).otherwise(hard).alias("c"), x["alpha"].alias("alpha"))

    return let(colour, lambda x: F.when(x.isNotNull(), mapped(x)))


def hex_text(colour: Column) -> Column:
    """``#rrggbb`` or ``#rrggbbaa`` of an sRGB colour, components clipped."""
    digits = lambda x: F.lpad(F.lower(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) * 255).cast("long"))), 2, "0")

    def text(x: Column) -> Column:
        parts = F.concat(F.lit("#"), *[digits(x["c"][i]) for i in range(3)])
        return F.when(x.isNotNull(), F.concat(parts, F.when(F.coalesce(x["alpha"], F.lit(1.0)) < 1, digits(x["alpha"])).otherwise(F.lit(""))))

    return let(colour, text)
