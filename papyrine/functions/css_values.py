"""CSS values: math functions, units, colours, easing curves."""

from __future__ import annotations

import math
import re

from .errors import TextError

#: Units by their size in the canonical unit of their kind.
UNITS = {
    "px": ("px", 1.0), "in": ("px", 96.0), "cm": ("px", 96 / 2.54), "mm": ("px", 96 / 25.4), "q": ("px", 96 / 101.6), "pt": ("px", 96 / 72), "pc": ("px", 16.0),
    "deg": ("deg", 1.0), "grad": ("deg", 0.9), "rad": ("deg", 180 / math.pi), "turn": ("deg", 360.0),
    "s": ("s", 1.0), "ms": ("s", 0.001), "hz": ("hz", 1.0), "khz": ("hz", 1000.0), "dppx": ("dppx", 1.0), "x": ("dppx", 1.0), "dpi": ("dppx", 1 / 96), "dpcm": ("dppx", 2.54 / 96),
}
_TOKEN = re.compile(r"\s*(?:([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(%|[a-zA-Z]+)?|([a-zA-Z_-][\w-]*)(\()?|([-+*/(),]))")
Value = tuple[float, str]


def evaluate(text: str, relative: dict[str, float] | None = None) -> Value:
    """(number, unit) of a math expression, in canonical units; ``relative`` gives px by unit (em, rem, vw, ...)."""
    return _Math(text, relative or {}).whole()


class _Math:
    def __init__(self, text: str, relative: dict[str, float]):
        self.t, self.at, self.relative = text.strip(), 0, relative

    def fail(self, message: str):
        raise TextError("css-math", message, self.t, self.at)

    def whole(self) -> Value:
        out = self.sum()
        if self.t[self.at :].strip():
            self.fail("unexpected text")
        return out

    def look(self, *signs: str) -> str | None:
        m = re.compile(r"\s*").match(self.t, self.at)
        for s in signs:
            if self.t.startswith(s, m.end()):
                return s
        return None

    def take(self, sign: str) -> None:
        m = re.compile(r"\s*" + re.escape(sign)).match(self.t, self.at)
        if not m:
            self.fail(f"{sign!r} is expected")
        self.at = m.end()

    def sum(self) -> Value:
        out = self.product()
        while m := re.compile(r"\s+([+-])\s+").match(self.t, self.at):
            self.at = m.end()
            other = self.product()
            if out[1] != other[1]:
                self.fail("units differ")
            out = (out[0] + other[0] if m[1] == "+" else out[0] - other[0], out[1])
        return out

    def product(self) -> Value:
        out = self.unit()
        while s := self.look("*", "/"):
            self.take(s)
            other = self.unit()
            if s == "*":
                if out[1] and other[1]:
                    self.fail("two units cannot be multiplied")
                out = (out[0] * other[0], out[1] or other[1])
            else:
                unit = "" if other[1] == out[1] else out[1]
                if other[1] and other[1] != out[1]:
                    self.fail("units cannot be divided")
                out = (out[0] / other[0] if other[0] else math.copysign(math.inf, out[0]) if out[0] else math.nan, unit)
        return out

    def unit(self) -> Value:
        m = _TOKEN.match(self.t, self.at)
        if not m:
            self.fail("a value is expected")
        self.at = m.end()
        if m[1] is not None:
            number, unit = float(m[1]), (m[2] or "").lower()
            if unit in self.relative:
                return number * self.relative[unit], "px"
            if unit in UNITS:
                kind, size = UNITS[unit]
                return number * size, kind
            if unit not in ("", "%"):
                self.fail(f"unknown unit {unit!r}")
            return number, unit
        if m[5] == "(":
            out = self.sum()
            self.take(")")
            return out
        name = (m[3] or "").lower()
        if not m[4]:
            constants = {"pi": math.pi, "e": math.e, "infinity": math.inf, "-infinity": -math.inf, "nan": math.nan}
            if name in constants:
                return constants[name], ""
            self.fail(f"unknown name {name!r}")
        return self.function(name)

    def function(self, name: str) -> Value:
        strategy = "nearest"
        if name == "round" and (m := re.compile(r"\s*(nearest|up|down|to-zero)\s*,").match(self.t, self.at)):
            strategy, self.at = m[1], m.end()
        args: list[Value | None] = []
        while True:
            if name == "clamp" and (m := re.compile(r"\s*none").match(self.t, self.at)):
                args.append(None)
                self.at = m.end()
            else:
                args.append(self.sum())
            if self.look(","):
                self.take(",")
                continue
            self.take(")")
            break
        units = {a[1] for a in args if a}
        v = [a[0] if a else None for a in args]
        same = name in ("min", "max", "clamp", "hypot", "mod", "rem", "round", "atan2")
        if same and len(units) > 1 and not (name == "round" and len(args) == 1):
            self.fail("units differ")
        unit = next(iter(units), "")
        angle = lambda x: math.radians(x) if unit == "deg" else x
        try:
            if name == "calc" and len(v) == 1:
                return v[0], unit
            if name in ("min", "max", "hypot") and v:
                return {"min": min, "max": max, "hypot": lambda x: math.hypot(*x)}[name](v), unit
            if name == "clamp" and len(v) == 3:
                low, x, high = v
                x = x if high is None else min(x, high)
                return (x if low is None else max(low, x)), unit
            if name in ("sin", "cos", "tan") and len(v) == 1:
                return getattr(math, name)(angle(v[0])), ""
            if name in ("asin", "acos", "atan") and len(v) == 1:
                return math.degrees(getattr(math, name)(v[0])), "deg"
            if name == "atan2" and len(v) == 2:
                return math.degrees(math.atan2(*v)), "deg"
            if name == "pow" and len(v) == 2:
                return v[0] ** v[1], ""
            if name in ("sqrt", "exp") and len(v) == 1:
                return getattr(math, name)(v[0]), ""
            if name == "log" and len(v) in (1, 2):
                return math.log(*v), ""
            if name == "abs" and len(v) == 1:
                return abs(v[0]), unit
            if name == "sign" and len(v) == 1:
                return float((v[0] > 0) - (v[0] < 0)), ""
            if name in ("mod", "rem") and len(v) == 2:
                return (v[0] - v[1] * math.floor(v[0] / v[1]) if name == "mod" else math.fmod(v[0], v[1])), unit
            if name == "round" and len(v) in (1, 2):
                step = v[1] if len(v) == 2 else 1.0
                q = v[0] / step
                whole = {"nearest": math.floor(q + 0.5), "up": math.ceil(q), "down": math.floor(q), "to-zero": math.trunc(q)}[strategy]
                return whole * step, unit
        except (ValueError, ZeroDivisionError, OverflowError):
            return math.nan, unit
        self.fail(f"{name}() is unknown or has other arguments")


#: The named colours of CSS Color 4.
NAMED = dict(
    pair.split(":") for pair in (
        "aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000 blanchedalmond:ffebcd blue:0000ff "
        "blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c "
        "cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b darkmagenta:8b008b "
        "darkolivegreen:556b2f darkorange:ff8c00 darkorchid:9932cc darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f "
        "darkslategrey:2f4f4f darkturquoise:00ced1 darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff firebrick:b22222 "
        "floralwhite:fffaf0 forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520 gray:808080 green:008000 greenyellow:adff2f "
        "grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0 khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5 lawngreen:7cfc00 "
        "lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080 lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3 lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 "
        "lightsalmon:ffa07a lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899 lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 "
        "limegreen:32cd32 linen:faf0e6 magenta:ff00ff maroon:800000 mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db mediumseagreen:3cb371 "
        "mediumslateblue:7b68ee mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585 midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5 "
        "navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa palegreen:98fb98 "
        "paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd powderblue:b0e0e6 purple:800080 rebeccapurple:663399 "
        "red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072 sandybrown:f4a460 seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 "
        "skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090 snow:fffafa springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 "
        "transparent:00000000 turquoise:40e0d0 violet:ee82ee wheat:f5deb3 white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32"
    ).split()
)


def color(text: str) -> tuple[float, float, float, float]:
    """sRGB components (0 to 255) and alpha of a colour: hex, rgb, hsl, hwb, lab, lch, oklab, oklch, basic names."""
    raw = text.strip().lower()
    raw = f"#{NAMED[raw]}" if raw in NAMED else raw
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", raw):
        digits = m[1] if len(m[1]) > 4 else "".join(c + c for c in m[1])
        parts = [int(digits[i : i + 2], 16) for i in range(0, len(digits), 2)]
        return (*map(float, parts[:3]), parts[3] / 255 if len(parts) > 3 else 1.0)
    m = re.fullmatch(r"(rgba?|hsla?|hwb|lab|lch|oklab|oklch)\((.*)\)", raw, re.S)
    if not m:
        raise TextError("color", "not a colour", text, 0)
    body, _, alpha = m[2].partition("/")
    parts = [p for p in re.split(r"[\s,]+", body.strip()) if p]
    if not alpha and len(parts) == 4:
        alpha = parts.pop()
    if len(parts) != 3:
        raise TextError("color", "three components are expected", text, 0)

    def number(p: str, per_cent: float) -> float:
        if p == "none":
            return 0.0
        value, unit = evaluate(p)
        return value * per_cent / 100 if unit == "%" else value

    kind = m[1].rstrip("a") if m[1] in ("rgba", "hsla") else m[1]
    a = min(1.0, max(0.0, number(alpha.strip(), 1.0))) if alpha.strip() else 1.0
    if kind == "rgb":
        out = [number(p, 255.0) for p in parts]
    elif kind in ("hsl", "hwb"):
        h, x, y = number(parts[0], 360.0), number(parts[1], 1.0), number(parts[2], 1.0)
        x, y = (x if "%" in parts[1] else x / 100), (y if "%" in parts[2] else y / 100)
        out = [255 * c for c in (_hsl(h, x, y) if kind == "hsl" else _hwb(h, x, y))]
    else:
        scale = (100.0, 125.0, 150.0) if kind in ("lab", "lch") else (1.0, 0.4, 0.4)
        light = number(parts[0], scale[0])
        if kind.endswith("lch"):
            c, h = number(parts[1], scale[2]), math.radians(number(parts[2], 360.0))
            p, q = c * math.cos(h), c * math.sin(h)
        else:
            p, q = number(parts[1], scale[1]), number(parts[2], scale[1])
        out = [255 * c for c in (_lab(light, p, q) if kind in ("lab", "lch") else _oklab(light, p, q))]
    return (*(min(255.0, max(0.0, c)) for c in out), a)


def _hsl(h: float, s: float, light: float) -> list[float]:
    def part(n: int) -> float:
        k = (n + h / 30) % 12
        return light - s * min(light, 1 - light) * max(-1.0, min(k - 3, 9 - k, 1))

    return [part(0), part(8), part(4)]


def _hwb(h: float, white: float, black: float) -> list[float]:
    if white + black >= 1:
        return [white / (white + black)] * 3
    return [c * (1 - white - black) + white for c in _hsl(h, 1.0, 0.5)]


def _gamma(c: float) -> float:
    return 12.92 * c if abs(c) <= 0.0031308 else math.copysign(1.055 * abs(c) ** (1 / 2.4) - 0.055, c)


def _lab(light: float, a: float, b: float) -> list[float]:
    f1 = (light + 16) / 116
    f0, f2 = a / 500 + f1, f1 - b / 200
    inverse = lambda f: f**3 if f**3 > 216 / 24389 else (116 * f - 16) * 27 / 24389
    x, y, z = inverse(f0) * 0.3457 / 0.3585, inverse(f1), inverse(f2) * (1 - 0.3457 - 0.3585) / 0.3585
    x, y, z = 0.9554734 * x - 0.0230985 * y + 0.0632593 * z, -0.0283697 * x + 1.0099955 * y + 0.0210414 * z, 0.0123140 * x - 0.0205077 * y + 1.3303659 * z
    return [_gamma(c) for c in (3.2409699 * x - 1.5373832 * y - 0.4986108 * z, -0.9692436 * x + 1.8759675 * y + 0.0415551 * z, 0.0556301 * x - 0.2039770 * y + 1.0569715 * z)]


def _oklab(light: float, a: float, b: float) -> list[float]:
    l, m, s = (light + 0.3963378 * a + 0.2158038 * b) ** 3, (light - 0.1055613 * a - 0.0638542 * b) ** 3, (light - 0.0894842 * a - 1.2914855 * b) ** 3  # noqa: E741
    return [_gamma(c) for c in (4.0767417 * l - 3.3077116 * m + 0.2309699 * s, -1.2684380 * l + 2.6097574 * m - 0.3413194 * s, -0.0041961 * l - 0.7034186 * m + 1.7076147 * s)]


def serialize_color(rgba: tuple[float, float, float, float]) -> str:
    """``rgb(r, g, b)`` or ``rgba(r, g, b, a)``."""
    r, g, b = (math.floor(c + 0.5) for c in rgba[:3])
    if rgba[3] >= 1:
        return f"rgb({r}, {g}, {b})"
    return f"rgba({r}, {g}, {b}, {round(rgba[3], 3):g})"


def cubic_bezier(x1: float, y1: float, x2: float, y2: float, t: float) -> float:
    """Output of a cubic Bézier easing at input ``t``, extended by its end tangents outside 0 to 1."""
    if t <= 0 or t >= 1:
        if t in (0, 1):
            return float(t)
        if t < 0:
            slope = y1 / x1 if x1 else y2 / x2 if not y1 and x2 else 0.0
            return slope * t
        slope = (1 - y2) / (1 - x2) if x2 < 1 else (1 - y1) / (1 - x1) if y2 == 1 and x1 < 1 else 0.0
        return 1 + slope * (t - 1)
    low, high = 0.0, 1.0
    at = lambda p1, p2, u: 3 * p1 * u * (1 - u) ** 2 + 3 * p2 * u * u * (1 - u) + u**3
    for _ in range(60):
        mid = (low + high) / 2
        if at(x1, x2, mid) < t:
            low = mid
        else:
            high = mid
    return at(y1, y2, (low + high) / 2)


# --- custom properties ---

_REFERENCE = re.compile(r"\b(var|env)\(", re.I)


def _references(value: str):
    """(begin, end, function, name, fallback) of the outermost references of a value."""
    at = 0
    while m := _REFERENCE.search(value, at):
        depth, i, comma = 1, m.end(), -1
        while i < len(value) and depth:
            depth += (value[i] == "(") - (value[i] == ")")
            comma = i if comma < 0 and depth == 1 and value[i] == "," else comma
            i += 1
        if depth:
            raise TextError("css", "a parenthesis is not closed", value, m.start())
        name = value[m.end() : comma if comma >= 0 else i - 1].strip()
        yield m.start(), i, m[1].lower(), name, value[comma + 1 : i - 1].strip() if comma >= 0 else None
        at = i


def _named(value: str) -> set[str]:
    """Custom properties that a value refers to, fallbacks included."""
    out: set[str] = set()
    for _, _, function, name, fallback in _references(value):
        if function == "var":
            out.add(name)
        out |= _named(fallback) if fallback else set()
    return out


def cyclic(properties: dict[str, str]) -> set[str]:
    """Custom properties that lie on a cycle of references."""
    edges = {k: {n for n in _named(v) if n in properties} for k, v in properties.items()}
    reach = {k: set(v) for k, v in edges.items()}
    changed = True
    while changed:
        changed = False
        for k, own in reach.items():
            more = set().union(*(reach[n] for n in own)) - own if own else set()
            if more:
                own |= more
                changed = True
    return {k for k, own in reach.items() if k in own}


def substitute(value: str, properties: dict[str, str], environment: dict[str, str], limit: int = 1 << 20) -> str | None:
    """``value`` with its references replaced; None where one is invalid and has no fallback, or the result is too long."""
    dead, known = cyclic(properties), {}

    def of(name: str) -> str | None:
        if name not in known:
            own = properties.get(name)
            known[name] = None if own is None or name in dead or own.strip().lower() == "initial" else expand(own)
        return known[name]

    def expand(text: str) -> str | None:
        out, at = [], 0
        for begin, end, function, name, fallback in _references(text):
            found = of(name) if function == "var" else environment.get(name)
            if found is None and fallback is not None:
                found = expand(fallback)
            if found is None:
                return None
            out += [text[at:begin], found]
            at = end
            if sum(map(len, out)) > limit:
                return None
        return "".join(out) + text[at:]

    return expand(value)
