import math

import pytest

from papyrine.functions import css_values as V
from papyrine.functions.errors import TextError


@pytest.mark.parametrize("text, wanted", [("calc(1in + 4px)", (100, "px")), ("min(10px, 2 * 3px)", (6, "px")), ("clamp(1px, 5px, 3px)", (3, "px")), ("round(up, 12px, 5px)", (15, "px")), ("mod(-7, 3)", (2, "")), ("rem(-7, 3)", (-1, "")), ("sin(90deg)", (1, "")), ("hypot(3px, 4px)", (5, "px")), ("calc(pi * 1rad / 1rad)", (math.pi, "")), ("2em", (32, "px")), ("sign(-3px)", (-1, "")), ("atan2(1px, 1px)", (45, "deg"))])
def test_math(text, wanted):
    number, unit = V.evaluate(text, {"em": 16})
    assert number == pytest.approx(wanted[0]) and unit == wanted[1]


@pytest.mark.parametrize("text", ["calc(1px + 1s)", "calc(1px+1px)", "foo(1)", "1px 2px", "calc(1px * 1px)", "3zz"])
def test_math_refuses(text):
    with pytest.raises(TextError):
        V.evaluate(text)


@pytest.mark.parametrize("text, wanted", [("#fff", "rgb(255, 255, 255)"), ("#11223380", "rgba(17, 34, 51, 0.502)"), ("rgb(10% 20% 30% / 50%)", "rgba(26, 51, 77, 0.5)"), ("hsl(120deg 100% 25%)", "rgb(0, 128, 0)"), ("hwb(0 20% 20%)", "rgb(204, 51, 51)"), ("Teal", "rgb(0, 128, 128)"), ("lab(100 0 0)", "rgb(255, 255, 255)"), ("oklch(0 0 0)", "rgb(0, 0, 0)")])
def test_color(text, wanted):
    assert V.serialize_color(V.color(text)) == wanted


def test_easing():
    assert V.cubic_bezier(0.25, 0.1, 0.25, 1, 0.5) == pytest.approx(0.8024, abs=1e-3)
    assert V.cubic_bezier(0, 0, 1, 1, 0.3) == pytest.approx(0.3) and V.cubic_bezier(0.5, 1, 0.5, 1, -1) == pytest.approx(-2)
