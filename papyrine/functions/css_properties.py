"""Definitions of CSS types, properties and shorthands, in the value definition syntax."""

from __future__ import annotations

from functools import cache

from .css_grammar import Grammar
from .css_values import NAMED

#: Types of the CSS specifications, by name.
TYPES: dict[str, str] = {
    "length-percentage": "<length> | <percentage>",
    "angle-percentage": "<angle> | <percentage>",
    "time-percentage": "<time> | <percentage>",
    "number-or-none": "<number> | none",
    "alpha-value": "<number> | <percentage>",
    "hue": "<number> | <angle>",
    "named-color": " | ".join(["transparent", *NAMED]),
    "rgb()": "rgb( <percentage>#{3} , <alpha-value>? ) | rgb( <number>#{3} , <alpha-value>? ) | rgb( [ <number> | <percentage> | none ]{3} [ / [ <alpha-value> | none ] ]? )",
    "rgba()": "rgba( <percentage>#{3} , <alpha-value>? ) | rgba( <number>#{3} , <alpha-value>? ) | rgba( [ <number> | <percentage> | none ]{3} [ / [ <alpha-value> | none ] ]? )",
    "hsl()": "hsl( <hue> , <percentage> , <percentage> , <alpha-value>? ) | hsl( [ <hue> | none ] [ <percentage> | <number> | none ]{2} [ / [ <alpha-value> | none ] ]? )",
    "hsla()": "hsla( <hue> , <percentage> , <percentage> , <alpha-value>? ) | hsla( [ <hue> | none ] [ <percentage> | <number> | none ]{2} [ / [ <alpha-value> | none ] ]? )",
    "hwb()": "hwb( [ <hue> | none ] [ <percentage> | <number> | none ]{2} [ / [ <alpha-value> | none ] ]? )",
    "lab-like": "[ <percentage> | <number> | none ]{3} [ / [ <alpha-value> | none ] ]?",
    "lch-like": "[ <percentage> | <number> | none ]{2} [ <hue> | none ] [ / [ <alpha-value> | none ] ]?",
    "color-space": "srgb | srgb-linear | display-p3 | a98-rgb | prophoto-rgb | rec2020 | xyz | xyz-d50 | xyz-d65",
    "color()": "color( <color-space> [ <number> | <percentage> | none ]{3} [ / [ <alpha-value> | none ] ]? )",
    "mix-space": "in [ srgb | srgb-linear | lab | oklab | xyz | xyz-d50 | xyz-d65 | [ hsl | hwb | lch | oklch ] [ [ shorter | longer | increasing | decreasing ] hue ]? ]",
    "color-mix()": "color-mix( <mix-space> , [ <color> && <percentage [0,100]>? ]#{2} )",
    "light-dark()": "light-dark( <color> , <color> )",
    "color": "currentcolor | <hex-color> | <named-color> | <rgb()> | <rgba()> | <hsl()> | <hsla()> | <hwb()> | lab( <lab-like> ) | oklab( <lab-like> ) | lch( <lch-like> ) | oklch( <lch-like> ) | <color()> | <color-mix()> | <light-dark()>",
    "color-stop": "<color> <length-percentage>{1,2}?",
    "gradient": "[ linear-gradient( [ <angle> | to [ left | right ] || [ top | bottom ] ]? , <stops> ) | repeating-linear-gradient( [ <angle> | to [ left | right ] || [ top | bottom ] ]? , <stops> ) | radial-gradient( [ [ circle | ellipse ] || <length-percentage [0,∞]>{1,2} ]? [ at <position> ]? , <stops> ) ]",
    "stops": "<color-stop> , [ <length-percentage>? , <color-stop> ]#",
    "image": "<url> | <gradient>",
    "position": "[ left | center | right ] || [ top | center | bottom ] | [ left | center | right | <length-percentage> ] [ top | center | bottom | <length-percentage> ]? | [ [ left | right ] <length-percentage> ] && [ [ top | bottom ] <length-percentage> ]",
    "bg-size": "[ <length-percentage [0,∞]> | auto ]{1,2} | cover | contain",
    "repeat-style": "repeat-x | repeat-y | [ repeat | space | round | no-repeat ]{1,2}",
    "visual-box": "content-box | padding-box | border-box",
    "line-style": "none | hidden | dotted | dashed | solid | double | groove | ridge | inset | outset",
    "line-width": "<length [0,∞]> | thin | medium | thick",
    "family-name": "<string> | <custom-ident>+",
    "easing": "linear | ease | ease-in | ease-out | ease-in-out | step-start | step-end | cubic-bezier( [ <number [0,1]> , <number> ]#{2} ) | steps( <integer [1,∞]> , [ jump-start | jump-end | jump-none | jump-both | start | end ]? )",
    "shadow": "<color>? && [ <length>{2} <length [0,∞]>? <length>? ] && inset?",
    "transform-function": "translate( <length-percentage> , <length-percentage>? ) | translatex( <length-percentage> ) | translatey( <length-percentage> ) | scale( [ <number> | <percentage> ]#{1,2} ) | rotate( [ <angle> | <zero> ] ) | skew( [ <angle> | <zero> ] , [ <angle> | <zero> ]? ) | matrix( <number>#{6} )",
    "track-size": "<length-percentage [0,∞]> | <flex [0,∞]> | min-content | max-content | auto | minmax( <track-breadth> , <track-breadth> )",
    "track-breadth": "<length-percentage [0,∞]> | <flex [0,∞]> | min-content | max-content | auto",
    "line-names": "'[' <custom-ident>* ']'",
    "track-list": "[ <line-names>? [ <track-size> | repeat( [ <integer [1,∞]> | auto-fill | auto-fit ] , [ <line-names>? <track-size> ]+ <line-names>? ) ] ]+ <line-names>?",
}
_SIDES = ("top", "right", "bottom", "left")
#: Grammars of properties.
PROPERTIES: dict[str, str] = {
    "display": "[ block | inline | run-in ] || [ flow | flow-root | table | flex | grid | ruby ] | none | contents | inline-block | inline-flex | inline-grid | inline-table | list-item | table-row | table-cell | table-caption",
    "position": "static | relative | absolute | fixed | sticky",
    "float": "none | left | right | inline-start | inline-end",
    "clear": "none | left | right | both | inline-start | inline-end",
    "visibility": "visible | hidden | collapse",
    "box-sizing": "content-box | border-box",
    "opacity": "<alpha-value>",
    "z-index": "auto | <integer>",
    "order": "<integer>",
    "color": "<color>",
    "direction": "ltr | rtl",
    "width": "auto | <length-percentage [0,∞]> | min-content | max-content | fit-content( <length-percentage [0,∞]> )",
    "height": "<'width'>",
    "min-width": "<'width'>",
    "min-height": "<'width'>",
    "max-width": "none | <'width'>",
    "max-height": "none | <'width'>",
    "aspect-ratio": "auto || <ratio>",
    "line-height": "normal | <number [0,∞]> | <length-percentage [0,∞]>",
    "letter-spacing": "normal | <length-percentage>",
    "text-align": "start | end | left | right | center | justify | match-parent",
    "text-indent": "<length-percentage> && hanging? && each-line?",
    "text-transform": "none | [ capitalize | uppercase | lowercase ] || full-width || full-size-kana",
    "white-space": "normal | pre | nowrap | pre-wrap | break-spaces | pre-line",
    "vertical-align": "baseline | sub | super | top | text-top | middle | bottom | text-bottom | <length-percentage>",
    "cursor": "[ <url> [ <number> <number> ]? , ]* [ auto | default | none | pointer | move | text | wait | help | crosshair | not-allowed | grab ]",
    "content": "normal | none | [ <string> | <url> | counter( <custom-ident> , <custom-ident>? ) | attr( <ident> ) | open-quote | close-quote ]+",
    "quotes": "auto | none | [ <string> <string> ]+",
    "transform": "none | <transform-function>+",
    "transform-origin": "[ left | center | right | <length-percentage> ] || [ top | center | bottom | <length-percentage> ]",
    "box-shadow": "none | <shadow>#",
    "text-shadow": "none | <shadow>#",
    "filter": "none | [ blur( <length>? ) | brightness( [ <number> | <percentage> ]? ) | opacity( [ <number> | <percentage> ]? ) | drop-shadow( <shadow> ) ]+",
    "counter-reset": "none | [ <custom-ident> <integer>? ]+",
    "counter-increment": "<'counter-reset'>",
    "grid-template-columns": "none | <track-list>",
    "grid-template-rows": "none | <track-list>",
    "align-items": "normal | stretch | center | start | end | flex-start | flex-end | [ first | last ]? && baseline",
    "justify-content": "normal | space-between | space-around | space-evenly | stretch | center | start | end | flex-start | flex-end | left | right",
    "flex-direction": "row | row-reverse | column | column-reverse",
    "flex-wrap": "nowrap | wrap | wrap-reverse",
    "flex-grow": "<number [0,∞]>",
    "flex-shrink": "<number [0,∞]>",
    "flex-basis": "content | <'width'>",
    "row-gap": "normal | <length-percentage [0,∞]>",
    "column-gap": "normal | <length-percentage [0,∞]>",
    "overflow-x": "visible | hidden | clip | scroll | auto",
    "overflow-y": "visible | hidden | clip | scroll | auto",
    "font-style": "normal | italic | oblique <angle [-90deg,90deg]>?",
    "font-variant-caps": "normal | small-caps",
    "font-weight": "normal | bold | bolder | lighter | <number [1,1000]>",
    "font-width": "normal | ultra-condensed | extra-condensed | condensed | semi-condensed | semi-expanded | expanded | extra-expanded | ultra-expanded",
    "font-size": "xx-small | x-small | small | medium | large | x-large | xx-large | larger | smaller | <length-percentage [0,∞]>",
    "font-family": "[ <family-name> ]#",
    "list-style-type": "none | <custom-ident> | <string>",
    "list-style-position": "inside | outside",
    "list-style-image": "none | <image>",
    "background-color": "<color>",
    "background-image": "none | <image>",
    "background-position": "<position>",
    "background-size": "<bg-size>",
    "background-repeat": "<repeat-style>",
    "background-attachment": "scroll | fixed | local",
    "background-origin": "<visual-box>",
    "background-clip": "<visual-box> | text",
    "outline-color": "auto | <color>",
    "outline-style": "auto | <line-style>",
    "outline-width": "<line-width>",
    "text-decoration-line": "none | underline || overline || line-through || blink",
    "text-decoration-style": "solid | double | dotted | dashed | wavy",
    "text-decoration-color": "<color>",
    "text-decoration-thickness": "auto | from-font | <length-percentage>",
    "column-width": "auto | <length [0,∞]>",
    "column-count": "auto | <integer [1,∞]>",
    "transition-property": "none | all | <custom-ident>",
    "transition-duration": "<time [0s,∞]>",
    "transition-timing-function": "<easing>",
    "transition-delay": "<time>",
    **{f"margin-{s}": "auto | <length-percentage>" for s in _SIDES},
    **{f"padding-{s}": "<length-percentage [0,∞]>" for s in _SIDES},
    **dict.fromkeys(_SIDES, "auto | <length-percentage>"),
    **{f"border-{s}-{p}": d for s in _SIDES for p, d in (("width", "<line-width>"), ("style", "<line-style>"), ("color", "<color>"))},
    **{f"border-{c}-radius": "<length-percentage [0,∞]>{1,2}" for c in ("top-left", "top-right", "bottom-right", "bottom-left")},
}
#: Initial values of the longhands that a shorthand may leave out.
INITIAL: dict[str, str] = {
    "width": "medium", "style": "none", "color": "currentcolor", "outline-color": "auto", "outline-style": "none", "outline-width": "medium",
    "font-style": "normal", "font-variant-caps": "normal", "font-weight": "normal", "font-width": "normal", "line-height": "normal",
    "list-style-type": "disc", "list-style-position": "outside", "list-style-image": "none", "flex-direction": "row", "flex-wrap": "nowrap",
    "background-color": "transparent", "background-image": "none", "background-position": "0% 0%", "background-size": "auto", "background-repeat": "repeat",
    "background-attachment": "scroll", "background-origin": "padding-box", "background-clip": "border-box",
    "text-decoration-line": "none", "text-decoration-style": "solid", "text-decoration-color": "currentcolor", "text-decoration-thickness": "auto",
    "column-width": "auto", "column-count": "auto", "transition-property": "all", "transition-duration": "0s", "transition-timing-function": "ease", "transition-delay": "0s",
}
#: Shorthands whose parts are properties in one grammar.
PARTED: dict[str, str] = {
    "outline": "<'outline-color'> || <'outline-style'> || <'outline-width'>",
    "list-style": "<'list-style-position'> || <'list-style-image'> || <'list-style-type'>",
    "flex-flow": "<'flex-direction'> || <'flex-wrap'>",
    "columns": "<'column-width'> || <'column-count'>",
    "text-decoration": "<'text-decoration-line'> || <'text-decoration-style'> || <'text-decoration-color'> || <'text-decoration-thickness'>",
    "font": "[ <'font-style'> || <'font-variant-caps'> || <'font-weight'> || <'font-width'> ]? <'font-size'> [ / <'line-height'> ]? <'font-family'>",
    "background": "<'background-image'> || <'background-position'> [ / <'background-size'> ]? || <'background-repeat'> || <'background-attachment'> || <'background-origin'> || <'background-clip'> || <'background-color'>",
    "transition": "<'transition-property'> || <'transition-duration'> || <'transition-timing-function'> || <'transition-delay'>",
}
#: Shorthands of four sides, by the longhand of a side.
SIDED: dict[str, str] = {"margin": "margin-{}", "padding": "padding-{}", "inset": "{}", "border-width": "border-{}-width", "border-style": "border-{}-style", "border-color": "border-{}-color"}
#: Shorthands of two values.
PAIRED: dict[str, tuple[str, str]] = {"overflow": ("overflow-x", "overflow-y"), "gap": ("row-gap", "column-gap")}
SHORTHANDS = frozenset([*PARTED, *SIDED, *PAIRED, "border", *(f"border-{s}" for s in _SIDES), "border-radius", "flex"])


def definition(name: str) -> str | None:
    """Grammar of a property or shorthand, None if it is not known."""
    if name in PROPERTIES:
        return PROPERTIES[name]
    if name in PARTED:
        return PARTED[name]
    if name in SIDED:
        return f"<'{SIDED[name].format('top')}'>{{1,4}}"
    if name in PAIRED:
        return f"<'{PAIRED[name][0]}'>{{1,2}}"
    if name == "border" or name in (f"border-{s}" for s in _SIDES):
        return "<'border-top-width'> || <'border-top-style'> || <'border-top-color'>"
    if name == "border-radius":
        return "<length-percentage [0,∞]>{1,4} [ / <length-percentage [0,∞]>{1,4} ]?"
    if name == "flex":
        return "none | [ <'flex-grow'> <'flex-shrink'>? || <'flex-basis'> ]"
    return None


@cache
def grammar(name: str) -> Grammar | None:
    """Compiled grammar of a property or shorthand."""
    text = definition(name)
    return None if text is None else Grammar(text, TYPES, PROPERTIES)
