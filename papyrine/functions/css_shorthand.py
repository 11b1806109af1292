"""Shorthands expanded by the grammars of their longhands, and logical property names."""

from __future__ import annotations

from . import css_properties as known
from .css_grammar import WIDE, Match

_SIDES = ("top", "right", "bottom", "left")
_CORNERS = ("top-left", "top-right", "bottom-right", "bottom-left")


def longhand_names(name: str) -> list[str]:
    """Longhands that a shorthand sets, in order."""
    if name in known.SIDED:
        return [known.SIDED[name].format(s) for s in _SIDES]
    if name in known.PAIRED:
        return list(known.PAIRED[name])
    if name == "border":
        return [f"border-{s}-{p}" for s in _SIDES for p in ("width", "style", "color")]
    if name.startswith("border-") and name[7:] in _SIDES:
        return [f"{name}-{p}" for p in ("width", "style", "color")]
    if name == "border-radius":
        return [f"border-{c}-radius" for c in _CORNERS]
    if name == "flex":
        return ["flex-grow", "flex-shrink", "flex-basis"]
    if name in known.PARTED:
        return [n for n in known.PROPERTIES if f"<'{n}'>" in known.PARTED[name]]
    return []


def _four(parts: list[str]) -> list[str]:
    """One to four values for top, right, bottom and left."""
    top, right, bottom, left = (parts + [""] * 3)[:4]
    right = right or top
    return [top, right, bottom or top, left or right]


def expand(name: str, value: str) -> tuple[str, list[tuple[str, str]]]:
    """(status, longhands with their values); a value that is pending or no match has no longhands."""
    names = longhand_names(name)
    if value.strip().lower() in WIDE:
        return "match", [(n, value.strip().lower()) for n in names]
    found = known.grammar(name).match(value)
    return found.status, _spread(name, names, found) if found.status == "match" else []


def _spread(name: str, names: list[str], found: Match) -> list[tuple[str, str]]:
    parts = [text for _, text in found.names]
    if name in known.SIDED:
        return list(zip(names, _four(parts), strict=True))
    if name in known.PAIRED:
        return list(zip(names, (parts[0], parts[-1]), strict=True))
    if name == "border-radius":
        across, _, down = found.text.partition(" / ")
        one, two = _four(across.split(" ")), _four(down.split(" ")) if down else [""] * 4
        return [(n, f"{a} {b}".strip()) for n, a, b in zip(names, one, two, strict=True)]
    given = dict(found.names)
    if name == "border" or name not in known.PARTED and name != "flex":
        return [(n, given.get(f"border-top-{kind}", known.INITIAL[kind])) for n in names for kind in (n.rpartition("-")[2],)]
    if name == "flex":
        if not given:
            return list(zip(names, ("0", "0", "auto"), strict=True))
        return [("flex-grow", given.get("flex-grow", "1")), ("flex-shrink", given.get("flex-shrink", "1")), ("flex-basis", given.get("flex-basis", "0px"))]
    if name == "background" and "background-origin" in given:
        given.setdefault("background-clip", given["background-origin"])
    return [(n, given.get(n, known.INITIAL.get(n, "initial"))) for n in names]


def physical_names(writing_mode: str = "horizontal-tb", direction: str = "ltr") -> dict[str, str]:
    """Physical property of every logical one (``margin-inline-start``, ``inline-size``, ...) in a writing mode."""
    vertical = not writing_mode.startswith("horizontal")
    backwards = (direction == "rtl") != (writing_mode == "sideways-lr")
    inline = ("top", "bottom") if vertical else ("left", "right")
    inline = inline[::-1] if backwards else inline
    block = {"horizontal-tb": ("top", "bottom"), "vertical-rl": ("right", "left"), "sideways-rl": ("right", "left")}.get(writing_mode, ("left", "right"))
    out = {}
    for axis, sides in (("inline", inline), ("block", block)):
        for end, side in zip(("start", "end"), sides, strict=True):
            out |= {f"margin-{axis}-{end}": f"margin-{side}", f"padding-{axis}-{end}": f"padding-{side}", f"inset-{axis}-{end}": side}
            out |= {f"border-{axis}-{end}-{p}": f"border-{side}-{p}" for p in ("width", "style", "color")}
        long = "height" if (axis == "inline") == vertical else "width"
        out |= {f"{axis}-size": long, f"min-{axis}-size": f"min-{long}", f"max-{axis}-size": f"max-{long}"}
        out[f"overflow-{axis}"] = "overflow-y" if long == "height" else "overflow-x"
    for corner in ("start-start", "start-end", "end-start", "end-end"):
        at = [block[corner.split("-")[0] == "end"], inline[corner.split("-")[1] == "end"]]
        at.sort(key=lambda s: s in ("left", "right"))
        out[f"border-{corner}-radius"] = f"border-{'-'.join(at)}-radius"
    return out
