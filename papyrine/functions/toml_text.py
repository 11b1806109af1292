"""TOML 1.0: parsing to JSON values, a statement walk, writing, JSON conversion."""

from __future__ import annotations

import datetime as dt
import math
import re
import tomllib
from collections.abc import Iterator

from .errors import TextError
from .json_text import Number


def parse(text: str) -> dict:
    """The document's table; raises a located ``TextError``."""
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"at line (\d+), column (\d+)", str(e))
        offset = sum(len(x) + 1 for x in text.split("\n")[: int(m[1]) - 1]) + int(m[2]) - 1 if m else len(text)
        raise TextError("toml", str(e), text, offset) from None


def to_json(value: object, nonfinite: str = "error") -> object:
    """JSON value of a TOML value: date-times become strings; ``nonfinite``: error, string or null."""
    if isinstance(value, dict):
        return {k: to_json(v, nonfinite) for k, v in value.items()}
    if isinstance(value, list):
        return [to_json(v, nonfinite) for v in value]
    if isinstance(value, (dt.datetime, dt.date, dt.time)):
        return value.isoformat().replace("+00:00", "Z")
    if isinstance(value, float) and not math.isfinite(value):
        if nonfinite == "error":
            raise TextError("nonfinite", f"{value} has no JSON form")
        return None if nonfinite == "null" else str(value)
    return value if isinstance(value, (bool, str)) else Number(repr(value))


def from_json(value: object, nulls: str = "error") -> object:
    """TOML value of a JSON value; ``nulls``: error or omit (of members)."""
    if isinstance(value, dict):
        return {k: from_json(v, nulls) for k, v in value.items() if not (v is None and nulls == "omit")}
    if isinstance(value, list):
        return [from_json(v, nulls) for v in value]
    if value is None:
        raise TextError("null", "TOML has no null")
    if isinstance(value, Number):
        return int(value) if re.fullmatch(r"-?\d+", value) else float(value)
    return value


_STRING = re.compile(r'"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'', re.S)


def statements(text: str) -> Iterator[str]:
    """Headers and assignments of a valid document, one after the other, without comments around them."""
    at, n = 0, len(text)
    while at < n:
        if text[at] in " \t\r\n":
            at += 1
            continue
        if text[at] == "#":
            at = text.find("\n", at)
            at = n if at < 0 else at
            continue
        start, depth = at, 0
        while at < n:
            c = text[at]
            if c in "\"\'":
                at = _STRING.match(text, at).end()
                continue
            if c == "#":
                stop = text.find("\n", at)
                if not depth:
                    break
                at = n if stop < 0 else stop
                continue
            if c == "\n" and not depth:
                break
            depth += (c in "[{") - (c in "]}")
            at += 1
        yield text[start:at].strip()


def _names(header: str) -> list[str]:
    """Key path of a header's inside."""
    names, found = [], tomllib.loads(f"{header} = 0")
    while isinstance(found, dict):
        ((name, found),) = found.items()
        names.append(name)
    return names


def events(text: str) -> list[dict]:
    """Leaf assignments in document order, whatever tables are opened again: dotted path, type and value text.

    Items of an array of tables are numbered; an empty table or array is a leaf where it is written.
    """
    whole = parse(text)
    out: list[dict] = []

    def walk(value: object, path: tuple) -> None:
        if isinstance(value, dict) and value:
            for k, v in value.items():
                walk(v, (*path, k))
        elif isinstance(value, list) and value:
            for i, v in enumerate(value):
                walk(v, (*path, str(i)))
        else:
            kind = {dict: "table", list: "array", str: "string", bool: "boolean", int: "integer", float: "float", dt.datetime: "datetime", dt.date: "date", dt.time: "time"}[type(value)]
            out.append({"path": ".".join(path), "kind": kind, "value": value if isinstance(value, str) else scalar(value) if not isinstance(value, (dict, list)) else ""})

    items: dict[tuple, int] = {}  # number of the current item of each array of tables
    here: tuple = ()
    for statement in statements(text.replace("\r\n", "\n")):
        if not statement.startswith("["):
            walk(tomllib.loads(statement), here)
            continue
        array = statement.startswith("[[")
        names, here, found = _names(statement.strip("[] \t")), (), whole
        for i, name in enumerate(names):
            here, found = (*here, name), found[name]
            if array and i == len(names) - 1:
                items[here] = items.get(here, -1) + 1
            if here in items:
                number = items[here]
                here, found = (*here, str(number)), found[number]
        if found == {}:
            walk(found, here)
    return out


def key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_-]+", name) else string(name)


def string(value: str) -> str:
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
    return '"' + "".join(short.get(c) or (f"\\u{ord(c):04X}" if c < " " or c == "\x7f" else c) for c in value) + '"'


def scalar(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return string(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            return "nan" if math.isnan(value) else "inf" if value > 0 else "-inf"
        return repr(value)
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise TextError("range", f"{value} is no 64-bit integer")
        return str(value)
    return value.isoformat().replace("+00:00", "Z")


def write(table: dict) -> str:
    """TOML text: plain keys before sub-tables, arrays of tables as such."""
    out: list[str] = []

    def inline(v: object) -> str:
        if isinstance(v, dict):
            return "{" + ", ".join(f"{key(k)} = {inline(x)}" for k, x in v.items()) + "}"
        return "[" + ", ".join(map(inline, v)) + "]" if isinstance(v, list) else scalar(v)

    def is_tables(v: object) -> bool:
        return isinstance(v, list) and bool(v) and all(isinstance(x, dict) for x in v)

    def body(t: dict, path: tuple[str, ...]) -> None:
        for k, v in t.items():
            if not isinstance(v, dict) and not is_tables(v):
                out.append(f"{key(k)} = {inline(v)}")
        for k, v in t.items():
            name = (*path, key(k))
            if isinstance(v, dict):
                if not v or any(not isinstance(x, dict) and not is_tables(x) for x in v.values()):
                    out.append(f"\n[{'.'.join(name)}]")
                body(v, name)
            elif is_tables(v):
                for x in v:
                    out.append(f"\n[[{'.'.join(name)}]]")
                    body(x, name)

    body(table, ())
    return "\n".join(out).lstrip("\n") + "\n" if out else ""
