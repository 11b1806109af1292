"""JSON: strict and relaxed parsing, duplicate-key policies, records, writing, equality.

Values are dict, list, str, bool, None and ``Number`` (the number's own lexeme,
so ``1.50`` and integers of any size survive).  Strict texts go through the
standard library's scanner; relaxed dialects have a parser of their own.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import cache
from json.encoder import encode_basestring, encode_basestring_ascii

from .errors import Limits, TextError


class Number(str):
    """A JSON number as written."""

    __slots__ = ()

    def decimal(self) -> Decimal:
        text = str(self).lstrip("+")
        if text.lower().startswith(("0x", "-0x")):
            return Decimal(int(text, 16))
        return Decimal(text.replace("Infinity", "inf"))


@dataclass(frozen=True)
class JsonOptions:
    """Parse options; the defaults are RFC 8259. ``duplicates``: error, first, last or collect."""

    duplicates: str = "error"
    comments: bool = False
    trailing_commas: bool = False
    nonfinite: bool = False
    single_quotes: bool = False
    unquoted_keys: bool = False
    hex_numbers: bool = False
    leading_plus: bool = False
    bare_point: bool = False
    line_continuations: bool = False
    control_characters: bool = False
    allow_bom: bool = True
    limits: Limits = field(default_factory=Limits)

    def relaxed(self) -> bool:
        return any((self.comments, self.trailing_commas, self.nonfinite, self.single_quotes, self.unquoted_keys, self.hex_numbers, self.leading_plus, self.bare_point, self.line_continuations, self.control_characters))


JSONC = JsonOptions(comments=True, trailing_commas=True)
JSON5 = JsonOptions(comments=True, trailing_commas=True, nonfinite=True, single_quotes=True, unquoted_keys=True, hex_numbers=True, leading_plus=True, bare_point=True, line_continuations=True)

_SPACE = " \t\n\r"
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_PLAIN_INTEGER = re.compile(r"0|-?[1-9][0-9]{0,14}")
_LOOSE_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|Infinity|NaN)")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_IDENTIFIER = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")


def _fold(pairs: list[tuple[str, object]], policy: str, text: str) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key not in out:
            out[key] = [value] if policy == "collect" else value
        elif policy == "error":
            raise TextError("duplicate-key", f"member {key!r} is repeated", text, 0)
        elif policy == "last":
            out[key] = value
        elif policy == "collect":
            out[key].append(value)
    if policy == "collect":
        out = {k: v[0] if len(v) == 1 else v for k, v in out.items()}
    return out


def parse(text: str, options: JsonOptions = JsonOptions()) -> object:
    """The value of a whole text; raises ``TextError``."""
    if text.startswith("\ufeff"):
        if not options.allow_bom:
            raise TextError("bom", "byte order mark", text, 0)
        text = text[1:]
    if len(text) > options.limits.total:
        raise TextError("limit", "text is too long", text[:1], 0)
    if options.relaxed():
        reader = _Reader(text, options)
        value = reader.document()
    else:
        value = _strict(text, options)
    _check(value, options.limits, text)
    return value


class _Constant(Exception):
    """NaN or an infinity in a strict text."""


def _refuse(name: str):
    raise _Constant(name)


@cache
def _decoder(policy: str) -> json.JSONDecoder:
    def members(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        return out if len(out) == len(pairs) else _fold(pairs, policy, "")

    return json.JSONDecoder(object_pairs_hook=members, parse_int=Number, parse_float=Number, parse_constant=_refuse)


def _strict(text: str, options: JsonOptions) -> object:
    try:
        value = _decoder(options.duplicates).decode(text)
    except json.JSONDecodeError as e:
        raise TextError("syntax", e.msg, text, e.pos) from None
    except _Constant as e:
        raise TextError("number", f"{e} is not JSON", text, max(0, text.find(str(e)))) from None
    except RecursionError:
        raise TextError("limit", "nested too deeply", text, 0) from None
    if "\\u" in text and re.search(r"\\u[dD][89a-fA-F]", text):
        _no_lone_surrogates(value, text)
    return value


def _no_lone_surrogates(value: object, text: str) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _no_lone_surrogates(k, text)
            _no_lone_surrogates(v, text)
    elif isinstance(value, list):
        for v in value:
            _no_lone_surrogates(v, text)
    elif isinstance(value, str) and any("\ud800" <= c <= "\udfff" for c in value):
        raise TextError("surrogate", "lone surrogate in a string", text, 0)


def _check(value: object, limits: Limits, text: str) -> None:
    if len(text) <= min(limits.items, limits.string) and text.count("[") + text.count("{") <= limits.depth:
        return  # too short to break a limit
    pending = [(value, 0)]
    while pending:
        v, depth = pending.pop()
        if isinstance(v, (dict, list)):
            if depth >= limits.depth:
                raise TextError("limit", "nested too deeply", text, 0)
            if len(v) > limits.items:
                raise TextError("limit", "too many items", text, 0)
            pending.extend((x, depth + 1) for x in (v.values() if isinstance(v, dict) else v))
        elif isinstance(v, str) and len(v) > limits.string:
            raise TextError("limit", "string is too long", text, 0)


class _Reader:
    """Recursive descent over a relaxed dialect."""

    def __init__(self, text: str, options: JsonOptions):
        self.text, self.o, self.at = text, options, 0

    def fail(self, message: str, code: str = "syntax"):
        raise TextError(code, message, self.text, min(self.at, len(self.text)))

    def gap(self) -> None:
        t, n = self.text, len(self.text)
        while self.at < n:
            c = t[self.at]
            if c in _SPACE or self.o.single_quotes and (c in "\v\f\u2028\u2029\ufeff" or c.isspace()):
                self.at += 1
            elif self.o.comments and t.startswith("//", self.at):
                end = t.find("\n", self.at)
                self.at = n if end < 0 else end
            elif self.o.comments and t.startswith("/*", self.at):
                end = t.find("*/", self.at + 2)
                if end < 0:
                    self.fail("comment is not closed")
                self.at = end + 2
            else:
                return

    def document(self) -> object:
        value = self.value(0)
        self.gap()
        if self.at < len(self.text):
            self.fail("text after the value")
        return value

    def value(self, depth: int) -> object:
        self.gap()
        if depth > self.o.limits.depth:
            self.fail("nested too deeply", "limit")
        c = self.text[self.at : self.at + 1]
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c == '"' or c == "'" and self.o.single_quotes:
            return self.string(c)
        for word, v in (("true", True), ("false", False), ("null", None)):
            if self.text.startswith(word, self.at) and not _IDENTIFIER.match(self.text, self.at + len(word)):
                self.at += len(word)
                return v
        return self.number()

    def number(self) -> Number:
        m = _NUMBER.match(self.text, self.at)
        loose = _LOOSE_NUMBER.match(self.text, self.at)
        if loose and (not m or loose.end() > m.end()):
            raw = loose[0]
            body = raw.lstrip("+-")
            fine = (
                (raw[0] != "+" or self.o.leading_plus)
                and (body[:2].lower() != "0x" or self.o.hex_numbers)
                and (body not in ("Infinity", "NaN") or self.o.nonfinite)
                and (not (body.startswith(".") or re.match(r"[0-9]+\.(?![0-9])", body)) or self.o.bare_point)
                and not re.match(r"0[0-9]", body)
            )
            if not fine:
                self.fail("number is not allowed", "number")
            m = loose
        if not m:
            self.fail("a value is expected")
        self.at = m.end()
        return Number(m[0])

    def string(self, quote: str) -> str:
        out, t = [], self.text
        self.at += 1
        while True:
            if self.at >= len(t):
                self.fail("string is not closed")
            c = t[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\\":
                e = t[self.at : self.at + 1]
                self.at += 1
                if e in _ESCAPES and e:
                    out.append(_ESCAPES[e])
                elif e == "u":
                    out.append(self.unicode())
                elif e == "'" and self.o.single_quotes:
                    out.append("'")
                elif e in ("\n", "\r") and e and self.o.line_continuations:
                    if e == "\r" and t[self.at : self.at + 1] == "\n":
                        self.at += 1
                elif self.o.single_quotes and e == "x" and re.match(r"[0-9a-fA-F]{2}", t[self.at : self.at + 2]):
                    out.append(chr(int(t[self.at : self.at + 2], 16)))
                    self.at += 2
                elif self.o.single_quotes and e and e not in "123456789ux":
                    out.append({"v": "\v", "0": "\0"}.get(e, e))
                else:
                    self.fail("unknown escape", "escape")
            elif c < " " and not self.o.control_characters:
                self.at -= 1
                self.fail("control character in a string", "control")
            else:
                out.append(c)

    def unicode(self) -> str:
        def four() -> int:
            raw = self.text[self.at : self.at + 4]
            if not re.fullmatch(r"[0-9a-fA-F]{4}", raw):
                self.fail("four hex digits are expected", "escape")
            self.at += 4
            return int(raw, 16)

        a = four()
        if 0xD800 <= a < 0xDC00 and self.text.startswith("\\u", self.at):
            self.at += 2
            b = four()
            if 0xDC00 <= b < 0xE000:
                return chr(0x10000 + ((a - 0xD800) << 10) + b - 0xDC00)
            self.fail("lone surrogate", "surrogate")
        if 0xD800 <= a < 0xE000:
            self.fail("lone surrogate", "surrogate")
        return chr(a)

    def _items(self, close: str, one):
        self.at += 1
        first = True
        while True:
            self.gap()
            if self.text.startswith(close, self.at) and (first or self.o.trailing_commas):
                self.at += 1
                return
            one()
            first = False
            self.gap()
            if self.text.startswith(close, self.at):
                self.at += 1
                return
            if not self.text.startswith(",", self.at):
                self.fail(f"',' or '{close}' is expected")
            self.at += 1

    def array(self, depth: int) -> list:
        out: list = []
        self._items("]", lambda: out.append(self.value(depth + 1)))
        return out

    def object(self, depth: int) -> dict:
        pairs: list = []

        def member():
            c = self.text[self.at : self.at + 1]
            if c == '"' or c == "'" and self.o.single_quotes:
                key = self.string(c)
            elif self.o.unquoted_keys and (m := _IDENTIFIER.match(self.text, self.at)):
                key, self.at = m[0], m.end()
            else:
                self.fail("a member name is expected")
            self.gap()
            if not self.text.startswith(":", self.at):
                self.fail("':' is expected")
            self.at += 1
            pairs.append((key, self.value(depth + 1)))

        self._items("}", member)
        return _fold(pairs, self.o.duplicates, self.text)


def records(text: str, mode: str, options: JsonOptions = JsonOptions()) -> list:
    """Values of a record sequence; ``mode`` is off, whitespace, line or seq (RFC 7464)."""
    if mode == "off":
        return [parse(text, options)]
    if mode == "line":
        return [parse(line, options) for line in re.split(r"\r?\n", text) if line.strip(_SPACE)]
    if mode == "seq":
        head, *parts = text.split("\x1e")
        if head.strip(_SPACE):
            raise TextError("syntax", "text before the first record separator", text, 0)
        for part in parts:
            body = part.rstrip(_SPACE)
            if body and body[-1] not in '}]"' and not part.endswith(tuple(_SPACE)):
                raise TextError("truncated", "a record that is a bare word must end in white space", text, len(text))
        return [parse(p, options) for p in parts if p.strip(_SPACE)]
    if mode == "whitespace":
        out, at, decoder = [], 0, json.JSONDecoder()
        while True:
            while at < len(text) and text[at] in _SPACE:
                at += 1
            if at == len(text):
                return out
            try:
                _, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError as e:
                raise TextError("syntax", e.msg, text, e.pos) from None
            if end < len(text) and text[end] not in _SPACE and text[end - 1] not in '}]"' and text[end] not in '{["':
                raise TextError("syntax", "records must be apart", text, end)
            out.append(parse(text[at:end], options))
            at = end
    raise ValueError(f"unknown record mode {mode!r}")


@dataclass(frozen=True)
class JsonStyle:
    """Write options. ``numbers``: keep (lexeme) or canonical; ``ascii``: escape all but ASCII."""

    indent: int | None = None
    sort_keys: bool = False
    ascii: bool = False
    numbers: str = "keep"
    escape_slash: bool = False
    nonfinite: str = "error"


CANONICAL = JsonStyle(sort_keys=True, numbers="canonical")


def canonical_number(lexeme: str) -> str:
    """One spelling for equal numbers: integers in full, else the shortest form of the double."""
    if _PLAIN_INTEGER.fullmatch(lexeme):
        return str(lexeme)
    d = Number(lexeme).decimal()
    if not d.is_finite():
        return str(lexeme)
    if d == 0:
        return "0"
    if d == d.to_integral_value() and abs(d) < Decimal(10) ** 21:
        return format(d.quantize(Decimal(1)), "f")
    short = repr(float(d))
    if Decimal(short) != d:
        short = format(d.normalize(), "E")
    mantissa, _, exponent = short.lower().partition("e")
    mantissa = mantissa.removesuffix(".0")
    return mantissa + (f"e{int(exponent)}" if exponent else "")


def write(value: object, style: JsonStyle = JsonStyle()) -> str:
    """JSON text of a value."""

    encode = encode_basestring_ascii if style.ascii else encode_basestring

    def quoted(s: str) -> str:
        out = encode(s)
        return out.replace("/", "\\/") if style.escape_slash else out

    def put(v: object, level: int) -> str:
        if v is None:
            return "null"
        if v is True or v is False:
            return "true" if v else "false"
        if isinstance(v, Number):
            if v.lstrip("+-") in ("Infinity", "NaN") and style.nonfinite == "error":
                raise TextError("nonfinite", f"{v} cannot be written")
            return canonical_number(v) if style.numbers == "canonical" else str(v)
        if isinstance(v, (int, float)):
            if isinstance(v, float) and not math.isfinite(v):
                if style.nonfinite == "null":
                    return "null"
                raise TextError("nonfinite", f"{v} cannot be written")
            return put(Number(repr(v)), level)
        if isinstance(v, str):
            return quoted(v)
        gap = "" if style.indent is None else "\n" + " " * (style.indent * (level + 1))
        end = "" if style.indent is None else "\n" + " " * (style.indent * level)
        if isinstance(v, dict):
            items = sorted(v.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass")) if style.sort_keys else v.items()
            colon = ":" if style.indent is None else ": "
            body = [gap + quoted(k) + colon + put(x, level + 1) for k, x in items]
            return "{" + ",".join(body) + (end if body else "") + "}"
        body = [gap + put(x, level + 1) for x in v]
        return "[" + ",".join(body) + (end if body else "") + "]"

    return put(value, 0)


def equal(a: object, b: object) -> bool:
    """Structural equality: member order does not matter, numbers compare by value."""
    if isinstance(a, Number) or isinstance(b, Number):
        return isinstance(a, Number) and isinstance(b, Number) and (a == b or a.decimal() == b.decimal())
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(equal, a, b))
    return a == b


def type_name(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


# --- pointer, patch ---


def pointer_tokens(pointer: str) -> list[str]:
    """Tokens of an RFC 6901 pointer."""
    if pointer and not pointer.startswith("/"):
        raise TextError("pointer", "a pointer is empty or starts with '/'", pointer, 0)
    if m := re.search(r"~(?![01])", pointer):
        raise TextError("pointer", "'~' must be followed by 0 or 1", pointer, m.start())
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/")[1:]]


_MISSING = object()


def _child(value: object, token: str) -> object:
    if isinstance(value, dict):
        return value.get(token, _MISSING)
    if isinstance(value, list) and re.fullmatch(r"0|[1-9][0-9]*", token) and int(token) < len(value):
        return value[int(token)]
    return _MISSING


def pointer_get(value: object, tokens: list[str], default: object = None) -> object:
    for token in tokens:
        value = _child(value, token)
        if value is _MISSING:
            return default
    return value


def _copy(value: object) -> object:
    if isinstance(value, dict):
        return {k: _copy(v) for k, v in value.items()}
    return [_copy(v) for v in value] if isinstance(value, list) else value


def patch(target: object, operations: object) -> object:
    """RFC 6902; the target is untouched and any failing operation fails the whole patch."""
    root = [_copy(target)]
    if not isinstance(operations, list):
        raise TextError("patch", "a patch is an array")

    def need(op: dict, name: str) -> object:
        if name not in op:
            raise TextError("patch", f"{op.get('op')} needs {name!r}")
        return op[name]

    def at(path: object) -> tuple[object, str | int]:
        tokens = pointer_tokens(path) if isinstance(path, str) else None
        if tokens is None:
            raise TextError("patch", "a path is a string")
        if not tokens:
            return root, 0
        parent = pointer_get(root[0], tokens[:-1], _MISSING)
        if not isinstance(parent, (dict, list)):
            raise TextError("patch", f"nothing holds {path!r}")
        return parent, tokens[-1]

    def get(path: object) -> object:
        parent, token = at(path)
        found = parent[0] if parent is root else _child(parent, token)
        if found is _MISSING:
            raise TextError("patch", f"{path!r} is missing")
        return found

    def add(path: object, value: object) -> None:
        parent, token = at(path)
        if parent is root:
            root[0] = value
        elif isinstance(parent, dict):
            parent[token] = value
        elif token == "-":
            parent.append(value)
        elif re.fullmatch(r"0|[1-9][0-9]*", token) and int(token) <= len(parent):
            parent.insert(int(token), value)
        else:
            raise TextError("patch", f"no place for {path!r}")

    def remove(path: object) -> object:
        found = get(path)
        parent, token = at(path)
        if parent is root:
            raise TextError("patch", "the whole document cannot be removed")
        del parent[token if isinstance(parent, dict) else int(token)]
        return found

    for op in operations:
        if not isinstance(op, dict):
            raise TextError("patch", "an operation is an object")
        kind, path = op.get("op"), need(op, "path")
        if kind == "add":
            add(path, _copy(need(op, "value")))
        elif kind == "remove":
            remove(path)
        elif kind == "replace":
            value = need(op, "value")
            get(path)
            parent, token = at(path)
            parent[int(token) if isinstance(parent, list) else token] = _copy(value)
        elif kind == "move":
            source = need(op, "from")
            if isinstance(source, str) and isinstance(path, str) and path.startswith(source + "/"):
                raise TextError("patch", "a value cannot move into itself")
            get(source)
            if source != path:
                add(path, remove(source))
        elif kind == "copy":
            add(path, _copy(get(need(op, "from"))))
        elif kind == "test":
            if not equal(get(path), need(op, "value")):
                raise TextError("patch-test", f"{path!r} has another value")
        else:
            raise TextError("patch", f"unknown operation {kind!r}")
    return root[0]


def merge_patch(target: object, change: object) -> object:
    """RFC 7386."""
    if not isinstance(change, dict):
        return _copy(change)
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in change.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


# --- setters and events ---


def put(target: object, pointer: str, value: object) -> object:
    """Copy of ``target`` with the member or item at ``pointer`` set; a new member goes last, '-' appends an item."""
    tokens = pointer_tokens(pointer)
    parent = pointer_get(target, tokens[:-1], _MISSING) if tokens else _MISSING
    there = isinstance(parent, list) and tokens[-1] != "-"
    return patch(target, [{"op": "replace" if there else "add", "path": pointer, "value": value}])


def insert(target: object, pointer: str, value: object) -> object:
    """Copy of ``target`` with an item put before the one at ``pointer``."""
    if not isinstance(pointer_get(target, pointer_tokens(pointer)[:-1], _MISSING), list):
        raise TextError("patch", f"{pointer!r} is not in an array")
    return patch(target, [{"op": "add", "path": pointer, "value": value}])


def remove(target: object, pointer: str) -> object:
    """Copy of ``target`` without the member or item at ``pointer``."""
    return patch(target, [{"op": "remove", "path": pointer}])


def merge(a: object, b: object, policy: str = "last") -> object:
    """Members of two objects in one, not merged below; ``policy`` for names of both: first, last or error."""
    if not isinstance(a, dict) or not isinstance(b, dict):
        raise TextError("type", "two objects are needed")
    if policy == "error" and (both := a.keys() & b.keys()):
        raise TextError("duplicate-key", f"member {min(both)!r} is in both objects")
    return a | b if policy == "last" else b | a if policy == "first" and a.keys() >= b.keys() else {**a, **{k: v for k, v in b.items() if k not in a}}


class _Members(list):
    """Members of an object in order, repeated names kept."""


def events(text: str, limits: Limits = Limits()) -> list[dict]:
    """Parse events in document order: event, depth, key of the member they belong to, value of a scalar.

    Repeated member names give an event each.
    """
    decoder = json.JSONDecoder(object_pairs_hook=_Members, parse_int=Number, parse_float=Number, parse_constant=_refuse)
    try:
        whole = decoder.decode(text.removeprefix("\ufeff"))
    except json.JSONDecodeError as e:
        raise TextError("syntax", e.msg, text, e.pos) from None
    except _Constant as e:
        raise TextError("number", f"{e} is not JSON", text, max(0, text.find(str(e)))) from None
    except RecursionError:
        raise TextError("limit", "nested too deeply", text, 0) from None
    out: list[dict] = []
    pending: list[tuple] = [("value", whole, 0, None)]
    while pending:
        kind, v, depth, key = pending.pop()
        if kind != "value":
            out.append({"event": kind, "depth": depth, "key": key, "value": None})
        elif isinstance(v, list):
            if depth >= limits.depth:
                raise TextError("limit", "nested too deeply", text, 0)
            name = "object" if isinstance(v, _Members) else "array"
            out.append({"event": f"begin_{name}", "depth": depth, "key": key, "value": None})
            pending.append((f"end_{name}", None, depth, key))
            inner = v if name == "object" else [(None, x) for x in v]
            pending.extend(("value", x, depth + 1, k) for k, x in reversed(inner))
        else:
            out.append({"event": type_name(v), "depth": depth, "key": key, "value": v if isinstance(v, str) else write(v)})
    return out
