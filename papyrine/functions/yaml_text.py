"""YAML 1.2: streams of documents to values (core schema) and back.

Covered: block and flow collections, plain, quoted, literal and folded scalars,
comments, directives, anchors and aliases with bounded expansion, merge keys, the
core tags, explicit keys, and duplicate-key errors.  Values are those of
``json_text`` (numbers keep their spelling where JSON allows it).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import Limits, TextError
from .json_text import Number


@dataclass(frozen=True)
class YamlOptions:
    """``schema``: core, json or failsafe; ``duplicates``: error, first or last."""

    schema: str = "core"
    duplicates: str = "error"
    merge: bool = True
    aliases: int = 10_000
    yaml11: bool = False
    limits: Limits = field(default_factory=Limits)


_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


def resolve(text: str, options: YamlOptions) -> object:
    """Value of a plain scalar under the schema."""
    if options.schema == "failsafe":
        return text
    if text in ("null", "Null", "NULL", "~", ""):
        return None
    if text in ("true", "True", "TRUE") or options.yaml11 and text.lower() in ("yes", "on", "y"):
        return True
    if text in ("false", "False", "FALSE") or options.yaml11 and text.lower() in ("no", "off", "n"):
        return False
    if _INT.fullmatch(text):
        base = 8 if text.startswith("0o") else 16 if text.startswith("0x") else 10
        return Number(int(text.removeprefix("0o"), base) if base != 16 else int(text, 16))
    if _FLOAT.fullmatch(text):
        return Number(text) if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", text) else Number(repr(float(text)))
    if re.fullmatch(r"[-+]?\.(inf|Inf|INF)", text):
        return Number("-Infinity" if text[0] == "-" else "Infinity")
    return Number("NaN") if text in (".nan", ".NaN", ".NAN") else text


def documents(text: str, options: YamlOptions = YamlOptions()) -> list[object]:
    """Values of every document of a stream."""
    if len(text) > options.limits.total:
        raise TextError("limit", "text is too long", text[:1], 0)
    out, begin, lines, seen_content = [], 0, text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").split("\n"), False
    current: list[tuple[int, str]] = []
    started = False

    def close() -> None:
        nonlocal current, started
        if started or any(x.strip() and not x.strip().startswith("#") for _, x in current):
            out.append(_Reader(current, options, "\n".join(lines)).document())
        current, started = [], False

    for number, line in enumerate(lines):
        if line.startswith("---") and line[3:4] in ("", " ", "\t"):
            if started or any(x.strip() and not x.strip().startswith(("#", "%")) for _, x in current):
                close()
            current, started = [(number, "   " + line[3:])] if line[3:].strip() else [], True
        elif line.startswith("...") and not line[3:].strip():
            close()
        elif line.startswith("%") and not started and not any(x.strip() for _, x in current):
            continue
        else:
            current.append((number, line))
    close()
    return out


def parse(text: str, options: YamlOptions = YamlOptions()) -> object:
    """The value of a stream of one document (an empty stream is null)."""
    found = documents(text, options)
    if len(found) > 1:
        raise TextError("documents", "the stream has several documents", text, 0)
    return found[0] if found else None


class _Reader:
    def __init__(self, lines: list[tuple[int, str]], options: YamlOptions, whole: str):
        self.o, self.whole = options, whole
        self.text = "\n".join(x for _, x in lines)
        self.first = lines[0][0] if lines else 0
        self.at, self.anchors, self.expanded = 0, {}, 0

    def fail(self, message: str, code: str = "yaml"):
        line = self.first + self.text.count("\n", 0, self.at)
        offset = sum(len(x) + 1 for x in self.whole.split("\n")[:line]) + self.column()
        raise TextError(code, message, self.whole, min(offset, len(self.whole)))

    def column(self) -> int:
        return self.at - (self.text.rfind("\n", 0, self.at) + 1)

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def gap(self) -> bool:
        """Skip blanks, comments and line breaks; whether a line break was crossed."""
        crossed = False
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\n":
                crossed = True
                self.at += 1
            elif c in " \t":
                self.at += 1
            elif c == "#" and (self.at == 0 or self.text[self.at - 1] in " \t\n"):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                break
        return crossed

    def document(self) -> object:
        self.gap()
        value = self.node(-1, 0)
        self.gap()
        if self.at < len(self.text):
            self.fail("unexpected text")
        return value

    def _line_blank(self) -> bool:
        end = self.text.find("\n", self.at)
        rest = self.text[self.at : end if end >= 0 else len(self.text)]
        return not rest.strip() or rest.lstrip().startswith("#")

    def node(self, parent: int, depth: int, same_ok: bool = False) -> object:
        """Block node indented more than ``parent`` (or as much, for a sequence under a mapping key)."""
        if depth > self.o.limits.depth:
            self.fail("nested too deeply", "limit")
        anchor = tag = None
        before = self.at
        while True:
            crossed = self.gap() or self.column() == 0 and before == self.at
            m = re.compile(r"&([^\s,\[\]{}]+)|!(?:<([^>]*)>|[^\s,\[\]{}]*)").match(self.text, self.at)
            if not m or self._is_key_line(m.end()):
                break
            anchor, tag = (m[1], tag) if m[1] else (anchor, m[2] or m[0])
            self.at = m.end()
        col, c = self.column(), self.peek()
        deeper = col > parent or same_ok and col == parent and c == "-" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", "\t")
        if self.at >= len(self.text) or not deeper:
            value: object = self._tagged("", tag) if tag else None
        elif c == "*" and not self._is_key_line(self.at):
            return self.alias()
        elif c == "-" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n", "\t"):
            value = self.sequence(col, depth)
        elif c == "?" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n") or self._is_key_line(self.at):
            if same_ok and "\n" not in self.text[before : self.at]:
                self.fail("a mapping cannot begin on the line of its key")
            value = self.mapping(col, depth)
        elif c in "|>" and c:
            value = self._tagged(self.block_scalar(parent), tag or "!")
        elif c in "[{" and c:
            value = self.flow(depth)
            self._end_of_value()
        elif c in "\"'" and c:
            value = self._tagged(self.quoted(c), tag or "!")
            self._end_of_value()
        else:
            value = self._tagged(self.plain(parent), tag)
        if anchor:
            self.anchors[anchor] = value
        return value

    def _end_of_value(self) -> None:
        m = re.compile(r"[ \t]*(?:[ \t]#[^\n]*)?(?:\n|$)").match(self.text, self.at)
        if not m:
            self.fail("text after a value")

    def _is_key_line(self, at: int) -> bool:
        """Whether an implicit mapping key begins at ``at``."""
        end = self.text.find("\n", at)
        line = self.text[at : end if end >= 0 else len(self.text)]
        line = re.sub(r"^(?:[&!][^\s]*\s+)+", "", line.lstrip(" \t"))
        if line[:1] in "\"'" and line:
            m = re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", line)
            return bool(m and re.match(r"[ \t]*:(?:\s|$)", line[m.end() :]))
        if line[:1] in ("[", "{", "#", "|", ">", "%", "@", "`") and line:
            return False
        m = re.match(r"(?:[^\s:#]|:(?=\S)|(?<=\S)#|[ \t]+(?![#:\s]))*[ \t]*:(?:\s|$)", line)
        return bool(m)

    def alias(self) -> object:
        m = re.compile(r"\*([^\s,\[\]{}:]+)").match(self.text, self.at)
        self.at = m.end()
        if m[1] not in self.anchors:
            self.fail(f"no anchor {m[1]!r} before")
        self.expanded += 1
        if self.expanded > self.o.aliases:
            self.fail("too many aliases", "limit")
        return self.anchors[m[1]]

    def sequence(self, col: int, depth: int) -> list:
        out = []
        while self.at < len(self.text) and self.column() == col and re.compile(r"-(?=\s|$)").match(self.text, self.at):
            self.at += 1
            out.append(self.node(col, depth + 1))
            self.gap()
            if self.at < len(self.text) and self.column() > col:
                self.fail("bad indentation of a sequence item")
        return out

    def mapping(self, col: int, depth: int) -> dict:
        pairs: list[tuple[object, object]] = []
        while self.at < len(self.text) and self.column() == col:
            if self.peek() == "?" and self.text[self.at + 1 : self.at + 2] in ("", " ", "\n"):
                self.at += 1
                key = self.node(col, depth + 1)
                self.gap()
                value = None
                if self.column() == col and re.compile(r":(?=\s|$)").match(self.text, self.at):
                    self.at += 1
                    value = self.node(col, depth + 1)
            elif self._is_key_line(self.at):
                key = self._key()
                value = self.node(col, depth + 1, same_ok=True)
            else:
                self.fail("a mapping key is expected")
            pairs.append((key, value))
            self.gap()
            if self.at < len(self.text) and self.column() > col:
                self.fail("bad indentation of a mapping value")
        return self._fold(pairs)

    def _key(self) -> object:
        anchor = tag = None
        while m := re.compile(r"(?:&(\S+)|(!\S*))[ \t]+").match(self.text, self.at):
            anchor, tag = m[1] or anchor, m[2] or tag
            self.at = m.end()
        c = self.peek()
        if c in "\"'" and c:
            key: object = self.quoted(c)
        elif c == "*":
            key = self.alias()
        else:
            m = re.compile(r"(?:[^\s:]|:(?=\S)|[ \t]+(?=[^\s:]|:\S))*").match(self.text, self.at)
            self.at = m.end()
            key = self._tagged(m[0], tag)
        m = re.compile(r"[ \t]*:").match(self.text, self.at)
        self.at = m.end()
        if anchor:
            self.anchors[anchor] = key
        return key

    def _fold(self, pairs: list[tuple[object, object]]) -> dict:
        out: dict = {}
        merged: list = []
        for key, value in pairs:
            if key == "<<" and self.o.merge and isinstance(value, (dict, list)):
                merged += value if isinstance(value, list) else [value]
                continue
            name = key if isinstance(key, str) else "null" if key is None else str(key).lower() if isinstance(key, bool) else None
            if name is None:
                self.fail("a key is no scalar", "key")
            if name in out:
                if self.o.duplicates == "error":
                    self.fail(f"key {name!r} is repeated", "duplicate-key")
                if self.o.duplicates == "first":
                    continue
            out[str(name)] = value
        for other in merged:
            if not isinstance(other, dict):
                self.fail("a merge key takes mappings")
            for k, v in other.items():
                out.setdefault(k, v)
        return out

    def _tagged(self, text: str, tag: str | None) -> object:
        short = (tag or "").removeprefix("tag:yaml.org,2002:").removeprefix("!!")
        if tag is None:
            return resolve(text, self.o)
        if short == "int" or short == "float":
            found = resolve(text, self.o)
            if not isinstance(found, Number):
                self.fail(f"{text!r} is no {short}")
            return found
        if short in ("bool", "null"):
            return resolve(text, self.o)
        return text

    def plain(self, parent: int, flow: bool = False) -> str:
        stop = r",\[\]{}" if flow else ""
        one = re.compile(rf"(?:[^\s#:{stop}]|:(?=[^\s{stop}])|(?<=\S)#|[ \t]+(?=[^\s#:{stop}]|:[^\s{stop}]))*")
        if self.peek() in "@`%" and self.peek() or self.peek() in ",[]{}" and flow:
            self.fail("a plain scalar cannot start so")
        m = one.match(self.text, self.at)
        out, self.at = m[0], m.end()
        if not out:
            self.fail("a value is expected")
        while True:
            rest = re.compile(r"[ \t]*\n((?:[ \t]*\n)*)([ \t]*)(?=\S)").match(self.text, self.at)
            if not rest or not flow and len(rest[2]) <= parent or self.text[rest.end()] == "#":
                break
            if not flow and (self._is_key_line(rest.end()) or parent < 0 and re.compile(r"-(?=\s)").match(self.text, rest.end())):
                if self._is_key_line(rest.end()):
                    self.at = rest.end()
                    self.fail("a key cannot follow a plain scalar here")
            m = one.match(self.text, rest.end())
            if not m[0]:
                break
            out += ("\n" * rest[1].count("\n") or " ") + m[0]
            self.at = m.end()
        if not flow:
            self._end_of_value()
        return out

    def quoted(self, quote: str) -> str:
        out: list[str] = []
        self.at += 1
        while True:
            if self.at >= len(self.text):
                self.fail("quoted scalar is not closed")
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                if quote == "'" and self.peek() == "'":
                    out.append("'")
                    self.at += 1
                    continue
                return "".join(out)
            if c == "\\" and quote == '"':
                e = self.peek()
                self.at += 1
                if e == "\n":
                    while self.peek() in (" ", "\t") and self.peek():
                        self.at += 1
                elif e in "xuU" and e:
                    width = {"x": 2, "u": 4, "U": 8}[e]
                    raw = self.peek(width)
                    if not re.fullmatch(rf"[0-9a-fA-F]{{{width}}}", raw):
                        self.fail("bad escape")
                    self.at += width
                    out.append(chr(int(raw, 16)))
                elif e in _ESCAPES and e:
                    out.append(_ESCAPES[e])
                else:
                    self.fail("unknown escape")
            elif c == "\n":
                while out and out[-1] in (" ", "\t"):
                    out.pop()
                m = re.compile(r"((?:[ \t]*\n)*)[ \t]*").match(self.text, self.at)
                self.at = m.end()
                out.append("\n" * m[1].count("\n") or " ")
            else:
                out.append(c)

    def block_scalar(self, parent: int) -> str:
        m = re.compile(r"([|>])(?:([1-9])([+-])?|([+-])([1-9])?)?[ \t]*(?:[ \t]#[^\n]*)?(?:\n|$)").match(self.text, self.at)
        if not m:
            self.fail("bad block scalar header")
        self.at = m.end()
        folded, width, chomp = m[1] == ">", m[2] or m[5], m[3] or m[4] or ""
        indent = max(parent, 0) + int(width) if width else None
        lines: list[str] = []
        while self.at < len(self.text):
            end = self.text.find("\n", self.at)
            end = len(self.text) if end < 0 else end
            line = self.text[self.at : end]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" "):
                if indent is None:
                    if lead <= parent:
                        break
                    indent = lead
                if lead < indent:
                    break
            lines.append(line[indent:] if indent is not None and line.strip(" ") else line[indent:] if indent is not None and len(line) > indent else "")
            self.at = end + 1 if end < len(self.text) else end
        if self.at and self.at <= len(self.text) and self.text[self.at - 1 : self.at] == "\n" and self.at < len(self.text):
            pass
        tail = 0
        while lines and not lines[-1]:
            lines.pop()
            tail += 1
        if folded:
            body, previous = "", None
            for line in lines:
                spaced = line[:1] in (" ", "\t") or not line
                if previous is None:
                    body = line
                elif line and not spaced and previous and previous[:1] not in (" ", "\t"):
                    body += " " + line
                elif not previous and line and not spaced and body.rstrip("\n") and not body.rstrip("\n").split("\n")[-1].startswith((" ", "\t")):
                    body += line
                else:
                    body += "\n" + line
                previous = line
        else:
            body = "\n".join(lines)
        if chomp == "-":
            return body
        if chomp == "+":
            return body + "\n" * (tail + (1 if lines else 0)) if self.text.endswith("\n") or self.at < len(self.text) else body + "\n" * tail
        return body + "\n" if lines else ""

    def flow(self, depth: int) -> object:
        if depth > self.o.limits.depth:
            self.fail("nested too deeply", "limit")
        self.gap()
        c = self.peek()
        anchor = tag = None
        while m := re.compile(r"&([^\s,\[\]{}]+)|(!(?:<[^>]*>|[^\s,\[\]{}]*))").match(self.text, self.at):
            anchor, tag = m[1] or anchor, m[2] or tag
            self.at = m.end()
            self.gap()
            c = self.peek()
        if c == "[":
            self.at += 1
            value: object = []
            while True:
                self.gap()
                if self.peek() == "]":
                    self.at += 1
                    break
                item = self.flow(depth + 1)
                self.gap()
                if self.peek() == ":":
                    self.at += 1
                    item = self._fold([(item, self._flow_value(depth))])
                    self.gap()
                value.append(item)
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() != "]":
                    self.fail("',' or ']' is expected")
        elif c == "{":
            self.at += 1
            pairs = []
            while True:
                self.gap()
                if self.peek() == "}":
                    self.at += 1
                    break
                if self.peek() == "?" and self.text[self.at + 1 : self.at + 2].isspace():
                    self.at += 1
                key = self.flow(depth + 1)
                self.gap()
                item = None
                if self.peek() == ":":
                    self.at += 1
                    item = self._flow_value(depth)
                    self.gap()
                pairs.append((key, item))
                if self.peek() == ",":
                    self.at += 1
                elif self.peek() != "}":
                    self.fail("',' or '}' is expected")
            value = self._fold(pairs)
        elif c in "\"'" and c:
            value = self._tagged(self.quoted(c), tag or "!")
        elif c == "*":
            return self.alias()
        elif tag and c in ",]}":
            value = self._tagged("", tag)
        else:
            value = self._tagged(self.plain(0, flow=True), tag)
        if anchor:
            self.anchors[anchor] = value
        return value

    def _flow_value(self, depth: int) -> object:
        self.gap()
        return None if self.peek() in (",", "}", "]") else self.flow(depth + 1)


def write(value: object, indent: int = 2) -> str:
    """YAML text of a value; strings that would read as something else are quoted."""
    out: list[str] = []

    def scalar(v: object) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, Number):
            return {"Infinity": ".inf", "-Infinity": "-.inf", "NaN": ".nan"}.get(v, str(v))
        plain = (
            v and v == v.strip() and not re.search(r"[\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff]|: |:$| #", v) and not re.match(r"[-?:,\[\]{}#&*!|>'\"%@`]|---|\.\.\.|<<$", v)
            and resolve(v, YamlOptions()) == v and not isinstance(resolve(v, YamlOptions()), Number) and resolve(v, YamlOptions(yaml11=True)) is not True and resolve(v, YamlOptions(yaml11=True)) is not False
        )
        if plain:
            return v
        short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}
        return '"' + "".join(short.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 or 0x7F <= ord(c) <= 0x9F or c in "\u2028\u2029\ufeff" else c) for c in v) + '"'

    def put(v: object, level: int, lead: str) -> None:
        pad = " " * (indent * level)
        if isinstance(v, dict) and v:
            for i, (k, x) in enumerate(v.items()):
                head = (lead if i == 0 else pad) + scalar(k) + ":"
                if isinstance(x, (dict, list)) and x:
                    out.append(head)
                    put(x, level + 1, " " * (indent * (level + 1)))
                else:
                    out.append(f"{head} {'{}' if x == {} else '[]' if x == [] else scalar(x)}")
        elif isinstance(v, list) and v:
            for i, x in enumerate(v):
                head = (lead if i == 0 else pad) + "-" + " " * (indent - 1)
                if isinstance(x, (dict, list)) and x:
                    put(x, level + 1, head)
                else:
                    out.append(head + ("{}" if x == {} else "[]" if x == [] else scalar(x)))
        else:
            out.append(lead + ("{}" if v == {} else "[]" if v == [] else scalar(v)))

    put(value, 0, "")
    return "\n".join(out) + "\n"
