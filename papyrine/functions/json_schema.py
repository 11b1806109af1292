"""JSON Schema: compiled on the driver, verdict and first failing location.

Drafts 2020-12, 2019-09, 07, 06 and 04; references within the schema and to
registered documents (never over a network); unevaluated* by tracking what was
evaluated; ``format`` asserted if asked.  A keyword that is known but has a
wrong type refuses the schema when it is compiled.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from decimal import Decimal
from urllib.parse import unquote, urldefrag, urljoin, urlsplit

from .errors import TextError
from .json_text import Number, equal, pointer_tokens, type_name, write

_TYPES = frozenset("null boolean number integer string array object".split())
#: Keywords by the type their value must have.
_SHAPES = {
    "number": "multipleOf maximum minimum maxLength minLength maxItems minItems maxProperties minProperties maxContains minContains".split(),
    "string": "$id id $ref $anchor $dynamicRef $dynamicAnchor $schema pattern format title description $comment".split(),
    "object": "properties patternProperties $defs definitions dependentSchemas dependentRequired dependencies".split(),
    "array": "required allOf anyOf oneOf prefixItems enum".split(),
}


class Invalid(Exception):
    """Where an instance failed: pointer tokens and a message."""

    def __init__(self, path: tuple, message: str):
        super().__init__(message)
        self.path, self.message = path, message


class Schema:
    """A compiled schema."""

    def __init__(self, schema: object, draft: str = "2020-12", documents: dict[str, object] | None = None, formats: bool = False):
        if isinstance(schema, dict) and (named := schema.get("$schema")):
            m = re.search(r"draft(?:-|/)(0[467]|2019-09|2020-12)", named)
            if not m:
                raise TextError("schema", f"unknown draft {named!r}")
            draft = m[1].lstrip("0") if m[1].startswith("0") else m[1]
        self.draft = draft.lstrip("0") if draft.startswith("0") else draft
        self.legacy = self.draft in ("4", "6", "7")
        self.formats, self.index = formats, {}
        self.root = schema
        self._scan(schema, "")
        for uri, other in (documents or {}).items():
            self.index[uri] = other
            self._scan(other, uri)
        self._resolve_all(schema, "")

    def _scan(self, schema: object, base: str) -> None:
        if isinstance(schema, list):
            for s in schema:
                self._scan(s, base)
        if not isinstance(schema, dict):
            return
        own = schema.get("id" if self.draft == "4" else "$id")
        if isinstance(own, str):
            base = urljoin(base, own)
            self.index[urldefrag(base)[0] if not urldefrag(base)[1] else base] = schema
        for word in ("$anchor", "$dynamicAnchor"):
            if isinstance(schema.get(word), str):
                self.index[f"{urldefrag(base)[0]}#{schema[word]}"] = schema
        for kind, words in _SHAPES.items():
            for word in words:
                if word in schema and type_name(schema[word]) != kind and not (word in ("required",) and self.draft == "4"):
                    raise TextError("schema", f"{word!r} must be of type {kind}")
        if "pattern" in schema:
            _pattern(schema["pattern"])
        for p in schema.get("patternProperties", {}):
            _pattern(p)
        for name in [*(schema["type"] if isinstance(schema.get("type"), list) else [schema["type"]] if "type" in schema else [])]:
            if name not in _TYPES:
                raise TextError("schema", f"unknown type {name!r}")
        for word, value in schema.items():
            if word in ("enum", "const", "default", "examples"):
                continue
            self._scan(list(value.values()) if isinstance(value, dict) and word in ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies") else value, base)

    def _resolve_all(self, schema: object, base: str) -> None:
        """Every reference must have a target when the schema is compiled."""
        if isinstance(schema, list):
            for s in schema:
                self._resolve_all(s, base)
        elif isinstance(schema, dict):
            own = schema.get("id" if self.draft == "4" else "$id")
            base = urljoin(base, own) if isinstance(own, str) else base
            for word in ("$ref", "$dynamicRef"):
                if isinstance(schema.get(word), str):
                    self.target(schema[word], base)
            for word, value in schema.items():
                if word not in ("enum", "const", "default", "examples"):
                    self._resolve_all(list(value.values()) if isinstance(value, dict) and word in ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas", "dependencies") else value, base)

    def target(self, ref: str, base: str) -> tuple[object, str]:
        uri = urljoin(base, ref)
        if uri in self.index:
            return self.index[uri], urldefrag(uri)[0]
        document, fragment = urldefrag(uri)
        found = self.index.get(document, self.root if not document or document == urldefrag(base)[0] and document not in self.index else None)
        if found is None:
            raise TextError("schema", f"no schema for {ref!r}")
        if fragment and not fragment.startswith("/"):
            raise TextError("schema", f"no anchor for {ref!r}")
        for token in pointer_tokens(unquote(fragment)):
            try:
                found = found[int(token)] if isinstance(found, list) else found[token]
            except (KeyError, IndexError, ValueError, TypeError):
                raise TextError("schema", f"no schema for {ref!r}") from None
            if isinstance(found, dict) and isinstance(found.get("$id"), str):
                document = urljoin(document, found["$id"])
        return found, document

    def validate(self, instance: object) -> dict:
        """{valid, pointer, message}: the location of the first failure."""
        try:
            self._check(self.root, instance, (), "", 0)
        except Invalid as e:
            pointer = "".join("/" + str(t).replace("~", "~0").replace("/", "~1") for t in e.path)
            return {"valid": False, "pointer": pointer, "message": e.message}
        return {"valid": True, "pointer": None, "message": None}

    def _passes(self, *args) -> tuple[set, set] | None:
        try:
            return self._check(*args)
        except Invalid:
            return None

    def _check(self, s: object, v: object, path: tuple, base: str, depth: int) -> tuple[set, set]:
        """Evaluated member names and item indices; raises ``Invalid``."""
        if s is True or s == {}:
            return set(), set()
        if s is False:
            raise Invalid(path, "nothing is allowed here")
        if depth > 200:
            raise Invalid(path, "references nest too deeply")
        names, items = set(), set()

        def fail(message: str) -> None:
            raise Invalid(path, message)

        def also(found: tuple[set, set] | None) -> None:
            if found:
                names.update(found[0])
                items.update(found[1])

        own = s.get("id" if self.draft == "4" else "$id")
        base = urljoin(base, own) if isinstance(own, str) else base
        for word in ("$ref", "$dynamicRef", "$recursiveRef"):
            if word in s:
                other, at = self.target(s[word], base)
                also(self._check(other, v, path, at, depth + 1))
                if self.legacy:
                    return names, items
        kind = type_name(v)
        number = v.decimal() if kind == "number" else None
        if "type" in s:
            wanted = s["type"] if isinstance(s["type"], list) else [s["type"]]
            whole = kind == "number" and number == number.to_integral_value() and not (self.draft == "4" and not re.fullmatch(r"-?\d+", v))
            if kind not in wanted and not (whole and "integer" in wanted):
                fail(f"type is {kind}, not {' or '.join(wanted)}")
        if "enum" in s and not any(equal(v, x) for x in s["enum"]):
            fail("value is not one of the enum")
        if "const" in s and not equal(v, s["const"]):
            fail("value is not the const")
        if number is not None:
            self._number(s, number, fail)
        if kind == "string":
            for word, bad in (("maxLength", len(v).__gt__), ("minLength", len(v).__lt__)):
                if word in s and bad(int(s[word].decimal())):
                    fail(f"length breaks {word}")
            if "pattern" in s and not _pattern(s["pattern"]).search(v):
                fail("string does not match the pattern")
            if self.formats and "format" in s and not check_format(s["format"], v):
                fail(f"string is no {s['format']}")
        if kind == "array":
            self._array(s, v, path, base, depth, fail, items)
        if kind == "object":
            self._object(s, v, path, base, depth, fail, names)
        for sub in s.get("allOf", ()):
            also(self._check(sub, v, path, base, depth + 1))
        if "anyOf" in s:
            found = [f for sub in s["anyOf"] if (f := self._passes(sub, v, path, base, depth + 1)) is not None]
            if not found:
                fail("no branch of anyOf matches")
            for f in found:
                also(f)
        if "oneOf" in s:
            found = [f for sub in s["oneOf"] if (f := self._passes(sub, v, path, base, depth + 1)) is not None]
            if len(found) != 1:
                fail(f"{len(found)} branches of oneOf match")
            also(found[0])
        if "not" in s and self._passes(s["not"], v, path, base, depth + 1) is not None:
            fail("the schema under not matches")
        if "if" in s and self.draft not in ("4", "6"):
            found = self._passes(s["if"], v, path, base, depth + 1)
            also(found)
            branch = "then" if found is not None else "else"
            if branch in s:
                also(self._check(s[branch], v, path, base, depth + 1))
        if not self.legacy:
            if kind == "object" and "unevaluatedProperties" in s:
                for k in v:
                    if k not in names:
                        self._check(s["unevaluatedProperties"], v[k], (*path, k), base, depth + 1)
                names.update(v)
            if kind == "array" and "unevaluatedItems" in s:
                for i, x in enumerate(v):
                    if i not in items:
                        self._check(s["unevaluatedItems"], x, (*path, i), base, depth + 1)
                items.update(range(len(v)))
        return names, items

    def _number(self, s: dict, n: Decimal, fail) -> None:
        get = lambda w: s[w].decimal() if isinstance(s.get(w), Number) else None
        low, high, step = get("minimum"), get("maximum"), get("multipleOf")
        if low is not None and (n < low or n == low and s.get("exclusiveMinimum") is True):
            fail("number is under the minimum")
        if high is not None and (n > high or n == high and s.get("exclusiveMaximum") is True):
            fail("number is over the maximum")
        if (x := get("exclusiveMinimum")) is not None and n <= x:
            fail("number is not over the exclusive minimum")
        if (x := get("exclusiveMaximum")) is not None and n >= x:
            fail("number is not under the exclusive maximum")
        if step and n % step != 0:
            fail("number is no multiple")

    def _array(self, s: dict, v: list, path: tuple, base: str, depth: int, fail, items: set) -> None:
        size = lambda w: int(s[w].decimal())
        if "maxItems" in s and len(v) > size("maxItems") or "minItems" in s and len(v) < size("minItems"):
            fail("number of items is out of bounds")
        if s.get("uniqueItems") is True:
            texts = [write(x, _CANONICAL) for x in v]
            if len(set(texts)) < len(texts):
                fail("items repeat")
        tuples = s.get("prefixItems") if self.draft == "2020-12" else s.get("items") if isinstance(s.get("items"), list) else None
        rest = s.get("items") if self.draft == "2020-12" or not isinstance(s.get("items"), list) else s.get("additionalItems")
        begin = 0
        for i, sub in enumerate(tuples or ()):
            if i < len(v):
                self._check(sub, v[i], (*path, i), base, depth + 1)
                items.add(i)
            begin = i + 1
        if rest is not None:
            for i in range(begin, len(v)):
                self._check(rest, v[i], (*path, i), base, depth + 1)
                items.add(i)
        if "contains" in s and self.draft != "4":
            hits = [i for i, x in enumerate(v) if self._passes(s["contains"], x, (*path, i), base, depth + 1) is not None]
            least = size("minContains") if "minContains" in s and not self.legacy else 1
            most = size("maxContains") if "maxContains" in s and not self.legacy else len(v)
            if not least <= len(hits) <= most:
                fail("number of contained items is out of bounds")
            if self.draft == "2020-12":
                items.update(hits)

    def _object(self, s: dict, v: dict, path: tuple, base: str, depth: int, fail, names: set) -> None:
        size = lambda w: int(s[w].decimal())
        if "maxProperties" in s and len(v) > size("maxProperties") or "minProperties" in s and len(v) < size("minProperties"):
            fail("number of members is out of bounds")
        for k in s.get("required", ()) if isinstance(s.get("required"), list) else ():
            if k not in v:
                fail(f"member {k!r} is missing")
        covered = set()
        for k, sub in s.get("properties", {}).items():
            if k in v:
                self._check(sub, v[k], (*path, k), base, depth + 1)
                covered.add(k)
        for p, sub in s.get("patternProperties", {}).items():
            for k in v:
                if _pattern(p).search(k):
                    self._check(sub, v[k], (*path, k), base, depth + 1)
                    covered.add(k)
        if "additionalProperties" in s:
            for k in v:
                if k not in covered:
                    self._check(s["additionalProperties"], v[k], (*path, k), base, depth + 1)
            covered = set(v)
        names.update(covered)
        if "propertyNames" in s:
            for k in v:
                self._check(s["propertyNames"], k, (*path, k), base, depth + 1)
        needs = dict(s.get("dependentRequired", {})) | {k: d for k, d in s.get("dependencies", {}).items() if isinstance(d, list)}
        for k, others in needs.items():
            if k in v and any(o not in v for o in others):
                fail(f"member {k!r} needs others")
        subs = dict(s.get("dependentSchemas", {})) | {k: d for k, d in s.get("dependencies", {}).items() if not isinstance(d, list)}
        for k, sub in subs.items():
            if k in v:
                names.update(self._check(sub, v, path, base, depth + 1)[0])


_CANONICAL = __import__(f"{__package__}.json_text", fromlist=["CANONICAL"]).CANONICAL
_patterns: dict[str, re.Pattern] = {}


def _pattern(text: str) -> re.Pattern:
    """An ECMA pattern as a Python one."""
    if text not in _patterns:
        import regex

        try:
            _patterns[text] = regex.compile(re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\Z", text).replace(r"\d", "[0-9]").replace(r"\w", "[A-Za-z0-9_]"))
        except regex.error as e:
            raise TextError("schema", f"bad pattern {text!r}: {e}") from None
    return _patterns[text]


_HOST = re.compile(r"(?=.{1,253}$)(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(?:\.(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?))*")
_TIME = re.compile(r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)")
_DURATION = re.compile(r"P(?!$)(?:\d+W|(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?)")


def check_format(name: str, text: str) -> bool:
    """Whether a string has a format; unknown formats hold."""

    def date(t: str) -> bool:
        try:
            return bool(re.fullmatch(r"\d{4}-\d\d-\d\d", t)) and bool(dt.date.fromisoformat(t))
        except ValueError:
            return False

    def address(cls, t: str) -> bool:
        try:
            return "%" not in t and bool(cls(t))
        except ValueError:
            return False

    def uri(t: str, relative: bool, unicode: bool) -> bool:
        allowed = r"[^\x00-\x20<>\"{}|\\^`]" if unicode else r"[!#$&-;=?-Z\[\]_a-z~]|%[0-9A-Fa-f]{2}"
        if not re.fullmatch(f"(?:{allowed})*", t) or re.search(r"%(?![0-9A-Fa-f]{2})", t):
            return False
        try:
            parts = urlsplit(t)
            _ = parts.port
        except ValueError:
            return False
        return relative or bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", t))

    def pointer(t: str) -> bool:
        return bool(re.fullmatch(r"(?:/(?:[^~/]|~[01])*)*", t))

    checks = {
        "date": date, "time": lambda t: bool(_TIME.fullmatch(t)),
        "date-time": lambda t: len(t) > 11 and t[10] in "Tt" and date(t[:10]) and bool(_TIME.fullmatch(t[11:])),
        "duration": lambda t: bool(_DURATION.fullmatch(t)),
        "email": lambda t: bool(re.fullmatch(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@.+", t)) and bool(_HOST.fullmatch(t.rpartition("@")[2])),
        "idn-email": lambda t: bool(re.fullmatch(r"[^\s@]+@[^\s@]+", t)),
        "hostname": lambda t: bool(_HOST.fullmatch(t)), "idn-hostname": lambda t: bool(t) and not re.search(r"[\s/@:?#]", t),
        "ipv4": lambda t: bool(re.fullmatch(r"(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])(?:\.(?!$)|$)){4}", t)), "ipv6": lambda t: address(ipaddress.IPv6Address, t),
        "uri": lambda t: uri(t, False, False), "uri-reference": lambda t: uri(t, True, False), "iri": lambda t: uri(t, False, True), "iri-reference": lambda t: uri(t, True, True),
        "uri-template": lambda t: not re.search(r"[{}]", re.sub(r"\{[+#./;?&=,!@|]?[A-Za-z0-9_%.,*:]+\}", "", t)),
        "uuid": lambda t: bool(re.fullmatch(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}", t)),
        "json-pointer": pointer, "relative-json-pointer": lambda t: bool(m := re.match(r"(?:0|[1-9]\d*)", t)) and (t[m.end() :] == "#" or pointer(t[m.end() :])),
        "regex": lambda t: _is_pattern(t),
    }
    return checks[name](text) if name in checks else True


def _is_pattern(text: str) -> bool:
    try:
        _pattern(text)
    except TextError:
        return False
    return True
