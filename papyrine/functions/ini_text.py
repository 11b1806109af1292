"""INI files in seven dialects: entries with locations, duplicate policies, values, writing."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from .errors import TextError


@dataclass(frozen=True)
class IniDialect:
    """What a dialect allows. ``duplicate_keys``: error, first, last or collect."""

    hash_comments: bool = True
    semicolon_comments: bool = True
    inline_comments: bool = False
    leading_space: bool = True
    preamble: bool = True
    duplicate_groups: bool = True
    duplicate_keys: str = "last"
    key_pattern: str = r"[^=\[\]#;][^=]*"
    separators: str = "="
    trim_trailing: bool = True
    fold_keys: bool = False
    fold_groups: bool = False
    quoted_values: bool = False
    strip_quotes: bool = False
    subsections: bool = False
    valueless_keys: bool = False
    continuation: str = "none"  # none, backslash-empty, backslash-space, indent
    escapes: str = ""
    list_separator: str = ""
    truth: tuple[str, str] = ("true", "false")
    locales: bool = False


_DESKTOP = "s n t r \\ ;"
#: The seven dialects and what their formats allow.
DIALECTS = {
    "desktop_entry": IniDialect(semicolon_comments=False, leading_space=False, preamble=False, duplicate_groups=False, duplicate_keys="error", key_pattern=r"[A-Za-z0-9-]+(?:\[[^\]]+\])?", trim_trailing=False, escapes=_DESKTOP, list_separator=";", locales=True),
    "generic": IniDialect(trim_trailing=False, escapes=_DESKTOP, list_separator=";", locales=True),
    "git_config": IniDialect(inline_comments=True, duplicate_keys="collect", key_pattern=r"[A-Za-z][A-Za-z0-9-]*", fold_keys=True, fold_groups=True, quoted_values=True, subsections=True, valueless_keys=True, continuation="backslash-empty", escapes='n t b \\ "', truth=("true yes on 1", "false no off 0")),
    "editorconfig": IniDialect(fold_keys=True),
    "systemd": IniDialect(preamble=False, duplicate_keys="collect", continuation="backslash-space", escapes="a b f n r t v \\ \" ' s", truth=("1 yes y true t on", "0 no n false f off")),
    "configparser": IniDialect(preamble=False, duplicate_groups=False, duplicate_keys="error", key_pattern=r"[^=:\[\]][^=:]*", separators="=:", fold_keys=True, continuation="indent", truth=("1 yes true on", "0 no false off")),
    "win32": IniDialect(hash_comments=False, duplicate_keys="first", fold_keys=True, fold_groups=True, valueless_keys=True, strip_quotes=True),
}
_ESCAPE_VALUES = {"s": " ", "n": "\n", "t": "\t", "r": "\r", "b": "\b", "a": "\a", "f": "\f", "v": "\v"}


def dialect(name: str, **changes) -> IniDialect:
    return replace(DIALECTS[name], **changes)


def entries(text: str, d: IniDialect) -> list[dict]:
    """Every entry in file order: group, subsection, key, value, line; duplicates are kept."""
    out: list[dict] = []
    group, sub, opened = None, None, set()
    lines = re.split(r"\r\n|\n|\r", text.removeprefix("﻿"))
    at = 0
    while at < len(lines):
        raw, number = lines[at], at + 1
        at += 1

        def fail(message: str, line: int = number, raw: str = raw):
            raise TextError("ini", message, text, sum(len(x) + 1 for x in lines[: line - 1]))

        body = raw.strip(" \t")
        if not body or d.hash_comments and body[0] == "#" or d.semicolon_comments and body[0] == ";":
            continue
        if d.continuation == "indent" and raw[0] in " \t" and out and out[-1]["group"] == group:
            out[-1]["value"] = f"{out[-1]['value'] or ''}\n{body}"
            continue
        if not d.leading_space and raw[0] in " \t":
            fail("line starts with white space")
        if body[0] == "[":
            close = body.find("]")
            m = re.match(r"\[\s*([A-Za-z0-9.-]+)\s+\"((?:[^\"\\]|\\.)*)\"\s*\]", body) if d.subsections else None
            if m:
                group, sub = m[1].lower(), re.sub(r"\\(.)", r"\1", m[2])
            elif close < 0:
                fail("group header is not closed")
            else:
                if d.key_pattern.startswith(r"[^=:") or not d.leading_space:
                    close = body.rfind("]") if d.leading_space is False else close
                group, sub = body[1:close], None
                if d.fold_groups:
                    group = group.lower()
            if (group, sub) in opened and not d.duplicate_groups:
                fail(f"group {group!r} is repeated")
            opened.add((group, sub))
            continue
        if group is None and not d.preamble:
            fail("entry before the first group")
        place = min((i for i in (body.find(s) for s in d.separators) if i >= 0), default=-1)
        if place < 0:
            if not d.valueless_keys:
                fail("separator is missing")
            key, value = body, None
            if d.inline_comments:
                key = re.split(r"[#;]", key)[0].rstrip()
        else:
            key, value = body[:place].rstrip(" \t"), raw.lstrip(" \t")[place + 1 :].lstrip(" \t")
            while d.continuation.startswith("backslash") and re.search(r"(?<!\\)(?:\\\\)*\\$", value) and at < len(lines):
                value = value[:-1] + (" " if d.continuation == "backslash-space" else "") + lines[at].lstrip(" \t" if d.continuation == "backslash-space" else "")
                at += 1
            if d.quoted_values:
                value = _git_value(value, fail)
            elif d.trim_trailing:
                value = value.rstrip(" \t")
            if d.strip_quotes and len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
        if not re.fullmatch(d.key_pattern, key):
            fail(f"{key!r} is not a key")
        out.append({"group": group or "", "subsection": sub, "key": key.lower() if d.fold_keys else key, "value": value, "line": number})
    if d.duplicate_keys == "error":
        seen = set()
        for e in out:
            k = (e["group"], e["subsection"], e["key"])
            if k in seen:
                raise TextError("duplicate-key", f"{e['key']!r} is repeated", text, 0)
            seen.add(k)
    return out


def _git_value(raw: str, fail) -> str:
    """Quotes, escapes and comments of a git-config value."""
    out, inside, i, kept = [], False, 0, 0
    while i < len(raw):
        c = raw[i]
        if c == '"':
            inside = not inside
            kept = len(out)
        elif c == "\\":
            i += 1
            e = raw[i : i + 1]
            if not e or e not in 'ntb\\"':
                fail("unknown escape")
            out.append(_ESCAPE_VALUES.get(e, e))
            kept = len(out)
        elif c in "#;" and not inside:
            break
        else:
            out.append(c)
            if inside or c not in " \t":
                kept = len(out)
        i += 1
    if inside:
        fail("quote is not closed")
    return "".join(out[:kept])


def resolve(found: list[dict], d: IniDialect) -> dict[tuple[str, str], object]:
    """(group, key) to value under the duplicate policy; ``collect`` gives lists."""
    out: dict = {}
    for e in found:
        k = (f"{e['group']}.{e['subsection']}" if e["subsection"] is not None else e["group"], e["key"])
        if d.duplicate_keys == "collect":
            out.setdefault(k, []).append(e["value"])
        elif d.duplicate_keys == "last" or k not in out:
            out[k] = e["value"]
    return out


def unescape(value: str, d: IniDialect) -> str:
    """Escapes of the dialect resolved; an unknown one is an error."""
    allowed = d.escapes.split()

    def one(m: re.Match) -> str:
        if m[1] not in allowed:
            raise TextError("escape", f"unknown escape \\{m[1]}", value, m.start())
        return _ESCAPE_VALUES.get(m[1], m[1])

    return re.sub(r"\\(.?)", one, value, flags=re.S) if allowed else value


def split_list(value: str, d: IniDialect) -> list[str]:
    """Items of a list value; a separator may be escaped and one at the end adds nothing."""
    sep = d.list_separator or ";"
    parts = re.findall(rf"((?:\\.|[^\\{re.escape(sep)}])*)(?:{re.escape(sep)}|$)", value, re.S)
    if parts and parts[-1] == "":
        parts.pop()
    return [unescape(p, d) for p in parts]


def truth(value: str, d: IniDialect) -> bool | None:
    yes, no = (set(x.split()) for x in d.truth)
    low = value.lower() if len(yes) > 1 else value
    return True if low in yes else False if low in no else None


def interpolate(values: dict[tuple[str, str], str], group: str, key: str, style: str = "basic", depth: int = 10) -> str:
    """``%(name)s`` (basic) or ``${section:name}`` (extended) references, at most ``depth`` deep."""
    if depth < 0:
        raise TextError("interpolation", "nested too deeply")
    raw = values.get((group, key), values.get(("DEFAULT", key)))
    if raw is None:
        raise TextError("interpolation", f"{key!r} is missing")
    if style == "basic":
        return re.sub(r"%(?:%|\(([^)]+)\)s)", lambda m: "%" if m[0] == "%%" else interpolate(values, group, m[1].lower(), style, depth - 1), raw)
    return re.sub(r"\$(?:\$|\{(?:([^:}]+):)?([^}]+)\})", lambda m: "$" if m[0] == "$$" else interpolate(values, m[1] or group, m[2].lower(), style, depth - 1), raw)


def localized(values: dict[str, str], key: str, locale: str) -> str | None:
    """Value for lang_COUNTRY@MODIFIER with the usual fallbacks."""
    m = re.fullmatch(r"([a-z]+)(?:_([A-Z]+))?(?:\.[^@]+)?(?:@(.+))?", locale)
    lang, country, modifier = m.groups() if m else (locale, None, None)
    for tag in (country and modifier and f"{lang}_{country}@{modifier}", country and f"{lang}_{country}", modifier and f"{lang}@{modifier}", lang):
        if tag and f"{key}[{tag}]" in values:
            return values[f"{key}[{tag}]"]
    return values.get(key)


def write(found: list[dict], d: IniDialect) -> str:
    """INI text of entries; refuses a value the dialect cannot spell."""
    out, current = [], object()
    for e in found:
        head = (e["group"], e["subsection"])
        if head != current and (e["group"] or e["subsection"] is not None or out):
            current = head
            name = e["group"] if e["subsection"] is None else f'{e["group"]} "' + re.sub(r'(["\\])', r"\\\1", e["subsection"]) + '"'
            out.append(f"[{name}]")
        value = e["value"]
        if value is None:
            if not d.valueless_keys:
                raise TextError("unwritable", f"{e['key']!r} needs a value")
            out.append(e["key"])
            continue
        if d.quoted_values:
            value = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t")
            value = f'"{value}"' if value != value.strip() or re.search("[#;]", value) else value
        elif "\n" in value or "\r" in value:
            if d.continuation == "indent" and "\r" not in value and "\n\n" not in value:
                value = value.replace("\n", "\n\t")
            else:
                raise TextError("unwritable", f"{e['key']!r} has a line break")
        elif value != value.strip(" \t") and d.trim_trailing:
            raise TextError("unwritable", f"{e['key']!r} has outer white space")
        out.append(f"{e['key']}={value}")
    return "\n".join(out) + "\n" if out else ""


def split_words(value: str) -> list[str]:
    """Words apart by white space; quotes of either kind hold a word together, a backslash takes the next character as it is."""
    out: list[str] = []
    word, quote, at = None, "", 0
    while at < len(value):
        c = value[at]
        if c == "\\" and quote != "'":
            if at + 1 == len(value):
                raise TextError("escape", "a backslash ends the value", value, at)
            at += 1
            word = (word or "") + value[at]
        elif quote:
            quote, word = ("", word) if c == quote else (quote, word + c)
        elif c in "\"'" and word is None:
            quote, word = c, ""
        elif c in " \t\n\r":
            out, word = ([*out, word] if word is not None else out), None
        else:
            word = (word or "") + c
        at += 1
    if quote:
        raise TextError("quote", "a quote is not closed", value, len(value))
    return [*out, word] if word is not None else out


def integer(value: str) -> int | None:
    """A decimal, 0x, 0o or 0b integer with an optional sign and K, M or G (of 1024); None if it is none."""
    m = re.fullmatch(r"([+-]?)(0x[0-9a-fA-F]+|0o[0-7]+|0b[01]+|[0-9]+)([KMG]?)", value.strip())
    if not m:
        return None
    return (-1 if m[1] == "-" else 1) * int(m[2], 0 if m[2][:1] == "0" and m[2][1:2] in ("x", "o", "b") else 10) * 1024 ** " KMG".index(m[3] or " ")
