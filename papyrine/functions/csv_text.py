"""CSV: dialects, parsing with ragged rows kept, writing, sniffing."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from .errors import Limits, TextError


@dataclass(frozen=True)
class Dialect:
    """How fields are spelt. ``escape``: None doubles the quote inside quotes."""

    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    comment: str | None = None
    trim: bool = False
    allow_bare_quote: bool = False
    skip_bom: bool = True
    skip_empty_lines: bool = False
    limits: Limits = field(default_factory=lambda: Limits(total=1 << 30, items=10_000_000))
    max_columns: int = 100_000

    def __post_init__(self):
        if len(self.delimiter) != 1 or len(self.quote) > 1 or self.delimiter == self.quote or self.delimiter in "\r\n":
            raise ValueError("delimiter and quote are two different single characters")


def parse(text: str, dialect: Dialect = Dialect()) -> list[list[str]]:
    """Rows of fields; CRLF, LF and CR end a record and rows keep their own widths."""
    if dialect.skip_bom and text.startswith("﻿"):
        text = text[1:]
    if len(text) > dialect.limits.total:
        raise TextError("limit", "text is too long", text[:1], 0)
    d, q = dialect.delimiter, dialect.quote
    rows: list[list[str]] = []
    row: list[str] = []
    at, n = 0, len(text)
    plain = re.compile(f"[^{re.escape(d)}\r\n{re.escape(q) if q and not dialect.allow_bare_quote else ''}]*")
    line_start = True
    while at < n or row:
        if line_start and dialect.comment and text.startswith(dialect.comment, at):
            end = re.compile("\r\n|\n|\r|$").search(text, at)
            at = end.end() if end.end() > at else n
            continue
        line_start = False
        start = at
        lead = at
        if dialect.trim:
            while lead < n and text[lead] in " \t" and text[lead] != d:
                lead += 1
        if q and text.startswith(q, lead):
            value, at = _quoted(text, lead, dialect)
            if dialect.trim:
                while at < n and text[at] in " \t" and text[at] != d:
                    at += 1
            if at < n and text[at] not in (d, "\r", "\n"):
                raise TextError("quote", "text after a closing quote", text, at)
        else:
            m = plain.match(text, at)
            at = m.end()
            if q and not dialect.allow_bare_quote and text.startswith(q, at):
                raise TextError("quote", "quote inside an unquoted field", text, at)
            value = m[0].strip(" \t") if dialect.trim else m[0]
        if len(value) > dialect.limits.string:
            raise TextError("limit", "field is too long", text, start)
        row.append(value)
        if len(row) > dialect.max_columns:
            raise TextError("limit", "too many columns", text, at)
        if at < n and text[at] == d:
            at += 1
            if at == n:
                row.append("")
            else:
                continue
        if at < n:
            at += 2 if text.startswith("\r\n", at) else 1
        if not (dialect.skip_empty_lines and row == [""]):
            rows.append(row)
        if len(rows) > dialect.limits.items:
            raise TextError("limit", "too many rows", text, at)
        row, line_start = [], True
    return rows


def _quoted(text: str, at: int, dialect: Dialect) -> tuple[str, int]:
    q, e = dialect.quote, dialect.escape
    out, begin, i = [], at, at + 1
    while True:
        stops = [x for x in (text.find(q, i), text.find(e, i) if e else -1) if x >= 0]
        if not stops:
            raise TextError("quote", "quoted field is not closed", text, begin)
        stop = min(stops)
        out.append(text[i:stop])
        if e and text[stop] == e and e != q:
            out.append(text[stop + 1 : stop + 2])
            i = stop + 2
        elif not e and text.startswith(q, stop + 1):
            out.append(q)
            i = stop + 2
        else:
            return "".join(out), stop + 1


def write(rows: list[list[str]], dialect: Dialect = Dialect(), quoting: str = "minimal", newline: str = "\n", trailing_newline: bool = True, trim_trailing_empty: bool = False) -> str:
    """CSV text; ``quoting``: minimal, all, nonnumeric or none. What cannot be spelt is refused before anything is written."""
    return "".join(
        record(r, dialect, quoting, trim_trailing_empty) + (newline if trailing_newline or i < len(rows) - 1 else "") for i, r in enumerate(rows)
    )


def record(fields: list[str], dialect: Dialect = Dialect(), quoting: str = "minimal", trim_trailing_empty: bool = False) -> str:
    d, q, e = dialect.delimiter, dialect.quote, dialect.escape
    fields = ["" if f is None else f for f in fields]
    if trim_trailing_empty:
        while fields and fields[-1] == "":
            fields = fields[:-1]

    def one(i: int, f: str) -> str:
        special = any(c in f for c in (d, "\n", "\r")) or bool(q and q in f) or (dialect.comment and i == 0 and f.startswith(dialect.comment))
        special = special or dialect.trim and f != f.strip(" \t") or len(fields) == 1 and f == ""
        numeric = bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", f))
        if quoting == "all" or quoting == "nonnumeric" and not numeric or quoting == "minimal" and special:
            if not q:
                raise TextError("unwritable", f"{f!r} needs a quote character")
            body = f.replace(e, e + e).replace(q, e + q) if e else f.replace(q, q + q)
            return q + body + q
        if quoting == "none" and special and f:
            raise TextError("unwritable", f"{f!r} cannot be written without quotes")
        return f

    return d.join(one(i, f) for i, f in enumerate(fields))


#: The dialects a sniffer tries, most usual first.
CANDIDATES = [Dialect(delimiter=d, quote=q) for q in "\"'" for d in ",;\t|:"]


def sniff(sample: str) -> Dialect:
    """The dialect under which most rows have one width of two or more; refuses ties and samples of one column."""
    scored = []
    for candidate in CANDIDATES:
        try:
            rows = [r for r in parse(sample, candidate) if r != [""]]
        except TextError:
            continue
        if not rows:
            continue
        width, hits = max(Counter(map(len, rows)).items(), key=lambda x: (x[1], x[0]))
        if width > 1:
            quoted = len(re.findall(f"(?:^|[{re.escape(candidate.delimiter)}\n]){candidate.quote}", sample))
            scored.append(((hits / len(rows), quoted, width), candidate))
    if not scored:
        raise TextError("sniff", "no dialect gives more than one column", sample, 0)
    scored.sort(key=lambda x: x[0], reverse=True)
    best = [c for s, c in scored if s == scored[0][0]]
    if len({c.delimiter for c in best}) > 1:
        raise TextError("sniff", "several dialects fit equally well", sample, 0)
    return best[0]
