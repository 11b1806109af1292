"""Parse events of JSON and XML texts that arrive in chunks, as keyed state machines.

A chunk is (stream_id, seq, data, last); it may be cut at any byte, come late, in any
order or more than once.  State of a stream, by ``transformWithState``: where its
tokenizer stands (a value), and the chunks that wait for one before them (a map, so
that a batch touches only the chunks it brings).  The tokenizers are resumable: what
follows the last whole token stays as ``rest`` with the place up to which it was
looked at, so a token of many chunks is not looked at again from its start.  The
events of a text are the same for every cut and every batching.

A bad or truncated text gives one ``error`` event and no more; so does a stream whose
rest and waiting chunks exceed ``max_state`` bytes.  A chunk that comes again, before or
after the end, is ignored: a finished stream leaves a mark of a few bytes.  With a
``time`` column (and a watermark on it) a stream that stays idle for ``idle`` ends: an
open one with a ``truncated`` error, and the marks of finished ones go.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.errors import TextError
from ..functions.markup import is_xml_name
from ..runtime import ship

OUTPUT = "stream_id string, event_idx long, record long, event string, depth int, key string, value string, repeated boolean"
_row = Row(*(c.split()[0] for c in OUTPUT.split(", ")))
#: (event, depth, key, value, repeated)
Event = tuple[str, int, str | None, str | None, bool]


@dataclass
class Tokenizer:
    """Resumable part of a tokenizer: text not yet used, how far it was looked at, characters used before it."""

    rest: str = ""
    seen: int = 0
    used: int = 0
    record: int = 0
    stack: list = field(default_factory=list)
    want: str = "value"

    def feed(self, text: str, last: bool) -> Iterator[tuple[int, Event]]:
        """(record, event) of what is whole now."""
        buffer, at = self.rest + text, 0
        while True:
            before = self.record
            step = self.token(buffer, at, last)
            if step is None:
                break
            at, events = step
            self.seen = 0
            for e in events:
                yield before, e
        self.rest = buffer[at:]
        self.used += at
        if last:
            self.finish()

    def fail(self, code: str, message: str, at: int):
        raise TextError(code, f"{message} at {self.used + at}", "", 0)

    def state(self) -> str:
        return json.dumps([self.rest, self.seen, self.used, self.record, self.stack, self.want])

    @classmethod
    def of(cls, state: str, **options):
        return cls(*json.loads(state), **options)

    def token(self, buffer: str, at: int, last: bool) -> tuple[int, list[Event]] | None:
        raise NotImplementedError

    def finish(self) -> None:
        raise NotImplementedError


_SPACE = re.compile(r"[ \t\r\n]*")
_INSIDE = re.compile(r'(?:[^"\\]++|\\.)*+', re.S)
_WORD = re.compile(r"[-+.\w]+")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\Z")
_LITERALS = {"true": "boolean", "false": "boolean", "null": "null"}


@dataclass
class JsonTokenizer(Tokenizer):
    """Values one after the other.  ``names``: what a repeated member name does: ``flag`` it, ``first`` (later ones are left out) or ``error``.

    An open container is [kind, key, names, left out].
    """

    names: str = "flag"
    depth: int = 256

    def token(self, buffer: str, at: int, last: bool) -> tuple[int, list[Event]] | None:
        at = _SPACE.match(buffer, at).end()
        if at >= len(buffer):
            return None
        c = buffer[at]
        if c == '"':
            if self.want not in ("value", "value or end", "key", "key or end"):
                self.fail("syntax", f"{self.want} is expected", at)
            end = _INSIDE.match(buffer, at + 1 + self.seen).end()
            if end >= len(buffer) or buffer[end] != '"':
                self.seen = end - at - 1
                return None
            try:
                value = json.loads(buffer[at : end + 1])
            except json.JSONDecodeError as e:
                self.fail("syntax", e.msg, at)
            return end + 1, self._key(value, at) if self.want.startswith("key") else self._scalar("string", value)
        if c in "{[":
            if not self.want.startswith("value"):
                self.fail("syntax", f"{self.want} is expected", at)
            if len(self.stack) >= self.depth:
                self.fail("limit", "nested too deeply", at)
            kind = "object" if c == "{" else "array"
            event = self._event(f"begin_{kind}", None)
            self.stack.append([kind, self._name(), [], self._hidden()])
            self.want = "key or end" if c == "{" else "value or end"
            return at + 1, event
        if c in "}]":
            kind = "object" if c == "}" else "array"
            if not self.stack or self.stack[-1][0] != kind or not self.want.endswith("end"):
                self.fail("syntax", f"{self.want} is expected", at)
            _, key, _, hidden = self.stack.pop()
            event = [] if hidden else [(f"end_{kind}", len(self.stack), key if isinstance(key, str) else None, None, False)]
            return at + 1, event + self._after()
        if c == ",":
            if self.want != "comma or end":
                self.fail("syntax", f"{self.want} is expected", at)
            self.want = "key" if self.stack[-1][0] == "object" else "value"
            return at + 1, []
        if c == ":":
            if self.want != "colon":
                self.fail("syntax", f"{self.want} is expected", at)
            self.want = "value"
            return at + 1, []
        m = _WORD.match(buffer, at)
        if not m:
            self.fail("syntax", f"{self.want} is expected", at)
        if m.end() == len(buffer) and not last:
            return None
        if not self.want.startswith("value"):
            self.fail("syntax", f"{self.want} is expected", at)
        kind = _LITERALS.get(m[0]) or ("number" if _NUMBER.match(m[0]) else None)
        if kind is None:
            self.fail("syntax", f"{m[0][:20]!r} is no value", at)
        return m.end(), self._scalar(kind, m[0])

    def _name(self) -> str | None:
        return self.stack[-1][2][-1] if self.stack and self.stack[-1][0] == "object" and self.stack[-1][2] else None

    def _repeated(self) -> bool:
        return bool(self.stack) and self.stack[-1][0] == "object" and self.stack[-1][2].count(self._name()) > 1

    def _hidden(self) -> bool:
        return bool(self.stack) and (self.stack[-1][3] or self.names == "first" and self._repeated())

    def _event(self, kind: str, value: str | None) -> list[Event]:
        return [] if self._hidden() else [(kind, len(self.stack), self._name(), value, self._repeated())]

    def _key(self, name: str, at: int) -> list[Event]:
        if self.names == "error" and name in self.stack[-1][2]:
            self.fail("duplicate-key", f"member {name[:40]!r} is repeated", at)
        self.stack[-1][2].append(name)
        self.want = "colon"
        return []

    def _scalar(self, kind: str, value: str) -> list[Event]:
        return self._event(kind, value) + self._after()

    def _after(self) -> list[Event]:
        if self.stack:
            self.want = "comma or end"
            return []
        self.want = "value"
        self.record += 1
        return [("end_record", 0, None, None, False)]

    def finish(self) -> None:
        if self.stack or self.rest.strip(" \t\r\n"):
            self.fail("truncated", f"{self.want} is expected", len(self.rest))


_TAG = re.compile(r"<(/?)([^\s/<>\"'=]+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"\s+([^\s=\"'<>/]+)\s*=\s*(?:\"([^<\"]*)\"|'([^<']*)')")
_REFERENCE = re.compile(r"&(?:#(\d+)|#x([0-9a-fA-F]+)|(\w+));|&")
_PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_SECTIONS = (("<!--", "-->", "comment"), ("<![CDATA[", "]]>", "cdata"), ("<?", "?>", "instruction"))


@dataclass
class XmlTokenizer(Tokenizer):
    """One well-formed document; names keep their prefixes, entities other than the predefined ones are refused."""

    depth: int = 256

    def token(self, buffer: str, at: int, last: bool) -> tuple[int, list[Event]] | None:
        if at >= len(buffer):
            return None
        if buffer[at] != "<":
            return self._text(buffer, at, last)
        for opening, closing, kind in _SECTIONS:
            if buffer.startswith(opening, at):
                end = buffer.find(closing, max(at + len(opening), at + self.seen))
                if end < 0:
                    self.seen = max(len(opening), len(buffer) - at - len(closing) + 1)
                    return None
                return end + len(closing), self._section(kind, buffer[at + len(opening) : end], at)
            if opening.startswith(buffer[at:]) and not last:
                return None
        if buffer.startswith("<!DOCTYPE", at):
            return self._doctype(buffer, at)
        if "<!DOCTYPE".startswith(buffer[at:]) and not last:
            return None
        m = _TAG.match(buffer, at)
        if not m:
            if last or re.match(r"<[^\"'<>]*<", buffer[at : at + 4096]):
                self.fail("syntax", "a tag is not closed", at)
            return None
        return m.end(), self._end(m, at) if m[1] else self._start(m, at)

    def _text(self, buffer: str, at: int, last: bool) -> tuple[int, list[Event]] | None:
        end = buffer.find("<", at + self.seen)
        if end < 0 and not last:
            self.seen = len(buffer) - at
            return None
        end = len(buffer) if end < 0 else end
        raw = buffer[at:end].replace("\r\n", "\n").replace("\r", "\n")
        if not self.stack:
            if raw.strip(" \t\n").removeprefix("﻿"):
                self.fail("syntax", "text outside the root element", at)
            return end, []
        if "]]>" in raw:
            self.fail("syntax", "']]>' in text", at)
        return end, [("text", len(self.stack), None, self._decoded(raw, at), False)]

    def _decoded(self, raw: str, at: int) -> str:
        def one(m: re.Match) -> str:
            if m[1] or m[2]:
                code = int(m[1]) if m[1] else int(m[2], 16)
                if code in (9, 10, 13) or 32 <= code < 0xD800 or 0xE000 <= code < 0xFFFE or 0x10000 <= code < 0x110000:
                    return chr(code)
            if m[3] in _PREDEFINED:
                return _PREDEFINED[m[3]]
            self.fail("reference", f"{m[0][:20]!r} is not known", at)

        return _REFERENCE.sub(one, raw) if "&" in raw else raw

    def _section(self, kind: str, body: str, at: int) -> list[Event]:
        if kind == "comment" and ("--" in body or body.endswith("-")):
            self.fail("syntax", "'--' in a comment", at)
        if kind == "cdata" and not self.stack:
            self.fail("syntax", "text outside the root element", at)
        if kind == "instruction":
            target, _, body = body.partition(" ")
            if target == "xml":
                return []
            return [(kind, len(self.stack), target, body.strip(), False)]
        return [(kind, len(self.stack), None, body.replace("\r\n", "\n").replace("\r", "\n"), False)]

    def _doctype(self, buffer: str, at: int) -> tuple[int, list[Event]] | None:
        m = re.compile(r"<!DOCTYPE\s+([^\s\[>]+)(?:[^\[>\"']|\"[^\"]*\"|'[^']*')*+(?:\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*+\]\s*)?>").match(buffer, at)
        if not m:
            return None
        if self.stack or self.want != "value":
            self.fail("syntax", "a doctype after the root's start", at)
        return m.end(), [("doctype", 0, m[1], None, False)]

    def _start(self, m: re.Match, at: int) -> list[Event]:
        name, raw = m[2], m[3]
        empty = raw.endswith("/")
        raw = raw[:-1] if empty else raw
        if not is_xml_name(name):
            self.fail("syntax", f"{name[:20]!r} is no name", at)
        if not self.stack and self.want == "end":
            self.fail("syntax", "a second root element", at)
        if len(self.stack) >= self.depth:
            self.fail("limit", "nested too deeply", at)
        attributes: dict[str, str] = {}
        place = 0
        while a := _ATTRIBUTE.match(raw, place):
            if a[1] in attributes or not is_xml_name(a[1]):
                self.fail("syntax", f"attribute {a[1][:20]!r} is repeated or no name", at)
            value = a[2] if a[2] is not None else a[3]
            attributes[a[1]] = self._decoded(re.sub(r"\r\n|[\t\r\n]", " ", value), at)
            place = a.end()
        if raw[place:].strip():
            self.fail("syntax", "an attribute is expected", at)
        depth, self.want = len(self.stack), "end"
        event = ("start_element", depth, name, json.dumps(attributes, ensure_ascii=False), False)
        if empty:
            return [event, ("end_element", depth, name, None, False)]
        self.stack.append(name)
        return [event]

    def _end(self, m: re.Match, at: int) -> list[Event]:
        if not self.stack or self.stack[-1] != m[2] or m[3].strip():
            self.fail("syntax", f"</{m[2][:20]}> closes nothing", at)
        self.stack.pop()
        return [("end_element", len(self.stack), m[2], None, False)]

    def finish(self) -> None:
        if self.stack or self.want != "end" or self.rest.strip():
            self.fail("truncated", "the root element is not complete", len(self.rest))


KINDS: dict[str, type[Tokenizer]] = {"json": JsonTokenizer, "xml": XmlTokenizer}


class _Parse(StatefulProcessor):
    """One key: progress is (next seq, last seq, ended, events sent, undecoded bytes, tokenizer, bytes waiting, timer)."""

    def __init__(self, kind: str, options: dict, max_state: int, idle_ms: int | None):
        self.kind, self.options, self.max_state, self.idle_ms = kind, options, max_state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next long, final long, ended boolean, sent long, bytes binary, tokenizer string, waiting long, timer long")
        self.waiting = handle.getMapState("waiting", "seq long", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        made = KINDS[self.kind](**self.options)
        held = tuple(self.progress.get()) if self.progress.exists() else (0, -1, False, 0, b"", made.state(), 0, -1)
        following, final, ended, sent, undecoded, state, size, timer = held
        tokens, decoder = KINDS[self.kind].of(state or made.state(), **self.options), codecs.getincrementaldecoder("utf-8")()
        decoder.setstate((bytes(undecoded or b""), 0))
        out: list[Row] = []
        latest = -1
        for row in rows:
            if self.idle_ms is not None and row["time"] is not None:
                latest = max(latest, int(row["time"].timestamp() * 1000))
            seq, data = int(row["seq"]), bytes(row["data"] or b"")
            if ended or seq < following:
                continue
            if row["last"]:
                final = seq
            if seq != following:
                if not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), (data,))
                    size += len(data)
            else:
                try:
                    while data is not None:
                        done = following == final
                        for record, e in tokens.feed(decoder.decode(data, done), done):
                            out.append(_row(key[0], sent, record, *e))
                            sent += 1
                        following += 1
                        ended = done
                        data = None
                        if not ended and self.waiting.containsKey((following,)):
                            data = bytes(self.waiting.getValue((following,))[0])
                            self.waiting.removeKey((following,))
                            size -= len(data)
                except (TextError, UnicodeDecodeError) as e:
                    ended = self._refuse(key, out, sent, tokens.record, str(e))
                    sent += 1
            if not ended and size + len(tokens.rest) > self.max_state:
                ended = self._refuse(key, out, sent, tokens.record, "limit at 0: the stream's state is too large")
                sent += 1
        if ended:
            self.waiting.clear()
            size, tokens = 0, made
        if self.idle_ms is not None and latest >= 0:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = max(timer, latest + self.idle_ms)
            self.handle.registerTimer(timer)
        self.progress.update((following, final, ended, sent, b"" if ended else decoder.getstate()[0], "" if ended else tokens.state(), size, timer))
        yield from out

    @staticmethod
    def _refuse(key, out: list[Row], sent: int, record: int, message: str) -> bool:
        out.append(_row(key[0], sent, record, "error", 0, None, message, False))
        return True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        if self.progress.exists():
            _, _, ended, sent, *_ = tuple(self.progress.get())
            if not ended:
                yield _row(key[0], sent, 0, "error", 0, None, "truncated at 0: no chunk came in time", False)
        self.progress.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, which keyed state machines need, unless the session names a provider of its own."""
    if spark.conf.get(_PROVIDER).endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def parse_events(chunks: DataFrame, kind: str = "json", time: str | None = None, idle: int = 3600, max_state: int = 16 << 20, **options) -> DataFrame:
    """Events of every stream: stream_id, event_idx, record, event, depth, key, value, repeated.

    ``kind`` is json or xml; ``options`` are those of its tokenizer.  ``time`` names a
    column with a watermark, ``idle`` the seconds without a chunk after which a stream ends.
    """
    ship(chunks.sparkSession)
    use_rocksdb(chunks.sparkSession)
    columns = [F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"), F.coalesce("last", F.lit(False)).alias("last")]
    thin = chunks.select(*columns, *([F.col(time).alias("time")] if time else [])).where("seq >= 0")
    machine = _Parse(kind, options, max_state, 1000 * idle if time else None)
    return thin.groupBy("stream_id").transformWithState(machine, OUTPUT, "Append", "EventTime" if time else "None")
