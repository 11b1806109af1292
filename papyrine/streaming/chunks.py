"""Incremental parsing as stateful Structured Streaming.

Chunks (stream_id, seq, data, last) of many texts arrive in any order.  State
for each stream holds chunks not yet in sequence and the tail of the text that
no complete record has used; rows do not depend on where the text was cut.  The
watermark rules of Spark apply if the caller sets one; a stream without its last
chunk keeps its tail until then.  A stream whose state grows over ``max_state``
characters, or whose text is bad, emits one error row; what follows is dropped on
arrival.  A chunk that comes again is ignored, after the end too: a finished stream
leaves a mark of a few bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import csv_text, json_text
from ..functions.errors import TextError
from ..runtime import ship

OUTPUT = "stream_id string, record_idx long, record string, error string"
_STATE = "next_seq long, emitted long, tail string, waiting string, failed boolean, final_seq long, dropped long"


def _csv_records(text: str, last: bool, dialect: csv_text.Dialect) -> tuple[list[str], str]:
    """Complete records as JSON arrays, and the text left."""
    cut, inside = 0, False
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if dialect.escape and c == dialect.escape and inside:
            i += 2
            continue
        if c == dialect.quote:
            inside = not inside
        elif not inside and c in "\r\n":
            if c == "\r" and i + 1 == n and not last:
                break  # the line feed of a CRLF may be in the next chunk
            i += text.startswith("\r\n", i)
            cut = i + 1
        i += 1
    cut = n if last else cut
    rows = csv_text.parse(text[:cut], dialect)
    return [json.dumps(r, ensure_ascii=False) for r in rows], text[cut:]


def _json_lines(text: str, last: bool, _dialect) -> tuple[list[str], str]:
    cut = len(text) if last else text.rfind("\n") + 1
    return [json_text.write(v) for v in json_text.records(text[:cut], "line")], text[cut:]


def parse_chunks(chunks: DataFrame, kind: str = "csv", dialect: csv_text.Dialect = csv_text.Dialect(), max_state: int = 16 << 20) -> DataFrame:
    """Records of every stream: (stream_id, record_idx, record as JSON text, error).

    ``kind`` is ``csv`` or ``json`` (one value a line).
    """
    ship(chunks.sparkSession)
    split = {"csv": _csv_records, "json": _json_lines}[kind]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_seq, emitted, tail, waiting, failed, final, dropped = state.get if state.exists else (0, 0, "", "{}", False, -1, 0)
        held = {int(k): v for k, v in json.loads(waiting).items()}
        size = len(tail) + sum(map(len, held.values()))
        rows: list[tuple] = []

        def fail(e: TextError) -> None:
            nonlocal failed, tail, size, dropped
            rows.append((key[0], emitted, None, str(e)))
            dropped = next_seq + len(held)
            failed, tail, size = True, "", 0
            held.clear()

        for batch in batches:
            for seq, data, last in zip(batch["seq"], batch["data"], batch["last"], strict=True):
                seq, data = int(seq), data or ""
                if last:
                    final = seq
                if failed:
                    dropped += 1
                    continue
                if seq >= next_seq and seq not in held:
                    held[seq] = data
                    size += len(data)
                try:
                    while next_seq in held:
                        tail += held.pop(next_seq)
                        done = next_seq == final
                        next_seq += 1
                        found, left = split(tail, done, dialect)
                        size, tail = size - len(tail) + len(left), left
                        rows += [(key[0], emitted + i, r, None) for i, r in enumerate(found)]
                        emitted += len(found)
                    if size > max_state:
                        raise TextError("limit", "the stream's state is too large")
                except TextError as e:
                    fail(e)
        if (dropped if failed else next_seq) > final >= 0:
            held.clear()  # the mark of a finished stream: what comes again is known by its seq
        state.update((next_seq, emitted, tail, json.dumps(held), failed, final, dropped))
        yield pd.DataFrame(rows, columns=["stream_id", "record_idx", "record", "error"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
