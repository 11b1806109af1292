"""Tokens that one set alone holds, counted for every set, at any size.

A batch of sets sends its tokens by slices of the hash range: 32 bits of the hash
and two bytes for the set's place in the batch (at most two copies of a token from
each batch).  The reducer of a slice has all tokens of the slice (about
``SLICE_TOKENS``, whatever the size of the table) and returns the places of those
that came once; a second shuffle brings them back to their batch, where they are
counted.  No filter is held by a worker or the driver, so nothing fills up.

Tokens of one slice that agree in 32 bits are taken for the same, so a count may be
too small, never too large.  Batches are named by task and number, hence a repeated
task sends the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import _locate

SLICE_TOKENS = 1 << 20
#: Sets of a batch; a place has two bytes.
BATCH_SETS = 1 << 16
#: A row with a slice below 0 is a batch's head: key (8 bytes) and size (8 bytes) of each of its sets.
SENT = "slice int, batch long, marks binary, places binary"
_BACK = "batch long, head boolean, marks binary, places binary"


class Sender:
    """Rows that a task sends for its batches; one for each task."""

    def __init__(self, tokens: int):
        self.slices, self.batches = max(1, -(-tokens // SLICE_TOKENS)), 0

    def rows(self, keys: list[int], sizes: list[int], sets: list[np.ndarray]) -> pa.Table | None:
        """Of sets with their keys, sizes and the tokens to count."""
        made = [self._batch(keys[i : i + BATCH_SETS], sizes[i : i + BATCH_SETS], sets[i : i + BATCH_SETS]) for i in range(0, len(sets), BATCH_SETS)]
        return pa.Table.from_batches(made) if made else None

    def _batch(self, keys: list[int], sizes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        batch = (TaskContext.get().partitionId() << 32) + self.batches
        self.batches += 1
        hashes = np.concatenate(sets)
        places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        keep = np.ones(len(hashes), bool)
        keep[2:] = hashes[2:] != hashes[:-2]
        part, marks = _locate(hashes[keep], self.slices)
        places = places[order[keep]]
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        ends = np.append(begin[1:], len(part))
        cuts = list(zip(begin.tolist(), ends.tolist(), strict=True)) if len(part) else []
        ids = [-1 - batch % 1_000_003, *(part[begin].tolist() if cuts else [])]
        marks_of = [np.array(keys, np.int64).tobytes(), *(marks[a:b].tobytes() for a, b in cuts)]
        places_of = [np.array(sizes, np.int64).tobytes(), *(places[a:b].tobytes() for a, b in cuts)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int32()), pa.array([batch] * len(ids), pa.int64()), pa.array(marks_of, pa.binary()), pa.array(places_of, pa.binary())],
            names=["slice", "batch", "marks", "places"],
        )


def _answer(batch: list[int], head: bool, marks: list[bytes], places: list[bytes]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
    columns = [batch, [head] * len(batch), marks, places]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["batch", "head", "marks", "places"])


def lone_places(marks: list[np.ndarray], places: list[np.ndarray]) -> list[np.ndarray]:
    """Of each part of a slice the places whose marks came once in the whole slice."""
    whole = np.concatenate(marks).astype(np.uint64)
    order = (whole << np.uint64(32)) | np.arange(len(whole), dtype=np.uint64)
    order.sort()
    mark = order >> np.uint64(32)
    same = mark[1:] == mark[:-1]
    once = np.ones(len(whole), bool)
    once[1:] &= ~same
    once[:-1] &= ~same
    lone = np.empty(len(whole), bool)
    lone[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)] = once
    cuts = np.cumsum([len(m) for m in marks])[:-1]
    return [p[own] for p, own in zip(places, np.split(lone, cuts), strict=True)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, names, marks, places = None, [], [], []

    def close() -> pa.RecordBatch:
        found = [(name, p.tobytes()) for name, p in zip(names, lone_places(marks, places), strict=True) if len(p)]
        return _answer([name for name, _ in found], False, [b""] * len(found), [p for _, p in found])

    for b in batches:
        for part, name, mark, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part < 0:
                yield _answer([name], True, [mark], [place])
                continue
            if part != current:
                if names:
                    yield close()
                current, names, marks, places = part, [], [], []
            names.append(name)
            marks.append(np.frombuffer(mark, np.uint32))
            places.append(np.frombuffer(place, np.uint16))
    if names:
        yield close()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, counts, head = None, np.zeros(BATCH_SETS, np.int64), None

    def close() -> pa.RecordBatch:
        keys, sizes = (np.frombuffer(x, np.int64) for x in head)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sizes), pa.array(counts[: len(keys)])], names=["key", "n", "lone"])

    for b in batches:
        for name, is_head, mark, place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if name != current:
                if head:
                    yield close()
                current, counts, head = name, np.zeros(BATCH_SETS, np.int64), None
            if is_head:
                head = (mark, place)
            else:
                found = np.bincount(np.frombuffer(place, np.uint16))
                counts[: len(found)] += found
    if head:
        yield close()


def lone_counts(sent: DataFrame) -> DataFrame:
    """(key, n, lone) of every set in ``sent``, which holds a Sender's rows."""
    width = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = sent.repartition(width, "slice").sortWithinPartitions("slice").mapInArrow(_slices, _BACK)
    return back.repartition(width, F.col("batch")).sortWithinPartitions("batch").mapInArrow(_counted, "key long, n long, lone long")
