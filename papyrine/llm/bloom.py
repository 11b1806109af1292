"""A pair of blocked Bloom filters: keys seen once, keys seen twice.

Tasks send sparse partial filters (four bytes a key, at most two copies of a key
from each batch).  The filter is cut into slices of one megabit; every slice is
merged by one reducer that streams the partial filters through a once-seen and a
twice-seen bitmap.  Only the twice-seen bitmap leaves the reducers.  Its size is
``bits_per_key`` times the counted keys and never exceeds ``max_bytes``: beyond
that the rate of false suspicions rises, while no repeated key is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ship
from .kernels import mix

SLICE_BITS = 1 << 20
_BLOCK = 512
_PROBES = 5
PARTIAL_SCHEMA = "slice int, marks binary"


def slices_for(keys: int, bits_per_key: int = 12, max_bytes: int = 32 << 20) -> int:
    wanted = -(-max(1, keys) * bits_per_key // SLICE_BITS)
    return int(max(1, min(wanted, max_bytes * 8 // SLICE_BITS)))


def _locate(hashes: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    part = ((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    return part.astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _positions(marks: np.ndarray) -> np.ndarray:
    """Bit positions inside a slice, one row for each probe."""
    x = mix(marks.astype(np.uint64) + np.uint64(0x51ED27))
    block = (x % np.uint64(SLICE_BITS // _BLOCK)) * np.uint64(_BLOCK)
    out = np.empty((_PROBES, len(marks)), np.int64)
    for i in range(_PROBES):
        out[i] = block + ((x >> np.uint64(16 + 9 * i)) & np.uint64(_BLOCK - 1))
    return out


def partials(hashes: np.ndarray, slices: int) -> pa.RecordBatch:
    """Sparse partial filter of one batch; ``hashes`` has a key once for each document."""
    if not len(hashes):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["slice", "marks"])
    hashes = np.sort(hashes)
    keep = np.ones(len(hashes), bool)
    keep[2:] = hashes[2:] != hashes[:-2]
    part, marks = _locate(hashes[keep], slices)
    ids, begin = np.unique(part, return_index=True)
    ends = np.append(begin[1:], len(part))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int32)), pa.array([marks[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary())],
        names=["slice", "marks"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, once, twice = None, None, None

    def close():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    for b in batches:
        for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != current:
                if current is not None:
                    yield close()
                current, once, twice = part, np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)
            marks, count = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
            at = _positions(marks)
            again = once[at].all(axis=0) | (count > 1)
            twice[at[:, again].ravel()] = True
            once[at.ravel()] = True
    if current is not None:
        yield close()


class TwiceSeen:
    """Bitmap of keys that at least two documents may hold."""

    def __init__(self, slices: int, bits: np.ndarray):
        self.slices, self.bits = slices, bits

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        part, marks = _locate(hashes, self.slices)
        at = _positions(marks) + part * SLICE_BITS
        found = np.ones(len(hashes), bool)
        for row in at:
            found &= (self.bits[row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1
        return found


def collect_twice(partial: DataFrame, slices: int) -> TwiceSeen:
    """Merge partial filters; the driver receives at most ``slices`` megabits."""
    ship(partial.sparkSession)
    width = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = partial.repartition(max(1, min(slices, width)), "slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, bits binary")
    bits = np.zeros(slices * SLICE_BITS // 8, np.uint8)
    size = SLICE_BITS // 8
    for row in merged.toLocalIterator():
        bits[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return TwiceSeen(slices, bits)
