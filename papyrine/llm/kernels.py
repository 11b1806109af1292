"""Vectorised byte kernels shared by the corpus operators.

Texts arrive as one Arrow buffer of UTF-8 bytes plus offsets.  Words are maximal
runs without ``[\\x20\\x09-\\x0D]``; every word gets a 64-bit polynomial hash from
prefix sums, so no Python object is made per word.  A polynomial modulo 2 ** 64
maps some long words with a repetitive pattern to one value, so words over
``LONG_WORD`` bytes are hashed by keyed BLAKE2b instead.  Buffers are walked in
segments cut at white space, hence memory stays bounded for texts of any length
(a single word longer than a segment widens that segment).
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 20
#: Longer words are hashed by BLAKE2b.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODES = _LETTER_CODES[LOWER]

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, _SEGMENT + 4096)
        made = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, np.uint64(base))
            table[0] = 1
            made.append(np.cumprod(table, dtype=np.uint64))
        if size > 8 * _SEGMENT:  # a freak segment: do not keep its tables
            return made[0], made[1]
        _powers, _inverses = made
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, n + 1, from 0) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, raw_offsets, raw = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw_offsets, np.int64, n + 1, column.offset * 8)
    if raw is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def segments(data: np.ndarray, offsets: np.ndarray):
    """(begin, end) cuts of the buffer; each cut follows white space or starts a text."""
    n, begin = len(data), 0
    while begin < n:
        end = begin + _SEGMENT
        if end >= n:
            yield begin, n
            return
        step = 4096
        while end < n:
            window = np.flatnonzero(SPACE[data[end : end + step]])
            if len(window):
                end += int(window[0]) + 1
                break
            nxt = np.searchsorted(offsets, end, side="left")
            if nxt < len(offsets) and offsets[nxt] <= end + step:
                end = int(offsets[nxt])
                break
            end += step
            step *= 2
        end = min(end, n)
        yield begin, end
        begin = end


@dataclass
class Words:
    """Words of a batch: hashes, byte ranges, and the range of words of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Hash every word; A-Z is lower-cased first if ``lower``."""
    codes = _LOWER_CODES if lower else _LETTER_CODES
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    hashes, starts, ends = [], [], []
    for begin, end in segments(data, offsets):
        part = data[begin:end]
        m = end - begin
        power, inverse = _power_tables(m + 1)
        space = SPACE[part]
        before = np.empty(m, bool)
        before[0] = True
        before[1:] = space[:-1]
        before |= edges[begin:end]
        after = np.empty(m, bool)
        after[-1] = True
        after[:-1] = space[1:]
        after |= edges[begin + 1 : end + 1]
        solid = ~space
        s = np.flatnonzero(solid & before)
        e = np.flatnonzero(solid & after) + 1
        total = np.zeros(m + 1, np.uint64)
        x = codes[part]
        x *= power[:m]
        np.cumsum(x, out=total[1:])
        h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        for i in np.flatnonzero(e - s > LONG_WORD).tolist():
            word = part[s[i] : e[i]]
            h[i] = int.from_bytes(blake2b(LOWER[word].data if lower else word.tobytes(), digest_size=8, key=b"word").digest(), "little")
        hashes.append(h)
        starts.append(s + begin)
        ends.append(e + begin)
    if hashes:
        h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(h, s, e, np.searchsorted(s, offsets))


def shingle_stream(words: Words, k: int) -> np.ndarray:
    """Hash of the k words starting at each word; ends of texts are not masked."""
    h = words.hashes
    n = max(0, len(h) - k + 1)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j : n + j]
    return mix(acc)


def shingle_sets(words: Words, k: int):
    """Yield one sorted array of distinct 64-bit shingle hashes for each text.

    A text of 1 to k-1 words has its whole sequence as its one shingle; a text
    without words has an empty set.
    """
    stream = shingle_stream(words, k)
    first = words.first
    for d in range(len(first) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= k:
            out = np.sort(stream[a : b - k + 1])
            if len(out) > 1:
                keep = np.empty(len(out), bool)
                keep[0] = True
                np.not_equal(out[1:], out[:-1], out=keep[1:])
                out = out[keep]
            yield out
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in words.hashes[a:b]:
                    acc = acc * _STEP + x
            yield mix(np.array([acc], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def arrow_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def portions(data: np.ndarray, offsets: np.ndarray, size: int = 4 << 20):
    """Cut a batch into runs of whole texts of about ``size`` bytes, to bound the arrays made from them."""
    n, begin = len(offsets) - 1, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        end = min(end, n)
        yield data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end
