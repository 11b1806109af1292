"""Hashed subword bags: n-grams of the bytes of each word with its boundaries.

A word (ASCII white space around it, A-Z lower-cased) is padded with one space
on either side; its bag holds the padded word's n-grams of ``sizes`` bytes and
the whole padded word, each hashed to one of ``1 << bits`` buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import kernels


class Bags:
    """Bucket indices by n-gram size for one padded buffer.

    ``grams[j]`` has the bucket of the n-gram that begins at each byte; a word's
    n-grams of size n are those at ``low`` to ``high - n`` of its padded range.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int):
        counts = np.diff(offsets)
        n_docs = len(counts)
        padded = np.full(len(data) + n_docs + 1, 32, np.uint8)
        at = np.arange(len(data)) + np.repeat(np.arange(n_docs), counts) + 1
        padded[at] = kernels.LOWER[data]
        padded[kernels.SPACE[padded]] = 32
        solid = padded != 32
        self.low = np.flatnonzero(solid[1:] & ~solid[:-1])  # the space before the word
        self.high = np.flatnonzero(solid[:-1] & ~solid[1:]) + 2  # after the space that follows
        self.first = np.searchsorted(self.low, offsets[:-1] + np.arange(n_docs))
        self.first = np.append(self.first, len(self.low))
        m = len(padded)
        power, inverse = kernels._power_tables(m + 1)
        total = np.zeros(m + 1, np.uint64)
        np.cumsum(kernels._LETTER_CODES[padded] * power[:m], out=total[1:])
        shift = np.uint64(64 - bits)
        self.sizes, self.grams = sizes, []
        for n in sizes:
            if m >= n:
                h = (total[n:] - total[:-n]) * inverse[: m - n + 1]
                h *= np.uint64(2 * n + 1)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                self.grams.append((h >> shift).astype(np.int32))
            else:
                self.grams.append(np.zeros(0, np.int32))
        self.words = (kernels.mix((total[self.high] - total[self.low]) * inverse[self.low] + np.uint64(99)) >> shift).astype(np.int32)

    def bag_sizes(self) -> np.ndarray:
        width = self.high - self.low
        return 1 + sum(np.maximum(0, width - n + 1) for n in self.sizes)

    def word_sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of ``table`` over each word's bag; a column of the result for each of the table's."""
        wide = table if table.ndim == 2 else table[:, None]
        out = wide[self.words].astype(np.float64)
        for n, gram in zip(self.sizes, self.grams, strict=True):
            if not len(gram):
                continue
            upto = np.maximum(self.low, self.high - n + 1)
            for c in range(wide.shape[1]):
                run = np.zeros(len(gram) + 1)
                np.cumsum(wide[:, c][gram], out=run[1:], dtype=np.float64)
                out[:, c] += run[np.minimum(upto, len(gram))] - run[np.minimum(self.low, len(gram))]
        return out

    def lists(self) -> Iterator[np.ndarray]:
        """The bag of every word as an index array (for training)."""
        for i, (a, b) in enumerate(zip(self.low.tolist(), self.high.tolist(), strict=True)):
            yield np.concatenate([self.words[i : i + 1], *(g[a : max(a, b - n + 1)] for n, g in zip(self.sizes, self.grams, strict=True))])
