"""Periodic runs of words, found by branching tandem repeats of a suffix tree.

A run is a stretch of words with smallest period q (words q apart are equal) of at
least ``max(min_length, min_repeats * q)`` words that no neighbouring word extends.
The work is a map: a document is searched where it is read, nothing is shuffled.

1. Words become 64-bit hashes (see ``kernels``).  Every window of ``k`` words inside
   a run occurs twice in it (``k`` follows from the two minima), so only stretches
   of the document whose windows all repeat in that document are searched; most
   documents have none.
2. Names of all factors whose length is a power of two (each level sorts pairs of
   names of the level before) give the suffix array and, by descending the levels,
   the common extension of two places in either direction.
3. The suffix tree is walked as the tree of splits of the array by its common
   prefixes.  Of the two sides of a split at depth D only the smaller one's leaves
   are listed: leaf i and i + D (or i - D) on different sides are a tandem repeat
   that does not continue to the right (a branching one).
4. A branching repeat is rotated to the left as long as it stays one, by one common
   extension.  Repeats with the same ends merge into the run of the least D: the
   last repeat of a run is branching, so none is missed.

Time is O(n log n) comparisons of names for n words searched, whatever the text;
the documents of a batch are searched together in portions of 4 MB of text, and a
document is never cut.

Defined results: a null or empty text, or one without words, has no runs and an
empty collapsed text; runs are ordered by start, then period; runs may overlap, and
a word is dropped if any run holds it after its first period; repeated rows (and
ids) are searched each for itself; an empty table gives no rows; null ids are kept.
Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map
from . import kernels

#: Leaves listed at a time.
_LEAVES = 1 << 21


def window(min_length: int, min_repeats: int) -> int:
    """Words of a window that every run holds twice, wherever in the run it starts."""
    return max(1, min(max(min_length, min_repeats * q) - 2 * q + 1 for q in range(1, min_length + 2)))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def stretches(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words whose windows of ``k`` repeat within the same owner."""
    n = len(hashes) - k + 1
    if n <= 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = kernels.Words(hashes, hashes, hashes, hashes)
    keys = kernels.mix(kernels.shingle_stream(words, k) ^ kernels.mix(owner[:n].astype(np.uint64) + np.uint64(1)))
    whole = owner[:n] == owner[k - 1 :]
    keep = np.zeros(n, bool)
    keep[whole] = _repeated(keys[whole])
    # neighbouring windows of different owners are told apart by the windows over the edge, or for k = 1 by the owner
    begins = keep & np.concatenate([[True], ~keep[:-1] | (owner[1:n] != owner[: n - 1])])
    finish = keep & np.concatenate([~keep[1:] | (owner[1:n] != owner[: n - 1]), [True]])
    return np.flatnonzero(begins), np.flatnonzero(finish) + k


@dataclass
class Factors:
    """Names of the factors of 2 ** level words at each place; ``first`` is where the place's own stretch begins."""

    levels: list[np.ndarray]
    first: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, stretch: np.ndarray) -> Factors:
        """``codes`` are word codes below 2 ** 32, ``stretch`` their stretches in ascending order."""
        n = len(codes)
        own, start, size = np.unique(stretch, return_index=True, return_counts=True)
        at = np.searchsorted(own, stretch)
        first, last = start[at], (start + size)[at]
        names = np.unique(at.astype(np.int64) << 32 | codes, return_inverse=True)[1].astype(np.int64)
        levels, reach = [names.astype(np.int32)], 1
        while int(names.max()) + 1 < n:
            beyond = np.arange(n) + reach
            inside = beyond < last
            pair = names * (n + 1)
            pair[inside] += names[beyond[inside]] + 1
            names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            levels.append(names.astype(np.int32))
            reach *= 2
        return cls(levels, first)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that starts at i and at j."""
        out, n = np.zeros(len(i), np.int64), len(self.first)
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            names = self.levels[level]
            same = (a < n) & (b < n)
            same &= names[np.minimum(a, n - 1)] == names[np.minimum(b, n - 1)]
            out += same.astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends before i and before j (i < j)."""
        out, least = np.zeros(len(i), np.int64), self.first[i]
        for level in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - (1 << level), j - out - (1 << level)
            names = self.levels[level]
            same = a >= least
            same &= names[np.maximum(a, 0)] == names[np.maximum(b, 0)]
            out += same.astype(np.int64) << level
        return out


def splits(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place r of the array the first place of its left side and the end of its right side.

    ``depth[r]`` is the common prefix of the suffixes r - 1 and r.  Of equal depths
    the leftmost splits first, so the splits are the inner nodes of a binary tree.
    """
    values = depth.tolist()
    n = len(values)
    left, right = [0] * n, [n] * n
    held: list[int] = []
    for r in range(n):
        d = values[r]
        while held and values[held[-1]] > d:
            right[held.pop()] = r
        left[r] = held[-1] if held else 0
        held.append(r)
    return np.array(left), np.array(right)


def branching_repeats(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """(i, D) of all tandem repeats of 2 D words at i that the next word does not continue."""
    rank = factors.levels[-1].astype(np.int64)
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    depth = np.zeros(n, np.int64)
    depth[1:] = factors.forward(order[:-1], order[1:])
    left, right = splits(depth)
    node = np.flatnonzero(depth > 0)
    small_left = node - left[node] <= right[node] - node
    begin, end = np.where(small_left, left[node], node), np.where(small_left, node, right[node])
    low, high = np.where(small_left, node, left[node]), np.where(small_left, right[node], node)
    total = np.cumsum(end - begin)
    found_at, found_depth = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(node):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _LEAVES)))
        size = (end - begin)[a:b]
        which = np.repeat(np.arange(a, b), size)
        leaf = order[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]]
        d = depth[node[which]]
        for start, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
            inside = (other >= 0) & (other < n)
            at = rank[np.clip(other, 0, n - 1)]
            inside &= (at >= low[which]) & (at < high[which])
            found_at.append(start[inside])
            found_depth.append(d[inside])
        a = b
    return np.concatenate(found_at), np.concatenate(found_depth)


def maximal_runs(codes: np.ndarray, stretch: np.ndarray, min_length: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of each stretch, by start, then period."""
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    factors = Factors.of(codes, stretch)
    at, period = branching_repeats(factors)
    start, end = at - factors.backward(at, at + period), at + 2 * period
    long = end - start >= np.maximum(min_length, min_repeats * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of_words(words: kernels.Words, min_length: int, min_repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a batch, as places in its words."""
    k = window(min_length, min_repeats)
    owner = np.repeat(np.arange(len(words.first) - 1), words.counts())
    place, hashes = np.arange(len(owner)), words.hashes
    for _ in range(2):  # what remains is searched again: its windows must repeat inside their own stretch
        begin, end = stretches(hashes, owner, k)
        long = end - begin >= min_length
        begin, size = begin[long], (end - begin)[long]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        place, hashes, owner = place[at], hashes[at], np.repeat(np.arange(len(size)), size)
    start, end, period = maximal_runs(np.unique(hashes, return_inverse=True)[1], owner, min_length, min_repeats)
    return place[start], place[end - 1] + 1, period


_RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) and the collapsed text of every row.

    The collapsed text keeps of every run its first period; its words are joined by
    one space.  ``min_repeats`` is at least 2.
    """
    if min_repeats < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")
    thin = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def make():
        def part(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            words = kernels.hash_words(data, offsets, lower=False)
            start, end, period = runs_of_words(words, min_length, min_repeats)
            doc = np.searchsorted(words.first, start, side="right") - 1
            n_docs = len(offsets) - 1
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, end, -1)
            dropped = np.cumsum(edge[:-1]) > 0
            has_runs = np.zeros(n_docs, bool)
            has_runs[doc] = True
            view, texts = memoryview(data), []
            for i in range(n_docs):
                own = bytes(view[offsets[i] : offsets[i + 1]]).split()
                if has_runs[i]:
                    own = [own[j] for j in np.flatnonzero(~dropped[words.first[i] : words.first[i + 1]]).tolist()]
                texts.append(b" ".join(own))
            runs = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            edges = np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)
            return [pa.array(words.counts().astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), runs), pa.array(texts, pa.binary()).cast(pa.string())]

        def step(b: pa.RecordBatch) -> pa.Table | None:
            if not b.num_rows:
                return None
            out, at = [], 0
            for data, offsets in kernels.portions(*kernels.text_buffer(b.column("text"))):
                ids = b.column("doc_id").slice(at, len(offsets) - 1)
                out.append(pa.RecordBatch.from_arrays([ids, *part(data, offsets)], names=["doc_id", "n_words", "runs", "collapsed"]))
                at += len(offsets) - 1
            return pa.Table.from_batches(out)

        return step

    return arrow_map(thin, make, _RUNS)
