"""Alignment of the tokens of two tokenizers by the bytes they cover.

Tokenizer A is a byte-level BPE over a space and the text, tokenizer B a piece BPE
with byte fallback over the text, to which it adds that space itself; both cover the
same bytes.  Ends of tokens are running sums of their sizes.  Ends that both have
are the common cuts (``intersect1d``); the place of an end among the cuts labels its
token's group (``searchsorted``); tokens of A and B that end at one cut are linked
(products of the counts at each cut, expanded by ``repeat``).

Neither tokenizer merges across the edge between a word and ASCII white space, so a
text's tokens, cuts and links are those of its units (white space and the word after
it) one after the other.  A task aligns each distinct unit once and keeps the result
in a memo bounded by bytes; a text with white space for which that does not hold (a
carriage return, white space beyond ASCII, whatever the piece vocabulary joins) is
one unit as a whole.

Counts take two passes over the texts, since storing all links costs more than
hashing the words again:

1. Every task sends the links of each batch summed by id pair; sums by (pair, salt)
   and then by pair give the corpus counts, so that a frequent pair is spread over
   many reducers.  A B id has at most as many pairs as A has ids, which bounds the
   window that finds its highest count.
2. The most frequent pairs, at most ``max_pairs`` (17 bytes each), are broadcast;
   links of other pairs, which are rare, meet their counts in a join.

Defined results: a text that is null or empty, or whose joined token bytes differ
from a space and the text (such as one that holds U+2581), has no tokens: zeros, and
empty groups; it adds nothing to the counts.  Texts of any length are aligned whole.
Repeated rows (and ids) are aligned, and counted, each for itself; ties for a B id's
highest count are all best; an empty table gives no rows; null ids are kept.
Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_map, drop, stash
from . import kernels

#: UTF-8 of white space beyond ASCII.
_WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: Units over so many bytes are not kept in the memo.
_LARGE_UNIT = 256
#: Units given to a tokenizer at a time.
_CALL = 8192
_aligners: dict[tuple, Aligner] = {}


def byte_symbols() -> dict[str, int]:
    """Byte of each symbol of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs given by starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the values of each run between neighbouring edges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


class TokenBytes:
    """Bytes of every id of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[runs(self.starts[ids], self.sizes[ids])]


@dataclass
class Units:
    """Columns of aligned units; the links and their id pairs lie in ``pairs`` from ``start`` on."""

    bad: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    start: np.ndarray
    pairs: np.ndarray
    groups: np.ndarray

    def take(self, rows: np.ndarray) -> Units:
        sizes = self.n_links[rows]
        flat = self.pairs[runs(self.start[rows], sizes)]
        return Units(self.bad[rows], self.n_a[rows], self.n_b[rows], self.n_groups[rows], sizes, np.cumsum(sizes) - sizes, flat, self.groups[rows])

    def plus(self, other: Units) -> Units:
        ours, theirs = vars(self), vars(other) | {"start": other.start + len(self.pairs)}
        return Units(**{k: np.concatenate([ours[k], theirs[k]]) for k in ours})


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts of two ascending series of ends, and the group of each token of A and of B."""
    distinct = bool((ends_a[1:] > ends_a[:-1]).all() and (ends_b[1:] > ends_b[:-1]).all())
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=distinct)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def links_at(cuts: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of A and of B (as places) of all links, by cut."""
    first_a, first_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    many_a, many_b = np.searchsorted(ends_a, cuts, "right") - first_a, np.searchsorted(ends_b, cuts, "right") - first_b
    size = many_a * many_b
    cut = np.repeat(np.arange(len(cuts)), size)
    within = np.arange(len(cut)) - np.repeat(np.cumsum(size) - size, size)
    return first_a[cut] + within // many_b[cut], first_b[cut] + within % many_b[cut]


class Aligner:
    """Both tokenizers and the memo of units of a worker process."""

    def __init__(self, byte_path: str, piece_path: str, memo_bytes: int, write: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        symbol = byte_symbols()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = TokenBytes([bytes(symbol[c] for c in name) if all(c in symbol for c in name) else name.encode() for name in names])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        joins = {"\r"} | {c for p in pieces for c in p[1:] if c in "\t\n\x0b\x0c"}
        self.odd = re.compile(b"[" + "".join(sorted(joins)).encode() + b"]|" + _WIDE_SPACE)
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)
        self.lone_space = self.b.piece_to_id("▁")
        self.memo_bytes, self.write = memo_bytes, write
        self.forget()

    def forget(self) -> None:
        empty = np.zeros(0, np.int64)
        self.keys, self.rows = np.zeros(0, np.uint64), empty
        self.table = Units(np.zeros(0, bool), empty, empty, empty, empty, empty, empty, np.zeros(0, object))

    @staticmethod
    def _flat(encode: Callable[[list[str]], list[list[int]]], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and how many each has; the tokenizers' own objects are held for a few texts at a time."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), _CALL):
            lists = encode(texts[i : i + _CALL])
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of B for units: the space it adds is the unit's own, or goes again; it adds none to an empty text."""
        spaced = [t[:1] == " " for t in texts]
        found = self.b.encode([t[1:] if s else t for t, s in zip(texts, spaced, strict=True)], num_threads=1)
        lone = [self.lone_space]
        return [lone if t == " " else ids if s else ids[1:] if ids[:1] == lone else [] for t, ids, s in zip(texts, found, spaced, strict=True)]

    def align(self, raw: list[bytes]) -> Units:
        """Tokens, groups and links of units given by their bytes."""
        texts = [r.decode("utf-8", "replace") for r in raw]
        (ids_a, n_a), (ids_b, n_b) = self._flat(self._ids_a, texts), self._flat(self._ids_b, texts)
        size = np.array([len(r) for r in raw], np.int64)
        of_a, of_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
        bad = np.zeros(len(raw), bool)
        edges = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        for ids, of, vocabulary in ((ids_a, of_a, self.bytes_a), (ids_b, of_b, self.bytes_b)):
            width = np.bincount(of, vocabulary.sizes[ids], len(raw)).astype(np.int64)
            bad |= width != size
            same = ~bad
            kept = np.repeat(same, size)
            bytes_of = vocabulary.joined(ids[same[of]])
            differs = np.zeros(len(data), bool)
            differs[kept] = bytes_of != data[kept]
            bad |= _sums(differs, edges) > 0
        good_a, good_b = ~bad[of_a], ~bad[of_b]
        ids_a, ids_b, of_a, of_b = ids_a[good_a], ids_b[good_b], of_a[good_a], of_b[good_b]
        n_a[bad], n_b[bad] = 0, 0
        ends_a, ends_b = np.cumsum(self.bytes_a.sizes[ids_a]), np.cumsum(self.bytes_b.sizes[ids_b])
        cuts, group_a, group_b = cut_groups(ends_a, ends_b)
        link_a, link_b = links_at(cuts, ends_a, ends_b)
        pairs = ids_a[link_a] << 32 | ids_b[link_b]
        n_links = np.bincount(of_a[link_a], minlength=len(raw))
        n_groups = np.bincount(of_a[np.searchsorted(ends_a, cuts)], minlength=len(raw))
        groups = self._written(ids_a, ids_b, group_a, group_b, n_groups) if self.write else np.full(len(raw), b"", object)
        return Units(bad, n_a, n_b, n_groups, n_links, np.cumsum(n_links) - n_links, pairs, groups)

    @staticmethod
    def _written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_groups: np.ndarray) -> np.ndarray:
        """``a1,a2|b1;a3|b2,b3`` of each unit: digits of all ids at once, then one slice a unit."""
        group = np.concatenate([group_a, group_b])
        order = np.argsort(2 * group + (np.arange(len(group)) >= len(group_a)), kind="stable")
        ids, group, of_b = np.concatenate([ids_a, ids_b])[order], group[order], order >= len(group_a)
        sign = np.full(len(ids), ord(","), np.uint8)  # what follows each id
        if len(ids):
            ends = np.append(group[1:] != group[:-1], True)
            sign[~ends & ~of_b & np.append(of_b[1:], False)] = ord("|")
            sign[ends] = ord(";")
        digits = 1 + sum((ids >= 10**d).astype(np.int64) for d in range(1, 10))
        stop = np.cumsum(digits + 1)
        out = np.empty(int(stop[-1]) if len(ids) else 0, np.uint8)
        out[stop - 1] = sign
        rest, at, place = ids, stop - 2, digits
        while len(rest):
            out[at] = 48 + rest % 10
            left = place > 1
            rest, at, place = rest[left] // 10, at[left] - 1, place[left] - 1
        edge = np.searchsorted(group, np.concatenate([[0], np.cumsum(n_groups)]))
        edge = np.concatenate([[0], stop])[edge].tolist()
        text, made = out.tobytes(), np.empty(len(n_groups), object)
        made[:] = [text[i : max(i, j - 1)] for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return made

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, starts, ends, first): the units of a batch of texts; a start of -1 - d means the first unit of text d, with its space."""
        words = kernels.hash_words(data, offsets, lower=False)
        keys, ends, owner = words.hashes.copy(), words.ends, np.repeat(np.arange(len(offsets) - 1), words.counts())
        starts = np.zeros(len(keys), np.int64)
        starts[1:] = ends[:-1]
        opening = words.first[:-1][words.counts() > 0]
        starts[opening] = offsets[owner[opening]]
        gap = words.starts - starts
        before = data[np.minimum(starts, max(0, len(data) - 1))] if len(data) else np.zeros(len(keys), np.uint8)
        first = np.zeros(len(keys), bool)
        first[opening] = True
        view = memoryview(data)
        plain = np.where(first, gap == 0, (gap == 1) & (before == 32))
        single = ~first & (gap == 1) & ~plain
        keys[single] = kernels.mix(keys[single] + before[single].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        spaces: dict[bytes, int] = {}
        for i in np.flatnonzero(~plain & ~single).tolist():
            run = b" " * bool(first[i]) + bytes(view[starts[i] : words.starts[i]])
            if run not in spaces:
                spaces[run] = int.from_bytes(blake2b(run, digest_size=8, key=b"space").digest(), "little")
            keys[i] ^= np.uint64(spaces[run])
        keys = kernels.mix(keys)
        starts[opening] = -1 - owner[opening]
        last_end = np.where(words.counts() > 0, ends[np.maximum(words.first[1:] - 1, 0)] if len(ends) else 0, offsets[:-1])
        single_docs = np.ones(len(offsets) - 1, bool) if self.whole else np.zeros(len(offsets) - 1, bool)
        if not self.whole:
            single_docs[np.searchsorted(offsets, [m.start() for m in self.odd.finditer(view)], side="right") - 1] = True
        trailing = np.flatnonzero((last_end < offsets[1:]) & ~single_docs)
        whole = np.flatnonzero(single_docs & (np.diff(offsets) > 0))
        if len(trailing) or len(whole):
            kept = ~single_docs[owner]
            own_starts = np.where(words.counts()[trailing] > 0, last_end[trailing], -1 - trailing)
            extra_starts, extra_ends = np.concatenate([own_starts, -1 - whole]), np.concatenate([offsets[trailing + 1], offsets[whole + 1]])
            extra = [self.bytes_of(view, offsets, a, b) for a, b in zip(extra_starts.tolist(), extra_ends.tolist(), strict=True)]
            extra_keys = np.array([int.from_bytes(blake2b(x, digest_size=8, key=b"unit").digest(), "little") for x in extra], np.uint64)
            owner = np.concatenate([owner[kept], trailing, whole])
            order = np.argsort(owner, kind="stable")
            keys, starts, ends, owner = (x[order] for x in (np.concatenate([keys[kept], extra_keys]), np.concatenate([starts[kept], extra_starts]), np.concatenate([ends[kept], extra_ends]), owner))
        return keys, starts, ends, np.searchsorted(owner, np.arange(len(offsets)))

    @staticmethod
    def bytes_of(view: memoryview, offsets: np.ndarray, start: int, end: int) -> bytes:
        return bytes(view[start:end]) if start >= 0 else b" " + bytes(view[offsets[-1 - start] : end])

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray]:
        """Aligned distinct units of a batch, the unit at each place, and the places of each text."""
        keys, starts, ends, first = self.units(data, offsets)
        place, distinct = pd.factorize(keys)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        once = np.empty(len(distinct), np.int64)
        once[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        fresh, view = once[~known], memoryview(data)
        raw = [self.bytes_of(view, offsets, a, b) for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)]
        made = self.align(raw)
        old = self.table.take(self.rows[at[known]])
        both = old.plus(made)
        row = np.empty(len(distinct), np.int64)
        row[known], row[~known] = np.arange(known.sum()), known.sum() + np.arange(len(fresh))
        if self._size() > self.memo_bytes:  # what this batch did not use goes
            self.forget()
            self._remember(distinct[known], old)
        small = np.fromiter(map(len, raw), np.int64, len(raw)) <= _LARGE_UNIT
        self._remember(distinct[~known][small], made.take(np.flatnonzero(small)))
        return both, row[place], first

    def _remember(self, keys: np.ndarray, made: Units) -> None:
        rows = np.concatenate([self.rows, len(self.table.bad) + np.arange(len(keys))])
        keys = np.concatenate([self.keys, keys])
        self.table = self.table.plus(made)
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]

    def _size(self) -> int:
        table = self.table
        return (120 if self.write else 72) * len(table.bad) + 8 * len(table.pairs) + 6 * self.write * int(table.n_a.sum() + table.n_b.sum())


def aligner(byte_path: str, piece_path: str, memo_bytes: int, write: bool = True) -> Aligner:
    """One for each worker process and pass (only the second one writes groups); its memo outlives a task."""
    key = (byte_path, piece_path, memo_bytes, write)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _thin(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def pair_counts(df: DataFrame, byte_path: str, piece_path: str, text_col: str = "text", salts: int = 16, memo_bytes: int = 64 << 20) -> DataFrame:
    """(a, b, n, best): how many links hold each id pair, and whether that is the highest count of its B id."""
    thin = df.select(F.col(text_col).cast("binary").alias("text"))

    def make():
        own = aligner(byte_path, piece_path, memo_bytes, write=False)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            pairs, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for data, offsets in kernels.portions(*kernels.text_buffer(b.column("text"))):
                units, row, first = own.batch(data, offsets)
                good = np.repeat(_sums(units.bad[row], first) == 0, np.diff(first))
                times = np.bincount(row[good], minlength=len(units.bad))
                pairs.append(units.pairs)
                many.append(np.repeat(times, units.n_links))
            flat, weight = np.concatenate(pairs), np.concatenate(many)
            place, distinct = pd.factorize(flat)
            n = np.bincount(place, weight, len(distinct)).astype(np.int64)
            kept, n = distinct[n > 0], n[n > 0]
            return pa.RecordBatch.from_arrays([pa.array((kept >> 32).astype(np.int32)), pa.array((kept & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        return step

    partial = arrow_map(thin, make, "a int, b int, n long").withColumn("salt", F.spark_partition_id() % salts)
    summed = partial.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _frequent(pairs: DataFrame, max_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Keys, counts and best marks of the most frequent pairs, by key; and whether these are all."""
    by_size = sorted(((r[0], r[1]) for r in pairs.groupBy(F.floor(F.log2("n")).alias("e")).count().collect()), reverse=True)
    total, least = 0, 1
    for e, n in by_size:
        if total + n > max_pairs:
            least = 1 << (int(e) + 1)
            break
        total += n
    kept = pairs.where(F.col("n") >= least).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("key"), "n", "best").toArrow()
    keys = kept.column("key").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return keys[order], kept.column("n").to_numpy().astype(np.int64)[order], kept.column("best").to_numpy().astype(bool)[order], least == 1


_COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_RARE = "rare array<struct<a: int, b: int, times: long>>"


def align(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = 1 << 20, salts: int = 16, memo_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row.

    ``n_best`` counts the links whose pair has its B id's highest count, ``count_sum``
    adds up the counts of all links' pairs, ``groups`` is ``a1,a2|b1;a3|b2,b3``.
    """
    spark = df.sparkSession
    pairs = stash(pair_counts(df, byte_path, piece_path, text_col, salts, memo_bytes), "pairs")
    *told, complete = _frequent(pairs, max_pairs)
    shared = spark.sparkContext.broadcast(tuple(told))
    schema = _COLUMNS if complete else f"{_COLUMNS}, {_RARE}"

    def make():
        own, (keys, counts, best) = aligner(byte_path, piece_path, memo_bytes), shared.value

        def part(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
            units, row, first = own.batch(data, offsets)
            at = np.minimum(np.searchsorted(keys, units.pairs), max(0, len(keys) - 1))
            known = keys[at] == units.pairs if len(keys) else np.zeros(len(units.pairs), bool)
            edges = np.append(units.start, len(units.pairs))
            n_best, count = (_sums(np.where(known, x[at], 0) if len(x) else np.zeros(len(at), np.int64), edges) for x in (best, counts))
            good = _sums(units.bad[row], first) == 0
            numbers = [np.where(good, _sums(x[row], first), 0) for x in (units.n_a, units.n_b, units.n_groups, units.n_links, n_best, count)]
            texts, edge = units.groups[row].tolist(), first.tolist()
            groups = [b";".join(texts[i:j]) if g else b"" for i, j, g in zip(edge[:-1], edge[1:], good.tolist(), strict=True)]
            columns = [*map(pa.array, numbers), pa.array(groups, pa.binary()).cast(pa.string())]
            return columns if complete else [*columns, rare(units, row, first, good, known)]

        def rare(units: Units, row: np.ndarray, first: np.ndarray, good: np.ndarray, known: np.ndarray) -> pa.Array:
            doc = np.repeat(np.arange(len(good)), np.diff(first))
            place = runs(units.start[row], units.n_links[row])
            doc = np.repeat(doc, units.n_links[row])
            wanted = ~known[place] & good[doc]
            found = pd.DataFrame({"doc": doc[wanted], "pair": units.pairs[place[wanted]]}).value_counts(sort=False).sort_index()
            own_doc, pair = (found.index.get_level_values(x).to_numpy() for x in ("doc", "pair"))
            items = pa.StructArray.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(found.to_numpy().astype(np.int64))], names=["a", "b", "times"])
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(own_doc, np.arange(len(good) + 1)).astype(np.int32)), items)

        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", *["rare"] * (not complete)]

        def step(b: pa.RecordBatch) -> pa.Table | None:
            if not b.num_rows:
                return None
            out, begin = [], 0
            for data, offsets in kernels.portions(*kernels.text_buffer(b.column("text"))):
                ids = b.column("doc_id").slice(begin, len(offsets) - 1)
                out.append(pa.RecordBatch.from_arrays([ids, *part(data, offsets)], names=names))
                begin += len(offsets) - 1
            return pa.Table.from_batches(out)

        return step

    aligned = arrow_map(_thin(df, id_col, text_col), make, schema)
    if complete:
        drop(pairs)
        return aligned
    aligned = stash(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = aligned.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(pairs, ["a", "b"])
    more = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_count"))
    whole = aligned.join(more, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups",
    )
