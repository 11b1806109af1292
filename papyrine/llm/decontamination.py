"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (classes of powers of
two).  For class c documents are seen through overlapping windows of
``2 ** (c + 2)`` shingles, stepped by half, so that a passage as long as any item
of the class lies whole in one window and the sizes compared stay within a
factor of four however long the document is.  Items and windows are sketched by
one-permutation MinHash with four bins for each shingle of a window; an item is a
candidate for a document if a window's minimum equals the item's in any bin (one
row a band).  A window's minimum can only equal an item's if that shingle is in
the document, so bins are computed only around such shingles.  Items of classes
up to ``DIRECT_CLASS`` (fewer than 8 shingles) are too small for a sketch: every
document that holds any of their shingles is a candidate.  Candidates are verified
by exact containment of the item's whole set in the document's, so nothing is found
wrongly, small items are all found, and a larger one is missed only if no minimum
of any shared shingle's bin survives in a window.

Items are collected in blocks of bounded count and bytes, one at a time, and each
block is one pass over the documents; documents are never shuffled.  With more
than one block the documents are written between passes, so that only one block
is on the driver and the executors.

Recall: items of fewer than 8 shingles have none to lose.  A larger item lies whole
in one window of at most 4 times its size, whose bins are 16 times the item's
least size, so a given shared shingle is its bin's minimum with a chance of
about 0.88 and all shared ones (7 at least) are not with less than one in 10 ** 5.

Defined results: texts of any length are taken whole; an empty table gives no rows,
empty items no leaks; there are no ties (every item that reaches the share is
reported, in the order of the items); null, empty and wordless texts have no shingles and match
nothing; with fewer than k words the whole sequence is the one shingle; repeated
items and documents match each for itself; an item with a null id matches like any
other and its leaks have a null item_id.  A column of the input named leaks is
replaced, others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_map, drop, stash
from . import kernels

#: Largest class of items that are found by their shingles without sketches.
DIRECT_CLASS = 2
LEAK = "array<struct<item_id:bigint,item_shingles:bigint,shared:bigint,containment:double>>"


class ItemIndex:
    """Signatures of one block of items."""

    def __init__(self, ids: list[int], texts: list[bytes | None], k: int):
        words = kernels.hash_words(*kernels.text_buffer(pa.array(texts, pa.binary())))
        self.ids, self.sets, self.k = ids, list(kernels.shingle_sets(words, k)), k
        self.bands: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        self.direct: dict[int, list[int]] = defaultdict(list)
        classes = set()
        for i, own in enumerate(self.sets):
            if len(own):
                c = len(own).bit_length() - 1
                if c <= DIRECT_CLASS:
                    for v in own.tolist():
                        self.direct[v].append(i)
                    continue
                classes.add(c)
                for b, v in self.signature(own, c):
                    self.bands[c, b, v].append(i)
        self.classes = sorted(classes)
        self.values = np.unique(np.array([*(v for _, _, v in self.bands), *self.direct], np.uint64))
        self.bitmap = np.zeros(1 << 21, np.uint8)
        at = (self.values >> np.uint64(40)).astype(np.int64)
        np.bitwise_or.at(self.bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @staticmethod
    def bins(hashes: np.ndarray, c: int) -> np.ndarray:
        return ((hashes >> np.uint64(16)) & np.uint64((1 << (c + 4)) - 1)).astype(np.int64)

    def signature(self, hashes: np.ndarray, c: int) -> list[tuple[int, int]]:
        """(bin, minimum) of every bin that is not empty."""
        ordered = np.sort(hashes)
        bins, first = np.unique(self.bins(ordered, c), return_index=True)
        return list(zip(bins.tolist(), ordered[first].tolist(), strict=True))

    def hits(self, stream: np.ndarray) -> np.ndarray:
        """Positions of shingles that are the minimum of some item's bin, or of a small item."""
        at = (stream >> np.uint64(40)).astype(np.int64)
        maybe = np.flatnonzero((self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        if not len(maybe) or not len(self.values):
            return maybe[:0]
        found = stream[maybe]
        where = np.minimum(np.searchsorted(self.values, found), len(self.values) - 1)
        return maybe[self.values[where] == found]

    def candidates(self, shingles: np.ndarray, hits: np.ndarray) -> set[int]:
        """Small items that share a shingle with the document, others that share a bin's minimum with a window of it."""
        out: set[int] = set()
        if self.direct:
            for v in np.unique(shingles[hits]).tolist():
                out.update(self.direct.get(v, ()))
        for c in self.classes:
            step = 1 << (c + 1)
            windows = {int(p) // step + back for p in hits for back in (0, -1)}
            for w in windows:
                if w < 0 and len(shingles):
                    continue
                for band in self.signature(shingles[w * step : (w + 2) * step], c):
                    out.update(self.bands.get((c, *band), ()))
        return out

    def leaks(self, shingles: np.ndarray, hits: np.ndarray, num: int, den: int) -> list[dict]:
        own = np.unique(shingles)
        out = []
        for i in sorted(self.candidates(shingles, hits)):
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[at] == item).sum())
            if den * shared >= num * len(item):
                out.append({"item_id": self.ids[i], "item_shingles": len(item), "shared": shared, "containment": shared / len(item)})
        return out


def _one_pass(docs: DataFrame, index: ItemIndex, text_col: str, num: int, den: int, keep: bool):
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*docs.schema.fields, T.StructField("leaks", T._parse_datatype_string(LEAK))]) if "leaks" not in docs.columns else docs.schema
    leak_type = pa.list_(pa.struct([("item_id", pa.int64()), ("item_shingles", pa.int64()), ("shared", pa.int64()), ("containment", pa.float64())]))

    def make():
        items = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            found = []
            for part in kernels.portions(*kernels.text_buffer(b.column(text_col))):
                words = kernels.hash_words(*part)
                stream = kernels.shingle_stream(words, items.k)
                hits, count = items.hits(stream), words.counts()
                docs_of = np.searchsorted(words.first, hits, side="right") - 1
                whole = hits + items.k <= words.first[docs_of + 1]
                by_doc = defaultdict(list)
                for d, p in zip(docs_of[whole].tolist(), hits[whole].tolist(), strict=True):
                    by_doc[d].append(p)
                short = None
                for d in range(len(count)):
                    a, n = int(words.first[d]), int(count[d])
                    if d in by_doc:
                        found.append(items.leaks(stream[a : a + n - items.k + 1], np.array(by_doc[d]) - a, num, den))
                    elif 0 < n < items.k:
                        short = list(kernels.shingle_sets(words, items.k)) if short is None else short
                        found.append(items.leaks(short[d], items.hits(short[d]), num, den))
                    else:
                        found.append([])
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            if "leaks" in columns:
                found = [(x or []) + y for x, y in zip(columns["leaks"].to_pylist(), found, strict=True)]
            columns["leaks"] = pa.array(found, leak_type)
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            return out if keep else out.filter(pa.array([bool(x) for x in found], pa.bool_()))

        return step

    return arrow_map(docs, make, schema), shared


def item_blocks(items: DataFrame, id_col: str, text_col: str, rows: int, size: int):
    """Functions that collect one block (ids, texts) each, of at most about ``rows`` items and ``size`` bytes.

    Items are dealt to blocks by their row number, so repeated items lie in different ones.
    """
    thin = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    thin = stash(thin.withColumn("row", F.monotonically_increasing_id()), "items")
    n, total = thin.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // rows), -(-total // size))

    def block(i: int) -> tuple[list, list]:
        part = thin.where(F.pmod("row", F.lit(blocks)) == i).orderBy("id", "row").toArrow()
        return part.column("id").to_pylist(), part.column("text").to_pylist()

    return [partial(block, i) for i in range(blocks)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    item_id: str = "item_id",
    item_text: str = "text",
    block_rows: int = 50_000,
    block_bytes: int = 32 << 20,
    keep_clean: bool = True,
) -> DataFrame:
    """``docs`` with ``leaks``: the items whose shingles lie in the document to at least ``num/den``.

    ``keep_clean=False`` keeps only rows with leaks (a row passes every block of
    items before that is decided).
    """
    out = docs.drop("leaks")
    *others, last = item_blocks(items, item_id, item_text, block_rows, block_bytes)
    for block in others:
        found, shared = _one_pass(out, ItemIndex(*block(), k), text_col, num, den, keep=True)
        out, before = stash(found, "screened"), out
        shared.unpersist()
        drop(before)
    out, _ = _one_pass(out, ItemIndex(*last(), k), text_col, num, den, keep_clean or bool(others))
    return out if keep_clean else out.where(F.size("leaks") > 0)


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item."""
    return find_leaks(docs, items, **options).where(F.size("leaks") == 0).drop("leaks")
