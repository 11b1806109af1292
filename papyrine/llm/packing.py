"""Packing by power-of-two decomposition.

The token ids of a document (its text's ids, then an end id) are cut into pieces
whose lengths are powers of two: as many of ``window`` as fit, then the binary
digits of the rest.  Every piece is a sequence of its own, so no sequence
crosses documents and none needs padding; equal lengths share a bucket, from
which batches of one shape are drawn.  There is no shuffle: a document is packed
where it is read.

Tokenising is memoised by word.  The vocabulary's pre-tokenizer never joins text
across ASCII white space, so a word's ids do not depend on its neighbours;
batches hash their words with numpy, look each distinct word up once, and only
unseen words reach the tokenizer.  The memo is bounded by bytes.

Defined results: null text is empty and gives one piece holding the end id; an
empty table gives no rows; texts of any length are tokenised whole, in
portions of whole texts; there are no ties, since nothing is ranked; repeated
rows (and ids) are packed each for itself; sequence ids are unique within a
result and stable when a task is retried on the same input partitions.  Columns
other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_map
from . import kernels

#: Words tokenised by one call, and the length (in code points) from which a word has a call of its own.
_CALL_WORDS, _OWN_CALL = 1000, 256
_encoders: dict[tuple[str, int], WordEncoder] = {}


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs given by their starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Token ids of white-space separated words, memoised in at most about ``memo_bytes``.

    The memo is flat: sorted word hashes with the place of each word's ids in one
    array.  When it is full only the words of the current batch stay.
    """

    def __init__(self, path: str, memo_bytes: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.memo_bytes = memo_bytes
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.kind))

    def keep(self, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.starts, self.sizes, self.ids = keys[order], starts[order], sizes[order], ids

    def size(self) -> int:
        return self.keys.nbytes + self.starts.nbytes + self.sizes.nbytes + self.ids.nbytes

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each word has; each as the tokenizer gives them for it alone."""
        texts = [r.decode("utf-8", "replace") for r in raw]
        alone = [len(t) > _OWN_CALL for t in texts]
        if any(s in b" ".join(raw) for s in self.special):
            alone = [own or any(s in r for s in self.special) for own, r in zip(alone, raw, strict=True)]
        ids, counts = [], np.zeros(len(texts), np.int32)
        for begin, end in self._calls(alone):
            found = self.tokenizer.encode(" ".join(texts[begin:end]), add_special_tokens=False)
            ids.append(np.array(found.ids, self.kind))
            if end - begin == 1:
                counts[begin] = len(found.ids)
                continue
            lengths = np.fromiter(map(len, texts[begin:end]), np.int64, end - begin)
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            word = np.searchsorted(np.cumsum(lengths + 1) - lengths - 1, at, side="right") - 1
            counts[begin:end] = np.bincount(word, minlength=end - begin)
        return np.concatenate(ids) if ids else np.zeros(0, self.kind), counts

    @staticmethod
    def _calls(alone: list[bool]):
        begin = 0
        for i, own in enumerate(alone):
            if own:
                if begin < i:
                    yield begin, i
                yield i, i + 1
                begin = i + 1
            elif i + 1 - begin == _CALL_WORDS:
                yield begin, i + 1
                begin = i + 1
        if begin < len(alone):
            yield begin, len(alone)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        words = kernels.hash_words(data, offsets, lower=False)
        inverse, keys = pd.factorize(words.hashes)
        first = np.empty(len(keys), np.int64)
        first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        fresh = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
        view = memoryview(data)
        ids, counts = self.words([bytes(view[a:b]) for a, b in zip(words.starts[first[fresh]].tolist(), words.ends[first[fresh]].tolist(), strict=True)])
        starts, sizes = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        if len(self.keys):
            starts[~fresh], sizes[~fresh] = self.starts[at[~fresh]], self.sizes[at[~fresh]]
        starts[fresh], sizes[fresh] = np.cumsum(counts) - counts + len(self.ids), counts
        flat = np.concatenate([self.ids, ids])
        total = np.concatenate([[0], np.cumsum(sizes[inverse])])
        out = flat[_spread(starts[inverse], sizes[inverse])].astype("<u4"), np.diff(total[words.first])
        self.keep(np.concatenate([self.keys, keys[fresh]]), np.concatenate([self.starts, starts[fresh]]), np.concatenate([self.sizes, sizes[fresh]]), flat)
        if self.size() > self.memo_bytes:
            self.keep(keys, np.cumsum(sizes, dtype=np.int64) - sizes, sizes, flat[_spread(starts, sizes)])
        if self.size() > self.memo_bytes:
            self.keep(keys[:0], starts[:0], sizes[:0], flat[:0])
        return out


def encoder(path: str, memo_bytes: int) -> WordEncoder:
    """One encoder for each worker process; its memo outlives a task."""
    if (path, memo_bytes) not in _encoders:
        _encoders[path, memo_bytes] = WordEncoder(path, memo_bytes)
    return _encoders[path, memo_bytes]


def piece_lengths(tokens: int, window: int) -> list[int]:
    """Powers of two, largest first, that add up to ``tokens``."""
    out = [window] * (tokens // window)
    rest = tokens % window
    return out + [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    memo_bytes: int = 32 << 20,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, bucket, ids (if ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset.

    ``bucket`` is the exponent of the piece's length; write with
    ``partitionBy("bucket")`` to batch sequences of equal length.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    thin = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = T._parse_datatype_string("doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)

    def make():
        enc = encoder(tokenizer_path, memo_bytes)

        def part(docs: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            tokens = counts + 1
            ends = np.cumsum(tokens)
            full = np.full(int(ends[-1]), end_id, "<u4")
            mask = np.ones(len(full), bool)
            mask[ends - 1] = False
            full[mask] = ids
            lengths = [piece_lengths(int(t), window) for t in tokens]
            pieces = np.array([len(x) for x in lengths])
            length = np.array([y for x in lengths for y in x], np.int64)
            at = np.concatenate([[0], np.cumsum(length)])
            doc = np.repeat(np.arange(len(docs)), pieces)
            start = at[:-1] - (ends - tokens)[doc]
            raw = memoryview(full.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            columns = [docs.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(np.log2(length).astype(np.int32)), pa.array(crc, pa.int64()), pa.array(tokens[doc])]
            if with_ids:
                columns.append(kernels.arrow_lists(full.astype(np.int32), length, pa.int32()))
            return pa.RecordBatch.from_arrays(columns, schema.names)

        def step(b: pa.RecordBatch) -> pa.Table | None:
            if not b.num_rows:
                return None
            out, begin, sizes = [], 0, np.diff(kernels.text_buffer(b.column("text"))[1])
            while begin < b.num_rows:  # about 8 MB of text at a time
                upto = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), 8 << 20)) + begin)
                cut = b.slice(begin, upto - begin)
                ids, counts = enc.batch(*kernels.text_buffer(cut.column("text")))
                out.append(part(cut.column("doc_id"), ids, counts))
                begin = upto
            return pa.Table.from_batches(out)

        return step

    return arrow_map(thin, make, schema).select(
        *[c for c in schema.names if c != "ids"], *["ids"] * with_ids,
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
