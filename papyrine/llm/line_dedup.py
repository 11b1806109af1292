"""Line deduplication with two Bloom filters and exact confirmation.

1. Each batch of documents sends a sparse partial filter of its line keys; the
   merged twice-seen filter (bounded size, see ``bloom``) is broadcast.
2. Only lines that the filter suspects shuffle, as (128-bit key digest, doc id);
   distinct documents are counted exactly and the keeper is the largest doc id.
3. Confirmed keys are applied to the texts in a map.  They are broadcast only if
   their counted size (100 bytes a key of fixed width) is under
   ``max_broadcast_bytes``; beyond it the suspected lines meet them in a join and
   the drops are joined to the documents by id.

Beyond ``filter_bytes`` the filter suspects more lines than repeat: more lines
shuffle for the confirmation and none is lost.

Defined results: a null or empty text is one empty line; a null id counts as one
document smaller than all others; rows that repeat an id count as one document
when keys are counted, and all of them keep the line if the id is the keeper.
Texts of any length count whole; repeated rows keep or lose their lines alike;
an empty table gives no rows.  Columns of the input named like the added ones are
replaced, others are kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_map, stash
from .bloom import PARTIAL_SCHEMA, collect_twice, partials, slices_for

_BLANK = b" \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Digest of a line's key, None if the key is shorter than ``min_chars`` code points."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    if not text or len(text) < min_chars:
        return set()
    found = {line_key(x, min_chars) for x in text.split(b"\n") if len(x) >= min_chars}
    found.discard(None)
    return found


def _heads(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if keys else np.zeros(0, np.uint64)


class Drops:
    """Confirmed keys and their keepers, by key."""

    def __init__(self, table: pa.Table):
        self.keepers = dict(zip(table.column("key").to_pylist(), table.column("keeper").to_pylist(), strict=True))


def repeated_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, filter_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(key, keeper) of keys of at least ``min_chars`` code points held by at least ``min_docs`` documents; (key, doc) of all suspects."""
    spark = df.sparkSession
    thin = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    lines = F.size(F.filter(F.split(F.col(text_col).cast("string"), "\n", -1), lambda x: F.octet_length(x) >= min_chars))
    keys = df.where(F.octet_length(text_col) >= min_chars).agg(F.sum(lines)).first()[0] or 0
    slices = slices_for(keys, max_bytes=filter_bytes)

    def sending():
        def step(b: pa.RecordBatch):
            found: list[bytes] = []
            for text in b.column("text").to_pylist():
                found.extend(_keys(text, min_chars))
            return partials(_heads(found), slices)

        return step

    twice = collect_twice(arrow_map(thin.select("text"), sending, PARTIAL_SCHEMA), slices)
    shared = spark.sparkContext.broadcast(twice)

    def suspecting():
        seen = shared.value

        def step(b: pa.RecordBatch):
            keys, docs = [], []
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True):
                if own := list(_keys(text, min_chars)):
                    keys.extend(own)
                    docs.extend([doc] * len(own))
            if not keys:
                return None
            hit = pa.array(seen.suspects(_heads(keys)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).filter(hit), pa.array(docs, pa.int64()).filter(hit)], names=["key", "doc"])

        return step

    suspects = arrow_map(thin, suspecting, "key binary, doc long").distinct()
    confirmed = suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("keeper"))
    return stash(confirmed.where(F.col("n") >= min_docs).select("key", "keeper"), "lines"), suspects


def _kept(text: bytes | None, dropped: set[bytes], min_chars: int) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    if not dropped:
        return text or b"", len(lines), 0
    kept = [x for x in lines if len(x) < min_chars or line_key(x, min_chars) not in dropped]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    filter_bytes: int = 32 << 20,
    max_broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """``df`` with ``text_col`` replaced by the kept lines, plus n_lines and n_dropped."""
    spark = df.sparkSession
    confirmed, suspects = repeated_lines(df, id_col, text_col, min_chars, min_docs, filter_bytes)
    base = df.drop("n_lines", "n_dropped")
    added = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    added = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in added.fields])

    names = set(base.columns)

    def rewrite(b: pa.RecordBatch, dropped_of) -> pa.RecordBatch:
        ids, texts = b.column(id_col).to_pylist(), b.column(text_col).cast(pa.binary()).to_pylist()
        out = [_kept(text, dropped_of(i, doc, text), min_chars) for i, (doc, text) in enumerate(zip(ids, texts, strict=True))]
        columns = {n: b.column(n) for n in b.schema.names if n in names}
        columns[text_col] = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
        columns["n_lines"] = pa.array([x[1] for x in out], pa.int64())
        columns["n_dropped"] = pa.array([x[2] for x in out], pa.int64())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    if confirmed.count() * 100 <= max_broadcast_bytes:
        shared = spark.sparkContext.broadcast(Drops(confirmed.toArrow()))

        def applying():
            keepers = shared.value.keepers

            def dropped_of(_, doc, text):
                doc = _NO_ID if doc is None else doc
                return {k for k in _keys(text, min_chars) if keepers.get(k, doc) != doc} if keepers else set()

            return lambda b: rewrite(b, dropped_of)

        return arrow_map(base, applying, added)

    listed, of = "_drops", "_drops_of"
    while listed in names or of in names:
        listed, of = f"{listed}_", f"{of}_"
    drops = suspects.join(confirmed, "key").where("doc <> keeper").groupBy(F.col("doc").alias(of)).agg(F.collect_list("key").alias(listed))
    joined = base.join(drops, F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col(of), "left").drop(of)

    def joined_apply():
        def step(b: pa.RecordBatch):
            lists = b.column(listed).to_pylist()
            return rewrite(b, lambda i, *_: set(lists[i] or ()))

        return step

    return arrow_map(joined, joined_apply, added)
