"""Held-out split and the bounded training sample of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is an empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, object]]:
    """At most ``rows`` (text, label) with a label, the first in the order of a hash of the id.

    Labels are bounded before they meet the documents, so at most ``rows``
    labels are broadcast; of documents that repeat an id the first texts in order
    count, and at most ``2 * rows`` texts reach the driver.  Texts over ``max_bytes``
    take no part in training.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    texts = docs.where(F.octet_length(text_col) <= max_bytes).select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    found = texts.join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("_at"), "_id", "_text", "_label")
    found = found.orderBy("_at", "_id", "_label", "_text").limit(2 * rows).toArrow().to_pylist()
    found.sort(key=lambda r: (r["_at"], r["_id"], str(r["_label"]), r["_text"]))
    return [(r["_text"], r["_label"]) for r in found]


def interleave(a: list, b: list) -> list:
    """Both lists in turn, so that any stride through the result meets both."""
    out = [x for pair in zip(a, b, strict=False) for x in pair]
    return out + a[len(b) :] + b[len(a) :]
