"""Sharding: global prefix sums of byte sizes, cut at equal targets.

The rows to deal out are put in a fixed order once (by ``order_by`` through a
range partitioning, or as stored) and written to shared storage, so that every
later pass sees the same partitions even if executors are lost.  One small row
for each partition (its number of rows and bytes) gives every partition the sum
before it; rows are then dealt in place.  A row goes to the shard in whose equal
share of all bytes its first byte lies: shards are contiguous and differ from
the target by at most one row.  Equal texts are not kept together: with a hot
group that would break the law of near equal bytes.

Only the per-partition totals and one row count for each (partition, shard) that
meet (at most partitions + shards rows) reach the driver.

Defined results: a null text or size has no bytes, texts of any length count by
their bytes (one longer than a shard's share leaves shards empty); a null id is
dealt like any other (first in order); repeated rows are dealt each for itself;
rows that tie in ``order_by`` stand in any order (op2 orders by all its columns, so
that tied rows are equal); an empty table gives an empty result; if no row has any
bytes, all rows go to shard 0.  Columns named size, shard, slot, part, row or
bytes_before are replaced, others are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import arrow_map, stash


def deal(ordered: DataFrame, shards: int, size_col: str = "size") -> DataFrame:
    """``ordered`` (a scan with one partition for each part, in order) with part, shard and slot.

    ``ordered`` must have the columns ``part`` and ``row``, as ``numbered`` makes them.
    """
    totals = sorted(ordered.groupBy("part").agg(F.sum(size_col).alias("bytes")).collect())
    before, run = {}, 0
    for part, size in totals:
        before[part] = run
        run += size
    if not before:
        return ordered.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).where("false")
    prefix = ordered.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "part int, before long")
    joined = ordered.join(F.broadcast(prefix), "part")
    start = F.col("before") + F.col("bytes_before")
    shard = F.least(F.floor(start.cast("decimal(38,0)") * shards / F.lit(run or 1).cast("decimal(38,0)")).cast("int"), F.lit(shards - 1))
    placed = joined.withColumn("shard", shard).drop("before")
    met = sorted(placed.groupBy("shard", "part").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect())
    base, current, seen = [], None, 0
    for s, part, first, n in met:
        if s != current:
            current, seen = s, 0
        base.append((s, part, seen - first))
        seen += n
    shift = ordered.sparkSession.createDataFrame(base, "shard int, part int, shift long")
    return placed.join(F.broadcast(shift), ["shard", "part"]).withColumn("slot", F.col("row") + F.col("shift")).drop("shift")


def numbered(df: DataFrame, size_col: str = "size") -> DataFrame:
    """``df`` written to shared storage with part, row (from 0 in the part) and bytes_before (in the part)."""
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("part int, row long, bytes_before long").fields])

    def make():
        part, rows, size = TaskContext.get().partitionId(), 0, 0

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal rows, size
            sizes = b.column(size_col).to_numpy(zero_copy_only=False).astype(np.int64)
            more = [np.full(len(sizes), part, np.int32), rows + np.arange(len(sizes)), size + np.cumsum(sizes) - sizes]
            rows, size = rows + len(sizes), size + int(sizes.sum())
            return pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], names=schema.names)

        return step

    return stash(arrow_map(df, make, schema), "shards")


def shard_sized(df: DataFrame, shards: int, size_col: str = "size", order_by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with shard and slot, from the byte sizes in ``size_col``.

    Without ``order_by`` rows keep their stored order and nothing shuffles; with
    it they are range partitioned and sorted by those columns.
    """
    df = df.drop("shard", "slot", "part", "row", "bytes_before").withColumn(size_col, F.coalesce(F.col(size_col).cast("long"), F.lit(0)))
    if order_by:
        width = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(width, *order_by).sortWithinPartitions(*order_by)
    return deal(numbered(df, size_col), shards, size_col).drop("part", "row", "bytes_before")


def shard_by_bytes(df: DataFrame, shards: int = 24, text_col: str = "text", overhead: int = 8, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with size (UTF-8 bytes of the text plus ``overhead``), shard and slot (gapless from 0 in each shard)."""
    sized = df.drop("size").withColumn("size", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead)
    return shard_sized(sized, shards, order_by=order_by)


def text_crc32(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with text_crc32 in place of the text (null: that of no bytes)."""
    return df.withColumn("text_crc32", F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(zlib.crc32(b""))))
