"""CSV files of any size read by many tasks, quoted line breaks included.

Spark cuts files into splits without knowing whether a cut lies inside quotes.  Two
passes over the splits settle that:

1. Each split counts its quotes.  The parity of all quotes before a split (a prefix
   sum over the splits of its file) tells whether it begins inside a quoted field.
2. Each split is read again as its own task, now knowing that: it parses the records
   that lie in it and sets aside what belongs to a record begun before (head), what
   begins a record that goes on (tail), or all of it (middle).  These few pieces are
   chained in order and parsed; counts of records by split give every record its number.

No record is lost or read twice wherever the cuts fall, and no task holds more than
a split and one record.  What the driver gets is one row a split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import csv_text
from ..functions.columns import value_udf
from ..runtime import prepare, stash

_RECORD, _HEAD, _MIDDLE, _TAIL = range(4)
_PARTS = "file string, start long, idx long, kind int, fields array<string>, text string"
_NAMES = ["file", "start", "idx", "kind", "fields", "text"]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]


class _Split:
    """What is read of one split."""

    def __init__(self, file: str, start: int, inside: bool, dialect: csv_text.Dialect):
        self.file, self.start, self.inside, self.head = file, start, inside, inside
        self.dialect = dialect if start == 0 else replace(dialect, skip_bom=False)
        self.held: list[str] = []
        self.count = 0

    def lines(self, lines: list[str]) -> Iterator[tuple]:
        """Rows of the records that end in ``lines``; a record that does not end is held."""
        whole = 0  # lines held that make complete records
        for line in lines:
            self.held.append(line)
            self.inside ^= line.count(self.dialect.quote) & 1 == 1
            if self.inside:
                continue
            if self.head:
                self.head = False
                yield self.file, self.start, 0, _HEAD, None, "\n".join(self.held)
                self.held, whole = [], 0
                continue
            whole = len(self.held)
        if whole:
            for fields in csv_text.parse("\n".join(self.held[:whole]) + "\n", self.dialect):
                yield self.file, self.start, self.count, _RECORD, fields, None
                self.count += 1
            self.dialect = replace(self.dialect, skip_bom=False)
            self.held = self.held[whole:]

    def rest(self) -> Iterator[tuple]:
        if self.held:
            yield self.file, self.start, self.count, _MIDDLE if self.head else _TAIL, None, "\n".join(self.held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def read_split_csv(spark: SparkSession, path: str, dialect: csv_text.Dialect = csv_text.Dialect(), max_splits: int = 1 << 20) -> DataFrame:
    """(file, row_idx, fields) of CSV files, ragged rows kept, rows numbered in the order of each file.

    Quotes stand around whole fields and are doubled inside them; line feeds (or CRLF) end
    records.  An escape character, comments and bare quotes would hide quotes from the
    first pass, so dialects with them are refused (``read_csv`` takes them, a file a task).
    A quote that is never closed fails the job, as in ``read_csv``.
    """
    if dialect.escape or dialect.comment or dialect.allow_bare_quote or not dialect.quote:
        raise ValueError("files are split by the parity of quotes: the dialect must double them and have no comments")
    prepare(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(dialect.quote), F.lit("")))
    in_file = Window.partitionBy("file").orderBy("start")
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.coalesce(F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = stash(counted.select("file", "start", (before % 2 == 1).alias("inside")), "splits")
    if splits.count() > max_splits:
        raise ValueError("more splits than fit a broadcast: raise spark.sql.files.maxPartitionBytes")
    begins_inside = spark.sparkContext.broadcast({(r.file, r.start): r.inside for r in splits.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for b in batches:
            values, files, starts = (b.column(c).to_pylist() for c in ("value", "file", "start"))
            at, out = 0, []
            while at < len(values):
                end = at
                while end < len(values) and starts[end] == starts[at] and files[end] == files[at]:
                    end += 1
                if split is None or (split.file, split.start) != (files[at], starts[at]):
                    out.extend(split.rest() if split else ())
                    split = _Split(files[at], starts[at], begins_inside.value[files[at], starts[at]], dialect)
                out.extend(split.lines(values[at:end]))
                at = end
            if out:
                yield _batch(out)
        if split and (last := list(split.rest())):
            yield _batch(last)

    parts = stash(lines.mapInArrow(run, _PARTS), "csv_parts")
    order = Window.partitionBy("file").orderBy("start", "kind")
    chained = parts.where(F.col("kind") > _RECORD).withColumn("chain", F.sum((F.col("kind") == _TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    joined = chained.groupBy("file", "chain").agg(F.array_join(F.transform(piece, lambda x: x["text"]), "\n").alias("text"), F.max(F.when(F.col("kind") == _TAIL, F.struct("start", "idx"))).alias("at"))
    plain = replace(dialect, skip_bom=False)
    parsed = joined.select("file", F.coalesce("at.start", F.lit(0)).alias("start"), F.coalesce("at.idx", F.lit(0)).alias("idx"), F.explode(value_udf(lambda t: csv_text.parse(t + "\n", plain), "array<array<string>>", "text")).alias("fields"))
    rows = parts.where(F.col("kind") == _RECORD).select("file", "start", "idx", "fields").unionByName(parsed)
    ends = parts.where(F.col("kind").isin(_RECORD, _TAIL)).groupBy("file", "start").agg(F.count("*").alias("n"))
    offsets = F.broadcast(stash(ends.select("file", "start", F.coalesce(F.sum("n").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset")), "offsets"))
    return rows.join(offsets, ["file", "start"]).select("file", (F.col("offset") + F.col("idx")).alias("row_idx"), "fields")
