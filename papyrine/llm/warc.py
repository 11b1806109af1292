"""WARC archives of captures with revisit records, and their index in global order.

1. Write: payloads of at least ``min_revisit`` bytes are grouped by SHA-256; the
   smallest page of a group is its response, the others become revisit records.
   Only groups of more than one capture are joined back: by broadcast while they are
   few, else by digest, where the few groups that are large are broadcast all the
   same, so no reducer gets a large group.  Every task streams its captures into
   archives of its own in the shared folder (one gzip member a record) and returns
   their names; only files named in that list, which is written down, are ever read,
   so what a lost or repeated task left behind does no harm.
2. Read: a task streams whole archives member by member, checks the digest of each
   payload and returns one sorted run of index entries for each archive.
3. Merge (external): entries go to ranges of (URL key, time, page), cut by Spark's
   sample; a range receives its part of every run and merges these runs by a loser
   tree.  The ranges in order are the capture histories.  A URL with very many
   captures may lie in several ranges: each range numbers its own captures, and the
   driver adds what the ranges before it hold of its first key (one row a range).

A URL key is the host without ``www.``, its labels reversed, then path and sorted
query; user, port, scheme and fragment go.

Defined results: a null payload is empty and a response like all below
``min_revisit`` bytes; a null id counts as larger than any, and if a group has no
other id all its captures are responses, like all rows that share the smallest id
(repeated rows); an unparsable url is a key of its own text, a
null one of none; control characters of a url are percent-encoded in its record, and
so in its key; a null time is
1970-01-01; equal (key, time, page) keep the order of archive and offset; payloads of
any length are written whole; an empty table gives no rows.  Other columns are not
read, whatever their names.  The shared folder must be one that pyarrow opens (a
mounted path, HDFS, an object store).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import prepare, scratch, stash

_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(?:\?([^#]*))?")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_TIME = "1970-01-01T00:00:00Z"
_CHUNK, _FEED = 1 << 20, 1 << 13


def url_key(url: str | None) -> str:
    """Sort key of a URL."""
    m = _URL.match(url or "")
    if not m:
        return url or ""
    host = m[1].lower().removeprefix("www.")
    query = "?" + "&".join(sorted(m[3].split("&"))) if m[3] else ""
    return f"{','.join(reversed(host.split('.')))}){m[2] or '/'}{query}"


def _place(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page_of(place: str) -> int | None:
    text = place.rpartition(":")[2].rstrip(">")
    return None if text == "none" else int(text)


def field_text(value: str) -> str:
    """A field's value as it is written: control characters percent-encoded, no space around it."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", value).strip()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{name}: {field_text(value)}" for name, value in fields]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def capture(page: int | None, url: str | None, time: str | None, payload: bytes, digest: str, revisit: bool, first: int | None) -> bytes:
    """Response or revisit record of one capture."""
    fields = [("WARC-Record-ID", _place(page)), ("WARC-Date", time or _NO_TIME), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if revisit:
        fields += [("WARC-Refers-To", _place(first)), ("WARC-Profile", _PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("revisit" if revisit else "response", fields, head if revisit else head + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    size = int(fields.get("content-length", -1))
    if not found or not version.startswith("WARC/") or size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def _http(block: bytes) -> tuple[int, bytes]:
    """Content-Length and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(line.partition(b":")[2]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return (sizes[0] if sizes else len(payload)), payload


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of every gzip member; only one is held at a time."""
    at, held, used = 0, b"", 0
    while True:
        unpack, content, size = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if used == len(held):
                held, used = stream.read(_CHUNK), 0
            if not held:
                if size:
                    raise ValueError("archive ends within a record")
                return
            piece = held[used : used + _FEED]
            content.append(unpack.decompress(piece))
            taken = len(piece) - len(unpack.unused_data)
            size, used = size + taken, used + taken
        yield at, size, b"".join(content)
        at += size


_MANIFEST = "file string, records long, bytes long"


def write_archives(captures: DataFrame, folder: str, roll_bytes: int = 32 << 20, level: int = 1) -> DataFrame:
    """Archives of ``captures`` (page_id, url, time, payload, digest, revisit, first) in ``folder``: (file, records, bytes), written down."""
    prepare(captures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = fs.FileSystem.from_uri(folder)
        store.create_dir(home, recursive=True)
        out, name, records, size = None, "", 0, 0

        def put(raw: bytes) -> None:
            nonlocal records, size
            pack = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = pack.compress(raw) + pack.flush()
            out.write(member)
            records, size = records + 1, size + len(member)

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records - 1], "bytes": [size]})

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "time", "payload", "digest", "revisit", "first")), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{home}/{name}", compression=None)
                    put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _NO_TIME), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                put(capture(*row))
                if size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return stash(captures.mapInArrow(run, _MANIFEST), "manifest")


_ENTRY = {
    "url_key": pa.string(), "time": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "intact": pa.bool_(), "file": pa.string(), "offset": pa.int64(), "length": pa.int64(),
}
_ENTRY_SQL = "url_key string, time string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, file string, offset long, length long"


def _order(key: str, time: str, page: int | None, file: str, offset: int) -> tuple:
    return key, time, page is None, page or 0, file, offset


def entry(fields: dict[str, str], block: bytes, file: str, offset: int, length: int) -> tuple | None:
    """Index entry of a record, in the order of its columns; none for records that are no captures."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    size, payload = _http(block)
    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    own = told if kind == "revisit" else hashlib.sha256(payload).hexdigest()
    intact = own == told and (kind == "revisit" or size == len(payload))
    url, refers = fields.get("warc-target-uri"), fields.get("warc-refers-to")
    size = size if kind == "revisit" else len(payload)
    return url_key(url), fields["warc-date"], _page_of(fields["warc-record-id"]), url, kind, _page_of(refers) if refers else None, size, own, intact, file, offset, length


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Index entries of the archives in ``manifest``: each archive's are one run, ``seq`` is an entry's place in it."""
    spark = manifest.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, home = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                with store.open_input_stream(f"{home}/{file}", compression=None) as stream:
                    entries = [e for at, size, raw in members(stream) if (e := entry(*parse_record(raw), file, at, size))]
                entries.sort(key=lambda e: _order(*e[:3], *e[9:11]))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*entries, strict=True), _ENTRY.values(), strict=True)] if entries else []
                if columns:
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(range(len(entries)), pa.int64())], names=[*_ENTRY, "seq"])

    files = manifest.count()
    width = max(1, min(files, 8 * spark.sparkContext.defaultParallelism) if files < 4096 else files // 64)
    return stash(manifest.select("file").repartition(width).mapInArrow(run, f"{_ENTRY_SQL}, seq long"), "runs")


class LoserTree:
    """Merges sorted series: ``pop`` gives the series of the least head and moves it on.

    An inner node holds the loser of the match below it, so that a series that
    moves on plays only the losers on its way to the root.
    """

    def __init__(self, heads: list[tuple | None]):
        self.heads, self.k = heads, len(heads)
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x <= y)

    def replace(self, head: tuple | None) -> None:
        """Give the winning series its next head (None: it has ended) and play again."""
        own = self.winner
        self.heads[own] = head
        node = (own + self.k) // 2
        while node:
            if self._before(self.losers[node], own):
                own, self.losers[node] = self.losers[node], own
            node //= 2
        self.winner = own


def merge_order(starts: list[int], ends: list[int], keys: list[tuple]) -> list[int]:
    """Places of ``keys`` in ascending order, where each (start, end) is sorted in itself."""
    at = list(starts)
    tree, out = LoserTree([keys[s] for s in starts]), []
    for _ in range(len(keys)):
        run = tree.winner
        out.append(at[run])
        at[run] += 1
        tree.replace(keys[at[run]] if at[run] < ends[run] else None)
    return out


def merge_runs(entries: DataFrame, rows_a_range: int = 500_000) -> DataFrame:
    """``entries`` in capture histories: with ``range`` (their order is global), ``place`` within it, and ``capture_no`` within the URL key, from 1."""
    spark = entries.sparkSession
    prepare(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // rows_a_range))
    ranged = entries.repartitionByRange(ranges, F.asc("url_key"), F.asc("time"), F.asc_nulls_last("page_id"), F.asc("file"), F.asc("offset")).sortWithinPartitions("file", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        columns = [whole.column(c).to_pylist() for c in ("url_key", "time", "page_id", "file", "offset")]
        keys, files = [_order(*row) for row in zip(*columns, strict=True)], columns[3]
        starts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
        order = merge_order(starts, [*starts[1:], len(files)], keys)
        numbers, last, n = [], None, 0
        for i in order:
            n = n + 1 if keys[i][0] == last else 1
            last = keys[i][0]
            numbers.append(n)
        merged = whole.drop_columns(["seq"]).take(pa.array(order))
        merged = merged.append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from merged.append_column("place", pa.array(range(len(order)), pa.int64())).append_column("nth", pa.array(numbers, pa.int64())).to_batches(max_chunksize=10_000)

    merged = stash(ranged.mapInArrow(run, f"{_ENTRY_SQL}, range int, place long, nth long"), "histories")
    edges = merged.groupBy("range").agg(F.min("url_key").alias("low"), F.max(F.struct("url_key", "nth")).alias("top")).orderBy("range").collect()
    before, last, count = [], None, 0
    for edge in edges:
        carried = count if edge.low == last else 0
        if carried:
            before.append((edge.range, edge.low, carried))
        count = edge.top.nth + (carried if edge.top.url_key == edge.low else 0)
        last = edge.top.url_key
    carry = spark.createDataFrame(before, "range int, url_key string, before long")
    numbered = merged.join(F.broadcast(carry), ["range", "url_key"], "left")
    return numbered.withColumn("capture_no", F.col("nth") + F.coalesce("before", F.lit(0))).drop("nth", "before")


def captures_of(pages: DataFrame, id_col: str, url_col: str, payload_col: str, time: Column, min_revisit: int = 100, max_broadcast_rows: int = 1 << 17, large_group: int = 100_000) -> DataFrame:
    """Captures with digest, and for those that repeat a payload of ``min_revisit`` bytes the page that has the response."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), time.cast("string").alias("time"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = base.where(F.octet_length("payload") >= min_revisit).select("digest", "page_id")
    groups = stash(long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null"), "groups")

    def marked(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.select("digest", "first"), "digest", "left")

    if groups.count() <= max_broadcast_rows:
        found = marked(base, F.broadcast(groups))
    else:
        large, small = groups.where(F.col("rows") > large_group), groups.where(F.col("rows") <= large_group)
        of_large = F.broadcast(large.select("digest"))
        found = marked(base.join(of_large, "digest", "left_semi"), F.broadcast(large)).unionByName(marked(base.join(of_large, "digest", "left_anti"), small))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return found.withColumn("revisit", revisit)


def histories(pages: DataFrame, time: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 100, roll_bytes: int = 32 << 20, **options) -> DataFrame:
    """Archives of ``pages`` written to the shared folder and read back: the merged index (see ``merge_runs``)."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archives(captures_of(pages, id_col, url_col, payload_col, time, min_revisit, **options), folder, roll_bytes)
    return merge_runs(read_archives(manifest, folder))
