"""WARC archives: exact round trip, revisits, merged histories."""

import gzip
import io
import random
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrine.llm import queries, sql, warc

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no", "intact"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6).map(sorted), max_size=9))
def test_loser_tree_merges_sorted_runs(runs):
    runs = [r for r in runs if r]
    keys = [(x,) for r in runs for x in r]
    ends = [sum(map(len, runs[: i + 1])) for i in range(len(runs))]
    order = warc.merge_order([e - len(r) for e, r in zip(ends, runs, strict=True)], ends, keys) if runs else []
    assert sorted(order) == list(range(len(keys))) and [keys[i] for i in order] == sorted(keys)


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com/a?b=2&a=1#top", "com,example)/a?a=1&b=2"), ("https://u:p@x.org:8080", "org,x)/"), ("mailto:a@b", "mailto:a@b"), (None, ""), ("ftp://h/?", "h)/"), ("http://h?q", "h)/?q"),
])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.text(max_size=20), st.booleans())
def test_records_round_trip(payload, url, revisit):
    digest = sha256(payload).hexdigest()
    raw = warc.capture(7, url, None, payload, digest, revisit, 3)
    got = warc.entry(*warc.parse_record(raw), "f", 0, len(raw))
    assert got[2] == 7 and got[5:9] == (3 if revisit else None, len(payload), digest, True)
    assert got[4] == ("revisit" if revisit else "response") and got[1] == "1970-01-01T00:00:00Z"


def test_members_of_any_size_and_damage():
    parts = [b"", b"x" * 3_000_000, random.Random(1).randbytes(2_500_000), b"tail"]
    data = b"".join(map(gzip.compress, parts))
    found = list(warc.members(io.BytesIO(data)))
    assert [c for _, _, c in found] == parts and all(gzip.decompress(data[a : a + n]) == c for a, n, c in found)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    fields, block = warc.parse_record(warc.capture(1, "http://a/", None, b"payload", "0" * 64, False, None))
    assert warc.entry(fields, block, "f", 0, 1)[8] is False


def plain(rows):
    """Result rows but for capture_no, by a loop over all rows."""
    first = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            first[payload] = min(page, first.get(payload, page))
    out = []
    for page, url, html in rows:
        payload = (html or "").encode()
        leads = first.get(payload)
        again = leads is not None and page != leads
        out.append((page, len(payload), sha256(payload).hexdigest(), "revisit" if again else "response", leads if again else None, warc.url_key(url and warc.field_text(url)), True))
    return out


def _rows():
    same, other = "<p>hot</p>" * 20, "é" * 50
    rows = [(i, f"http://www.hot.example/?b={i % 2}&a=1#f{i}", same if i % 3 else f"<b>{i}</b>" * 30) for i in range(400)]
    rows += [(1000 + i, u, h) for i, (u, h) in enumerate([(None, None), ("", ""), ("no url", "x" * 99), ("no url", "x" * 99), ("http://a.b/\r\nX: y", other), ("http://a.b/", other), ("http://a.b", "WARC/1.1\r\n\r\n\r\n" * 20)])]
    rows += [(None, "http://n/", same), (None, "http://n/", "only null ids" * 10), (None, "http://n/", "only null ids" * 10), (5, "http://twice/", "t" * 200), (5, "http://twice/", "t" * 200)]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"max_broadcast_rows": 0, "large_group": 50}, {"max_broadcast_rows": 0, "large_group": 1}])
def test_histories_equal_plain_rows(spark, bounds):
    frame = spark.createDataFrame([(*r, "x") for r in _rows()], "page_id long, url string, html string, digest string").repartition(5)
    time = F.when(F.col("page_id") % 2 == 0, F.lit("2001-02-03T04:05:06Z"))
    got = warc.histories(frame, time, roll_bytes=4000, **bounds).collect()
    assert sorted([tuple(r[c] for c in COLUMNS if c != "capture_no") for r in got], key=repr) == sorted(plain(_rows()), key=repr)
    # the order by (range, place) is the global order, and histories are numbered through
    order = sorted(got, key=lambda r: (r.range, r.place))
    keys = [(r.url_key, r.time, r.page_id is None, r.page_id or 0) for r in order]
    assert keys == sorted(keys) and len({r.range for r in got}) > 1 and len({r.file for r in got}) > 5
    seen = defaultdict(list)
    for r in order:
        seen[r.url_key].append(r.capture_no)
    assert all(v == list(range(1, len(v) + 1)) for v in seen.values())
    assert max(Counter(r.url_key for r in got).values()) > 100


def test_query_equals_sql(spark, tmp_path):
    rows = [r for r in {x[0]: x for x in _rows() if x[0] is not None}.values() if r[0] != 1004]
    rows += [(None, "http://a.b/", "no id"), (-7, "http://a.b/", "early"), (1 << 62, "http://a.b/", "late")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op11_warc(spark, str(tmp_path))
    assert got.columns == COLUMNS
    pages = duckdb.connect()
    pages.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = pages.execute(sql.ORACLE_SQL["op11_warc"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.histories(empty, F.lit(None)).count() == 0
