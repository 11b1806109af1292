"""Rows and cells that must not be lost, bounds that must hold."""

import json

from pyspark.sql import functions as F

from papyrine.functions import columns as C
from papyrine.operators import cascade, timing
from papyrine.sources import text_sources
from papyrine.streaming import chunks


def test_keyframes_keep_repeated_rows(spark):
    times = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("a", None), ("a", 2.0), ("a", -1.0), ("b", 0.1)], "name string, progress double")
    frames = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 10.0)], "name string, offset double, value double")
    found = timing.sample_keyframes(times, frames, ["name"]).collect()
    assert sorted((r.progress is None, r.progress or 0, r.value) for r in found) == [(False, -1.0, 0.0), (False, 0.5, 5.0), (False, 0.5, 5.0), (False, 2.0, 10.0), (True, 0, 0.0)]


def test_csv_header_keeps_surplus_cells_and_repeated_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,a\n1,2,3,4\n5\n")
    rows = text_sources.read_csv(spark, str(tmp_path), header=True).orderBy("row_idx").collect()
    assert [(r.record, r.fields, r.surplus) for r in rows] == [({"a": "1", "b": "2"}, ["1", "2", "3", "4"], ["4"]), ({"a": "5"}, ["5"], [])]


def test_nested_layers(spark):
    _, layers = cascade.compile_sheet("@layer a { @layer b {p{color:red}} p{color:blue} } @layer c {p{color:x}} @layer a.d {p{color:y}}")
    assert layers == ["a.b", "a.d", "a", "c"]


def _stream(spark, tmp_path, rows, **options):
    source = tmp_path / "in"
    source.mkdir()
    for i, batch in enumerate(rows):
        (source / f"{i:03}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "data", "last"), r, strict=True))) for r in batch))
    read = spark.readStream.schema("stream_id string, seq long, data string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    name = f"out_{abs(hash(str(tmp_path)))}"
    done = chunks.parse_chunks(read, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    done.awaitTermination()
    return spark.table(name).collect()


def test_stream_state_is_bounded_on_arrival(spark, tmp_path):
    late = [[("s", i, "x" * 60 + "\n", False)] for i in range(1, 6)] + [[("s", 0, "a\n", False)], [("s", 6, "z\n", True)], [("t", 0, "1,2\n", True)]]
    rows = _stream(spark, tmp_path, late, max_state=100)
    assert [(r.stream_id, r.record, r.error is not None) for r in sorted(rows, key=lambda r: r.stream_id)] == [("s", None, True), ("t", '["1", "2"]', False)]


def test_a_chunk_repeated_after_the_end_is_ignored(spark, tmp_path):
    whole = [("s", 0, "a,b\n", False), ("s", 1, "c", True)]
    rows = _stream(spark, tmp_path, [[whole[0]], [whole[1]], [whole[0]], whole])
    assert sorted((r.record_idx, r.record) for r in rows) == [(0, '["a", "b"]'), (1, '["c"]')]


def test_typed_getters(spark):
    rows = [('{"a": {"b c": [1, "x", {"d": null}]}, "0": 7, "q": 1.5}',), ("not json",), ("[5, 6]",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    found = df.select(
        C.json_get("t", "/a/b c/0", "long").alias("x"), C.json_get("t", "/a/b c/1").alias("y"), C.json_get("t", "/0", "long").alias("z"), C.json_get("t", "/q", "double").alias("w"), C.json_get("t", "/a/b c/2/d").alias("n"), C.json_get("t", "").alias("all")
    )
    assert [tuple(r)[:5] for r in found.collect()] == [(1, "x", 7, 1.5, None), (None,) * 5, (None, None, 5, None, None), (None,) * 5]
    plan = found._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and F.count is not None
