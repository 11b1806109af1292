"""Keyed transitions and animations: what happens, in which order, whatever the batches."""

import random

from papyrine.streaming import transitions
from papyrine.streaming.transitions import Element


def played(rows):
    element, out = Element(), []
    for r in rows:
        out += element.apply(*r)
        element = Element.of(element.state())
    return [(round(at, 6), kind, prop, value if value is None else round(value, 6)) for at, kind, prop, value in out]


def test_a_transition_runs_starts_and_ends():
    rows = [(0, "set", "x", 1.0, 100, 50), (10, "set", "x", 3.0, 100, 50), (60, "tick", None, None, 0, 0), (110, "tick", None, None, 0, 0), (500, "tick", None, None, 0, 0)]
    assert played(rows) == [(10, "run", "x", 1.0), (60, "start", "x", 1.0), (60, "sample", "x", 1.0), (110, "sample", "x", 2.0), (160, "end", "x", 3.0), (500, "sample", "x", 3.0)]


def test_a_change_cancels_and_the_way_back_is_as_short():
    rows = [(0, "set", "x", 0.0, 100, 0), (0, "set", "x", 10.0, 100, 0), (40, "set", "x", 0.0, 100, 0), (60, "tick", None, None, 0, 0), (90, "tick", None, None, 0, 0)]
    assert played(rows) == [(0, "run", "x", 0.0), (0, "start", "x", 0.0), (40, "cancel", "x", 4.0), (40, "run", "x", 4.0), (40, "start", "x", 4.0), (60, "sample", "x", 2.0), (80, "end", "x", 0.0), (90, "sample", "x", 0.0)]


def test_nothing_happens_without_a_change_or_a_duration():
    rows = [(0, "set", "x", 1.0, 100, 0), (5, "set", "x", 1.0, 100, 0), (6, "set", "x", 2.0, 0, 0), (7, "set", "x", 3.0, 10, -20), (8, "tick", None, None, 0, 0)]
    assert played(rows) == [(8, "sample", "x", 3.0)]


def test_events_of_one_moment_keep_the_order_of_their_beginnings():
    rows = [(0, "set", p, 0.0, 0, 0) for p in "ba"] + [(0, "set", "b", 1.0, 50, 0), (0, "set", "a", 1.0, 50, 0), (10, "set", "c", 0.0, 0, 0), (10, "set", "c", 1.0, 40, 0), (99, "tick", None, None, 0, 0)]
    assert [(k, p) for at, k, p, _ in played(rows) if at == 50] == [("end", "b"), ("end", "a"), ("end", "c")]


def test_finished_animations_under_a_finished_one_are_removed():
    rows = [(0, "animate", "x", 1.0, 100, 0), (10, "animate", "x", 2.0, 20, 0), (20, "animate", "x", 3.0, 200, 0), (50, "tick", None, None, 0, 0), (300, "tick", None, None, 0, 0)]
    shown = [r for r in played(rows) if r[1] in ("finish", "remove")]
    assert shown == [(30, "finish", "x", 2.0), (100, "finish", "x", 1.0), (100, "remove", "x", 1.0), (220, "finish", "x", 3.0), (220, "remove", "x", 2.0)]
    assert played(rows)[-1] == (300, "sample", "x", 3.0)


def test_the_same_rows_for_any_batching(spark, tmp_path):
    rng = random.Random(8)
    elements = {}
    for e in ("p", "q"):
        at, rows = 0.0, []
        for _ in range(30):
            at += rng.choice([0, 5, 20, 70])
            rows.append((at, rng.choice(["set", "set", "animate", "tick"]), rng.choice("xy"), float(rng.randrange(3)), rng.choice([0.0, 30.0, 60.0]), rng.choice([0.0, 10.0, -10.0])))
        elements[e] = rows
    schema = "element string, seq long, at double, kind string, prop string, value double, duration double, delay double"
    flat = [(e, i, *r) for e, rows in elements.items() for i, r in enumerate(rows)]
    flat += flat[:7]
    rng.shuffle(flat)
    for i in range(3):
        spark.createDataFrame(flat[i::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = transitions.run_elements(read).writeStream.format("memory").queryName("moved").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()
    got = {e: [(round(r.at, 6), r.kind, r.prop, r.value if r.value is None else round(r.value, 6)) for r in spark.table("moved").where(f"element = '{e}'").orderBy("event_no").collect()] for e in elements}
    assert got == {e: played(rows) for e, rows in elements.items()} and sum(p["numInputRows"] > 0 for p in query.recentProgress) == 3
