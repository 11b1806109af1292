"""Animation timing as column expressions: phases, progress, easing, keyframes.

Time is data: a row of ``animations`` meets rows of times by a join, and nothing
reads a clock.  Keyframes meet times by one join with the sorted frames of each
animation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_time(local: Column, delay: Column, duration: Column, iterations: Column, fill: Column) -> Column:
    """Time since the end of the delay where the effect is in play or filled, else null."""
    active = duration * iterations
    before, after = local < delay, local >= delay + active
    back, forward = fill.isin("backwards", "both"), fill.isin("forwards", "both")
    return F.when(before, F.when(back, F.lit(0.0))).when(after, F.when(forward, active)).otherwise(local - delay)


def phase(local: Column, delay: Column, duration: Column, iterations: Column) -> Column:
    return F.when(local < delay, "before").when(local >= delay + duration * iterations, "after").otherwise("active")


def iteration_progress(active: Column, duration: Column, iterations: Column, direction: Column) -> tuple[Column, Column]:
    """(current iteration, directed progress of 0 to 1) of an active time."""
    overall = F.when(duration == 0, iterations).otherwise(active / duration)
    at_end = (overall == iterations) & (F.pmod(overall, F.lit(1.0)) == 0) & (iterations > 0) & (active >= duration * iterations)
    current = F.when(at_end, F.ceil(iterations) - 1).otherwise(F.floor(overall))
    simple = F.when(at_end, F.lit(1.0)).otherwise(overall - F.floor(overall))
    turned = F.when(direction == "reverse", True).when(direction == "alternate", F.pmod(current, F.lit(2)) == 1).when(direction == "alternate-reverse", F.pmod(current, F.lit(2)) == 0).otherwise(False)
    return current, F.when(turned, 1 - simple).otherwise(simple)


def steps(progress: Column, count: int, position: str = "jump-end") -> Column:
    """Step easing of a progress within 0 to 1."""
    jumps = {"jump-start": count, "start": count, "jump-end": count, "end": count, "jump-none": count - 1, "jump-both": count + 1}[position]
    step = F.floor(progress * count) + (1 if position in ("jump-start", "start", "jump-both") else 0)
    return F.least(F.greatest(step, F.lit(0)), F.lit(jumps)) / F.lit(float(jumps))


def sample_keyframes(times: DataFrame, frames: DataFrame, key: list[str], progress: str = "progress") -> DataFrame:
    """``times`` with value: frames (key, offset, value) around the progress, interpolated linearly.

    The frames of a key are one sorted array, so every row of ``times`` whose key has
    frames gives one row, repeated rows included.  Before the first frame and for a null
    progress the first value holds, after the last frame the last.
    """
    listed = frames.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("offset", F.col("value").alias("v")))).alias("_frames"))
    at = F.col(progress)
    under = F.try_element_at(F.filter("_frames", lambda x: x["offset"] <= at), F.lit(-1))
    over = F.try_element_at(F.filter("_frames", lambda x: x["offset"] > at), F.lit(1))
    joined = times.join(listed, key).withColumn("_a", F.coalesce(under, F.element_at("_frames", 1))).withColumn("_b", F.coalesce(over, "_a"))
    span = F.col("_b.offset") - F.col("_a.offset")
    share = F.when(span == 0, 0.0).otherwise((at - F.col("_a.offset")) / span)
    value = F.col("_a.v") + F.when(at < F.col("_a.offset"), 0.0).otherwise(F.coalesce(share, F.lit(0.0))) * (F.col("_b.v") - F.col("_a.v"))
    return joined.select(*times.columns, value.alias("value"))
