"""Structural joins over a node table, as windows in document order.

The nodes of a document are nested intervals (pre, post), so what lies around a node
can be told from the nodes before it, and no pair of nodes needs to be listed: a
document costs one sort, and the plan one shuffle by document.

* A node has an ancestor among some nodes if the largest post of those before it
  lies behind it.
* It has a descendant among some nodes if the next of those lies before its post.
* Its nearest ancestor among some nodes is the last one opened at the level of nesting
  (of these nodes alone) at which it stands.

Nulls in the id columns are equal to each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _events(rows: DataFrame, keys: list[str], at: str, rank: int, *values: Column) -> DataFrame:
    return rows.select(*keys, F.col(at).alias("_at"), F.lit(rank).alias("_rank"), *values)


def _nothing(df: DataFrame) -> Column:
    return F.lit(None).cast(df.select(F.struct("*").alias("r")).schema["r"].dataType)


def with_ancestor(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` that have an ancestor in ``among`` with equal ``keys``; both have pre, ``among`` has post."""
    own = _events(rows, keys, "pre", 0, F.struct("*").alias("_row"), F.lit(None).cast("int").alias("_post"))
    other = _events(among, keys, "pre", 1, _nothing(rows).alias("_row"), F.col("post").alias("_post"))
    before = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    reach = own.unionByName(other).withColumn("_reach", F.max("_post").over(before))
    return reach.where("_row is not null and _reach > _at").select("_row.*")


def with_descendant(rows: DataFrame, among: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (pre, post) that have a descendant in ``among`` with equal ``keys``."""
    own = _events(rows, keys, "pre", 1, F.struct("*").alias("_row"), F.lit(None).cast("int").alias("_other"))
    other = _events(among, keys, "pre", 0, _nothing(rows).alias("_row"), F.col("pre").alias("_other"))
    after = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(1, Window.unboundedFollowing)
    following = own.unionByName(other).withColumn("_next", F.min("_other").over(after))
    return following.where("_row is not null and _next < _row.post").select("_row.*")


def nearest_ancestor(rows: DataFrame, among: DataFrame, keys: list[str], value: str, or_self: bool = False) -> DataFrame:
    """``rows`` with ``value`` of the nearest ancestor (or the row itself) in ``among`` (pre, post, value); null if there is none."""
    held = rows.drop(value)
    none = _nothing(held)
    no_value = F.lit(None).cast(among.select(F.struct(value).alias("v")).schema["v"].dataType)
    opened = _events(among, keys, "pre", 1 if or_self else 2, none.alias("_row"), F.struct(value).alias("_value"), F.lit(1).alias("_step"))
    closed = _events(among, keys, "post", 0, none.alias("_row"), no_value.alias("_value"), F.lit(-1).alias("_step"))
    own = _events(held, keys, "pre", 2 if or_self else 1, F.struct("*").alias("_row"), no_value.alias("_value"), F.lit(0).alias("_step"))
    order = Window.partitionBy(*keys).orderBy("_at", "_rank")
    levelled = opened.unionByName(closed).unionByName(own).withColumn("_level", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = Window.partitionBy(*keys, "_level").orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    found = levelled.where("_step >= 0").withColumn("_near", F.last("_value", ignorenulls=True).over(same))
    return found.where("_row is not null").select("_row.*", F.col(f"_near.{value}").alias(value))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], prefix: str = "") -> Column:
    """Null-safe equality of the keys of two tables."""
    return reduce(Column.__and__, [a[k].eqNullSafe(b[prefix + k]) for k in keys])


def text_within(rows: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pre, text): the texts (pre, text) under each row (pre, post) in order, cut out of the document's whole text."""
    size = F.length("text").cast("long")
    zero = F.lit(0).cast("long")
    own = _events(rows, keys, "pre", 0, F.col("pre").alias("_pre"), zero.alias("_size"))
    end = _events(rows, keys, "post", 0, F.col("pre").alias("_pre"), zero.alias("_size"))
    parts = _events(texts, keys, "pre", 1, F.lit(None).cast("int").alias("_pre"), size.alias("_size"))
    order = Window.partitionBy(*keys).orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    offsets = own.unionByName(end).unionByName(parts).withColumn("_offset", F.sum("_size").over(order)).where("_pre is not null")
    spans = offsets.groupBy(*keys, "_pre").agg(F.min("_offset").alias("_from"), F.max("_offset").alias("_to"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), "")
    whole = texts.groupBy(*keys).agg(listed.alias("_whole")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = spans.join(whole, same_keys(spans, whole, keys, "_k_"), "left")
    cut = F.expr("substring(_whole, cast(_from + 1 as int), cast(_to - _from as int))")
    return joined.select(*keys, F.col("_pre").alias("pre"), F.coalesce(cut, F.lit("")).alias("text"))
