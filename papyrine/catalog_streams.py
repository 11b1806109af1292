"""Queries of event parsers over many micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_formats import run_stream
from .operators import csv_table
from .runtime import scratch, stash
from .sources import split_csv
from .streaming import events, transitions


def cut_stream(texts: DataFrame, size: int, files: int = 3) -> DataFrame:
    """``texts`` (stream_id, text) as a stream of chunks of ``size`` bytes: shuffled over files that come one a batch, every fifth chunk twice."""
    raw = F.col("text").cast("binary")
    last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / size)
    parts = texts.select("stream_id", raw.alias("raw"), last.alias("end"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("seq"))
    data = F.substring("raw", (F.col("seq") * size + 1).cast("int"), F.lit(size))
    once = parts.select("stream_id", "seq", data.alias("data"), (F.col("seq") == F.col("end")).alias("last"))
    again = once.where("seq % 5 = 0").withColumn("turn", F.lit(1))
    both = once.withColumn("turn", F.lit(0)).unionByName(again).repartition(files, F.xxhash64("stream_id", "seq", "turn"))
    kept = stash(both.drop("turn"), "chunks")
    return kept.sparkSession.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(kept._stashed_at)


def user_arrays(spark: SparkSession, sf_dir: str, ending: Column) -> DataFrame:
    """One JSON array of the props of all events for each user."""
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("all"))
    return found.select(F.col("user_id").cast("string").alias("stream_id"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["props"]), ", "), ending).alias("text"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS stream_id, count(*) AS n_objects, CAST(sum(CAST(json_extract(props, '/k') AS BIGINT)) AS BIGINT) AS sum_k,
       CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 END AS n_records, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS n_errors,
       3 * count(*) + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 2 END AS last_idx FROM events GROUP BY user_id
""")
def stream_json_events(spark, sf_dir):
    """JSON events of texts whose chunks come late, shuffled and twice over several micro-batches; every seventh text is cut short."""
    texts = user_arrays(spark, sf_dir, F.when(F.col("user_id") % 7 == 0, F.lit(" ")).otherwise(F.lit("]")))
    found = run_stream(events.parse_events(cut_stream(texts, 61), "json"), "json_events", "append")
    number = (F.col("event") == "number") & (F.col("key") == "k")
    return found.groupBy("stream_id").agg(
        F.count_if(F.col("event") == "begin_object").alias("n_objects"), F.sum(F.when(number, F.col("value").cast("long"))).alias("sum_k"),
        F.count_if(F.col("event") == "end_record").cast("int").alias("n_records"), F.count_if(F.col("event") == "error").cast("int").alias("n_errors"), F.max("event_idx").alias("last_idx"),
    )


@query("""
SELECT CAST(c_nationkey AS VARCHAR) AS stream_id, count(*) AS n_elements, sha256(string_agg(c_name || '|' || c_mktsegment || ' & <' || c_custkey || '>', chr(10) ORDER BY c_custkey)) AS names FROM customer GROUP BY 1
""")
def stream_xml_events(spark, sf_dir):
    """XML events of one document for each nation, cut at any byte: attributes, references and CDATA come out whole."""
    body = F.concat(F.lit('<c n="'), "c_name", F.lit('">'), F.replace("c_mktsegment", F.lit("&"), F.lit("&amp;")), F.lit(" &amp; <![CDATA[<"), F.col("c_custkey"), F.lit(">]]></c>\r\n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", body.alias("x")))), lambda c: c["x"]), "")
    texts = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("<?xml version='1.0'?><all>"), listed, F.lit("</all>")).alias("text"))
    found = run_stream(events.parse_events(cut_stream(texts.select(F.col("c_nationkey").cast("string").alias("stream_id"), "text"), 97), "xml"), "xml_events", "append")
    inner = found.where("depth >= 1 and event in ('start_element', 'text', 'cdata') and value <> chr(10)")
    piece = F.when(F.col("event") == "start_element", F.concat(F.lit("\n"), F.get_json_object("value", "$.n"), F.lit("|"))).otherwise(F.col("value"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_idx", piece.alias("x")))), lambda e: e["x"]), "")
    return inner.groupBy("stream_id").agg(F.count_if(F.col("event") == "start_element").alias("n_elements"), F.sha2(F.substring(whole, 2, 1 << 30), 256).alias("names"))


@query("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT n AS row_idx, CAST(o_orderkey AS VARCHAR) AS key, 'said "' || o_orderstatus || '",' || chr(10) || chr(10) || o_orderpriority AS note, repeat('wide' || chr(10), CAST(o_custkey % 9 AS INTEGER)) AS pad FROM o
""")
def csv_read_by_splits(spark, sf_dir):
    """One CSV file of all orders with quotes and line breaks inside its fields, read by many tasks, rows in their order."""
    note = F.concat(F.lit('said "'), "o_orderstatus", F.lit('",\n\n'), "o_orderpriority")
    pad = F.repeat(F.lit("wide\n"), (F.col("o_custkey") % 9).cast("int"))
    text = table(spark, sf_dir, "orders").select("o_orderkey", csv_table.record(F.array(F.col("o_orderkey").cast("string"), note, pad)).alias("value"))
    home = scratch(spark, "orders_csv")
    text.orderBy("o_orderkey").select("value").coalesce(1).write.option("lineSep", "\n").text(home)
    small = spark.newSession()  # splits of 256 KB, so that a small file has many
    small.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    rows = split_csv.read_split_csv(small, home)
    return rows.select("row_idx", F.col("fields")[0].alias("key"), F.col("fields")[1].alias("note"), F.col("fields")[2].alias("pad"))


@query("""
WITH e AS (SELECT user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
x AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY n) AS after FROM e)
SELECT CAST(user_id AS VARCHAR) AS element, count_if(n > 1) AS n_run, count_if(n > 1 AND after >= t + 3600000) AS n_end, count_if(n > 1 AND after < t + 3600000) AS n_cancel FROM x GROUP BY user_id
""")
def stream_transitions(spark, sf_dir):
    """Every event of a user sets a new value that takes an hour to reach: transitions that end, and those the next event cancels, over several batches out of order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("element"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at")
    )
    ticks = rows.select("*", F.lit("set").alias("kind"), F.lit("x").alias("prop"), F.col("seq").cast("double").alias("value"), F.lit(3_600_000.0).alias("duration"), F.lit(0.0).alias("delay"))
    kept = stash(ticks.repartition(3, F.xxhash64("element", "seq")), "ticks")
    stream = spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 1).parquet(kept._stashed_at)
    found = run_stream(transitions.run_elements(stream), "transitions", "append")
    of = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy("element").agg(of("run").alias("n_run"), of("end").alias("n_end"), of("cancel").alias("n_cancel"))
