"""Corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  ``run`` writes each stage but the last to the
shared folder and reads it again as the next one's docs.

Defined results of every stage: a null or empty text is a document like others (it
has a score, no line to drop, no shingle, one piece with the end token); a null
or repeated id makes no document special but where the near duplicates say so;
repeated rows are documents of their own until near_duplicates, which keeps one;
ties there go to the smallest id, then the smallest hash of the text; an empty
table gives an empty result; whole texts count, however long; columns beside
those of ``documents`` are kept by all stages but the last, whatever their names.

SQL cannot express the trained classifier or the tokenizer, so there is no
ORACLE_SQL; tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import decontamination, jaccard_join, line_dedup, packing, quality
from papyrine.runtime import drop, stash

#: A document is rejected if the quality classifier gives it less than this.
KEEP_SCORE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (n-gram logistic regression by FTRL) does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    score = "_quality"
    while score in docs.columns:
        score += "_"
    return quality.score(docs, model, score_col=score).where(F.col(score) >= KEEP_SCORE).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines (40 code points or more) that 5 documents hold, but for one keeper of each line."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by 5-word shingles at a Jaccard similarity of 0.8.

    Every row is a document of its own: rows that repeat an id or have none are
    compared like others (a null id counts as larger than any), and those that
    link with nothing stay.
    """
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        found = jaccard_join.link_components(docs.select("doc_id", "text"), k=5, num=80, den=100)
        dropped = found.where("component_id <> doc_id").select("doc_id")
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    # numbered in storage, so that every later pass sees the same numbers
    rows = stash(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = jaccard_join.link_components(rows.select("row", "doc.text"), k=5, num=80, den=100, id_col="row")
    of = rows.select("row", "doc.doc_id", F.xxhash64("doc.text").alias("at")).join(found.select(F.col("doc_id").alias("row"), "component_id"), "row")
    keeper = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "at", "row"))["row"]
    kept = of.groupBy("component_id").agg(keeper.alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 0.8 of its 5-word shingles."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.drop_leaking(docs, items).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents left, with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = stash(stage(spark, docs, sf_dir), name), docs
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
