"""Queries that apply the corpus operators to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, html_main, jaccard_join, langid, line_dedup, packing, periodic_runs, quality, sharding, token_alignment, toxicity, warc
from .samples import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, up to 4096 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in doc_id order dealt to 24 contiguous shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    thin = sharding.text_crc32(docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text_crc32").cast("long").alias("text_crc32"), (F.col("bytes") + 8).alias("size")
    )
    dealt = sharding.shard_sized(thin, 24, order_by=["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _scored(df: DataFrame, folds: int, held_fold: int) -> DataFrame:
    return df.select(
        "doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model), 4, 2)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's consensus path."""
    return html_main.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of the kept lines of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model), 3, 1)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.link_components(docs, k=4, num=85, den=100)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.knn(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id) where at least 0.8 of the item's 5-word shingles lie in the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep_clean=False)
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("leak.item_id", "doc_id", "leak.item_shingles", "leak.shared", "leak.containment")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of all pages written to WARC archives with revisits, read back and merged into capture histories.

    ``pages`` has no time of capture: page n counts as taken n seconds after 2000, and one
    without an id, or whose id is beyond a year of four digits, as taken last.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    dated = F.col("page_id").between(-30_000_000_000, 200_000_000_000)
    seconds = F.lit(946_684_800) + F.when(dated, F.col("page_id")).otherwise(0)
    time = F.when(dated, F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("9999-12-31T23:59:59Z")
    found = warc.histories(pages, time)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no", "intact")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two public tokenizers for every document, with corpus counts of id pairs."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth document, by crc32 of its id, repeats a part of its words to its end.

    With h the crc32, g = h div 10 and n words, the words from a = g mod n on repeat
    with period 1 + (n - a) div (3 + g mod 8); such a text's words are joined by one space.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = (g % n).cast("int")
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - a) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, period), turns)), F.lit(1), (n - a).cast("int"))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in the words of every document, its longest run and its text without the repeats."""
    found = periodic_runs.find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")), min_length=6, min_repeats=4)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    return found.withColumn("top", ranked).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), "top.length", (-F.col("top.shorter")).alias("period"),
        F.expr("1000 * top.length div -top.shorter").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_sharding": op2_sharding,
    "op3_quality": op3_quality,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}
