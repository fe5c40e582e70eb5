"""The query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import audio, html_text, langid, line_dedup, mixing, order_minhash, packing, quality, sharding, simhash
from seamline.llm.common import remove, scratch, table


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.assign_shards(docs, ["doc_id"]).select("doc_id", "slot", "shard_index", "shard")


def op3_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op4_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audio.audio_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(*got.columns[:8], F.sha2("tensors", 256).alias("tensors_sha256"), F.size("spans").alias("n_spans"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    told = pages.withColumns({"declared": langid.declared_in_markup(F.col("html")), "host": langid.host_of(F.col("url"))})
    # The texts are read several times: once to fit and once to score.
    at = scratch(spark, "main-texts")
    html_text.extract(told).drop("html", "n_chars", "url").write.parquet(at)
    out = langid.identify(spark.read.parquet(at), declared="declared", address="host", key="page_id", with_text=False)
    remove(spark, at)
    return out.select("page_id", "host", "declared", "language", "confidence", "accepted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text,
        op2_maglev_sharding,
        op3_line_crf_quality,
        op4_dp_packing,
        op5_line_dedup,
        op6_audio_columns,
        op7_simhash_components,
        op8_order_minhash,
        op9_source_mixing,
        op10_language_id,
    )
}

ORACLES = {
    "op2_maglev_sharding": sharding.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
}
