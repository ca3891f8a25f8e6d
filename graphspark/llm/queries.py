"""The thin queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, htmlcut, lpf, neardup, packing, quality, severity, substrings, tiff, token_store

from .common import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.encode_documents(table(spark, sf_dir, "documents")).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return tiff.page_digests(tiff.tiff_pages(media, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"]))


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op3_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_passages(documents(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_repair_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_store.store_tokens(table(spark, sf_dir, "documents"))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_previous_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lpf.dedup_bytes(documents(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_ordinal_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


def op9_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = htmlcut.extract_main_text(pages, weights=htmlcut.fit(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_linear_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tiff_pages, op2_rule_cascade, op3_cover_anchors, op4_repair_token_store, op5_previous_factors, op6_superminhash, op7_pack_sequences, op8_ordinal_severity, op9_html_min_cut, op10_linear_bpe)
}

ORACLES: dict[str, str] = {"op2_rule_cascade": quality.ORACLE}
