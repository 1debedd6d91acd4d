"""Registered queries of the operators. Each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language, lattice, mixing, neardup, packing, quality, repair, secrets, spelling, sql, topk, urls, warc, wrappers
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@register
def op1_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, folder, "documents")))


@register
def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_text(table(spark, folder, "pages"), "page_id")


@register
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@register
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), RULES, "page_id")


@register
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"), "doc_id").drop("class_distance", "common_distance")


@register
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents")).drop("key")


@register
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@register
def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(table(spark, folder, "pages"))


@register
def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


@register
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@register
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.report(table(spark, folder, "conversations"))


@register
def op13_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.groups(table(spark, folder, "embeddings"))


ORACLES = {
    "op4_url_filters": sql.urls(RULES),
    "op5_quality_rules": sql.quality(quality.WORDS),
    "op6_minhash_near_dedup": sql.NEAR_DUPLICATES,
    "op9_warc": sql.ARCHIVE,
    "op10_exact_top_k": sql.TOP_K,
    "op11_spelling_variants": sql.SPELLING,
    "op12_conversation_repair": sql.REPAIR,
    "op13_embedding_near_dedup": sql.NEAR_VECTORS,
}
