"""The queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language_id, mixing, near_duplicates, nearest, packing, personal_data, quality, token_counts, url_filter
from .common import spread, table

TOKEN_LIMIT = 512

#: (verdict, host, path), as the contract of op10 gives them.
URL_RULES = [
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
]


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_counts(texts(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few large tasks pack a small table tighter than many small ones
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(texts(spark, sf_dir))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_text.main_text(spread(pages.select("page_id", "url", "html")), html_text.fit(pages), keep=("page_id", "url"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(texts(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *[count(k) for k in personal_data.KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.fit(documents.where(~language_id.held_out()))
    found = language_id.predict(texts(spark, sf_dir), model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_duplicates.near_duplicate_classes(texts(spark, sf_dir))
    return members.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_nearest_neighbours,
        op3_best_fit_packing,
        op4_quality_rules,
        op5_html_extraction,
        op6_personal_data,
        op7_source_mixing,
        op8_language_id,
        op9_ngram_jaccard_join,
        op10_url_filter,
    )
}

ORACLE_SQL: dict[str, str] = {}
