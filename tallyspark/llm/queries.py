"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_classifier as q

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return q.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, per_cent=80)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = q.quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    # labels that speak of pages: what the fixed rules say of those that they cover
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.url_filter(pages, url_filter.rule_labels(pages))
    return out.select("page_id", "host", "path", "rule", "verdict", "mined")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pieces_with_checksums(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "sources", "text")


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tiff

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return tiff.tiff_pages(tiff.texts_as_tiff(docs).drop("text")).select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "compression", "predictor", "tiled",
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer("word_bpe_49k.json")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
