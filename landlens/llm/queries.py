"""The registered queries of the operators, each over its whole table, with DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.llm import (
    classifier, hard_negatives, mixing, near_vectors, packing, pii, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity,
    url_lists, whitening,
)
from landlens.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents")).select(*pii.QUERY_COLUMNS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(*quality_rules.QUERY_COLUMNS)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).select(*packing.QUERY_COLUMNS)


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge_captures(url_lists.captures_of(pages), url_lists.entries_of(pages))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(*mixing.QUERY_COLUMNS)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings")).select(*near_vectors.QUERY_COLUMNS)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents")).select(*simhash.QUERY_COLUMNS)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*toxicity.QUERY_COLUMNS)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = hard_negatives.moved_labels(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(moved).select(*hard_negatives.QUERY_COLUMNS)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).select(*whitening.QUERY_COLUMNS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_pii, op3_quality_rules, op4_best_fit_packing, op5_url_lists, op6_suffix_dedup, op7_mixing,
        op8_near_vectors, op9_simhash_dedup, op10_quality_classifier, op11_toxicity, op12_hard_negatives, op13_whitening,
    )
}

ORACLES: dict[str, str] = {"op5_url_lists": url_lists.SQL, "op7_mixing": mixing.SQL, "op12_hard_negatives": hard_negatives.SQL}
