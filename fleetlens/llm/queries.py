"""Queries of the corpus operators over the given tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import (
    bpe, lexical_search, minhash_dedup, mixing, quality_classifier, quality_rules, secret_scan, sharding, spelling_variants,
    substring_dedup, suffix_dedup, topk_search, toxicity,
)
from fleetlens.llm.common import stage, table


def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_threshold_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stage(topk_search.levels(table(spark, folder, "embeddings")), "levels")
    return topk_search.exact_top_k(vectors, vectors.filter("id % 50 = 0"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeats_report(table(spark, folder, "documents"))


def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trips(table(spark, folder, "documents"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeats_report(table(spark, folder, "documents"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op10_sampled_splitters(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.shard_by_splitters(table(spark, folder, "documents"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_bag_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, folder, "documents"))


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_threshold_top_k": op2_threshold_top_k,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_source_mix": op9_source_mix,
    "op10_sampled_splitters": op10_sampled_splitters,
    "op11_bag_search": op11_bag_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}
TWINS = {
    "op1_minhash_dedup": minhash_dedup.SQL,
    "op2_threshold_top_k": topk_search.SQL,
    "op3_quality_rules": quality_rules.SQL,
    "op8_substring_dedup": substring_dedup.SQL,
    "op9_source_mix": mixing.SQL,
    "op10_sampled_splitters": sharding.SQL,
    "op11_bag_search": lexical_search.SQL,
    "op12_spelling_variants": spelling_variants.SQL,
}
