"""The corpus operators as queries over the whole of their tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, jaccard, mixing, pii, quality_classifier, quality_rules, sharding, token_counts, url_filters, warc
from plumbline.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules.scored(docs, quality_rules.trusted_ids(labels)).select("doc_id", "n_features", "score", "keep")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filtered(read(spark, sf_dir, "pages"), url_filters.default_rules(spark))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures_of_pages(read(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_pii")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_queue(read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_url_filters": op2_url_filters,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_warc": op4_warc,
        "op5_pii": op5_pii,
        "op6_mix_sources": op6_mix_sources,
        "op7_token_counts": op7_token_counts,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_decontaminate": op9_decontaminate,
        "op10_reshard": op10_reshard,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op2_url_filters": url_filters.SQL,
        "op6_mix_sources": mixing.SQL,
        "op8_jaccard_join": jaccard.SQL,
        "op9_decontaminate": decontaminate.SQL,
        "op10_reshard": sharding.sql(),
    }
