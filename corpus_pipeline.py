"""From raw documents to balanced shards: quality, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, jaccard, mixing, quality_rules, sharding
from plumbline.llm.common import read, stored

#: Old shards are the documents' sources; the last stage rewrites those that change and names each document's new one.
Stage = tuple[str, object]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the log-likelihood ratio rejects go, and with them those whose text is null or has no token.

    Labels without a doc_id, or of documents that aren't there, don't matter; without good labels every document with a token stays.
    """
    return quality_rules.filter_quality(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones stays, that of the least doc_id; of rows that repeat a doc_id one, and all without doc_id."""
    return jaccard.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null items and texts hold nothing."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted fair queue serves within the token budget stay; rows without doc_id go, a null source is one of its own."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its old and new shard, the affected shards rewritten in the shared folder. A null source is the shard ''."""
    return sharding.resharded(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark leaks", benchmark_leaks),
    ("source mix", source_mix),
    ("shards", shards),
]

#: Near-duplicate groups are connected components, which SQL can't give at this size: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder as Parquet before the next reads them.

    Empty tables give no rows. The rows are those of documents that every stage keeps, with their old and new shards.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
