"""Other inputs: corpora with nested metadata, vector shards, question files, study files, configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIERS = ("anchor", "paraphrase", "join", "cross-record", "absent")
TARGET = "struct<table: string, column: string, literal: string, match_mode: string, rowids: array<bigint>, rowids_truncated: boolean>"
QUESTION = f"id string, corpus string, question string, tier string, nil boolean, targets array<{TARGET}>, provenance string, type string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, uuid, text, license, category) of Parquet records whose metadata is nested; ids number uuids in order."""
    raw = spark.read.parquet(path)
    d = raw.select("uuid", "text", "license", F.coalesce("metadata.category", F.lit("")).alias("category"))
    # two-level numbering: offsets of range partitions, so no single task sorts the corpus
    parts = d.repartitionByRange("uuid").sortWithinPartitions("uuid").withColumn("__p", F.spark_partition_id()).persist()
    before = {r["__p"]: r["n"] for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    at, offsets = 0, []
    for p in sorted(before):
        offsets.append((p, at))
        at += before[p]
    o = spark.createDataFrame(offsets or [(0, 0)], "__p int, __o long")
    w = Window.partitionBy("__p").orderBy("uuid")
    return parts.join(F.broadcast(o), "__p").withColumn("id", F.row_number().over(w) + F.col("__o")).select("id", "uuid", "text", "license", "category")


def read_vectors(spark: SparkSession, path: str, source: DataFrame) -> tuple[DataFrame, int]:
    """((id, vec) of the shards' rows whose uuid the source has, how many have none)."""
    v = spark.read.parquet(path).select("uuid", F.col("embedding").cast("array<float>").alias("vec"))
    missed = v.join(source.select("uuid"), "uuid", "left_anti").count()
    return v.join(source.select("uuid", "id"), "uuid").select("id", "vec"), missed


def footer_identity(file: str) -> dict[str, str]:
    """Model and dimension that a shard's Parquet footer names."""
    import pyarrow.parquet as pq

    meta = pq.read_schema(file).metadata or {}
    return {k.decode(): v.decode() for k, v in meta.items() if k.startswith(b"embedding_")}


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON Lines file; headers and lines without a question are left out, an unknown tier is an error."""
    stem = Path(path).stem
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("m"))
    lines = lines.withColumn("line", F.row_number().over(Window.orderBy("m"))).where("trim(value) <> ''")
    q = lines.select("line", F.from_json("value", QUESTION).alias("q")).select("line", "q.*").where("question is not null and coalesce(type, '') <> 'header'")
    ok = F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(F.raise_error(F.concat(F.lit("unknown tier "), F.coalesce("tier", F.lit("null")))))
    ident = F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit(f"{stem}#"), F.col("line"))).otherwise(F.col("id"))
    return q.select(ident.alias("id"), F.coalesce(F.nullif("corpus", F.lit("")), F.lit(stem)).alias("corpus"), "question", ok.alias("tier"), F.coalesce("nil", F.lit(False)).alias("nil"), F.coalesce("targets", F.array().cast(f"array<{TARGET}>")).alias("targets"), "provenance")


def read_sql_questions(spark: SparkSession, path: str, db_ids: list[str] | None = None) -> DataFrame:
    """question_id, db_id, question, evidence, SQL of a JSON array file."""
    q = spark.read.schema("question_id long, db_id string, question string, evidence string, SQL string").json(path, multiLine=True)
    return q.where(F.col("db_id").isin(db_ids)) if db_ids else q


def read_study(spark: SparkSession, path: str, kind: str) -> tuple[dict, DataFrame]:
    """(header, queries) of a study file; raises ValueError if the header is missing, an id repeats, or ranks aren't 1 .. n."""
    with open(path) as f:
        rows = [json.loads(x) for x in f if x.strip()]
    if not rows or rows[0].get("type") != kind:
        raise ValueError(f"the first line isn't a {kind} header")
    ids = [r["query_id"] for r in rows[1:]]
    if len(ids) != len(set(ids)):
        raise ValueError("a query id repeats")
    for r in rows[1:]:
        ranks = [c["rank"] for c in r.get("candidates", []) if "rank" in c]
        if ranks and sorted(ranks) != list(range(1, len(ranks) + 1)):
            raise ValueError(f"ranks of {r['query_id']} aren't 1 .. n")
    return rows[0], spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows[1:]]))


def load_config(start: str) -> dict:
    """The nearest config.json at or above start; its relative paths are taken from its own folder."""
    for folder in [Path(start).resolve(), *Path(start).resolve().parents]:
        file = folder / "config.json"
        if file.is_file():
            conf = json.loads(file.read_text())
            return {k: str(folder / v) if isinstance(v, str) and (k.endswith("path") or k.endswith("dir")) and not Path(v).is_absolute() else v for k, v in conf.items()}
    return {}
