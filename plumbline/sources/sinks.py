"""Writers of derived tables: partition replacement, ledgers, upserts, logs, feedback, checkpoints, reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the folder that all executors share.

    The folder is spark.checkpoint.dir; a temporary one serves in local mode only. What is settled may be read by
    many later plans, which stay small, and survives lost executors.
    """
    sc, spark = df.sparkSession.sparkContext, df.sparkSession
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint(eager=True)


class Store:
    """Derived tables under one root, a folder each; source tables are never written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        self._recover(table)
        try:
            return self.spark.read.parquet(self.path(table))
        except Exception as e:
            if schema is None or "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def replace_partitions(self, df: DataFrame, table: str, names: list[str] | None = None, by: str = "src_table") -> None:
        """Only the partitions that df has rows for are replaced; those of names that it has none for are dropped."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(table))
        if names:
            here = {r[0] for r in df.select(by).distinct().collect()}  # a row a table
            self.drop_partitions(table, [x for x in names if x not in here], by)

    def drop_partitions(self, table: str, names: list[str], by: str = "src_table") -> None:
        for x in names:
            folder = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(by, x)
            self._fs(table).delete(self._p(f"{self.path(table)}/{folder}"), True)
        self.spark.catalog.refreshByPath(self.path(table))

    def overwrite(self, df: DataFrame, table: str) -> None:
        """An unpartitioned table as a whole, which df may read: written beside it and then put in its place by renames.

        A reader that comes between the renames, or after a failure there, takes the old table back.
        """
        new, old, at = (self._p(self.path(table) + x) for x in (".new", ".old", ""))
        self._recover(table)
        df.write.mode("overwrite").parquet(self.path(table) + ".new")
        fs = self._fs(table)
        fs.delete(old, True)
        if fs.exists(at):
            fs.rename(at, old)
        fs.rename(new, at)
        fs.delete(old, True)
        self.spark.catalog.refreshByPath(self.path(table))

    def _p(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, table: str):
        return self._p(self.path(table)).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _recover(self, table: str) -> None:
        fs, at, old = self._fs(table), self._p(self.path(table)), self._p(self.path(table) + ".old")
        if not fs.exists(at) and fs.exists(old):
            fs.rename(old, at)

    def append(self, df: DataFrame, table: str) -> None:
        df.write.mode("append").parquet(self.path(table))

    def upsert(self, df: DataFrame, table: str, keys: list[str]) -> None:
        old = self.read(table, df.schema.simpleString()[7:-1].replace(":", " ")) if self._missing(table) else self.read(table)
        self.overwrite(old.join(df.select(*keys), keys, "left_anti").unionByName(df), table)

    def delete(self, table: str, keys: DataFrame) -> None:
        self.overwrite(self.read(table).join(keys, keys.columns, "left_anti"), table)

    def _missing(self, table: str) -> bool:
        self._recover(table)
        return not self._fs(table).exists(self._p(self.path(table)))


RECEIPT = "artifact string, fingerprint string, version string"


def dirty(now: DataFrame, receipts: DataFrame, version: str) -> DataFrame:
    """(artifact, change): tables that are new, changed, derived by another version, or dropped."""
    r = receipts.select("artifact", F.col("fingerprint").alias("old"), "version")
    j = now.join(r, "artifact", "full")
    change = F.when(F.col("fingerprint").isNull(), "dropped").when(F.col("old").isNull(), "new").when(F.col("old") != F.col("fingerprint"), "changed").when(F.col("version") != version, "version")
    return j.select("artifact", "fingerprint", change.alias("change")).where("change is not null")


def promote_vectors(staging: DataFrame) -> DataFrame:
    """(id, vec) of staged vectors; ValueError unless all have one model, template and dimension."""
    kinds = staging.select("model", "template", F.size("vec").alias("dim")).distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"vectors of several encoders: {kinds}")
    return staging.select("id", "vec")


class Checkpoints:
    """Finished passes of a long evaluation, one file each, written by rename."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def save(self, key: str, value: dict) -> None:
        tmp = self.folder / f".{key}.tmp"
        tmp.write_text(json.dumps(value))
        os.replace(tmp, self.folder / f"{key}.json")

    def load(self, key: str) -> dict | None:
        file = self.folder / f"{key}.json"
        return json.loads(file.read_text()) if file.is_file() else None

    def sweep(self, keep: set[str]) -> None:
        for f in self.folder.glob("*.json"):
            if f.stem not in keep:
                f.unlink()


def write_questions(df: DataFrame, path: str, header: dict) -> None:
    """JSON Lines with a header line first."""
    with open(path, "w") as f:
        f.write(json.dumps({"type": "header"} | header) + "\n")
        for line in df.toJSON().toLocalIterator():
            f.write(line + "\n")


def render_report(template: str, run: dict) -> str:
    """The template with the run's JSON at {{RUN}}, safe inside a script element."""
    return template.replace("{{RUN}}", json.dumps(run).replace("</", "<\\/"))


FEEDBACK = {"correct", "wrong_candidate", "missing_candidate", "wrong_span", "ambiguous"}


def check_feedback(log: dict, feedback: dict) -> None:
    """ValueError if a feedback doesn't fit its logged episode."""
    if feedback.get("category") not in FEEDBACK:
        raise ValueError("unknown category")
    if feedback.get("revision") != log.get("revision"):
        raise ValueError("the corpus has changed since")
    if feedback["category"] == "correct" and feedback.get("preferred") is not None:
        raise ValueError("correct excludes a preferred candidate")
    shown = log.get("presented", [])
    if feedback.get("preferred") is not None and feedback["preferred"] not in shown:
        raise ValueError("the preferred candidate wasn't presented")
