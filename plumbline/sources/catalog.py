"""A read-only source database: named tables with declared keys, and what can be read off them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import fnv1a, norm


@dataclass(frozen=True)
class Table:
    """A table's declared keys; Parquet carries none. rowid: an SQL expression for the row's identity."""

    name: str
    rowid: str
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, table, column)


@dataclass
class SourceCatalog:
    spark: SparkSession
    root: str
    tables: dict[str, Table] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def names(self) -> list[str]:
        return sorted(self.tables)

    def text_columns(self, name: str) -> list[str]:
        return [f.name for f in self.frame(name).schema.fields if isinstance(f.dataType, T.StringType)]

    def integer_columns(self, name: str) -> list[str]:
        return [f.name for f in self.frame(name).schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for the SQL console."""
        for name in self.names():
            self.frame(name).createOrReplaceTempView(prefix + name)
        return self.names()

    def schema(self) -> DataFrame:
        """(src_table, src_column, type, is_pk, fk) of every column."""
        rows = []
        for name in self.names():
            t = self.tables[name]
            fks = {c: f"{rt}.{rc}" for c, rt, rc in t.foreign_keys}
            rows += [(name, f.name, f.dataType.simpleString(), f.name in t.primary_key, fks.get(f.name)) for f in self.frame(name).schema.fields]
        return self.spark.createDataFrame(rows, "src_table string, src_column string, type string, is_pk boolean, fk string")

    def rowid(self, name: str) -> Column:
        return F.expr(self.tables[name].rowid).cast("long")

    def fingerprints(self) -> DataFrame:
        """(artifact, fingerprint 'count:max:sum of rowids') of every table: what a refresh compares."""
        out = None
        for name in self.names():
            r = self.rowid(name)
            one = self.frame(name).agg(F.concat_ws(":", F.count("*"), F.coalesce(F.max(r), F.lit(0)), F.coalesce(F.sum(r), F.lit(0))).alias("fingerprint"))
            one = one.select(F.lit(name).alias("artifact"), "fingerprint")
            out = one if out is None else out.unionByName(one)
        return out

    def corpus_fingerprint(self) -> str:
        rows = sorted((r.artifact, r.fingerprint) for r in self.fingerprints().collect())
        return fnv1a(";".join(f"{a}={f}" for a, f in rows))

    def lexical_values(self, names: list[str] | None = None) -> DataFrame:
        """(src_table, src_column, src_rowid, value, value_norm): every non-blank text cell of the tables."""
        out = None
        for name in names or self.names():
            cols = self.text_columns(name)
            if cols:
                one = unpivot_text(self.frame(name).withColumn("__rowid", self.rowid(name)), name, "__rowid", cols)
                out = one if out is None else out.unionByName(one)
        return out


def unpivot_text(df: DataFrame, table: str, rowid: str, columns: list[str]) -> DataFrame:
    """A table's text cells as rows; blank cells are left out."""
    tall = df.select(rowid, *columns).unpivot([rowid], columns, "src_column", "value").where("value is not null and trim(value) <> ''")
    return tall.select(F.lit(table).alias("src_table"), "src_column", F.col(rowid).alias("src_rowid"), "value", norm(F.col("value")).alias("value_norm"))


TPCH = {
    t.name: t
    for t in [
        Table("region", "r_regionkey", ("r_regionkey",)),
        Table("nation", "n_nationkey", ("n_nationkey",), (("n_regionkey", "region", "r_regionkey"),)),
        Table("customer", "c_custkey", ("c_custkey",), (("c_nationkey", "nation", "n_nationkey"),)),
        Table("supplier", "s_suppkey", ("s_suppkey",), (("s_nationkey", "nation", "n_nationkey"),)),
        Table("part", "p_partkey", ("p_partkey",)),
        Table("orders", "o_orderkey", ("o_orderkey",), (("o_custkey", "customer", "c_custkey"),)),
        Table("lineitem", "l_orderkey", (), (("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey"))),
        Table("events", "event_id", ("event_id",), (("user_id", "customer", "c_custkey"),)),
        Table("documents", "doc_id", ("doc_id",)),
        Table("embeddings", "vec_id", ("vec_id",)),
        Table("pages", "page_id", ("page_id",)),
        Table("benchmark", "item_id", ("item_id",)),
        Table("labels", "doc_id", ("doc_id",), (("doc_id", "documents", "doc_id"),)),
        Table("conversations", "conv_id * 1000 + turn", ("conv_id", "turn")),
    ]
}


def test_tables(spark: SparkSession, root: str) -> SourceCatalog:
    """The synthetic tables with their declared keys."""
    return SourceCatalog(spark, root, TPCH)
