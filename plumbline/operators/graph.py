"""Knowledge graph: schema and value layers, inclusion dependencies, terms, phrases, paths and centrality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.sources.catalog import SourceCatalog

NODE = "key string, kind string, label string, props string"
EDGE = "src string, dst string, kind string, label string, props string"
CONTAINMENT, MOST_DISTINCT = 0.95, 500_000
DAMPING, ROUNDS = 0.85, 40


def schema_layer(cat: SourceCatalog) -> tuple[DataFrame, DataFrame]:
    """Table and column nodes, has_column and fk edges, from the catalog."""
    nodes, edges = [], []
    for t in cat.names():
        nodes.append((f"table:{t}", "table", t, "{}"))
        for f in cat.frame(t).schema.fields:
            nodes.append((f"column:{t}.{f.name}", "column", f.name, "{}"))
            edges.append((f"table:{t}", f"column:{t}.{f.name}", "has_column", "", "{}"))
        for c, rt, rc in cat.tables[t].foreign_keys:
            edges.append((f"table:{t}", f"table:{rt}", "fk", f"{c} → {rc}", "{}"))
    return cat.spark.createDataFrame(nodes, NODE), cat.spark.createDataFrame(edges, EDGE)


def inclusion_dependencies(cat: SourceCatalog, containment: float = CONTAINMENT, most: int = MOST_DISTINCT) -> DataFrame:
    """(ref_table, ref_column, key_table, key_column, distinct, missing, containment) of undeclared references.

    Integer columns that aren't keys against single integer primary keys of other tables, all pairs in one
    join of distinct values; declared pairs are left out, and columns of more than `most` distinct values.
    """
    refs = keys = None
    declared = []
    for t in cat.names():
        tab = cat.tables[t]
        declared += [(f"{t}.{c}", f"{rt}.{rc}") for c, rt, rc in tab.foreign_keys]
        ints = cat.integer_columns(t)
        for c in ints:
            v = cat.frame(t).where(F.col(c).isNotNull()).select(F.lit(f"{t}.{c}").alias("col"), F.col(c).cast("long").alias("v")).distinct()
            if tab.primary_key == (c,):
                keys = v if keys is None else keys.unionByName(v)
            elif c not in tab.primary_key:
                refs = v if refs is None else refs.unionByName(v)
    sizes = refs.groupBy("col").agg(F.count("*").alias("distinct")).where(F.col("distinct") <= most)
    hits = refs.join(keys.select(F.col("col").alias("key"), "v"), "v").groupBy("col", "key").agg(F.count("*").alias("found"))
    out = hits.join(sizes, "col").withColumn("missing", F.col("distinct") - F.col("found")).withColumn("containment", F.round(1 - F.col("missing") / F.col("distinct"), 9))
    known = cat.spark.createDataFrame(declared or [("", "")], "col string, key string")
    out = out.join(F.broadcast(known), ["col", "key"], "left_anti").where(F.substring_index("col", ".", 1) != F.substring_index("key", ".", 1))
    return out.where(F.col("containment") >= containment).select(F.col("col").alias("ref"), "key", "distinct", "missing", "containment")


def frequent_values(lex: DataFrame, most: int = 10) -> DataFrame:
    """The ten most frequent normal forms of each column that occur at least twice."""
    n = lex.groupBy("src_table", "src_column", "value_norm").agg(F.count("*").alias("n")).where("n >= 2")
    w = Window.partitionBy("src_table", "src_column").orderBy(F.desc("n"), "value_norm")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def term_shortlist(docs: DataFrame, text: str, key: str, by_df: int = 4000, by_burst: int = 200) -> DataFrame:
    """Terms of middling document frequency, by burstiness (cf / df)(1 + ln df). docs: key, text."""
    total = docs.count()
    t = docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count_distinct(key).alias("df"), F.count("*").alias("cf"))
    t = t.where((F.length("term") >= 4) & (F.col("df") >= 5) & (F.col("df") <= math.ceil(0.25 * total)) & ~F.col("term").rlike("[0-9]"))
    t = t.orderBy(F.desc("df"), "term").limit(by_df)
    return t.withColumn("burst", F.round(F.col("cf") / F.col("df") * (1 + F.log("df")), 9)).orderBy(F.desc("burst"), "term").limit(by_burst)


def cooccurrence(docs: DataFrame, text: str, key: str, terms: DataFrame) -> DataFrame:
    """(a, b, both, df_a, df_b, ratio): documents that hold both terms. The term list is bounded, so it is broadcast."""
    t = docs.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).join(F.broadcast(terms.select("term")), "term", "left_semi")
    df = t.groupBy("term").agg(F.count("*").alias("n"))
    a, b = t.select(key, F.col("term").alias("a")), t.select(key, F.col("term").alias("b"))
    pairs = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(df.select(F.col("term").alias("a"), F.col("n").alias("df_a")), "a").join(df.select(F.col("term").alias("b"), F.col("n").alias("df_b")), "b")
    return out.withColumn("ratio", F.round(F.col("both") / F.least("df_a", "df_b"), 9))


def pagerank_local(n: int, edges: list[tuple[int, int, float]], damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """Undirected weighted power iteration; dangling mass is spread evenly."""
    if n == 0:
        return np.zeros(0)
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
        w[b, a] += x
    out = w.sum(1)
    r = np.full(n, 1.0 / n)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    for _ in range(rounds):
        r = (1 - damping) / n + damping * (share.T @ r + r[out == 0].sum() / n)
    return r


def textrank(pairs: DataFrame, keep: int = 24) -> DataFrame:
    """term, rank of the best terms of one co-occurrence table of at most a few hundred terms, in one grouped task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        terms = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {t: k for k, t in enumerate(terms)}
        r = pagerank_local(len(terms), [(at[a], at[b], float(x)) for a, b, x in zip(pdf["a"], pdf["b"], pdf["both"])])
        out = pd.DataFrame({"term": terms, "rank": r.round(9)})
        return out.sort_values(["rank", "term"], ascending=[False, True]).head(keep)

    return pairs.withColumn("__all", F.col("both") * 0).groupBy("__all").applyInPandas(run, "term string, rank double")


def pagerank(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(key, rank, centrality) of an undirected graph of any size; parallel edges add weight. edges: src, dst.

    The edge table is hash-partitioned by its source once and read by every round; each round is a join and a
    partial aggregation, with lineage cut every ten rounds where a checkpoint folder is set.
    """
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
    both = both.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("u"))).select("u", "v", "share").persist()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("key")).distinct().persist()
    n = max(nodes.count(), 1)
    r = nodes.select("key", F.lit(1.0 / n).alias("rank"))
    dangling = nodes.join(both.select(F.col("u").alias("key")).distinct(), "key", "left_anti").persist()
    has_dangling = not dangling.isEmpty()
    folder = edges.sparkSession.sparkContext.getCheckpointDir()
    for k in range(rounds):
        lost = r.join(dangling, "key", "left_semi").agg(F.sum("rank")).first()[0] or 0.0 if has_dangling else 0.0
        got = r.join(both, F.col("key") == F.col("u")).groupBy("v").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        r = nodes.join(got, F.col("key") == F.col("v"), "left").select("key", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if k % 10 == 9 and folder:
            r = r.checkpoint()
    return r.withColumn("centrality", F.round("rank", 5))


CONNECTORS = {"of", "and", "the", "for"}


def phrases_of(text: str, window: int = 6, most_bytes: int = 60) -> list[str]:
    """Runs of two and more capitalised words, joined by connectors within, that end capitalised."""
    out, run = [], []

    def close() -> None:
        while run and run[-1] in CONNECTORS:
            run.pop()
        if len(run) >= 2 and len(" ".join(run).encode()) <= most_bytes:
            out.append(" ".join(run))
        run.clear()

    for raw in text.split():
        word = raw.strip(".,;:!?()[]\"'|*#$%&")
        ends = raw[-1:] in ".,;:!?)"
        if word[:1].isupper() and len(run) < window:
            run.append(word)
        elif word in CONNECTORS and run and len(run) < window:
            run.append(word)
        else:
            close()
            if word[:1].isupper():
                run.append(word)
        if ends:
            close()
    close()
    return out


def phrase_entities(docs: DataFrame, text: str, least: int = 5, most: int = 20) -> DataFrame:
    """(phrase, n): frequent capitalised phrases, without those that are mostly the beginning of a longer one."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"phrase": [p for t in pdf[text] if t for p in phrases_of(t)]}, dtype="object")

    n = docs.select(text).mapInPandas(run, "phrase string").groupBy("phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = F.substring_index("phrase", " ", 1)
    long = n.select(F.col("phrase").alias("long"), F.col("n").alias("ln"), first.alias("w"))
    drop = n.withColumn("w", first).join(long, "w").where((F.length("long") > F.length("phrase")) & F.startswith("long", F.concat("phrase", F.lit(" "))) & (2 * F.col("ln") >= F.col("n")))
    return n.join(drop.select("phrase").distinct(), "phrase", "left_anti").orderBy(F.desc("n"), "phrase").limit(most)


def join_paths(edges: DataFrame, max_hops: int = 2) -> DataFrame:
    """(start, end, hops, path) of all simple undirected paths between tables. edges: src, dst, label; a row a key."""
    one = edges.select("src", "dst", "label").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
    path = one.select(F.col("src").alias("start"), F.col("dst").alias("end"), F.array("src", "dst").alias("seen"), F.array("label").alias("path"))
    out = path
    for _ in range(max_hops - 1):
        path = path.join(one, F.col("end") == F.col("src")).where(~F.array_contains("seen", F.col("dst")))
        path = path.select("start", F.col("dst").alias("end"), F.concat("seen", F.array("dst")).alias("seen"), F.concat("path", F.array("label")).alias("path"))
        out = out.unionByName(path)
    return out.select("start", "end", F.size("path").alias("hops"), F.array_join("seen", " → ").alias("route"), F.array_join("path", "; ").alias("keys"))


def grain_table(spark: SparkSession, cat: SourceCatalog) -> tuple[str, int] | None:
    """The table with the most outgoing keys, the one of more rows on ties."""
    best = sorted(((len(cat.tables[t].foreign_keys), cat.frame(t).count(), t) for t in cat.names() if cat.tables[t].foreign_keys), reverse=True)
    return (best[0][2], best[0][1]) if best else None
