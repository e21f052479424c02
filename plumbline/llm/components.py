"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut


def _least(e: DataFrame) -> DataFrame:
    """e (u, v) with m, the least v of its u; a combine and a join, so a u of many edges isn't one task's window."""
    return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = _least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    kept = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(down.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(v, root) for every vertex of the undirected edges (a, b), longs; root is the least vertex it reaches.

    Loops and repeated edges don't matter, a vertex that has only a loop is left out; no edges give no rows.
    Every round is a reliable checkpoint, and the rounds grow with the logarithm of the vertices.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).distinct()
    seen = None
    while True:
        e = cut(_small(_large(e)))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
    roots = e.select(F.col("u"), F.col("v").alias("root"))
    return roots.select(F.col("u").alias("v"), "root").unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
