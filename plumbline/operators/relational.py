"""Generic relational operators: paging, guarded SQL, plans, upserts, feedback and history views."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READ_ONLY = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(select|with|explain|values|show|describe)\b", re.I)


def keyset_page(df: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """Rows after a key, in key order, one more than the page: the extra row says that there are more."""
    d = df if after is None else df.where(F.col(key) > after)
    return d.orderBy(key).limit(limit + 1)


def substring_filter(df: DataFrame, columns: list[str], q: str) -> DataFrame:
    """Rows where some text column contains q in any case; %, _ and \\ in q are ordinary characters."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(c)), F.lit(q.lower())) for c in columns]))


def guarded_sql(spark: SparkSession, sql: str, limit: int = 200) -> dict:
    """columns, rows and truncated of one read-only statement; anything else raises PermissionError."""
    if not READ_ONLY.match(sql) or ";" in sql.strip().rstrip(";"):
        raise PermissionError("only one read-only statement is allowed")
    df = spark.sql(sql.strip().rstrip(";"))
    rows = df.limit(limit + 1).collect()
    return {"columns": df.columns, "rows": [tuple(r) for r in rows[:limit]], "truncated": len(rows) > limit}


def query_plan(spark: SparkSession, sql: str) -> list[dict]:
    """The optimised plan as (id, parent, depth, detail), in the order of its text."""
    if not READ_ONLY.match(sql):
        raise PermissionError("only one read-only statement is allowed")
    text = spark.sql(sql)._jdf.queryExecution().optimizedPlan().toString()
    out, stack = [], []
    for k, line in enumerate(x for x in text.splitlines() if x.strip()):
        body = re.sub(r"^[\s:+\-|]*", "", line)
        depth = (len(line) - len(body)) // 3
        del stack[depth:]
        out.append({"id": k, "parent": stack[-1] if stack else None, "depth": depth, "detail": body})
        stack += [k] * (depth + 1 - len(stack))
    return out


def display(c: Column, most: int = 400) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert as a query: the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def without_prefixes(nodes: DataFrame, edges: DataFrame, prefixes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose key begins with a prefix go, and the edges that touch them."""
    gone = reduce(lambda a, b: a | b, [F.col("key").startswith(p) for p in prefixes], F.lit(False))
    dead = nodes.where(gone).select("key")
    e = edges.join(dead.withColumnRenamed("key", "src"), "src", "left_anti").join(dead.withColumnRenamed("key", "dst"), "dst", "left_anti")
    return nodes.where(~gone), e


def drain_batch(queue: DataFrame, limit: int, retries: int = 3) -> DataFrame:
    """The next rows to embed: fewest attempts first."""
    return queue.where((F.col("status") == "pending") & (F.col("attempts") < retries)).orderBy("attempts", "id").limit(limit)


def conversation_list(log: DataFrame) -> DataFrame:
    """A row a conversation: turns, first turn, first user line."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    return log.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.min_by("text", user).alias("opening"))


def stratified(df: DataFrame, strata: list[str], order: Column, id_col: str) -> DataFrame:
    """Round robin over strata: position of each row when one row of every stratum is taken at a time."""
    w = Window.partitionBy(*strata).orderBy(order, id_col)
    return df.withColumn("round", F.row_number().over(w))


def packed_prefix(df: DataFrame, group: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each group while their sizes fit the budget; the first that overflows ends it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__over", F.when(F.sum(size).over(w) > budget, 1).otherwise(0))
    return d.withColumn("__over", F.max("__over").over(w)).where("__over = 0").drop("__over")
