"""Operator 6: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import RowMap, cut, located, rows_of

#: Target weights of the production mix; sources that aren't named get DEFAULT_WEIGHT.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 0.5, "src3": 1.5}
DEFAULT_WEIGHT = 1.0
BUDGET_FRACTION = 0.6
SEED = "mix-1"
_ROWS_A_BLOCK = 50_000
_MOST_RANGES = 100_000


def token_count(text: Column) -> Column:
    """Runs of characters other than blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 bits of md5(seed:doc_id): a deterministic random order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def weight_of(source: Column, weights: dict[str, float], default: float) -> Column:
    w = F.lit(float(default))
    if weights:
        pairs = [F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]
        w = F.coalesce(F.element_at(F.create_map(*pairs), source), w)
    return w


def _served(
    docs: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    default_weight: float = DEFAULT_WEIGHT,
    budget_tokens: int | None = None,
    budget_fraction: float = BUDGET_FRACTION,
    seed: str = SEED,
) -> DataFrame:
    light = docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")).where("doc_id is not null")
    light = light.groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("tokens").alias("tokens"))
    light = light.withColumn("k", shuffle_key(F.col("doc_id"), seed)).withColumn("w", weight_of(F.col("source"), weights, default_weight))
    light = cut(light.where("w > 0"))
    n, total = light.agg(F.count("*"), F.sum("tokens")).first()
    budget = budget_tokens if budget_tokens is not None else math.floor((total or 0) * budget_fraction)
    blocks = max(1, math.ceil(n / _ROWS_A_BLOCK))
    light = light.withColumn("b", F.floor(F.col("k") / F.lit((1 << 60) / blocks)).cast("int"))
    # level 1: (source, block) sums; as many rows as sources x blocks
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = light.groupBy("source", "b").agg(F.sum("tokens").alias("t"))
    sums = sums.select(F.col("source").alias("s"), F.col("b").alias("sb"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "b").orderBy("k", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    q = light.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("sb")))
    q = q.withColumn("source_tokens", F.col("base") + F.sum("tokens").over(inside))
    q = q.withColumn("virtual_finish", F.col("source_tokens") / F.col("w"))
    q = cut(q.select("doc_id", "source", "tokens", "source_tokens", "virtual_finish", "k"))
    # level 2: ranges of the queue, cut at sampled rows so that they are alike in rows whatever the weights
    order = ["virtual_finish", F.col("source").asc_nulls_first(), "k", "doc_id"]
    q = cut(q.repartitionByRange(min(blocks, _MOST_RANGES), *order).withColumn("bin", F.spark_partition_id()))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = q.groupBy("bin").agg(F.sum("tokens").alias("t"))
    bins = bins.select("bin", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base")).where(F.col("base") <= budget)
    served = Window.partitionBy("bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    q = q.join(bins, "bin").withColumn("total_tokens", F.col("base") + F.sum("tokens").over(served))
    return q.where(F.col("total_tokens") <= budget)


def fair_queue(docs: DataFrame, *args, **params) -> DataFrame:
    """The documents that a weighted fair queue serves before the token budget is used up, in its order.

    Columns: doc_id, source, tokens, source_tokens (cumulative within the source, in shuffled order),
    virtual_finish (source_tokens / weight), total_tokens (cumulative over the queue; at most the budget).
    The order is virtual_finish, source (null first), shuffle key, doc_id. Parameters: those of _served.

    The cumulative sums are taken in two levels, so no task ever holds a whole source (sources may be
    hot) or the whole queue: sums of (source, block) and of ranges of the queue are small tables whose prefix
    sums are added to the running sum within a block. The result doesn't depend on the block counts.

    Null or empty text has 0 tokens and is served when its turn comes. A null source is a source of its
    own with the default weight. Sources of weight 0 or less are never served. Rows that repeat a doc_id
    are one entry: their tokens add up, the least source counts. Rows without doc_id are left out.
    An empty table gives no rows. Other columns are ignored.
    """
    q = _served(docs, *args, **params).orderBy("virtual_finish", F.col("source").asc_nulls_first(), "k", "doc_id")
    return q.select("doc_id", "source", "tokens", "source_tokens", "virtual_finish", "total_tokens")


def mix(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns kept, whose doc_id the fair queue serves (see fair_queue). Texts don't move."""
    place = located(docs)
    kept = RowMap(rows_of(place, _served(docs, **params)))
    return place.where(kept.column()).select(*[F.col(f"`{c}`") for c in docs.columns])


def _weight_sql(weights: dict[str, float], default: float) -> str:
    cases = " ".join(f"when '{k}' then cast({float(v)} as double)" for k, v in sorted(weights.items()))
    return f"case source {cases} else cast({float(default)} as double) end"


SQL = f"""
with light as (
  select doc_id, min(source) source, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)) tokens
  from documents where doc_id is not null group by doc_id),
keyed as (
  select *, cast('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) as bigint) k, {_weight_sql(WEIGHTS, DEFAULT_WEIGHT)} w from light),
queue as (
  select doc_id, source, tokens, k, cast(sum(tokens) over (partition by source order by k, doc_id rows unbounded preceding) as bigint) source_tokens, w
  from keyed where w > 0),
served as (
  select doc_id, source, cast(tokens as bigint) tokens, source_tokens, source_tokens / w virtual_finish,
    cast(sum(tokens) over (order by source_tokens / w, source nulls first, k, doc_id rows unbounded preceding) as bigint) total_tokens
  from queue)
select * from served where total_tokens <= (select floor(sum(tokens) * {BUDGET_FRACTION}) from keyed where w > 0)
"""
