"""Evaluation: scoring of queries, cells, calibration, nil report, grading, policy and shadow studies."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import bootstrap_ci95, paired_randomization

TIERS = ("anchor", "paraphrase", "join", "cross-record", "absent")


def target_ranks(targets: DataFrame, candidates: DataFrame, on: list[str], match: Column | None = None) -> DataFrame:
    """(targets' columns, rank): least place of a candidate that hits the target, null if none does.

    candidates: qid, place and the columns of `on`; match: a further condition over both.
    """
    j = targets.join(candidates, on, "left")
    hit = F.col("place") if match is None else F.when(match, F.col("place"))
    return j.groupBy(*targets.columns).agg(F.min(hit).alias("rank"))


def query_outcomes(ranks: DataFrame, k: int = 5) -> DataFrame:
    """(qid, targets, found, recall, mrr, first): one row a query of its targets' ranks (0 is best)."""
    return ranks.groupBy("qid").agg(
        F.count("*").alias("targets"),
        F.count_if(F.col("rank") < k).alias("found"),
        F.round(F.count_if(F.col("rank") < k) / F.count("*"), 9).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / (F.col("rank") + 1), F.lit(0.0))), 9).alias("mrr"),
        F.min("rank").alias("first"),
    )


def cells(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Macro and micro means of query outcomes, with F2 of micro precision and recall. outcomes also have `selected`."""
    found, targets, selected = F.sum("found"), F.sum("targets"), F.sum("selected")
    g = outcomes.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 9).alias("macro_recall"), F.round(F.avg("mrr"), 9).alias("mrr"),
        F.round(found / targets, 9).alias("micro_recall"), F.round(F.coalesce(F.try_divide(found, selected), F.lit(0.0)), 9).alias("precision"),
    )
    p, r = F.col("precision"), F.col("micro_recall")
    return g.withColumn("f2", F.round(F.when(4 * p + r > 0, 5 * p * r / (4 * p + r)).otherwise(0.0), 9))


def calibration(pairs: DataFrame, score: str = "score", hit: str = "hit") -> DataFrame:
    """(bucket 0 .. 9, n, mean_score, hit_rate): ten equal buckets of score, empty ones too."""
    b = F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int")
    g = pairs.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(score), 9).alias("mean_score"), F.round(F.avg(F.col(hit).cast("double")), 9).alias("hit_rate"))
    every = pairs.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    return every.join(g, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "hit_rate")


def nil_report(outcomes: DataFrame) -> DataFrame:
    """One row: precision and recall of answering nothing. outcomes: nil (gold), said_nil."""
    both, gold, said = F.count_if(F.col("nil") & F.col("said_nil")), F.count_if("nil"), F.count_if("said_nil")
    return outcomes.agg(both.alias("both"), gold.alias("gold"), said.alias("said"), F.round(F.try_divide(both, said), 9).alias("precision"), F.round(F.try_divide(both, gold), 9).alias("recall"))


def diagnosis(nil: Column, said_nil: Column, first: Column, any_candidate: Column, k: int = 5) -> Column:
    """Why a query failed, or that it didn't."""
    return (
        F.when(nil & said_nil, "correct_nil").when(nil, "false_positive").when(first < k, "hit").when(first.isNotNull(), "ranked_low").when(said_nil, "false_nil").when(any_candidate, "wrong_candidates").otherwise("no_candidates")
    )


def nearest_rank_percentile(x: str, p: float) -> Column:
    """An aggregate: the percentile that is one of the values."""
    xs = F.array_sort(F.collect_list(x))
    n = F.size(xs)
    return F.when(n > 0, F.element_at(xs, F.least(F.greatest(F.ceil(n * F.lit(p)).cast("int"), F.lit(1)), n)))


def compare_runs(a: DataFrame, b: DataFrame, by: str, value: str, permutations: int = 2000) -> DataFrame:
    """(by, n, delta, p, lo, hi): paired difference b - a per group with a randomisation p and a bootstrap interval. a, b: qid, by, value.

    A group is one task: its differences are some numbers a query, and the draws are made a few at a time.
    """
    d = a.select("qid", by, F.col(value).alias("x")).join(b.select("qid", by, F.col(value).alias("y")), ["qid", by]).select(by, "qid", (F.col("y") - F.col("x")).cast("double").alias("d"))

    def run(group: pa.Table) -> pa.Table:
        at = pc.sort_indices(group, sort_keys=[("qid", "ascending"), ("d", "ascending")])
        diffs = group["d"].combine_chunks().to_numpy(zero_copy_only=False)[at.to_numpy()]
        lo, hi = bootstrap_ci95(diffs, permutations)
        row = {by: group[by][0].as_py(), "n": len(diffs), "delta": sum(diffs.tolist()) / len(diffs), "p": paired_randomization(diffs, permutations), "lo": lo, "hi": hi}
        return pa.Table.from_pylist([row], pa.schema([(by, pa.string()), ("n", pa.int64()), *[(c, pa.float64()) for c in ("delta", "p", "lo", "hi")]]))

    return d.groupBy(by).applyInArrow(run, f"{by} string, n long, delta double, p double, lo double, hi double")


def grade(run: DataFrame, baseline: DataFrame, floor: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """Failing cells (cell, metric, why). run: cell, value, p, latency_p95; baseline: cell, value, budget."""
    j = baseline.select("cell", F.col("value").alias("base"), "budget").join(run, "cell", "left")
    why = F.array_compact(F.array(
        F.when(F.col("value").isNull(), "missing"),
        F.when((F.col("base") - F.col("value") > floor) & (F.coalesce("p", F.lit(0.0)) < alpha), "regressed"),
        F.when(F.col("latency_p95") > F.col("budget"), "over_budget"),
    ))
    return j.select("cell", F.explode(why).alias("why"))


def accept(run: DataFrame) -> DataFrame:
    """A new baseline: values as they are, latency budgets 1.5 x p95 rounded up."""
    return run.select("cell", "value", F.ceil(F.col("latency_p95") * 1.5).cast("long").alias("budget"))


def policy_study(candidates: DataFrame, queries: DataFrame, limit: int, margin: float) -> DataFrame:
    """(policy, n, survival, alternative_recall, false_commitment) of candidate policies under one limit.

    candidates: qid, id, rank, score, graph_support, collision; queries: qid, gold, alternatives.
    Policies: top1, limit (the first by rank), margin (within the margin of the best), margin_graph (also those
    with graph support), collision (the margin, widened to the limit where the best collides), adaptive (top1 if
    alone within the margin, else the margin).
    """
    w = Window.partitionBy("qid")
    c = candidates.withColumn("best", F.max("score").over(w)).withColumn("near", F.col("best") - F.col("score") <= margin)
    c = c.withColumn("n_near", F.sum(F.col("near").cast("int")).over(w)).withColumn("top_collides", F.max(F.when(F.col("rank") == 1, F.col("collision"))).over(w))
    within = F.col("rank") <= limit
    rules = {
        "top1": F.col("rank") == 1,
        "limit": within,
        "margin": within & F.col("near"),
        "margin_graph": within & (F.col("near") | F.col("graph_support")),
        "collision": within & (F.col("near") | F.coalesce("top_collides", F.lit(False))),
        "adaptive": F.when(F.col("n_near") == 1, F.col("rank") == 1).otherwise(within & F.col("near")),
    }
    chosen = c.select("qid", "id", F.explode(F.array_compact(F.array(*[F.when(r, F.lit(k)) for k, r in rules.items()]))).alias("policy"))
    sets = chosen.groupBy("qid", "policy").agg(F.collect_set("id").alias("ids"))
    every = queries.crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(k,) for k in rules], "policy string")))
    j = every.join(sets, ["qid", "policy"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    kept = F.array_contains("ids", F.col("gold"))
    alt = F.when(F.size("alternatives") > 0, F.size(F.array_intersect("ids", "alternatives")) / F.size("alternatives"))
    return j.groupBy("policy").agg(
        F.count("*").alias("n"), F.round(F.avg(kept.cast("double")), 9).alias("survival"), F.round(F.avg(alt), 9).alias("alternative_recall"),
        F.round(F.avg(((F.size("ids") == 1) & ~kept).cast("double")), 9).alias("false_commitment"), F.round(F.avg(F.size("ids")), 9).alias("mean_size"),
    )


def shadow_compare(exact: DataFrame, approximate: DataFrame, margin: float) -> DataFrame:
    """One row (n, recall, top1_agreement, missed_ambiguity, outcome_change) of approximate against exact lists. Both: qid, id, cos, k."""

    def lists(d: DataFrame, p: str) -> DataFrame:
        top = F.max(F.when(F.col("k") == 1, F.col("cos"))) - F.max(F.when(F.col("k") == 2, F.col("cos")))
        return d.groupBy("qid").agg(F.collect_set("id").alias(f"{p}_ids"), F.max(F.when(F.col("k") == 1, F.col("id"))).alias(f"{p}_top"), F.coalesce(top < margin, F.lit(False)).alias(f"{p}_amb"))

    j = lists(exact, "e").join(lists(approximate, "a"), "qid", "left")
    same = F.coalesce(F.col("e_top") == F.col("a_top"), F.lit(False))
    a_amb = F.coalesce("a_amb", F.lit(False))
    return j.agg(
        F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.size(F.array_intersect("e_ids", "a_ids")), F.lit(0)) / F.size("e_ids")), 9).alias("recall"), F.round(F.avg(same.cast("double")), 9).alias("top1_agreement"),
        F.count_if(F.col("e_amb") & ~a_amb).alias("missed_ambiguity"), F.count_if(F.col("e_amb") != a_amb).alias("outcome_change"),
    )


def population_fingerprint(rows: list[dict]) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(rows, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def assign_tier(n_targets: Column, n_target_tables: Column, n_sql_tables: Column) -> Column:
    """cross-record if the gold rows lie in several tables, join if several mentions and the gold SQL joins tables, else anchor."""
    return F.when(n_target_tables >= 2, "cross-record").when((n_targets >= 2) & (n_sql_tables >= 2), "join").otherwise("anchor")
