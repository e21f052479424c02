"""Resolution: fusing channel hits, choosing mentions, ambiguity, reach, clarification and outcome."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import clip
from plumbline.operators.vectors import dense_confidence

RRF_K = 4.0
SELECT_THRESHOLD, TOP_K, MARGIN = 0.35, 5, 0.08
CAP, DOC_BONUS, TERM_BONUS, COHERENCE, AFFINITY = 0.9, 0.04, 0.05, 0.15, 0.04
COLUMN = ["src_table", "src_column"]
CANDIDATE = ["qid", "span", *COLUMN, "src_rowid"]


def fuse(hits: DataFrame, spans: DataFrame, geometry: tuple[float, float] | None = None) -> DataFrame:
    """One row a candidate (query, span, table, column, representative row) with its score, best first.

    hits: the channels' rows by name; spans: qid, span, text. Reciprocal ranks are summed and normalised to
    three channels at rank 0; exact hits score from 0.9, documents up to 0.85, values by how much of them the
    span covers; a semantic cosine lifts the score to what two agreeing channels give, by the geometry.
    """
    h = hits.withColumn("is_doc", F.coalesce("is_doc", F.lit(False)))
    rrf = F.sum(1.0 / (RRF_K + F.col("rank")))
    semantic = F.col("channel").isin("dense", "dense_approximate", "interp")
    g = h.groupBy(*CANDIDATE).agg(
        F.array_sort(F.collect_set(F.struct("channel", "rank", "raw"))).alias("channels"),
        F.min_by("value", "channel").alias("value"),
        F.max("is_doc").alias("is_doc"),
        F.max("row_count").alias("row_count"),
        F.max(F.col("channel") == "exact").alias("exact"),
        F.least(rrf / (3.0 / RRF_K), F.lit(1.0)).alias("base"),
        F.max(F.when(semantic, F.col("raw"))).alias("cos"),
    )
    g = g.join(spans.select("qid", "span", F.length("text").alias("span_len")), ["qid", "span"])
    cover = F.sqrt(F.col("span_len") / F.greatest(F.length("value"), F.col("span_len")))
    score = (
        F.when(F.col("exact"), F.least(0.9 + 0.1 * F.col("base"), F.lit(1.0)))
        .when(F.col("is_doc"), F.least(F.col("base") * 0.85, F.lit(0.85)))
        .otherwise(F.least(F.col("base") * (0.4 + 0.6 * cover), F.lit(1.0)))
    )
    if geometry:
        conf = dense_confidence(F.col("cos"), F.lit(geometry[0]), F.lit(geometry[1]))
        g = g.withColumn("dense_confidence", conf)
        score = F.greatest(score, F.coalesce(conf, F.lit(0.0)) * (2.0 / 3.0) * 0.85)
    else:
        g = g.withColumn("dense_confidence", F.lit(None).cast("double"))
    g = g.withColumn("score", F.round(score, 9)).withColumn("value", clip(F.col("value"), 160))
    place = Window.partitionBy("qid", "span").orderBy(F.desc("score"), *COLUMN, "src_rowid")
    return g.withColumn("place", F.row_number().over(place) - 1).select(*CANDIDATE, "value", "is_doc", "row_count", "channels", "exact", "dense_confidence", "score", "place")


def reorder(candidates: DataFrame) -> DataFrame:
    """Places anew after scores changed; equal scores keep their order."""
    w = Window.partitionBy("qid", "span").orderBy(F.desc("score"), "place")
    return candidates.withColumn("place", F.row_number().over(w) - 1)


def raised(candidates: DataFrame, bonus: DataFrame, amount: Column) -> DataFrame:
    """Scores plus amount (a column of bonus, joined on the candidate), up to the cap and never lowered."""
    b = bonus.select(*CANDIDATE, F.round(amount, 9).alias("__b"))
    up = F.greatest(F.col("score"), F.least(F.col("score") + F.coalesce("__b", F.lit(0.0)), F.lit(CAP)))
    return reorder(candidates.join(b, CANDIDATE, "left").withColumn("score", F.round(up, 9)).drop("__b"))


def document_coherence(candidates: DataFrame, co_terms: DataFrame, index: DataFrame) -> DataFrame:
    """+0.04 a co-term (4 at most) of the span that a document candidate holds. co_terms: qid, span, term."""
    docs = candidates.where("is_doc").select(*CANDIDATE)
    n = docs.join(co_terms, ["qid", "span"]).join(index.select("term", *COLUMN, "src_rowid"), ["term", *COLUMN, "src_rowid"], "left_semi")
    n = n.groupBy(*CANDIDATE).agg(F.least(F.count_distinct("term"), F.lit(4)).alias("n"))
    return raised(candidates, n, DOC_BONUS * F.col("n"))


def context_coherence(candidates: DataFrame, context: DataFrame, affinity: DataFrame) -> DataFrame:
    """+0.05 a context term (2 at most) that has affinity to a value candidate's column. context: qid, span, term."""
    n = candidates.where("not is_doc").select(*CANDIDATE).join(context, ["qid", "span"]).join(affinity, ["term", *COLUMN], "left_semi")
    n = n.groupBy(*CANDIDATE).agg(F.least(F.count_distinct("term"), F.lit(2)).alias("n"))
    return raised(candidates, n, TERM_BONUS * F.col("n"))


def select_mentions(spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, span, status, admitted): greedy choice of spans that don't overlap, query by query.

    Strongest first candidate first (times 1.08 for a span that names a graph entity), the longer span on ties;
    spans whose bytes are taken are 'overlapped', those without a candidate over the threshold 'weak'. The
    longest weak span with purely semantic evidence is nominated. spans: qid, span, start, end, status, kg_alias.
    """
    top = candidates.where("place = 0").select("qid", "span", "score", "dense_confidence", F.forall("channels", lambda c: c["channel"].isin("dense", "dense_approximate", "interp")).alias("semantic"))
    s = spans.select("qid", "span", "start", "end", "status", "kg_alias").join(top, ["qid", "span"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span").reset_index(drop=True)
        status, admitted = [], [None] * len(pdf)
        for st, score in zip(pdf["status"], pdf["score"]):
            status.append("skipped" if st == "skipped" else "selected" if score == score and score is not None and score >= SELECT_THRESHOLD else "weak")
        key = [(-(sc * (1.08 if a else 1.0)) if sc == sc and sc is not None else 0.0, -(e - b), k) for k, (sc, a, b, e) in enumerate(zip(pdf["score"], pdf["kg_alias"], pdf["start"], pdf["end"]))]
        taken: list[tuple[int, int]] = []
        for _, _, k in sorted(key):
            if status[k] != "selected":
                continue
            b, e = pdf["start"][k], pdf["end"][k]
            if any(b < y and x < e for x, y in taken):
                status[k] = "overlapped"
            else:
                taken.append((b, e))
                admitted[k] = "lexical"
        weak = [k for k in range(len(pdf)) if status[k] == "weak" and pdf["semantic"][k] is not None and pdf["semantic"][k] == 1 and (pdf["dense_confidence"][k] or 0) > 0]
        if weak:
            admitted[max(weak, key=lambda k: (pdf["end"][k] - pdf["start"][k], pdf["score"][k], k))] = "dense_geometry"
        return pd.DataFrame({"qid": pdf["qid"], "span": pdf["span"], "status": status, "admitted": pd.Series(admitted, dtype="object")})

    return s.groupBy("qid").applyInPandas(run, "qid long, span int, status string, admitted string")


def decide(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """candidates with selected and reject_reason, from the spans' status."""
    c = candidates.join(chosen.select("qid", "span", "status"), ["qid", "span"])
    ok = (F.col("status") == "selected") & (F.col("place") < TOP_K) & (F.col("score") >= SELECT_THRESHOLD)
    reason = F.when(F.col("status") != "selected", "span_not_selected").when(F.col("score") < SELECT_THRESHOLD, "below_threshold").when(F.col("place") >= TOP_K, "outranked")
    return c.withColumn("selected", ok).withColumn("reject_reason", reason)


def ambiguous_spans(decided: DataFrame) -> DataFrame:
    """(qid, span, ambiguous) of selected spans: the two best within the margin, unless the first alone is exact or both are one column's."""
    w = Window.partitionBy("qid", "span").orderBy("place")
    two = decided.where("selected").withColumn("k", F.row_number().over(w)).where("k <= 2")
    t = two.groupBy("qid", "span").agg(
        F.max_by(F.struct("score", "exact", *COLUMN), -F.col("k")).alias("a"), F.max_by(F.struct("score", "exact", *COLUMN), "k").alias("b"), F.count("*").alias("n")
    )
    other = (F.col("a.src_table") != F.col("b.src_table")) | (F.col("a.src_column") != F.col("b.src_column"))
    yes = (F.col("n") == 2) & (F.round(F.col("a.score") - F.col("b.score"), 9) < MARGIN) & (~F.col("a.exact") | (F.col("b.exact") & other))
    return t.select("qid", "span", yes.alias("ambiguous"))


def outcomes(queries: DataFrame, decided: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(qid, outcome): resolved, ambiguous or unknown."""
    some = decided.where("selected").groupBy("qid").agg(F.count("*").alias("n"))
    amb = ambiguous.where("ambiguous").groupBy("qid").agg(F.count("*").alias("a"))
    j = queries.select("qid").distinct().join(some, "qid", "left").join(amb, "qid", "left")
    return j.select("qid", F.when(F.coalesce("n", F.lit(0)) == 0, "unknown").when(F.col("a") > 0, "ambiguous").otherwise("resolved").alias("outcome"))


def clarifications(decided: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(qid, span, dimension, options): what to ask back about an ambiguous span: which relation, attribute or record."""
    c = decided.where("selected").join(ambiguous.where("ambiguous").select("qid", "span"), ["qid", "span"])
    g = c.groupBy("qid", "span").agg(F.count_distinct("src_table").alias("t"), F.count_distinct("src_table", "src_column").alias("c"), F.array_sort(F.collect_set(F.concat_ws(".", *COLUMN))).alias("options"))
    return g.select("qid", "span", F.when(F.col("t") > 1, "relation").when(F.col("c") > 1, "attribute").otherwise("record").alias("dimension"), "options")


def reach(values: DataFrame, chain: list[tuple[DataFrame, str, str]], value: str, grain_row: str) -> DataFrame:
    """(value, reach): distinct grain rows that a value's rows lead to over a chain of joins [(table, left key, right key)]."""
    d = values
    for table, left, right in chain:
        d = d.join(table, F.col(left) == F.col(right))
    return d.groupBy(value).agg(F.count_distinct(grain_row).alias("reach"))


def divergence(reaches: DataFrame, group: str) -> DataFrame:
    """max / max(min, 1) over positive reaches, where there are two or more."""
    g = reaches.where("reach > 0").groupBy(group).agg(F.max("reach").alias("hi"), F.min("reach").alias("lo"), F.count("*").alias("n"))
    return g.select(group, F.when(F.col("n") >= 2, F.round(F.col("hi") / F.greatest("lo", F.lit(1)), 9)).otherwise(0.0).alias("divergence"))


def value_links(left: DataFrame, right: DataFrame, on: Column, a: str, b: str, row_a: str, row_b: str) -> DataFrame:
    """Witness rows of each pair of values that a key path connects: (a, b, least row of a, least row of b, n)."""
    return left.join(right, on).groupBy(F.lower(a).alias("value_a"), F.lower(b).alias("value_b")).agg(F.min(row_a).alias("row_a"), F.min(row_b).alias("row_b"), F.count("*").alias("n"))


def collective(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """The best joint reading of each query's first 4 mentions x 4 candidates by verified links; its candidates rise by 0.15.

    candidates: qid, mention (0 ..), the candidate's key and score; links: pairs (a, b) of candidate keys, as
    strings table.column#row, with their qid. A tuple's score is the sum of its scores and 0.15 a link; the first in odometer
    order (mention 0 fastest) wins ties.
    """

    def run(pdf: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        linked = set(zip(pairs["a"], pairs["b"])) | set(zip(pairs["b"], pairs["a"]))
        pools = [g.sort_values("place").head(4) for _, g in sorted(pdf.groupby("mention"), key=lambda x: x[0])][:4]
        if len(pools) < 2:
            return pd.DataFrame(columns=["qid", "key", "links"])
        best, at, most = -1.0, None, 0
        for combo in product(*[range(len(p)) for p in reversed(pools)]):
            pick = [p.iloc[k] for p, k in zip(pools, reversed(combo))]
            n = sum((x["key"], y["key"]) in linked for i, x in enumerate(pick) for y in pick[:i])
            total = round(sum(x["score"] for x in pick) + COHERENCE * n, 9)
            if total > best:
                best, at, most = total, pick, n
        rows = [(pdf["qid"].iloc[0], x["key"], most) for x in at or [] if any((x["key"], y["key"]) in linked for y in at)]
        return pd.DataFrame(rows, columns=["qid", "key", "links"])

    return candidates.groupBy("qid").cogroup(links.groupBy("qid")).applyInPandas(run, "qid long, key string, links int")
