"""What sharpens a resolution: cards, affinities, link cache, embedding queue, model-backed passes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.stats import document_boundary
from plumbline.functions.text import humanize
from plumbline.operators.lexical import COLUMN, READING, modal_spelling
from plumbline.operators.resolve import CAP, MARGIN, reorder

CARD_CHARS, FRAGMENTS = 300, 2
AFFINITY_BONUS, AFFINITY_GAP = 0.04, 0.05
RETRIES, BATCH = 3, 768


def interpretation_cards(lex: DataFrame, readings: DataFrame) -> DataFrame:
    """(reading, card): 'table · column · spelling' and up to two '· other: value' that a strict majority of its rows share.

    readings limits which readings get a card (their three key columns); fragments come in the order of the
    other columns' names, and one that would pass 300 characters is left out.
    """
    r = readings.select(*READING)
    rows = lex.join(r, READING, "left_semi").select(*READING, "src_rowid").distinct()
    other = lex.select("src_table", F.col("src_column").alias("other"), "src_rowid", F.col("value_norm").alias("vn"), F.col("value").alias("v"))
    n = rows.join(other, ["src_table", "src_rowid"]).where("other <> src_column").groupBy(*READING, "other", "vn").agg(F.count("*").alias("n"), F.min("v").alias("v"))
    total = F.sum("n").over(Window.partitionBy(*READING, "other"))
    major = n.withColumn("total", total).where("2 * n > total").groupBy(*READING).agg(F.array_sort(F.collect_list(F.struct("other", "v"))).alias("frag"))
    head = modal_spelling(lex).join(r, READING, "left_semi").select(*READING, F.concat_ws(" · ", humanize(F.col("src_table")), humanize(F.col("src_column")), "value").alias("head"))
    j = head.join(major, READING, "left")
    parts = F.transform("frag", lambda f: F.concat(F.lit(" · "), humanize(f["other"]), F.lit(": "), f["v"]))
    start = F.struct(F.col("head").alias("card"), F.lit(0).alias("k"))
    packed = F.aggregate(parts, start, lambda s, x: F.when((s["k"] < FRAGMENTS) & (F.length(s["card"]) + F.length(x) <= CARD_CHARS), F.struct(F.concat(s["card"], x).alias("card"), (s["k"] + 1).alias("k"))).otherwise(s))
    return j.select(*READING, F.when(F.col("frag").isNull(), F.col("head")).otherwise(packed["card"]).alias("card"))


def adopt_boundary(previous: tuple[str, float] | None, medians: list[float]) -> tuple[str, float]:
    """The document boundary with hysteresis: the previous one stays unless some column changes sides."""
    import math

    now = document_boundary(medians)
    if previous is None:
        return now
    side = lambda b, m: b[0] == "all" or math.log(1 + m) > b[1]
    return now if any(side(previous, m) != side(now, m) for m in medians) else previous


def term_column_affinity(terms: DataFrame, index: DataFrame, columns: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(term, column, n): the columns (of columns) in whose cells a term occurs most, four at most a term."""
    hit = index.join(terms.select("term").distinct(), "term", "left_semi").join(columns.select(*COLUMN), COLUMN, "left_semi")
    n = hit.groupBy("term", *COLUMN).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy("term").orderBy(F.desc("n"), *COLUMN)
    return n.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def cached_links(cache: DataFrame, generation: str) -> DataFrame:
    """Verified links of this generation, each pair in one orientation."""
    c = cache.where(F.col("generation") == generation)
    return c.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "path").distinct()


def record_links(cache: DataFrame, verified: DataFrame, generation: str) -> DataFrame:
    """The cache with new verified links, without those of other generations."""
    old = cached_links(cache, generation)
    new = verified.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "path").distinct().join(old, ["a", "b"], "left_anti")
    return old.unionByName(new).withColumn("generation", F.lit(generation))


def dense_targets(spans: DataFrame, exact: DataFrame, most: int = 4) -> DataFrame:
    """The spans to embed: live ones without an exact hit, the longest four of a query."""
    live = spans.where("status <> 'skipped'").join(exact.select("qid", "span").distinct(), ["qid", "span"], "left_anti")
    w = Window.partitionBy("qid").orderBy(F.desc(F.col("end") - F.col("start")), "span")
    return live.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def strong_lexical(candidates: DataFrame) -> DataFrame:
    """(qid, span, strong): an exact hit, or a lexical-only score over the threshold; such spans need no semantic probe."""
    lexical_only = F.forall("channels", lambda c: ~c["channel"].isin("dense", "dense_approximate", "interp"))
    return candidates.groupBy("qid", "span").agg(F.max(F.col("exact") | (lexical_only & (F.col("score") >= 0.35))).alias("strong"))


def resolve_template(registered: str | None, configured: str | None, family: str) -> str:
    """The query template of a vector table: the registered one; a different configured one is an error."""
    if registered is not None and configured is not None and registered != configured:
        raise ValueError("the configured query template isn't the one the vectors were made for")
    return registered or configured or ("Instruct: retrieve the record\nQuery: {query}" if family.startswith("instruct") else "{query}")


def affinity_pass(candidates: DataFrame, cosines: DataFrame, on: list[str] = COLUMN) -> DataFrame:
    """Ties resolved by the question: of the two best within the margin, the one whose card is nearer by more than 0.05 gains 0.04.

    cosines: qid, on (what names a card: the column, or the reading's row), cos of the question with the card.
    Only values of different columns are tied. Scores are capped and never lowered; `torn` says that a tie stayed.
    """
    c = candidates.join(cosines, ["qid", *on], "left")
    if "is_doc" not in c.columns:
        c = c.withColumn("is_doc", F.lit(False))
    w = Window.partitionBy("qid", "span")
    at = lambda k, x: F.max(F.when(F.col("place") == k, x)).over(w)
    two, column = F.col("place") < 2, F.concat_ws(".", *COLUMN)
    gap = at(0, F.col("score")) - at(1, F.col("score"))
    a, b = at(0, F.col("cos")), at(1, F.col("cos"))
    values = (F.sum(F.when(two & ~F.col("is_doc"), 1)).over(w) == 2) & (at(0, column) != at(1, column))
    tie = F.coalesce((F.round(gap, 9) < MARGIN) & values, F.lit(False))
    clear = F.coalesce(F.abs(a - b) > AFFINITY_GAP, F.lit(False))
    wins = two & tie & clear & (F.col("cos") == F.greatest(a, b))
    score = F.when(wins, F.greatest(F.col("score"), F.least(F.col("score") + AFFINITY_BONUS, F.lit(CAP)))).otherwise(F.col("score"))
    out = c.withColumn("torn", two & tie & ~clear).withColumn("__s", F.round(score, 9)).drop("cos", "score").withColumnRenamed("__s", "score")
    return reorder(out if "is_doc" in candidates.columns else out.drop("is_doc"))


def card_ranks(cosines: DataFrame) -> DataFrame:
    """How many of a question's cards are strictly nearer, with a tolerance of 1e-12."""
    r = F.rank().over(Window.partitionBy("qid").orderBy(F.desc(F.round("cos", 12)))) - 1
    return cosines.withColumn("card_rank", r)


def render_path(start: Column, end: Column, hops: list[tuple[str, str, bool, bool]], tables: list[str]) -> Column:
    """'people #2 ←lead_id— teams #43' over hops (column, next table, forward, declared); ? marks inferred keys."""
    parts: list = [F.lit(f"{tables[0]} #"), start.cast("string")]
    for k, (column, table, forward, declared) in enumerate(hops):
        mark = column + ("" if declared else "?")
        parts.append(F.lit(f" —{mark}→ {table}" if forward else f" ←{mark}— {table}"))
        if k == len(hops) - 1:
            parts += [F.lit(" #"), end.cast("string")]
    return F.concat(*parts)


def drain(batch: DataFrame, make_embedder: Callable, dimension: int) -> DataFrame:
    """The batch's rows with vec, status and error: texts are embedded chunk by chunk in the tasks.

    make_embedder is called once a task. A failing chunk is tried again row by row; a row that still fails has
    its attempt counted, and is given up after three.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = make_embedder()
        for pdf in batches:
            vecs: list = [None] * len(pdf)
            errors: list = [None] * len(pdf)
            for start in range(0, len(pdf), BATCH):
                some = list(range(start, min(start + BATCH, len(pdf))))
                try:
                    for k, v in zip(some, e.embed([pdf["serialized"].iloc[k] for k in some])):
                        vecs[k] = v
                except Exception:
                    for k in some:
                        try:
                            vecs[k] = e.embed([pdf["serialized"].iloc[k]])[0]
                        except Exception as x:  # recorded with the row
                            errors[k] = str(x)[:200]
            for k, v in enumerate(vecs):
                if v is not None and len(v) != dimension:
                    vecs[k], errors[k] = None, f"dimension {len(v)}"
            out = pdf[["id"]].copy()
            out["vec"], out["error"] = vecs, pd.Series(errors, dtype="object")
            out["attempts"] = pdf["attempts"] + [int(v is None) for v in vecs]
            out["status"] = ["done" if v is not None else "failed" if n >= RETRIES else "pending" for v, n in zip(vecs, out["attempts"])]
            yield out

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("status", T.StringType())])
    return batch.select("id", "serialized", F.col("attempts").cast("long").alias("attempts")).mapInPandas(run, schema)


def alias_hits(proposals: DataFrame, readings: DataFrame) -> DataFrame:
    """Proposed other forms of a span that are readings word for word, as hits of channel alias:form.

    proposals: qid, span, form. What a model proposes counts only if the data hold it.
    """
    j = proposals.withColumn("value_norm", F.lower(F.trim("form"))).join(readings, "value_norm")
    w = Window.partitionBy("qid", "span", "form").orderBy(*COLUMN)
    j = j.withColumn("k", F.row_number().over(w)).where("k <= 8")
    return j.select("qid", "span", *COLUMN, "src_rowid", "value", "value_norm", "row_count", F.concat(F.lit("alias:"), "form").alias("channel"), F.lit(0).alias("rank"), F.lit(1.0).alias("raw"))


def merge_alias(candidates: DataFrame, hits: DataFrame, cap: float = CAP) -> DataFrame:
    """Candidates of alias hits, at most 0.9, where the span doesn't have them yet."""
    key = ["qid", "span", *COLUMN, "src_rowid"]
    new = hits.join(candidates.select(*key), key, "left_anti").groupBy(*key).agg(F.min("value").alias("value"), F.max("row_count").alias("row_count"))
    new = new.select(*key, "value", "row_count", F.lit(cap).alias("score"), F.lit(10_000).alias("place"))
    return reorder(candidates.select(*key, "value", "row_count", "score", "place").unionByName(new))


def verdict(reply: str, presented: int) -> int | str:
    """A model's choice among presented candidates: its index, 'nil' or 'ambiguous'; anything else is 'ambiguous'."""
    try:
        v = json.loads(reply).get("choice")
    except (ValueError, AttributeError):
        return "ambiguous"
    if v in ("nil", "ambiguous"):
        return v
    try:
        k = int(v)
    except (TypeError, ValueError):
        return "ambiguous"
    return k if 0 <= k < presented else "ambiguous"


def adjudicate(decided: DataFrame, ambiguous: DataFrame, choose: Callable[[list[dict]], str]) -> DataFrame:
    """(qid, span, src_table, src_column, src_rowid, place): ambiguous spans' candidates with the chosen one first.

    choose gets the selected candidates of a span and answers in JSON; it only reorders. nil and ambiguous
    leave the order.
    """
    c = decided.where("selected").join(ambiguous.where("ambiguous").select("qid", "span"), ["qid", "span"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        v = verdict(choose(pdf[["src_table", "src_column", "value"]].to_dict("records")), len(pdf))
        if isinstance(v, int):
            pdf = pd.concat([pdf.iloc[[v]], pdf.drop(index=v)])
        return pd.DataFrame({k: pdf[k].to_numpy() for k in ("qid", "span", "src_table", "src_column", "src_rowid")} | {"place": range(len(pdf))})

    return c.select("qid", "span", *COLUMN, "src_rowid", "value", "place").groupBy("qid", "span").applyInPandas(run, "qid long, span int, src_table string, src_column string, src_rowid long, place int")


def history(log: DataFrame, most: int = 8) -> DataFrame:
    """The last questions asked: each once, with when and from where."""
    return log.groupBy("query").agg(F.max("asked_at").alias("asked_at"), F.max("source").alias("source")).orderBy(F.desc("asked_at"), "query").limit(most)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n) of nodes and edges."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))
