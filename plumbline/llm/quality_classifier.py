"""Operator 3: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Share of the pooled covariance, and of the scaled identity, in each class covariance.
POOLED, IDENTITY = 0.1, 0.01
#: A document is kept if log p(good) - log p(bad) + log prior odds reaches this: losing a good one costs e^2 times keeping a bad one.
THRESHOLD = -2.0
#: Pseudo-count that draws ratios of short texts to a typical value, so they aren't judged by noise.
PSEUDO = 30.0
#: Statistics are summed as whole multiples of 1 / UNIT: the fit doesn't depend on the order of the rows.
UNIT = 100_000_000
STATS = ("x_len", "x_symbol", "x_upper", "x_distinct", "x_word", "x_digit")


def _ratio(count: Column, of: Column, typical: float) -> Column:
    """Log odds of a smoothed share."""
    p = (count + F.lit(PSEUDO * typical)) / (of + F.lit(PSEUDO))
    return F.log(p / (F.lit(1.0001) - p))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the transformed statistics STATS of each text; null for texts that are null or blank.

    x_len: log words; x_symbol, x_upper, x_digit: log odds of the smoothed share of symbols among the visible
    characters, of upper-case among them, of digits; x_distinct: log odds of the smoothed share of distinct
    words, against what a text of that length would have; x_word: smoothed mean word length, in logs.
    """
    t = F.col(text)
    d = docs.withColumn("__w", F.array_remove(F.split(F.lower(t), r"[ \t\n\r\f]+"), ""))
    words = F.size("__w").cast("double")
    visible = F.length(F.regexp_replace(t, r"[ \t\n\r\f]+", "")).cast("double")
    symbols = F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")).cast("double")
    upper = F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("double")
    digits = F.regexp_count(t, F.lit("[0-9]")).cast("double")
    d = d.withColumn("__n", words).withColumn("__u", F.size(F.array_distinct("__w")).cast("double")).withColumn("__v", visible)
    d = d.withColumn("__s", symbols).withColumn("__c", upper).withColumn("__d", digits).drop("__w")
    n, v = F.col("__n"), F.col("__v")
    usual = F.least(F.pow(n + 1.0, F.lit(0.9)), n)  # distinct words grow a little slower than words
    stats = {
        "x_len": F.log1p(n),
        "x_symbol": _ratio(F.col("__s"), v, 0.03),
        "x_upper": _ratio(F.col("__c"), v, 0.03),
        "x_distinct": F.log((F.col("__u") + PSEUDO) / (usual + PSEUDO)),
        "x_word": F.log((v + PSEUDO * 6) / (n + PSEUDO)),
        "x_digit": _ratio(F.col("__d"), v, 0.002),
    }
    return d.withColumns({k: F.when(F.col("__n") > 0, x) for k, x in stats.items()}).drop("__n", "__u", "__v", "__s", "__c", "__d")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians: means, inverse Cholesky factors of the shrunk covariances, log determinants, log prior odds."""

    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    logdets: tuple[float, float]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        d = [((x - m) @ w.T) ** 2 for m, w in zip(self.means, self.whiten)]
        return 0.5 * (d[0].sum(1) - d[1].sum(1)) + 0.5 * (self.logdets[0] - self.logdets[1]) + self.log_odds

    def column(self, names: tuple[str, ...] = STATS) -> Column:
        """The same as an expression: Mahalanobis distances by the cached factors, all in generated code."""
        total = F.lit(0.5 * (self.logdets[0] - self.logdets[1]) + self.log_odds)
        for k, (m, w) in enumerate(zip(self.means, self.whiten)):
            for row, _ in enumerate(names):
                z = sum(((F.col(c) - float(m[j])) * float(w[row, j]) for j, c in enumerate(names) if j <= row), F.lit(0.0))
                total = total + (0.5 if k == 0 else -0.5) * z * z
        return total


def fit(moments: dict[int, tuple[int, list[int], list[list[int]]]], pooled: float = POOLED, identity: float = IDENTITY) -> Discriminant | None:
    """From class -> (rows, sums, sums of products) of statistics in units of 1 / UNIT; None if a class has no rows.

    Sums are integers, so means and covariances are exact up to their last rounding, whatever cancels.
    """
    if any(moments.get(k, (0,))[0] == 0 for k in (0, 1)):
        return None
    n = [moments[k][0] for k in (0, 1)]
    mean = [np.array([x / (n[k] * UNIT) for x in moments[k][1]]) for k in (0, 1)]
    cov = [np.array([[(n[k] * xy - x * y) / (n[k] * UNIT) ** 2 for xy, y in zip(row, moments[k][1])] for row, x in zip(moments[k][2], moments[k][1])]) for k in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    whiten, logdet = [], []
    for c in cov:
        c = (1 - pooled) * c + pooled * both
        c = (1 - identity) * c + identity * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        low = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(low))
        logdet.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant((mean[0], mean[1]), (whiten[0], whiten[1]), (logdet[0], logdet[1]), math.log(n[1] / n[0]))


def class_moments(stats: DataFrame, labels: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """Exact moments of the labelled documents by class: one row a class reaches the driver, whatever the input."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("__q")).distinct()
    pairs = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
    whole = stats.where(F.col("x_len").isNotNull()).select("doc_id", *[F.round(F.col(c) * UNIT).cast("long").alias(c) for c in STATS])
    rows = whole.join(marks, "doc_id").groupBy("__q").agg(
        F.count("*"), *[F.sum(F.col(c).cast("decimal(20,0)")) for c in STATS], *[F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(28,0)")) for i, j in pairs]
    )
    out = {}
    for r in rows.collect():
        d = len(STATS)
        second = [[0] * d for _ in range(d)]
        for (i, j), v in zip(pairs, r[2 + d :]):
            second[i][j] = second[j][i] = int(v)
        out[r[0]] = (r[1], [int(x) for x in r[2 : 2 + d]], second)
    return out


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **shrink) -> DataFrame:
    """(doc_id, score, keep) for every row of docs.

    labels (doc_id, quality 0 or 1) trains two Gaussians on all labelled documents; score is the difference of
    their log densities plus the log prior odds, keep says whether it reaches the threshold. Text is read once:
    its statistics are written to the shared folder, joined with the labels for the fit, and scored.

    Texts that are null or blank, with no statistics, have a null score and aren't kept. A doc_id labelled both
    ways counts in both classes, repeated labels count once, other labels are ignored. With a class that has no
    example every score is null and each document with a word is kept. Repeated rows are scored alike. An empty
    table gives no rows; other columns are ignored.
    """
    stats = cut(with_stats(docs.select("doc_id", "text")).drop("text"))
    model = fit(class_moments(stats, labels), **shrink)
    if model is None:
        return stats.select("doc_id", F.lit(None).cast("double").alias("score"), F.col("x_len").isNotNull().alias("keep"))
    return stats.withColumn("score", model.column()).select("doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("keep"))
