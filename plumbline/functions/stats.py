"""Small-sample statistics on the driver or in grouped pandas functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, 1.0 - x) / b


def beta_quantile(a: float, b: float, p: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if incomplete_beta(a, b, mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15:
            break
    return 0.5 * (lo + hi)


def jeffreys_lcb(k: float, n: float) -> float:
    """5 % quantile of Beta(k + 1/2, n - k + 1/2): a lower bound of a share seen k times in n; 0 without cases."""
    return 0.0 if not n or n <= 0 else beta_quantile(k + 0.5, n - k + 0.5, 0.05)


@F.pandas_udf(T.DoubleType())
def jeffreys(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([jeffreys_lcb(float(a), float(b)) for a, b in zip(k, n)], dtype=float)


def otsu_cut(values: list[float]) -> float | None:
    """The midpoint of the gap that separates two classes best (largest between-class variance, first on ties)."""
    xs = sorted(values)
    if len(set(xs)) < 2:
        return None
    total, left, best, cut = sum(xs), 0.0, -1.0, None
    for k in range(1, len(xs)):
        left += xs[k - 1]
        if xs[k] == xs[k - 1]:
            continue
        w0, w1 = k / len(xs), 1 - k / len(xs)
        between = w0 * w1 * (left / k - (total - left) / (len(xs) - k)) ** 2
        if between > best:
            best, cut = between, 0.5 * (xs[k - 1] + xs[k])
    return cut


FLOOR = math.log(121.0)


def document_boundary(medians: list[float]) -> tuple[str, float]:
    """('all', floor) if every column is longer than the floor; else ('cut', where documents begin), both in log(1 + characters)."""
    logs = [math.log(1 + m) for m in medians]
    if logs and all(x > FLOOR for x in logs):
        return "all", FLOOR
    cut = otsu_cut(logs)
    return "cut", max(cut if cut is not None else FLOOR, FLOOR)


def nearest_rank(values: list[float], p: float) -> float:
    """The percentile that is one of the values."""
    xs = sorted(values)
    return xs[min(max(math.ceil(len(xs) * p), 1), len(xs)) - 1] if xs else 0.0


#: Numbers that one matrix of random draws holds.
DRAWN = 1 << 20


def _draws(total: int, n: int) -> Iterator[int]:
    """How many draws of n numbers to make at once: one at least. The generator's numbers are the same however they are split."""
    most = max(1, min(1000, DRAWN // n))
    for start in range(0, total, most):
        yield min(most, total - start)


def paired_randomization(diffs: list[float], permutations: int = 10_000, seed: int = 1) -> float:
    """Two-sided p of a mean difference under random sign flips, with add-one smoothing."""
    d = np.asarray(diffs, float)
    if not len(d):
        return 1.0
    rng = np.random.default_rng(seed)
    seen = abs(d.mean())
    hits = 0
    for draws in _draws(permutations, len(d)):
        signs = rng.integers(0, 2, (draws, len(d)))
        signs *= 2
        signs -= 1
        hits += int((np.abs((signs * d).mean(1)) >= seen - 1e-12).sum())
    return (hits + 1) / (permutations + 1)


def bootstrap_ci95(diffs: list[float], resamples: int = 10_000, seed: int = 1) -> tuple[float, float]:
    """Percentile bootstrap of a mean."""
    d = np.asarray(diffs, float)
    if not len(d):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    means = np.sort(np.concatenate([rng.choice(d, (draws, len(d))).mean(1) for draws in _draws(resamples, len(d))]))
    return float(means[int(0.025 * resamples)]), float(means[min(int(0.975 * resamples), resamples - 1)])


def randomized_tukey_hsd(scores: list[list[float]], permutations: int = 10_000, seed: int = 1) -> dict[tuple[int, int], float]:
    """p of each pair of variants by the largest difference of means under shuffles within each query (rows: queries)."""
    x = np.asarray(scores, float)
    if x.size == 0:
        return {}
    rng = np.random.default_rng(seed)
    means = x.mean(0)
    pairs = [(i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])]
    hits = dict.fromkeys(pairs, 0)
    for _ in range(permutations):
        m = rng.permuted(x, axis=1).mean(0)
        spread = m.max() - m.min()
        for i, j in pairs:
            hits[i, j] += spread >= abs(means[i] - means[j]) - 1e-12
    return {p: (h + 1) / (permutations + 1) for p, h in hits.items()}
