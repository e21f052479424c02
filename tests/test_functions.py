from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import stats
from plumbline.functions.text import fnv1a, spans_of, tokenize


def test_tokens_have_byte_offsets():
    assert tokenize("Où is Ça-va?") == [("Où", 0, 3, False), ("is", 4, 6, True), ("Ça", 7, 10, False), ("va", 11, 13, False)]
    assert tokenize("") == [] and tokenize(" .,") == []


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_spans_are_substrings(q):
    raw = q.encode()
    for _, text, a, b, n, status in spans_of(q):
        assert raw[a:b].decode() == text and 1 <= n <= 4
        assert status in ("skipped", "selected")


def test_stopword_spans_are_skipped():
    got = {t: s for _, t, _, _, _, s in spans_of("the Q3 of the")}
    assert got["the"] == "skipped" and got["of the"] == "skipped" and got["the Q3"] == "selected"


def test_fnv():
    assert fnv1a("") == "cbf29ce484222325" and fnv1a("a") == "af63dc4c8601ec8c"


def test_beta_quantiles_invert_the_distribution():
    for a, b in ((0.5, 0.5), (3.5, 0.5), (10, 2), (100.5, 300.5)):
        for p in (0.05, 0.5, 0.9):
            assert abs(stats.incomplete_beta(a, b, stats.beta_quantile(a, b, p)) - p) < 1e-9
    assert abs(stats.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-12
    assert stats.jeffreys_lcb(0, 0) == 0 and 0.75 < stats.jeffreys_lcb(10, 10) < 0.9 < stats.jeffreys_lcb(100, 100)


@pytest.mark.parametrize("medians,docs", [([9, 36, 57, 2660, 16151], {2660, 16151}), ([30, 90, 150, 3000], {3000}), ([3, 7, 11, 19, 36], set()), ([500, 4000], {500, 4000}), ([1000], {1000}), ([12], set())])
def test_document_boundary(medians, docs):
    kind, cut = stats.document_boundary(medians)
    assert {m for m in medians if (kind == "all" or math.log(1 + m) > cut)} == docs


def test_percentiles_and_resampling():
    assert stats.nearest_rank([5, 1, 3], 0.5) == 3 and stats.nearest_rank([], 0.5) == 0 and stats.nearest_rank([1, 2], 0.95) == 2
    assert stats.paired_randomization([1.0] * 12, 999) < 0.01 and stats.paired_randomization([1.0, -1.0] * 6, 999) > 0.5
    lo, hi = stats.bootstrap_ci95([0.0, 1.0] * 50, 1000)
    assert 0.35 < lo < 0.5 < hi < 0.65
    p = stats.randomized_tukey_hsd([[0.1, 0.9, 0.1]] * 12, 400)
    assert p[0, 1] < 0.05 and p[0, 2] == 1.0


def test_draws_of_many_queries_take_bounded_memory():
    import tracemalloc

    import numpy as np

    d = np.random.default_rng(1).standard_normal(40_000) / 8 + 0.001
    tracemalloc.start()
    p, (lo, hi) = stats.paired_randomization(d, 300), stats.bootstrap_ci95(d, 300)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 300 draws at once are 96 MB a matrix
    rng = np.random.default_rng(1)
    signs = rng.integers(0, 2, (300, len(d))) * 2 - 1
    assert p == (int((np.abs((signs * d).mean(1)) >= abs(d.mean()) - 1e-12).sum()) + 1) / 301
    means = np.sort(np.random.default_rng(1).choice(d, (300, len(d))).mean(1))
    assert (lo, hi) == (means[7], means[292])


def test_runs_are_compared_in_order_of_queries(spark):
    from plumbline.operators import evaluate

    a = spark.createDataFrame([(k, g, k / 64) for k in range(50) for g in "xy"] + [(99, "x", None)], "qid long, g string, v double")
    b = spark.createDataFrame([(k, g, (k * 7 % 13) / 16) for k in reversed(range(45)) for g in "xy"], "qid long, g string, v double")
    want = [(k * 7 % 13) / 16 - k / 64 for k in range(45)]
    for r in evaluate.compare_runs(a, b, "g", "v", 200).collect():
        assert (r.n, r.delta, r.p, (r.lo, r.hi)) == (45, sum(want) / 45, stats.paired_randomization(want, 200), stats.bootstrap_ci95(want, 200))
