"""The pipeline against a brute-force version on a small fixture."""

from __future__ import annotations

import random

import corpus_pipeline
from plumbline.llm import mixing, quality_rules
from tests.llm.test_operators import DOC, brute_leaks, brute_pairs, brute_queue, brute_scores, edited, text


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(21)
    rows = [(k, text(r.randint(20, 80), r), f"src{k % 4}") for k in range(80)]
    rows += [(100 + k, edited(rows[k % 5][1], 0.03, r), "src0") for k in range(20)] + [(130, rows[9][1], "src1"), (131, None, "src2"), (132, "", None)]
    rows += [(140 + k, " ".join(w + "***" for w in text(40, r).split()), "src2") for k in range(15)]
    items = [(k, text(25, r)) for k in range(4)]
    rows += [(160 + k, text(10, r) + " " + items[k % 4][1] + " " + text(10, r), "src3") for k in range(8)] + [rows[12], rows[12]]
    labels = [(i, int(not 140 <= i < 155), 0) for i, _, _ in rows if i not in (131, 132)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "old_shard", "new_shard", "moved"]

    good = {i for i, q, _ in labels if q}
    kept = [x for x, (_, n, total) in zip(rows, brute_scores(rows, good)) if n and total >= n * quality_rules.THRESHOLD]
    gone = {i for i, _, _ in rows} - {i for i, _, _ in kept}
    assert gone >= {131, 132, *range(140, 155)} and len(gone) < 40
    groups: dict = {}
    for a, b in brute_pairs(kept, 2, 0.7):
        both = groups.get(a, {a}) | groups.get(b, {b})
        for v in both:
            groups[v] = both
    once = {i: (i, t, s) for i, t, s in kept if i == min(groups.get(i, {i}))}
    kept = list(once.values())
    bad = {i for i, _ in brute_leaks(kept, items, 5, 0.8)}
    assert len(bad) >= 4
    kept = [x for x in kept if x[0] not in bad]
    served = [x[0] for x in brute_queue(kept, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.BUDGET_FRACTION, mixing.SEED)]
    assert sorted(x.doc_id for x in got.collect()) == sorted(served)


def test_stage_contract(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark leaks", "source mix", "shards"]
