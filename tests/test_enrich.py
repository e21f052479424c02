from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.engine import HashEmbedder
from plumbline.operators import enrich, lexical

LEX = "src_table string, src_column string, src_rowid long, value string, value_norm string"


def test_cards_take_strict_majorities(spark):
    rows = [("p", "kind", k, "Widget") for k in range(3)] + [("p", "brand", k, "Acme" if k < 2 else "Zeta") for k in range(3)] + [("p", "name", k, f"n{k}") for k in range(3)]
    lex = spark.createDataFrame([(t, c, i, v, v.lower()) for t, c, i, v in rows], LEX)
    cards = {r.value_norm: r.card for r in enrich.interpretation_cards(lex, lex.select(*lexical.READING)).collect()}
    assert cards["widget"] == "p · kind · Widget · brand: Acme" and cards["zeta"] == "p · brand · Zeta · kind: Widget · name: n2"


def test_boundary_hysteresis():
    first = enrich.adopt_boundary(None, [9, 36, 57, 2660, 16151])
    assert enrich.adopt_boundary(first, [10, 37, 58, 2700, 16000]) == first
    assert enrich.adopt_boundary(first, [9, 36, 57, 150, 16151]) == first  # the cut would move, but no column changes sides
    assert enrich.adopt_boundary(("cut", 9.0), [9, 36, 57, 2660, 16151]) == first


def test_link_cache_keeps_one_generation(spark):
    cache = spark.createDataFrame([("b", "a", "p", "g1"), ("x", "y", "q", "g0")], "a string, b string, path string, generation string")
    new = spark.createDataFrame([("a", "b", "p2"), ("c", "d", "r")], "a string, b string, path string")
    assert {tuple(r) for r in enrich.record_links(cache, new, "g1").collect()} == {("a", "b", "p", "g1"), ("c", "d", "r", "g1")}


def test_affinity_moves_only_clear_ties(spark):
    c = spark.createDataFrame([(1, 0, "t", "a", 1, 0.60, 0), (1, 0, "t", "b", 2, 0.58, 1), (1, 1, "t", "a", 1, 0.60, 0), (1, 1, "t", "c", 3, 0.58, 1), (1, 2, "t", "a", 1, 0.9, 0), (1, 2, "t", "b", 2, 0.5, 1)], "qid long, span int, src_table string, src_column string, src_rowid long, score double, place int")
    cos = spark.createDataFrame([(1, "t", "a", 0.2), (1, "t", "b", 0.5), (1, "t", "c", 0.22)], "qid long, src_table string, src_column string, cos double")
    got = {(r.span, r.src_column): (r.score, r.place, r.torn) for r in enrich.affinity_pass(c, cos).collect()}
    assert got[0, "b"] == (0.62, 0, False) and got[1, "a"] == (0.6, 0, True) and got[2, "a"] == (0.9, 0, False) and got[2, "b"][1] == 1
    assert {r.src_column: r.card_rank for r in enrich.card_ranks(cos).collect()} == {"b": 0, "c": 1, "a": 2}


def test_templates():
    assert enrich.resolve_template("q {query}", None, "x") == "q {query}" and enrich.resolve_template(None, None, "x") == "{query}"
    with pytest.raises(ValueError):
        enrich.resolve_template("a", "b", "x")


def test_drain_counts_attempts(spark):
    class Picky(HashEmbedder):
        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return super().embed(texts)

    q = spark.createDataFrame([(1, "good", 0), (2, "bad", 0), (3, "bad", 2)], "id long, serialized string, attempts long")
    got = {r.id: r for r in enrich.drain(q, lambda: Picky(4), 4).collect()}
    assert got[1].status == "done" and len(got[1].vec) == 4 and (got[2].status, got[2].attempts) == ("pending", 1) and (got[3].status, got[3].error) == ("failed", "no")
    assert enrich.drain(q.where("id = 1"), lambda: HashEmbedder(3), 4).first().error == "dimension 3"


def test_aliases_count_only_if_the_data_hold_them(spark):
    readings = spark.createDataFrame([("u", "state", "california", 4, "California", 3)], "src_table string, src_column string, value_norm string, src_rowid long, value string, row_count long")
    hits = enrich.alias_hits(spark.createDataFrame([(1, 0, "California "), (1, 0, "Canada")], "qid long, span int, form string"), readings)
    assert [r.channel for r in hits.collect()] == ["alias:California "]
    cand = spark.createDataFrame([(1, 0, "u", "name", 1, "CA", 1, 0.5, 0)], "qid long, span int, src_table string, src_column string, src_rowid long, value string, row_count long, score double, place int")
    assert [(r.value, r.score) for r in enrich.merge_alias(cand, hits).orderBy("place").collect()] == [("California", 0.9), ("CA", 0.5)]


def test_adjudication_only_reorders(spark):
    d = spark.createDataFrame([(1, 0, "t", c, k, c, k, True) for k, c in enumerate("abc")], "qid long, span int, src_table string, src_column string, src_rowid long, value string, place int, selected boolean")
    amb = spark.createDataFrame([(1, 0, True)], "qid long, span int, ambiguous boolean")
    order = lambda reply: [r.src_column for r in enrich.adjudicate(d, amb, lambda cs: reply).orderBy("place").collect()]
    assert order('{"choice": 2}') == ["c", "a", "b"] and order('{"choice": "nil"}') == ["a", "b", "c"] and order("junk") == ["a", "b", "c"] and order('{"choice": 7}') == ["a", "b", "c"]


def test_paths_history_and_stats(spark):
    row = spark.range(1).select(enrich.render_path(F.lit(2), F.lit(43), [("lead_id", "teams", False, True), ("x", "y", True, False)], ["people"]).alias("p")).first()
    assert row.p == "people #2 ←lead_id— teams —x?→ y #43"
    log = spark.createDataFrame([("a", 1, "ui"), ("a", 5, "api"), ("b", 3, "ui")], "query string, asked_at long, source string")
    assert [(r["query"], r.asked_at, r.source) for r in enrich.history(log).collect()] == [("a", 5, "ui"), ("b", 3, "ui")]
    n = spark.createDataFrame([("x", "table"), ("y", "table")], "key string, kind string")
    assert {(r.what, r.kind, r.n) for r in enrich.graph_stats(n, n.limit(1)).collect()} == {("node", "table", 2), ("edge", "table", 1)}
