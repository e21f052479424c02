from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.engine import Engine, HashEmbedder
from plumbline.sources import datasets
from plumbline.sources.catalog import SourceCatalog, Table
from plumbline.sources.sinks import Checkpoints, Store, check_feedback, dirty, promote_vectors, render_report, write_questions
from plumbline.streaming.refresh import refresh, stream_lexical_values


@pytest.fixture()
def cat(spark, tmp_path):
    d = tmp_path / "src"
    spark.createDataFrame([(1, "Seattle", "open"), (2, "Tacoma ", None), (3, " ", "shut")], "id long, city string, state string").write.parquet(f"{d}/offices.parquet")
    spark.createDataFrame([(1, "Wei Chen", 1), (2, "Dana Chen", 2)], "id long, name string, office_id long").write.parquet(f"{d}/people.parquet")
    return SourceCatalog(spark, str(d), {"offices": Table("offices", "id", ("id",)), "people": Table("people", "id", ("id",), (("office_id", "offices", "id"),))})


def test_catalog(cat):
    assert cat.names() == ["offices", "people"] and cat.text_columns("offices") == ["city", "state"]
    lex = {(r.src_table, r.src_column, r.src_rowid): r.value_norm for r in cat.lexical_values().collect()}
    assert lex[("offices", "city", 2)] == "tacoma" and ("offices", "city", 3) not in lex and len(lex) == 6
    assert {r.artifact: r.fingerprint for r in cat.fingerprints().collect()} == {"offices": "3:3:6", "people": "2:2:3"}
    assert {(r.src_column, r.is_pk, r.fk) for r in cat.schema().where("src_table = 'people'").collect()} == {("id", True, None), ("name", False, None), ("office_id", False, "offices.id")}


def test_refresh_loses_nothing_in_any_order(spark, tmp_path):
    """Tables are dropped, emptied, changed and come back; the rest stays as it was."""
    root, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))

    def put(name, values):
        spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v string").write.mode("overwrite").parquet(f"{root}/{name}.parquet")

    def derived():
        return {(r.src_table, r.value) for r in store.read("lex_values", "src_table string, value string").select("src_table", "value").collect()}

    for n in "abc":
        put(n, [f"{n}1", f"{n}2"])
    tables = {n: Table(n, "id", ("id",)) for n in "abc"}
    refresh(SourceCatalog(spark, root, tables), store)
    want = {(n, f"{n}{k}") for n in "abc" for k in (1, 2)}
    assert derived() == want
    two = {n: tables[n] for n in "ab"}
    assert refresh(SourceCatalog(spark, root, two), store) == [("c", "dropped")] and derived() == {x for x in want if x[0] != "c"}
    put("a", ["a1", "a2", "a3"])
    assert refresh(SourceCatalog(spark, root, two), store) == [("a", "changed")]
    assert derived() == {x for x in want if x[0] != "c"} | {("a", "a3")}
    put("a", [])
    assert refresh(SourceCatalog(spark, root, two), store) == [("a", "changed")] and derived() == {("b", "b1"), ("b", "b2")}
    assert sorted(refresh(SourceCatalog(spark, root, tables), store)) == [("c", "new")] and derived() == {x for x in want if x[0] != "a"}
    put("b", [])
    put("c", [" "])
    refresh(SourceCatalog(spark, root, tables), store, force=True)
    assert derived() == set()
    put("a", ["again"])
    refresh(SourceCatalog(spark, root, tables), store)
    assert derived() == {("a", "again")}


def test_an_overwrite_that_broke_off_is_undone(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.overwrite(spark.range(3), "t")
    store.overwrite(store.read("t").where("id > 0"), "t")
    assert store.read("t").count() == 2
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if it had stopped between the renames
    assert store.read("t").count() == 2 and not (tmp_path / "t.old").exists()


def test_refresh_touches_only_what_changed(spark, cat, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert sorted(refresh(cat, store)) == [("offices", "new"), ("people", "new")]
    assert refresh(cat, store) == [] and store.read("lex_values").count() == 6
    spark.createDataFrame([(3, "Ann Lee", 1)], "id long, name string, office_id long").write.mode("append").parquet(f"{cat.root}/people.parquet")
    assert refresh(cat, store) == [("people", "changed")] and store.read("lex_values").count() == 7
    del cat.tables["people"]
    assert refresh(cat, store) == [("people", "dropped")] and store.read("lex_values").count() == 4
    assert refresh(cat, store, force=True) == [("offices", "new")]


def test_stream_of_arriving_files(spark, cat, tmp_path):
    store, landing = Store(spark, str(tmp_path / "store")), str(tmp_path / "in")
    run = lambda: stream_lexical_values(cat, "people", landing, store, str(tmp_path / "cp")).awaitTermination(60)
    new = lambda k: spark.createDataFrame([(k, f"P {k}", 1)], "id long, name string, office_id long").write.mode("append").parquet(landing)
    new(10)
    run()
    new(11)
    run()
    assert sorted(r.value for r in store.read("lex_stream").collect()) == ["P 10", "P 11"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    s.upsert(a, "t", ["k"])
    s.upsert(spark.createDataFrame([("y", 3), ("z", 4)], "k string, v long"), "t", ["k"])
    assert {(r.k, r.v) for r in s.read("t").collect()} == {("x", 1), ("y", 3), ("z", 4)}
    s.delete("t", spark.createDataFrame([("x",)], "k string"))
    assert s.read("t").count() == 2
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "artifact string, fingerprint string")
    old = spark.createDataFrame([("a", "1", "v"), ("b", "9", "v"), ("c", "3", "u"), ("d", "4", "v")], "artifact string, fingerprint string, version string")
    assert {r.artifact: r.change for r in dirty(now, old, "v").collect()} == {"b": "changed", "c": "version", "d": "dropped"}
    v = spark.createDataFrame([(1, [1.0], "m", "t"), (2, [2.0], "m", "t")], "id long, vec array<double>, model string, template string")
    assert promote_vectors(v).count() == 2
    with pytest.raises(ValueError):
        promote_vectors(v.withColumn("model", F.col("id").cast("string")))
    c = Checkpoints(str(tmp_path / "cp"))
    c.save("a", {"x": 1})
    c.save("b", {})
    c.sweep({"a"})
    assert c.load("a") == {"x": 1} and c.load("b") is None
    assert render_report("<script>{{RUN}}</script>", {"a": "</script>"}) == '<script>{"a": "<\\/script>"}</script>'
    check_feedback({"revision": 1, "presented": [3]}, {"category": "wrong_candidate", "revision": 1, "preferred": 3})
    for bad in ({"category": "x"}, {"category": "correct", "revision": 2}, {"category": "correct", "revision": 1, "preferred": 3}, {"category": "wrong_candidate", "revision": 1, "preferred": 4}):
        with pytest.raises(ValueError):
            check_feedback({"revision": 1, "presented": [3]}, bad)


def test_corpus_and_vector_shards(spark, tmp_path):
    rows = [{"uuid": f"u{k:03d}", "text": "t", "license": "l", "metadata": {"category": None if k % 2 else "c"}} for k in range(50)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "c.parquet")
    got = datasets.read_corpus(spark, str(tmp_path / "c.parquet")).orderBy("uuid").collect()
    assert [r.id for r in got] == list(range(1, 51)) and got[1].category == "" and got[0].category == "c"
    t = pa.table({"uuid": ["u001", "u002", "zz"], "embedding": [[1.0], [2.0], [3.0]]}).replace_schema_metadata({"embedding_model": "m", "embedding_dim": "1"})
    pq.write_table(t, tmp_path / "v.parquet")
    v, missed = datasets.read_vectors(spark, str(tmp_path / "v.parquet"), datasets.read_corpus(spark, str(tmp_path / "c.parquet")))
    assert {(r.id, r.vec[0]) for r in v.collect()} == {(2, 1.0), (3, 2.0)} and missed == 1
    assert datasets.footer_identity(str(tmp_path / "v.parquet")) == {"embedding_model": "m", "embedding_dim": "1"}


def test_question_and_study_files(spark, tmp_path):
    f = tmp_path / "mini.jsonl"
    f.write_text("\n".join(map(json.dumps, [{"type": "header"}, {"question": "q1", "tier": "anchor"}, {"note": 1}, {"id": "x", "question": "q2", "tier": "join", "targets": [{"table": "t", "rowids": [1]}]}])))
    q = datasets.read_questions(spark, str(f)).collect()
    assert [(r.id, r.corpus, r.nil, len(r.targets)) for r in q] == [("mini#2", "mini", False, 0), ("x", "mini", False, 1)]
    out = tmp_path / "out.jsonl"
    write_questions(datasets.read_questions(spark, str(f)), str(out), {"n": 2})
    assert json.loads(out.read_text().splitlines()[0]) == {"type": "header", "n": 2} and datasets.read_questions(spark, str(out)).count() == 2
    f.write_text(json.dumps({"question": "q", "tier": "odd"}))
    with pytest.raises(Exception, match="unknown tier"):
        datasets.read_questions(spark, str(f)).collect()
    s = tmp_path / "s.jsonl"
    s.write_text("\n".join(map(json.dumps, [{"type": "study", "limit": 2}, {"query_id": "a", "candidates": [{"id": "x", "rank": 1}]}])))
    head, d = datasets.read_study(spark, str(s), "study")
    assert head["limit"] == 2 and d.count() == 1
    s.write_text("\n".join(map(json.dumps, [{"type": "study"}, {"query_id": "a", "candidates": [{"rank": 2}]}])))
    with pytest.raises(ValueError):
        datasets.read_study(spark, str(s), "study")
    (tmp_path / "config.json").write_text(json.dumps({"db_path": "x.db", "n": 1}))
    (tmp_path / "sub").mkdir()
    assert datasets.load_config(str(tmp_path / "sub")) == {"db_path": str(tmp_path / "x.db"), "n": 1}


def test_engine(spark, cat):
    e = Engine(cat, HashEmbedder(8))
    assert e.sql("select city from offices order by id", 1) == {"columns": ["city"], "rows": [("Seattle",)], "truncated": True}
    assert e.rows("people", 1)["has_more"] and [r["id"] for r in e.rows("people", 5, q="wei")["rows"]] == [1]
    r = e.resolve(spark.createDataFrame([(1, "who is Wei Chen in Seattle"), (2, "of the")], "qid long, query string"))
    assert {x.qid: x.outcome for x in r["outcomes"].collect()} == {1: "resolved", 2: "unknown"}
    assert {x.value for x in r["candidates"].where("selected").collect()} >= {"Wei Chen", "Seattle"}
    nodes, edges = e.knowledge_graph()
    assert edges.where("kind = 'fk'").count() == 1 and nodes.count() == 8
    assert {x.src_table: x.cells for x in e.store_meta().collect()} == {"offices": 4, "people": 2}
    v = HashEmbedder(8).embed(["a b", "a b"])
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-9
