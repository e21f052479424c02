"""The engine as one object: SQL console, schema, graph, resolution, examples and store summary."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import enumerate_spans
from plumbline.operators import enrich, graph, lexical, phases, relational, resolve, vectors
from plumbline.operators.admission import Trace, parse
from plumbline.operators.admission import Candidate as Cited
from plumbline.sources.catalog import SourceCatalog
from plumbline.sources.sinks import settle


class Embedder(Protocol):
    """Text to unit vectors, with the identity that a vector table is tied to."""

    model: str
    dimension: int
    template: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: a bag of hashed words."""

    model, template = "hash", "{query}"

    def __init__(self, dimension: int = 32):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        import math
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dimension] += 1.0 if h & 0x10000 else -1.0
            size = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / size for x in v])
        return out


class Engine:
    def __init__(self, catalog: SourceCatalog, embedder: Embedder | None = None):
        self.catalog, self.spark, self.embedder = catalog, catalog.spark, embedder
        self._lex: DataFrame | None = None
        self._index: dict | None = None

    def lex(self) -> DataFrame:
        """The lexical values with their document flag, derived once."""
        if self._lex is None:
            raw = self.catalog.lexical_values()
            self._lex = lexical.with_doc_flag(raw, lexical.typed_profiles(lexical.column_profiles(raw))).persist()
        return self._lex

    def sql(self, statement: str, limit: int = 200) -> dict:
        self.catalog.register()
        return relational.guarded_sql(self.spark, statement, limit)

    def plan(self, statement: str) -> list[dict]:
        self.catalog.register()
        return relational.query_plan(self.spark, statement)

    def schema(self) -> DataFrame:
        return self.catalog.schema()

    def rows(self, table: str, limit: int = 50, after: int | None = None, q: str = "") -> dict:
        """A page of a table in row order, optionally of rows that contain q."""
        df = self.catalog.frame(table).withColumn("rowid", self.catalog.rowid(table))
        if q:
            df = relational.substring_filter(df, self.catalog.text_columns(table), q)
        got = relational.keyset_page(df, "rowid", after, limit).collect()
        return {"rows": [r.asDict() for r in got[:limit]], "has_more": len(got) > limit}

    def knowledge_graph(self) -> tuple[DataFrame, DataFrame]:
        """Schema, keys, inferred keys and frequent values as nodes and edges."""
        nodes, edges = graph.schema_layer(self.catalog)
        inferred = graph.inclusion_dependencies(self.catalog)
        inferred = inferred.select(F.concat(F.lit("table:"), F.substring_index("ref", ".", 1)).alias("src"), F.concat(F.lit("table:"), F.substring_index("key", ".", 1)).alias("dst"), F.lit("inferred_join").alias("kind"), F.concat_ws(" → ", "ref", "key").alias("label"), F.to_json(F.struct("containment")).alias("props"))
        values = graph.frequent_values(self.lex().where("not is_doc"))
        key = F.concat(F.lit("value:"), F.col("src_table"), F.lit("."), F.col("src_column"), F.lit("="), F.col("value_norm"))
        nodes = nodes.unionByName(values.select(key.alias("key"), F.lit("value").alias("kind"), F.col("value_norm").alias("label"), F.to_json(F.struct("n")).alias("props")))
        has = values.select(F.concat(F.lit("column:"), F.col("src_table"), F.lit("."), F.col("src_column")).alias("src"), key.alias("dst"), F.lit("has_value").alias("kind"), F.lit("").alias("label"), F.lit("{}").alias("props"))
        return nodes, edges.unionByName(inferred).unionByName(has)

    def index(self) -> dict:
        """What every resolution reads, derived once: postings, readings, and the index's size and mean lengths."""
        if self._index is None:
            lex = self.lex()
            n, avg = lexical.index_stats(lex)
            self._index = {
                "postings": lexical.postings(lex).persist(), "readings": lexical.interpretations(lex.where("not is_doc")).persist(), "n": n, "avg": avg,
                "grams": lex.agg(F.avg(F.greatest(F.length("value") - 2, F.lit(1)))).first()[0] or 1.0,
            }
        return self._index

    def lexical_hits(self, live: DataFrame) -> DataFrame:
        lex, x = self.lex(), self.index()
        hits = lexical.exact_channel(live, x["readings"]).withColumn("is_doc", F.lit(False))
        hits = hits.unionByName(lexical.ranked_channel(lexical.bm25(lexical.phrase_matches(live, x["postings"]), x["n"], x["avg"]), lex, "bm25"))
        return hits.unionByName(lexical.ranked_channel(lexical.bm25(lexical.trigram_matches(live, lex), x["n"], x["grams"]), lex, "trigram"))

    def resolve(self, queries: DataFrame, evidence: phases.Evidence | None = None) -> dict[str, DataFrame]:
        """spans, candidates, outcomes and clarifications of all (qid, query) at once.

        Phases: lexical channels; semantic channels where they leave a span open; fusion with coherence of documents
        and of context; forms that a model proposes and the index confirms; the best joint reading; affinity of the
        question to cards and to columns; choice of mentions; adjudication; reach of what is still ambiguous. A
        phase whose evidence is missing is left out. candidates has coherence and reach, spans divergence.
        """
        ev = evidence or phases.Evidence()
        spans = enumerate_spans(queries, whole=ev.embedder is not None)
        if ev.nodes is not None:
            known = phases.terms_of(ev).select(F.col("term").alias("low")).distinct().withColumn("kg_alias", F.lit(True))
            spans = spans.withColumn("low", F.lower("text")).join(known, "low", "left").withColumn("kg_alias", F.coalesce("kg_alias", F.lit(False)) & (F.col("status") != "skipped")).drop("low")
        else:
            spans = spans.withColumn("kg_alias", F.lit(False))
        spans = settle(spans)
        live = spans.where("status <> 'skipped'")
        hits = settle(self.lexical_hits(live))
        more = phases.semantic_hits(live, hits, resolve.fuse(hits, live), self.lex(), self.index()["readings"], ev) if ev.embedder is not None else None
        candidates = settle(resolve.fuse(hits if more is None else hits.unionByName(more), live, ev.geometry))
        if ev.edges is not None:
            candidates = resolve.document_coherence(candidates, phases.co_terms(live, ev), self.index()["postings"])
            candidates = resolve.context_coherence(settle(candidates), phases.context_terms(queries, live), phases.affinity_columns(ev))
        if ev.aliases is not None:
            candidates = phases.alias_pass(queries, spans, settle(candidates), ev, lambda forms: resolve.fuse(self.lexical_hits(forms), forms))
        if ev.edges is not None:
            candidates = phases.collective_pass(self.catalog, spans, settle(candidates), ev)
        else:
            candidates = candidates.withColumn("coherence", F.lit(None).cast("string"))
        contended = None
        if ev.usable("cards") is not None or ev.usable("column_cards") is not None:
            vecs = settle(phases.embedded(queries.select("qid", F.col("query").alias("text")), ev.embedder, "qid"))
            if ev.usable("cards") is not None:
                candidates = phases.context_affinity(candidates, vecs, ev)
            if ev.usable("column_cards") is not None:
                candidates, contended = phases.column_affinity(settle(candidates), vecs, ev)
        candidates = settle(candidates)
        chosen = settle(resolve.select_mentions(spans, candidates))
        decided = settle(resolve.decide(candidates, chosen))
        ambiguous = resolve.ambiguous_spans(decided)
        if contended is not None:
            flag = contended.withColumn("contended", F.lit(True))
            ambiguous = ambiguous.join(flag, ["qid", "span"], "left").select("qid", "span", (F.col("ambiguous") | F.coalesce("contended", F.lit(False))).alias("ambiguous"))
        if ev.choose is not None:
            order = enrich.adjudicate(decided, ambiguous, ev.choose).withColumnRenamed("place", "new_place")
            decided = decided.join(order, resolve.CANDIDATE, "left").withColumn("place", F.coalesce("new_place", "place")).drop("new_place")
            decided = settle(decided)
        ambiguous = settle(ambiguous)
        reached = settle(phases.reaches(self.catalog, decided, ambiguous))
        return {
            "spans": spans.drop("status").join(chosen, ["qid", "span"]).join(ambiguous, ["qid", "span"], "left").join(phases.divergences(reached), ["qid", "span"], "left").fillna({"ambiguous": False, "divergence": 0.0}),
            "candidates": decided.join(reached, resolve.CANDIDATE, "left").fillna({"reach": 0}),
            "outcomes": resolve.outcomes(queries, decided, ambiguous),
            "clarifications": resolve.clarifications(decided, ambiguous),
        }

    def propose(self, resolution: dict[str, DataFrame], qid: int, propose: Callable) -> tuple:
        """Admission of SQL for one resolved query; propose is a language model or a script."""
        rows = resolution["candidates"].where((F.col("qid") == qid) & F.col("selected")).orderBy("span", "place").collect()
        trace = Trace()
        for r in rows:
            trace.spans.setdefault(r.span, []).append(Cited(r.src_table, r.src_column, r.value))
        self.catalog.register()
        schema = {t: set(self.catalog.frame(t).columns) for t in self.catalog.names()}
        return parse(self.spark, trace, schema, propose)

    def nearest(self, queries: DataFrame, table: DataFrame, k: int = 8) -> DataFrame:
        return vectors.knn(queries, table, k)

    def examples(self, limit: int = 6) -> list[str]:
        """Some things to ask about: the most frequent values."""
        top = graph.frequent_values(self.lex().where("not is_doc"), 3).orderBy(F.desc("n"), "value_norm").limit(limit).collect()
        return list(dict.fromkeys(r.value_norm for r in top))

    def store_meta(self) -> DataFrame:
        """(src_table, columns, cells, readings) of the lexical index."""
        return self.lex().groupBy("src_table").agg(F.count_distinct("src_column").alias("columns"), F.count("*").alias("cells"), F.count_distinct("src_column", "value_norm").alias("readings"))


def open_engine(spark: SparkSession, root: str) -> Engine:
    from plumbline.sources.catalog import test_tables

    return Engine(test_tables(spark, root))
