"""The phases of a resolution after the lexical channels: semantic hits, coherence, aliases, joint readings, affinities, reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import STOPWORDS, norm, tokens
from plumbline.operators import enrich, lexical, resolve, vectors
from plumbline.operators.lexical import CHANNEL_LIMIT, COLUMN
from plumbline.operators.resolve import CANDIDATE, COHERENCE, MARGIN, SELECT_THRESHOLD
from plumbline.sources.catalog import SourceCatalog
from plumbline.sources.sinks import settle

OVERFETCH, MENTIONS, POOL, MOST_HOPS, MOST_PATHS = 4, 4, 4, 2, 4
COLUMN_GAP = 0.05
LEAST_CONTEXT = 3
_FORMS = 1000


@dataclass
class Evidence:
    """What sharpens a resolution beyond the lexical index. Each part may be missing; its phase is then left out.

    nodes, edges: the compiled graph. dense, cards: src_table, src_column, src_rowid, vec of documents and cells,
    and of interpretation cards (keyed by their representative row). column_cards: src_table, src_column, vec.
    spaces: vector table -> model; a table of another model than the embedder's is not used. aliases: (question,
    span) -> other forms; choose: candidates -> verdict in JSON. links: verified links (qid-free) of former runs.
    """

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    embedder: object | None = None
    dense: DataFrame | None = None
    cards: DataFrame | None = None
    column_cards: DataFrame | None = None
    spaces: dict[str, str] = field(default_factory=dict)
    geometry: tuple[float, float] | None = None
    aliases: Callable[[str, str], list[str]] | None = None
    choose: Callable[[list[dict]], str] | None = None
    links: DataFrame | None = None

    def usable(self, table: str) -> DataFrame | None:
        """A vector table if there is one in the embedder's space."""
        df = getattr(self, table)
        return df if df is not None and self.embedder is not None and self.spaces.get(table, self.embedder.model) == self.embedder.model else None


def embedded(texts: DataFrame, embedder: object, *keys: str) -> DataFrame:
    """(keys, vec) of texts (keys, text), in the embedder's query template, batch by batch in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[list(keys)].copy()
            out["vec"] = [[float(x) for x in v] for v in embedder.embed([embedder.template.replace("{query}", t) for t in pdf["text"]])] if len(pdf) else []
            yield out

    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return texts.select(*keys, "text").mapInPandas(run, schema)


def neighbours(targets: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(qid, span, src_table, src_column, src_rowid, cos) of the k nearest rows of a vector table to each target (qid, span, vec)."""
    q = targets.withColumn("tid", F.xxhash64("qid", "span"))
    t = table.withColumn("id", F.xxhash64(*COLUMN, "src_rowid"))
    near = vectors.knn(q.select(F.col("tid").alias("qid"), "vec"), t, k).withColumnRenamed("qid", "tid")
    return near.join(q.select("tid", "qid", "span"), "tid").join(t.select("id", *COLUMN, "src_rowid"), "id").select("qid", "span", *COLUMN, "src_rowid", "cos")


def interp_hits(near: DataFrame, readings: DataFrame, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """Hits of the cards' nearest, without cards whose representative row the index no longer has, with competition ranks.

    readings: interpretations(), which gives the value and the number of rows that share the reading.
    """
    from pyspark.sql import Window

    j = near.join(readings.select(*COLUMN, "src_rowid", "value", "value_norm", "row_count"), [*COLUMN, "src_rowid"])
    span = Window.partitionBy("qid", "span")
    j = j.withColumn("k", F.row_number().over(span.orderBy(F.desc("cos"), *COLUMN, "src_rowid"))).where(F.col("k") <= limit)
    j = j.withColumn("rank", F.rank().over(span.orderBy(F.desc("cos"))) - 1)
    return j.select("qid", "span", *COLUMN, "src_rowid", "value", "value_norm", "row_count", F.lit(False).alias("is_doc"), F.lit("interp").alias("channel"), "rank", F.col("cos").alias("raw"))


def semantic_hits(live: DataFrame, hits: DataFrame, fused: DataFrame, lex: DataFrame, readings: DataFrame, ev: Evidence) -> DataFrame | None:
    """Dense and card hits of the spans that lexical evidence leaves open, the longest four of a question.

    Documents are probed for spans without an exact hit, cards for spans without a strong lexical candidate. fused:
    the lexical candidates.
    """
    dense, cards = ev.usable("dense"), ev.usable("cards")
    if dense is None and cards is None:
        return None
    strong = enrich.strong_lexical(fused).where("strong").select("qid", "span")
    exact = hits.where("channel = 'exact'").select("qid", "span")
    targets = enrich.dense_targets(live, exact if dense is not None else strong)
    vecs = settle(embedded(targets, ev.embedder, "qid", "span"))
    out = vectors.dense_hits(neighbours(vecs, dense, CHANNEL_LIMIT * OVERFETCH), lex) if dense is not None else None
    if cards is not None:
        weak = vecs.join(strong, ["qid", "span"], "left_anti")
        more = interp_hits(neighbours(weak, cards, CHANNEL_LIMIT * OVERFETCH), readings)
        out = more if out is None else out.unionByName(more)
    return out


def terms_of(ev: Evidence) -> DataFrame:
    return ev.nodes.where("kind = 'term'").select(F.col("key").alias("term_key"), F.lower("label").alias("term"))


def co_terms(live: DataFrame, ev: Evidence, most: int = 4) -> DataFrame:
    """(qid, span, term): terms that occur together with a token of the span, four at most in their order."""
    from pyspark.sql import Window

    terms = terms_of(ev)
    e = ev.edges.where("kind = 'cooccurs'").select("src", "dst")
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    mine = live.select("qid", "span", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).where(F.length("token") >= LEAST_CONTEXT)
    j = mine.join(terms, F.col("token") == F.col("term")).join(e, F.col("term_key") == F.col("src"))
    j = j.select("qid", "span", F.col("dst").alias("term_key")).distinct().join(terms, "term_key")
    j = j.withColumn("k", F.row_number().over(Window.partitionBy("qid", "span").orderBy("term"))).where(F.col("k") <= most)
    return j.join(mine.withColumnRenamed("token", "term"), ["qid", "span", "term"], "left_anti").select("qid", "span", "term")


def context_terms(queries: DataFrame, live: DataFrame) -> DataFrame:
    """(qid, span, term): the question's content words outside of the span."""
    from plumbline.functions.text import tokenize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(q, w.lower(), a, b) for q, t in zip(pdf["qid"], pdf["query"]) for w, a, b, _ in tokenize(t or "") if len(w) >= LEAST_CONTEXT and w.lower() not in STOPWORDS]
            yield pd.DataFrame(rows, columns=["qid", "term", "lo", "hi"])

    words = queries.select("qid", "query").mapInPandas(run, "qid long, term string, lo int, hi int")
    return live.select("qid", "span", "start", "end").join(words, "qid").where("hi <= start or lo >= end").select("qid", "span", "term").distinct()


def affinity_columns(ev: Evidence) -> DataFrame:
    """(term, src_table, src_column) of the graph's affinity edges."""
    e = ev.edges.where("kind = 'col_affinity'").join(terms_of(ev), F.col("src") == F.col("term_key"))
    name = F.regexp_replace("dst", "^column:", "")
    return e.select("term", F.substring_index(name, ".", 1).alias("src_table"), F.regexp_replace(name, r"^[^.]*\.", "").alias("src_column")).distinct()


def alias_pass(queries: DataFrame, spans: DataFrame, candidates: DataFrame, ev: Evidence, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """candidates with those of other forms of the spans that no channel found anything for.

    A model proposes forms; they count only through the lexical channels, that is through search (spans -> fused
    candidates), score 0.9 at most, and are marked by the channel alias:form.
    """
    propose = ev.aliases
    none = spans.where("status <> 'skipped'").join(candidates.select("qid", "span").distinct(), ["qid", "span"], "left_anti").join(queries.select("qid", "query"), "qid")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, s, t, query in zip(pdf["qid"], pdf["span"], pdf["text"], pdf["query"]):
                forms = [f.strip() for f in propose(query, t) if f and f.strip() and f.strip().lower() != t.lower()]
                rows += [(q, s * _FORMS + k, f, s) for k, f in enumerate(dict.fromkeys(forms[: _FORMS - 1]))]
            yield pd.DataFrame(rows, columns=["qid", "span", "text", "of"])

    forms = settle(none.select("qid", "span", "text", "query").mapInPandas(run, "qid long, span int, text string, of int"))
    found = search(forms).join(forms.select("qid", "span", "of", F.col("text").alias("form")), ["qid", "span"])
    channel = F.struct(F.concat(F.lit("alias:"), "form").alias("channel"), F.lit(0).alias("rank"), F.lit(1.0).cast("double").alias("raw"))
    key = ["qid", "of", *COLUMN, "src_rowid"]
    new = found.groupBy(*key).agg(
        F.max(F.least("score", F.lit(resolve.CAP))).alias("score"), F.array_sort(F.collect_set(channel)).alias("channels"), F.min("value").alias("value"),
        F.max("is_doc").alias("is_doc"), F.max("row_count").alias("row_count"), F.lit(False).alias("exact"), F.lit(None).cast("double").alias("dense_confidence"),
    ).withColumnRenamed("of", "span")
    new = new.withColumn("place", F.dense_rank().over(_by_span().orderBy(*COLUMN, "src_rowid")) + 9999)
    cols = candidates.columns
    kinds = dict(candidates.dtypes)
    return resolve.reorder(candidates.unionByName(new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in cols])))


def _by_span():
    from pyspark.sql import Window

    return Window.partitionBy("qid", "span")


def table_paths(cat: SourceCatalog, start: str, end: str, inferred: list[tuple[str, str, str, str]] = (), most_hops: int = MOST_HOPS, most: int = MOST_PATHS) -> list[list[tuple]]:
    """Simple paths between two tables over declared and inferred keys, short ones first: hops (column, table, column there, forward, declared)."""
    keys = [(t, c, rt, rc, True) for t in cat.names() for c, rt, rc in cat.tables[t].foreign_keys] + [(*k, False) for k in inferred]
    step: dict[str, list[tuple]] = {}
    for t, c, rt, rc, declared in keys:
        step.setdefault(t, []).append((c, rt, rc, True, declared))
        step.setdefault(rt, []).append((rc, t, c, False, declared))
    out, level = [], [([], [start])]
    for _ in range(most_hops):
        level = [([*p, h], [*seen, h[1]]) for p, seen in level for h in step.get(seen[-1], []) if h[1] not in seen]
        out += [p for p, seen in level if seen[-1] == end]
    return out[:most]


def _along(cat: SourceCatalog, start: DataFrame, path: list[tuple], keep: list[str], unique: bool = False) -> DataFrame:
    """start (with the columns of its table as c_*) joined along a path; the last table's rowid, or a number of its row, is row_b."""
    d = start
    for k, (column, table, there, _, _) in enumerate(path):
        right = cat.frame(table).withColumn("row_b", F.monotonically_increasing_id() if unique else cat.rowid(table))
        right = right.select(*[F.col(c).alias(f"c_{c}") for c in cat.frame(table).columns], "row_b")
        d = d.select(*keep, F.col(f"c_{column}").alias("__on")).join(right, F.col("__on") == F.col(f"c_{there}")).drop("__on")
    return d


def witnessed(cat: SourceCatalog, pairs: DataFrame, inferred: list[tuple[str, str, str, str]] = ()) -> DataFrame:
    """pairs (ta, ca, va, tb, cb, vb: readings in normal form) that a path of keys connects, with the least rows and the path as evidence.

    One join along each path of each pair of columns that occurs, for all values at once; a shorter path's evidence goes first.
    """
    spark, out = pairs.sparkSession, None
    pairs = settle(pairs.distinct())
    for r in pairs.select("ta", "ca", "tb", "cb").distinct().collect():  # pairs of columns of the schema
        for order, path in enumerate(table_paths(cat, r.ta, r.tb, inferred) if r.ta != r.tb else []):
            mine = pairs.where((F.col("ta") == r.ta) & (F.col("ca") == r.ca) & (F.col("tb") == r.tb) & (F.col("cb") == r.cb)).select("va", "vb")
            a = cat.frame(r.ta).withColumn("row_a", cat.rowid(r.ta))
            a = a.select(*[F.col(c).alias(f"c_{c}") for c in cat.frame(r.ta).columns], "row_a", norm(F.col(r.ca)).alias("va")).join(mine.select("va").distinct(), "va", "left_semi")
            d = _along(cat, a, path, ["row_a", "va"]).withColumn("vb", norm(F.col(f"c_{r.cb}")))
            got = d.join(mine, ["va", "vb"]).groupBy("va", "vb").agg(F.min(F.struct("row_a", "row_b")).alias("w"))
            hops = [(h[0] if h[3] else h[2], h[1], h[3], h[4]) for h in path]
            got = got.select(*[F.lit(r[c]).alias(c) for c in ("ta", "ca", "tb", "cb")], "va", "vb", F.col("w.row_a").alias("row_a"), F.col("w.row_b").alias("row_b"), enrich.render_path(F.col("w.row_a"), F.col("w.row_b"), hops, [r.ta]).alias("evidence"), F.lit(order).alias("path_no"))
            out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], "ta string, ca string, tb string, cb string, va string, vb string, row_a long, row_b long, evidence string")
    key = ["ta", "ca", "tb", "cb", "va", "vb"]
    best = out.groupBy(*key).agg(F.min_by(F.struct("row_a", "row_b", "evidence"), "path_no").alias("x"))
    return best.select(*key, "x.row_a", "x.row_b", "x.evidence")


def candidate_key() -> Column:
    return F.concat(F.concat_ws(".", *COLUMN), F.lit("#"), F.col("src_rowid").cast("string"))


def collective_pass(cat: SourceCatalog, spans: DataFrame, candidates: DataFrame, ev: Evidence) -> DataFrame:
    """candidates of the best joint reading of each question's mentions, which connected ones 0.15 higher, with the path as coherence."""
    from pyspark.sql import Window

    chosen = resolve.select_mentions(spans, candidates).where("status = 'selected'").select("qid", "span")
    place = spans.select("qid", "span", "start").join(chosen, ["qid", "span"]).join(candidates.where("place = 0").select("qid", "span", "score"), ["qid", "span"])
    first = Window.partitionBy("qid").orderBy(F.desc("score"), "start")
    place = place.withColumn("k", F.row_number().over(first)).where(F.col("k") <= MENTIONS)
    place = place.withColumn("mention", F.row_number().over(Window.partitionBy("qid").orderBy("start")) - 1).select("qid", "span", "mention")
    pool = settle(candidates.where(F.col("place") < POOL).join(place, ["qid", "span"]).withColumn("key", candidate_key()).withColumn("vn", norm(F.col("value"))))
    side = lambda x: pool.select("qid", F.col("mention").alias(f"m{x}"), F.col("key").alias(f"k{x}"), F.col("src_table").alias(f"t{x}"), F.col("src_column").alias(f"c{x}"), F.col("vn").alias(f"v{x}"))
    both = side("a").join(side("b"), "qid").where("ma < mb and ta <> tb")
    fresh = both.select("ta", "ca", "va", "tb", "cb", "vb").distinct()
    known = None
    if ev.links is not None:
        known = ev.links.select("ta", "ca", "va", "tb", "cb", "vb", F.concat("evidence", F.lit(" [cached]")).alias("evidence"))
        fresh = fresh.join(known, ["ta", "ca", "va", "tb", "cb", "vb"], "left_anti")
    links = witnessed(cat, fresh).select("ta", "ca", "va", "tb", "cb", "vb", "evidence")
    links = links if known is None else links.unionByName(known)
    linked = settle(both.join(links, ["ta", "ca", "va", "tb", "cb", "vb"]).select("qid", F.col("ka").alias("a"), F.col("kb").alias("b"), "evidence"))
    won = settle(resolve.collective(pool.select("qid", "mention", "key", "score", "place"), linked.select("qid", "a", "b")))
    proof = linked.select("qid", F.col("a").alias("key"), F.col("b").alias("other"), "evidence").unionByName(linked.select("qid", F.col("b").alias("key"), F.col("a").alias("other"), "evidence"))
    proof = won.select("qid", "key").join(proof, ["qid", "key"]).join(won.select("qid", F.col("key").alias("other")), ["qid", "other"], "left_semi").groupBy("qid", "key").agg(F.min("evidence").alias("coherence"))
    bonus = pool.select(*CANDIDATE, "key").join(proof, ["qid", "key"]).select(*CANDIDATE, "coherence")
    out = resolve.raised(candidates, bonus, F.lit(COHERENCE))
    return out.join(bonus, CANDIDATE, "left")


def cosines(vecs: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """(qid, keys, cos) of the questions' vectors with a table of cards that candidates name; keys are bounded by the candidates."""
    return table.join(vecs.select("qid", F.col("vec").alias("__q")), "qid").select("qid", *keys, F.round(vectors.cosine(F.col("__q"), F.col("vec")), 9).alias("cos")).where("cos is not null")


def context_affinity(candidates: DataFrame, vecs: DataFrame, ev: Evidence) -> DataFrame:
    """Ties between readings of two columns go to the one whose card is nearer to the question."""
    named = candidates.where("place < 2 and not is_doc").select("qid", *COLUMN, "src_rowid").distinct()
    cos = cosines(vecs, named.join(ev.cards, [*COLUMN, "src_rowid"]), *COLUMN, "src_rowid")
    return enrich.affinity_pass(candidates, cos, [*COLUMN, "src_rowid"]).drop("torn")


def column_affinity(candidates: DataFrame, vecs: DataFrame, ev: Evidence) -> tuple[DataFrame, DataFrame]:
    """candidates after ties went to the column whose card is nearer, and the spans (qid, span) in contention.

    Beyond the margin nothing moves, but if the column nearest to the question of all columns is that of a
    reading that isn't first, by more than 0.05, the span is to be asked about. Cards are a row a column.
    """
    every = ev.column_cards.crossJoin(F.broadcast(vecs.select("qid", F.col("vec").alias("__q"))))
    cos = every.select("qid", *COLUMN, F.round(vectors.cosine(F.col("__q"), F.col("vec")), 9).alias("cos")).where("cos is not null")
    cos = settle(cos)
    out = enrich.affinity_pass(candidates, cos, COLUMN).drop("torn")
    top = cos.groupBy("qid").agg(F.max("cos").alias("most"))
    j = out.where("not is_doc").join(cos, ["qid", *COLUMN]).groupBy("qid", "span").agg(
        F.max("cos").alias("best"), F.max_by(F.struct(*COLUMN), "cos").alias("best_column"), F.min_by(F.struct(*COLUMN), "place").alias("first"), F.min_by("cos", "place").alias("cos"), F.min("place").alias("least"), F.count_distinct(*COLUMN).alias("n")
    )
    j = j.join(top, "qid").where((F.col("least") == 0) & (F.col("n") > 1) & (F.col("best") >= F.col("most")) & (F.col("best_column") != F.col("first")) & (F.col("best") - F.col("cos") > COLUMN_GAP))
    return out, j.select("qid", "span")


def reaches(cat: SourceCatalog, decided: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(qid, span, candidate, reach): how many rows of the grain table each reading in contention of an ambiguous span leads to."""
    from plumbline.operators.graph import grain_table

    grain = grain_table(cat.spark, cat)
    near = decided.where("selected and not is_doc").join(ambiguous.where("ambiguous").select("qid", "span"), ["qid", "span"])
    near = near.withColumn("best", F.max("score").over(_by_span())).where(F.round(F.col("best") - F.col("score"), 9) < MARGIN)
    near = settle(near.select(*CANDIDATE, norm(F.col("value")).alias("vn")))
    out = None
    for r in near.select(*COLUMN).distinct().collect() if grain else []:  # columns of the schema
        path = [] if r.src_table == grain[0] else next(iter(table_paths(cat, r.src_table, grain[0])), None)
        if path is None:
            continue
        mine = near.where((F.col("src_table") == r.src_table) & (F.col("src_column") == r.src_column))
        a = cat.frame(r.src_table)
        a = a.select(*[F.col(c).alias(f"c_{c}") for c in a.columns], cat.rowid(r.src_table).alias("row_b"), norm(F.col(r.src_column)).alias("vn")).join(mine.select("vn").distinct(), "vn", "left_semi")
        d = _along(cat, a, path, ["vn"], unique=True) if path else a
        n = d.groupBy("vn").agg((F.count_distinct("row_b") if path else F.count("*")).alias("reach"))
        got = mine.join(n, "vn").select(*CANDIDATE, "reach")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else near.select(*CANDIDATE, F.lit(0).cast("long").alias("reach")).limit(0)


def divergences(reached: DataFrame) -> DataFrame:
    """(qid, span, divergence): the largest reach over the least, where two or more readings have one."""
    g = reached.where("reach > 0").groupBy("qid", "span").agg(F.max("reach").alias("hi"), F.min("reach").alias("lo"), F.count("*").alias("n"))
    return g.select("qid", "span", F.when(F.col("n") >= 2, F.round(F.col("hi") / F.greatest("lo", F.lit(1)), 9)).otherwise(0.0).alias("divergence"))


def approximate_guard(candidates: DataFrame) -> DataFrame:
    """(qid, span) whose leading candidate would be selected although an approximate search took part: they need the exact search."""
    led = F.exists("channels", lambda c: c["channel"] == "dense_approximate")
    g = candidates.groupBy("qid", "span").agg(F.max(led).alias("approximate"), F.max("score").alias("score"))
    return g.where(F.col("approximate") & (F.col("score") >= SELECT_THRESHOLD)).select("qid", "span")
