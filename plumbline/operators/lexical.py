"""Lexical index and its channels: interpretations, profiles, postings, exact, BM25 and trigram search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import document_boundary, jeffreys
from plumbline.functions.text import norm, tokens

EXACT_MOST_CHARS = 120
CHANNEL_LIMIT = 8
PREWINDOW = 512
DOC_QUOTA = 4
SPREAD = 64  # tasks that the cells of one trigram may go to
COLUMN = ["src_table", "src_column"]
READING = [*COLUMN, "value_norm"]


def interpretations(lex: DataFrame, samples: int = 3) -> DataFrame:
    """One row a reading (table, column, normal form): representative row, its spelling, row count, first sample rows.

    Partial aggregates only: the samples are kept as the few least rowids, never as a list of all.
    """
    first = lex.groupBy(*READING, "src_rowid").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(*READING).orderBy("src_rowid")))
    return ranked.groupBy(*READING).agg(
        F.min("src_rowid").alias("src_rowid"),
        F.min_by("value", "src_rowid").alias("value"),
        F.sum("n").alias("row_count"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= samples, F.col("src_rowid")))).alias("samples"),
    )


def modal_spelling(lex: DataFrame) -> DataFrame:
    """The most frequent spelling of each reading, the least on ties."""
    counts = lex.groupBy(*READING, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*READING).orderBy(F.desc("n"), "value")
    return counts.withColumn("k", F.row_number().over(w)).where("k = 1").select(*READING, "value", "n")


def shapes(v: Column) -> dict[str, Column]:
    """Shape predicates of a normal form."""
    numeric = v.rlike("[0-9]") & ~v.rlike("[^0-9.e+-]")
    as_number = v.try_cast("double")
    epoch = numeric & (as_number.between(1e8, 4e9) | as_number.between(1e11, 4e12))
    iso = v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    uuid = v.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return {
        "alpha": v.rlike("[a-z]"),
        "numeric": numeric,
        "temporal": F.coalesce(epoch, F.lit(False)) | iso,
        "idlike": uuid | v.rlike("^[0-9a-f]{16,}$") | v.rlike("^[0-9]{6,}$"),
    }


def column_profiles(lex: DataFrame) -> DataFrame:
    """One row a text column: counts, shape shares with lower bounds, average and median length. One aggregation."""
    v = F.col("value_norm")
    is_shape = shapes(v)
    p = lex.groupBy(*COLUMN).agg(
        F.count("*").alias("n_values"),
        F.count_distinct("value_norm").alias("n_distinct"),
        F.avg(F.length("value")).alias("avg_len"),
        F.median(F.length("value")).alias("median_len"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in is_shape.items()],
    )
    p = p.withColumn("n_repeated", F.col("n_values") - F.col("n_distinct"))
    for k in [*is_shape, "repeated"]:
        p = p.withColumn(f"{k}_ratio", F.col(f"n_{k}") / F.col("n_values")).withColumn(f"{k}_lcb", jeffreys(F.col(f"n_{k}").cast("double"), F.col("n_values").cast("double")))
    return p


def typed_profiles(profiles: DataFrame) -> DataFrame:
    """profiles with is_document, is_paraphrasable, is_vocabulary. A row a column: the boundary is found on the driver."""
    medians = [r.median_len for r in profiles.select("median_len").collect()]
    _, cut = document_boundary(medians)
    doc = F.log(1 + F.col("median_len")) > cut
    para = (F.col("alpha_ratio") > 0.5) & (F.col("numeric_lcb") <= 0.5) & (F.col("temporal_lcb") <= 0.5) & (F.col("idlike_lcb") <= 0.5)
    return profiles.withColumn("is_document", doc).withColumn("is_paraphrasable", para).withColumn("is_vocabulary", para & ~doc)


def with_doc_flag(lex: DataFrame, typed: DataFrame) -> DataFrame:
    return lex.join(F.broadcast(typed.select(*COLUMN, F.col("is_document").alias("is_doc"))), COLUMN)  # a row a column


def postings(lex: DataFrame) -> DataFrame:
    """(term, src_table, src_column, src_rowid, positions, dl): the inverted index of the cells."""
    one = lex.withColumn("toks", tokens(F.col("value"))).withColumn("dl", F.size("toks"))
    one = one.select(*COLUMN, "src_rowid", "dl", F.posexplode("toks").alias("pos", "term"))
    return one.groupBy("term", *COLUMN, "src_rowid", "dl").agg(F.array_sort(F.collect_list("pos")).alias("positions"))


def vocabulary(index: DataFrame) -> DataFrame:
    """term, document frequency, collection frequency."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


def trigrams(c: Column) -> Column:
    """The distinct three-character pieces of a text in lower case."""
    low = F.lower(c)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substring(low, k, F.lit(3))))


def exact_channel(spans: DataFrame, readings: DataFrame) -> DataFrame:
    """Readings whose normal form is the span's: at most 8 a span, by table and column. spans: qid, span, text."""
    short = readings.where(F.length("value") <= EXACT_MOST_CHARS)
    hit = spans.withColumn("value_norm", norm(F.col("text"))).join(short, "value_norm")
    w = Window.partitionBy("qid", "span").orderBy(*COLUMN)
    hit = hit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= CHANNEL_LIMIT)
    return hit.select("qid", "span", *COLUMN, "src_rowid", "value", "value_norm", "row_count", F.lit("exact").alias("channel"), F.lit(0).alias("rank"), F.lit(1.0).alias("raw"))


def phrase_matches(spans: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, span, table, column, rowid, dl, f): cells that hold the span's tokens side by side, f times.

    One equi-join of all spans' terms with the index; adjacency is a count of terms at one offset.
    """
    terms = spans.withColumn("toks", tokens(F.col("text"))).withColumn("n", F.size("toks")).where("n > 0")
    terms = terms.select("qid", "span", "n", F.posexplode("toks").alias("k", "term"))
    at = terms.join(index, "term").select("qid", "span", "n", "k", *COLUMN, "src_rowid", "dl", F.explode("positions").alias("p"))
    begins = at.groupBy("qid", "span", "n", *COLUMN, "src_rowid", "dl", (F.col("p") - F.col("k")).alias("at")).agg(F.count("*").alias("hit")).where("hit = n")
    return begins.groupBy("qid", "span", *COLUMN, "src_rowid", "dl").agg(F.count("*").alias("f"))


def trigram_matches(spans: DataFrame, lex: DataFrame) -> DataFrame:
    """Cells that contain the span in any case: joined on the span's rarest trigram, then verified. f and dl count trigrams.

    The spans' distinct trigrams are broadcast (there are as many as letters make, not as many as spans), so cells are
    shuffled only for a trigram that is some span's rarest; those of one trigram go to many tasks.
    """
    grams = lex.select(*COLUMN, "src_rowid", "value", F.explode(trigrams(F.col("value"))).alias("g"))
    s = spans.where(F.length("text") >= 3).select("qid", "span", "text", F.explode(trigrams(F.col("text"))).alias("g"))
    df = grams.join(F.broadcast(s.select("g").distinct()), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    rare = s.join(df, "g", "left").withColumn("k", F.row_number().over(Window.partitionBy("qid", "span").orderBy(F.coalesce("df", F.lit(0)), "g"))).where("k = 1 and df > 0").select("qid", "span", "text", "g")
    some = grams.join(F.broadcast(rare.select("g").distinct()), "g", "left_semi").withColumn("part", F.pmod(F.xxhash64(*COLUMN, "src_rowid"), F.lit(SPREAD)).cast("int"))
    hit = rare.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).join(some, ["g", "part"]).where(F.contains(F.lower("value"), F.lower("text")))
    low, part = F.lower("value"), F.lower("text")
    f = (F.length(low) - F.length(F.replace(low, part, F.lit("")))) / F.length(part)
    return hit.select("qid", "span", *COLUMN, "src_rowid", F.greatest(F.length("value") - 2, F.lit(1)).alias("dl"), f.cast("long").alias("f"))


def bm25(matches: DataFrame, n_cells: int, avg_len: float) -> DataFrame:
    """matches with score: k1 1.2, b 0.75, inverse frequency floored at 1e-6. A span's matches are counted in parts, so they needn't be one task's."""
    m = matches.join(matches.groupBy("qid", "span").agg(F.count("f").alias("__n")), ["qid", "span"])
    n = F.col("__n")
    idf = F.log((n_cells - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    f = F.col("f")
    return m.withColumn("score", F.round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("dl") / avg_len)), 9)).drop("__n")


def ranked_channel(scored: DataFrame, lex: DataFrame, channel: str) -> DataFrame:
    """The channel's hits: of a span's best 512 cells, value cells grouped by reading and at most 4 documents a
    column, the best 8 of them all, with competition ranks. lex needs is_doc."""
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("qid", "span").orderBy(F.desc("score"), *COLUMN, "src_rowid"))).where(F.col("k") <= PREWINDOW)
    # by hash on both sides: as a late broadcast, a task would read all the cells that one task of lex wrote
    best = best.hint("shuffle_hash").join(lex.select(*COLUMN, "src_rowid", "value", "value_norm", "is_doc"), [*COLUMN, "src_rowid"])
    values = best.where("not is_doc").groupBy("qid", "span", *READING).agg(
        F.min("src_rowid").alias("src_rowid"), F.min("value").alias("value"), F.max("score").alias("raw"), F.count("*").alias("row_count"), F.lit(False).alias("is_doc")
    )
    quota = Window.partitionBy("qid", "span", *COLUMN).orderBy(F.desc("score"), "src_rowid")
    docs = best.where("is_doc").withColumn("q", F.row_number().over(quota)).where(F.col("q") <= DOC_QUOTA)
    docs = docs.select("qid", "span", *READING, "src_rowid", "value", F.col("score").alias("raw"), F.lit(1).cast("long").alias("row_count"), "is_doc")
    both = values.unionByName(docs)
    top = Window.partitionBy("qid", "span").orderBy(F.desc("raw"), *COLUMN, "src_rowid")
    both = both.withColumn("k", F.row_number().over(top)).where(F.col("k") <= CHANNEL_LIMIT)
    rank = F.rank().over(Window.partitionBy("qid", "span").orderBy(F.desc("raw"))) - 1
    return both.withColumn("rank", rank).select("qid", "span", *COLUMN, "src_rowid", "value", "value_norm", "row_count", "is_doc", F.lit(channel).alias("channel"), "rank", "raw")


def index_stats(lex: DataFrame) -> tuple[int, float]:
    n, total = lex.agg(F.count("*"), F.sum(F.size(tokens(F.col("value"))))).first()
    return n or 0, (total or 0) / max(n or 0, 1)


def snippet(value: Column, span: Column, around: int = 40) -> Column:
    """The first hit with brackets around it and some text on both sides."""
    at = F.position(F.lower(span), F.lower(value))
    start = F.greatest(at - around, F.lit(1))
    before = F.substring(value, start, at - start)
    hit = F.substring(value, at, F.length(span))
    after = F.substring(value, at + F.length(span), F.lit(around))
    lead = F.when(start > 1, "…").otherwise("")
    tail = F.when(F.length(value) > at + F.length(span) + around - 1, "…").otherwise("")
    return F.when(at > 0, F.concat(lead, before, F.lit("⟨"), hit, F.lit("⟩"), after, tail))


def column_cards(cells: DataFrame, most_chars: int = 300) -> DataFrame:
    """(src_table, src_column, card): 't.c · n distinct values · e.g. v1, v2', frequent values first, while they fit.

    cells: src_table, src_column, value (any column cast to text). Packing stops at the first value that overflows.
    """
    counts = cells.where("value is not null and trim(value) <> ''").groupBy(*COLUMN, "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "value")
    head = F.concat(F.col("src_table"), F.lit("."), F.col("src_column"), F.lit(" · "), F.col("d").cast("string"), F.lit(" distinct values · e.g. "))
    r = counts.withColumn("d", F.count("*").over(Window.partitionBy(*COLUMN))).withColumn("k", F.row_number().over(w)).where("k <= 150")
    r = r.withColumn("used", F.length(head) + F.sum(F.length("value") + 2).over(w) - 2)
    r = r.withColumn("over", F.max(F.when(F.col("used") > most_chars, 1).otherwise(0)).over(w))
    packed = r.groupBy(*COLUMN, "d").agg(F.array_sort(F.collect_list(F.when(F.col("over") == 0, F.struct("k", "value")))).alias("v"))
    return packed.select(*COLUMN, F.concat(head, F.array_join(F.transform("v", lambda x: x["value"]), ", ")).alias("card"))


def copied_pairs(lex: DataFrame) -> DataFrame:
    """Column pairs that share more than half of the smaller one's vocabulary: copies or keys, no ambiguity."""
    v = lex.select(*READING).distinct()
    size = v.groupBy(*COLUMN).agg(F.count("*").alias("n"))
    key = F.concat_ws(".", *COLUMN)
    a = v.select(key.alias("a"), "value_norm")
    b = v.select(key.alias("b"), "value_norm")
    n = size.select(key.alias("key"), "n")
    shared = a.join(b, "value_norm").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(n.select(F.col("key").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b")
    return out.withColumn("copied", 2 * F.col("shared") > F.least("na", "nb"))


def ambiguous_vocabulary(lex: DataFrame) -> DataFrame:
    """(src_table, src_column, value_norm) of values that two columns share which aren't copies of each other."""
    v = lex.select(*READING).distinct().withColumn("key", F.concat_ws(".", *COLUMN))
    ok = copied_pairs(lex).where("not copied").select("a", "b")
    pairs = v.select("value_norm", F.col("key").alias("a")).join(v.select("value_norm", F.col("key").alias("b")), "value_norm").join(ok, ["a", "b"])
    shared = pairs.select("value_norm", F.explode(F.array("a", "b")).alias("key")).distinct()
    return v.join(shared, ["value_norm", "key"], "left_semi").select(*READING)


def queue_actions(cells: DataFrame, queue: DataFrame, vectors: DataFrame) -> DataFrame:
    """What to do with each cell against the embedding queue: new, changed, requeue (done but its vector is gone), keep; drop for queue rows without a cell.

    cells and queue: src_table, src_column, src_rowid, content_hash (and status in queue); vectors: the three keys.
    """
    key = [*COLUMN, "src_rowid"]
    q = queue.select(*key, F.col("content_hash").alias("old_hash"), "status")
    j = cells.select(*key, "content_hash").join(q, key, "full").join(vectors.select(*key).distinct().withColumn("covered", F.lit(True)), key, "left")
    action = (
        F.when(F.col("content_hash").isNull(), "drop")
        .when(F.col("status").isNull(), "new")
        .when((F.col("old_hash") != "") & (F.col("old_hash") != F.col("content_hash")), "changed")
        .when((F.col("status") == "done") & F.col("covered").isNull(), "requeue")
        .otherwise("keep")
    )
    return j.select(*key, action.alias("action"))
