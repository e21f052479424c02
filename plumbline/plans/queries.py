"""The reference-level operators as queries over whole test tables, each with its SQL where SQL can give the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import evaluate as ev
from plumbline.operators import enrich, graph, lexical, mining, relational, resolve, vectors
from plumbline.sources.catalog import test_tables

FLAGSHIP = "resolve_candidates"
LEX = ["customer", "nation", "part", "region", "supplier"]
#: Questions for the resolution queries: (qid, query).
QUESTIONS = [
    (1, "urgent building customers in France"),
    (2, "Which suppliers are in the United Kingdom"),
    (3, "small polished brass"),
    (4, "the of and"),
    (5, "europe machinery 1"),
    (6, "Customer#000000011 asia"),
    (7, "GERMANY and germany"),
]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lex(spark: SparkSession, d: str) -> DataFrame:
    return test_tables(spark, d).lexical_values(LEX)


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


_COLS = [("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("nation", "n_nationkey", ["n_name"]), ("part", "p_partkey", ["p_name", "p_brand", "p_type"]), ("region", "r_regionkey", ["r_name"]), ("supplier", "s_suppkey", ["s_name"])]
LEX_SQL = "lex as (" + " union all ".join(
    f"select '{t}' src_table, '{c}' src_column, cast({k} as bigint) src_rowid, {c} as value, lower(trim({c})) value_norm from {t} where {c} is not null and trim({c}) <> ''" for t, k, cs in _COLS for c in cs
) + ")"
_ALL = [
    ("benchmark", "item_id", ["text"]), ("conversations", "conv_id * 1000 + turn", ["role", "text"]), ("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("documents", "doc_id", ["text", "lang", "source"]),
    ("events", "event_id", ["event_type", "props"]), ("lineitem", "l_orderkey", ["l_returnflag", "l_linestatus"]), ("nation", "n_nationkey", ["n_name"]), ("orders", "o_orderkey", ["o_orderstatus", "o_orderpriority"]),
    ("pages", "page_id", ["url", "html"]), ("part", "p_partkey", ["p_name", "p_brand", "p_type"]), ("region", "r_regionkey", ["r_name"]), ("supplier", "s_suppkey", ["s_name"]),
]
ALL_SQL = "lex as (" + " union all ".join(
    f"select '{t}' src_table, '{c}' src_column, cast({k} as bigint) src_rowid, {c} as value, lower(trim({c})) value_norm from {t} where {c} is not null and trim({c}) <> ''" for t, k, cs in _ALL for c in cs
) + ")"
_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def toks_sql(c: str) -> str:
    return _TOK.format(c)


# sources, projections, filters


@query(f"with {ALL_SQL} select * from lex")
def lexical_values(spark, d):
    return test_tables(spark, d).lexical_values()


_FP = " union all ".join(f"select '{t}' artifact, concat_ws(':', count(*), coalesce(max({k}), 0), coalesce(cast(sum({k}) as bigint), 0)) fingerprint from {t}" for t, k in [("customer", "c_custkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id"), ("documents", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id"), ("labels", "doc_id"), ("region", "r_regionkey"), ("conversations", "conv_id * 1000 + turn")])


@query(_FP)
def table_fingerprints(spark, d):
    return test_tables(spark, d).fingerprints()


@query()
def source_schema(spark, d):
    return test_tables(spark, d).schema()


@query("select p_partkey, p_name, p_type from part where contains(lower(p_name), 'an') or contains(lower(p_type), 'an')")
def substring_filter(spark, d):
    return relational.substring_filter(_read(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], "AN")


@query("select doc_id, lang, source from documents where doc_id > 100 order by doc_id limit 51")
def keyset_page(spark, d):
    return relational.keyset_page(_read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", 100, 50)


@query("select doc_id, case when length(text) > 400 then left(text, 400) || '…' else text end shown, length(text) > 160 clipped from documents")
def display_clip(spark, d):
    return _read(spark, d, "documents").select("doc_id", relational.display(F.col("text")).alias("shown"), (F.length("text") > 160).alias("clipped"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k, value from events where json_extract_string(props, '$.k') is not null")
def json_fields(spark, d):
    e = _read(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "value").where("k is not null")


# joins, sets


@query("select c_custkey, c_name, count(o_orderkey) n_orders, round(coalesce(sum(o_totalprice), 0), 2) total from customer left join orders on c_custkey = o_custkey group by all")
def left_join_counts(spark, d):
    o = _read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))  # aggregated before the join
    j = _read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("select d.doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_join(spark, d):
    return _read(spark, d, "documents").select("doc_id", "source").join(_read(spark, d, "labels"), "doc_id", "left_anti")


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_returnflag = 'R')")
def semi_join(spark, d):
    return _read(spark, d, "supplier").join(_read(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@query("select n_name, r_name, cast(count(*) as bigint) lines, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def join_chain(spark, d):
    li, o, c = _read(spark, d, "lineitem"), _read(spark, d, "orders"), _read(spark, d, "customer")
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_nationkey").agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return g.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", "lines", F.round("revenue", 2).alias("revenue"))


@query("(select o_custkey k from orders except select user_id from events) union all (select user_id from events except select o_custkey from orders)")
def except_both_ways(spark, d):
    a, b = _read(spark, d, "orders").select(F.col("o_custkey").alias("k")), _read(spark, d, "events").select(F.col("user_id").alias("k"))
    return a.subtract(b).unionByName(b.subtract(a))


# aggregates, windows, top-k


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc,
  round(avg(l_quantity), 6) avg_qty, round(avg(l_discount), 6) avg_disc, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, d):
    li = _read(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query(f"""with {LEX_SQL} select src_table, src_column, value_norm, min(src_rowid) src_rowid, min_by(value, src_rowid) as value, count(*) row_count,
  array_to_string(list_slice(list_sort(list(distinct src_rowid)), 1, 3), ',') samples from lex group by all""".replace("group by all", "group by src_table, src_column, value_norm"))
def interpretations(spark, d):
    return lexical.interpretations(_lex(spark, d)).withColumn("samples", F.array_join("samples", ","))


@query("""select source, lang, n from (select source, lang, count(*) n, row_number() over (partition by source order by count(*) desc, lang) k from documents group by source, lang) where k = 1""")
def mode_with_tie_break(spark, d):
    n = _read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "lang"))).where("k = 1").select("source", "lang", "n")


@query("""select source, lang, n, cast(total as bigint) total from (select source, lang, count(*) n, sum(count(*)) over (partition by source) total from documents group by source, lang) where 2 * n > total""")
def strict_majority(spark, d):
    n = _read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("source"))).where("2 * n > total")


@query(f"""with {LEX_SQL}, n as (select src_table, src_column, value_norm, count(*) n from lex group by all having count(*) >= 2)
select *, cast(rank as int) rank from (select *, row_number() over (partition by src_table, src_column order by n desc, value_norm) rank from n) where rank <= 10""".replace("select *, cast(rank as int) rank from", "select src_table, src_column, value_norm, n, cast(rank as int) rank from"))
def frequent_values(spark, d):
    return graph.frequent_values(_lex(spark, d))


@query(f"""with {LEX_SQL} select src_table, src_column, count(*) n_values, count(distinct value_norm) n_distinct, round(avg(length(value)), 6) avg_len, cast(median(length(value)) as double) median_len,
  count(*) filter (regexp_matches(value_norm, '[a-z]')) n_alpha, count(*) filter (regexp_matches(value_norm, '[0-9]') and not regexp_matches(value_norm, '[^0-9.e+-]')) n_numeric,
  count(*) filter (regexp_matches(value_norm, '^[0-9]{{6,}}$') or regexp_matches(value_norm, '^[0-9a-f]{{16,}}$')) n_idlike, round(count_if(regexp_matches(value_norm, '[a-z]')) / count(*), 9) alpha_ratio from lex group by all""")
def column_profiles(spark, d):
    p = lexical.column_profiles(_lex(spark, d))
    return p.select("src_table", "src_column", "n_values", "n_distinct", F.round("avg_len", 6).alias("avg_len"), "median_len", "n_alpha", "n_numeric", "n_idlike", F.round("alpha_ratio", 9).alias("alpha_ratio"))


@query()
def column_types(spark, d):
    return lexical.typed_profiles(lexical.column_profiles(test_tables(spark, d).lexical_values([*LEX, "documents", "benchmark", "conversations", "orders"]))).select("src_table", "src_column", "alpha_lcb", "numeric_lcb", "is_document", "is_paraphrasable", "is_vocabulary")


@query("select event_type, list_sort(list(value))[least(greatest(cast(ceil(count(*) * cast(0.95 as double)) as int), 1), count(*))] p95 from events where value is not null group by event_type")
def nearest_rank_p95(spark, d):
    return _read(spark, d, "events").where("value is not null").groupBy("event_type").agg(ev.nearest_rank_percentile("value", 0.95).alias("p95"))


@query("""select user_id, event_id, ts, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) k from events) where k = 1""")
def keep_last(spark, d):
    return relational.keep_last(_read(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "event_type")


@query("""select l_suppkey, l_partkey, round(rev, 2) rev, cast(k as int) k from (select l_suppkey, l_partkey, sum(l_extendedprice) rev, row_number() over (partition by l_suppkey order by sum(l_extendedprice) desc, l_partkey) k from lineitem group by 1, 2) where k <= 3""")
def top_k_per_group(spark, d):
    g = _read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("rev"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("rev"), "l_partkey")
    return g.withColumn("k", F.row_number().over(w)).where("k <= 3").select("l_suppkey", "l_partkey", F.round("rev", 2).alias("rev"), "k")


@query("select c_custkey, c_nationkey, c_acctbal, cast(rank() over (partition by c_nationkey order by c_acctbal desc) - 1 as int) place from customer")
def competition_rank(spark, d):
    c = _read(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", "c_acctbal", (F.rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"))) - 1).alias("place"))


@query("""select conv_id, count(*) turns, min(turn) first_turn, min_by(text, case when role = 'user' then turn end) opening from conversations group by conv_id""")
def conversation_list(spark, d):
    return relational.conversation_list(_read(spark, d, "conversations"))


@query("""with s as (select conv_id, turn, text, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) used from conversations)
select conv_id, turn, text from s where turn < coalesce((select min(turn) from s b where b.conv_id = s.conv_id and b.used > 2000), 1000000000)""")
def packed_prefix(spark, d):
    return relational.packed_prefix(_read(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"], F.length("text"), 2000)


@query("select doc_id, source, lang, cast(row_number() over (partition by source, lang order by md5(cast(doc_id as varchar)), doc_id) as int) round from documents")
def stratified_rounds(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "source", "lang")
    return relational.stratified(docs, ["source", "lang"], F.md5(F.col("doc_id").cast("string")), "doc_id")


# lexical index


@query(f"""with t as (select doc_id, unnest({toks_sql('text')}) term from documents) select term, count(distinct doc_id) df, count(*) cf from t group by term""")
def vocabulary(spark, d):
    docs = _read(spark, d, "documents")
    t = docs.select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))  # partial sums before the distinct count
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def _questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "qid long, query string")


def _spans(spark) -> DataFrame:
    return tx.enumerate_spans(_questions(spark))


def _span_values() -> str:
    """The questions' spans in SQL: tokens are runs of letters and digits, a span is a run of one to four of them."""
    asked = ", ".join(f"({q}, '{t}')" for q, t in QUESTIONS)
    stop = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))
    return f"""asked as (select * from (values {asked}) v(qid, query)),
chars as (select qid, query, i, substr(query, cast(i as int), 1) ch from (select qid, query, unnest(range(1, length(query) + 1)) i from asked)),
flags as (select *, regexp_matches(ch, '[\\p{{L}}\\p{{N}}]') inside from chars),
begun as (select *, inside and not coalesce(lag(inside) over (partition by qid order by i), false) first from flags),
numbered as (select *, sum(cast(first as int)) over (partition by qid order by i) tok from begun),
placed as (select *, octet_length(encode(substr(query, 1, cast(i as int)))) upto from numbered where inside),
words as (select qid, any_value(query) query, tok, min(i) lo, max(i) hi, min(upto - octet_length(encode(ch))) a, max(upto) b, lower(string_agg(ch, '' order by i)) word from placed group by qid, tok),
spans as (select x.qid, cast(row_number() over (partition by x.qid order by x.tok, y.tok) - 1 as int) span, substr(x.query, cast(x.lo as int), cast(y.hi - x.lo + 1 as int)) as text, cast(x.a as int) start_, cast(y.b as int) end_, cast(y.tok - x.tok + 1 as int) n_tokens,
  case when exists (select 1 from words z where z.qid = x.qid and z.tok between x.tok and y.tok and z.word not in ({stop})) then 'selected' else 'skipped' end status
  from words x join words y on x.qid = y.qid and y.tok between x.tok and x.tok + 3)"""


@query(f'with {_span_values()} select qid, span, text, start_ as "start", end_ as "end", n_tokens, status from spans')
def span_enumeration(spark, d):
    return _spans(spark)


_READ_SQL = "readings as (select src_table, src_column, value_norm, min(src_rowid) src_rowid, min_by(value, src_rowid) as value, count(*) row_count from lex group by 1, 2, 3)"


@query(f"""with {LEX_SQL}, {_span_values()}, {_READ_SQL} select * from (select qid, span, src_table, src_column, src_rowid, r.value, value_norm, row_count, row_number() over (partition by qid, span order by src_table, src_column) k
  from spans s join readings r on lower(trim(s.text)) = r.value_norm and length(r.value) <= 120 where status <> 'skipped') where k <= 8""".replace("select * from (select", "select qid, span, src_table, src_column, src_rowid, value, value_norm, row_count from (select", 1))
def exact_channel(spark, d):
    live = _spans(spark).where("status <> 'skipped'")
    return lexical.exact_channel(live, lexical.interpretations(_lex(spark, d))).select("qid", "span", "src_table", "src_column", "src_rowid", "value", "value_norm", "row_count")


_PHRASE = f"""cells as (select *, {toks_sql('value')} toks from lex), st as (select *, {toks_sql('text')} toks from spans where status <> 'skipped'),
terms as (select qid, span, len(toks) n, unnest(toks) term, unnest(range(len(toks))) k from st), pos as (select src_table, src_column, src_rowid, len(toks) dl, unnest(toks) term, unnest(range(len(toks))) p from cells),
m as (select qid, span, src_table, src_column, src_rowid, dl, count(*) f from (select qid, span, n, src_table, src_column, src_rowid, dl, p - k at_ from terms join pos using (term) group by all having count(*) = any_value(n)) group by all)"""


@query(f"""with {LEX_SQL}, {_span_values()}, {_PHRASE}, stats as (select count(*) c, sum(len(toks)) / count(*) avgdl from cells), n as (select qid, span, count(*) n from m group by all)
select qid, span, src_table, src_column, src_rowid, f, round(greatest(case when ln((c - n + 0.5) / (n + 0.5)) <= 0 then 1e-6 else ln((c - n + 0.5) / (n + 0.5)) end, 0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9) score
from m join n using (qid, span), stats""".replace("-- ", ""))
def bm25_phrase(spark, d):
    lex = _lex(spark, d)
    n, avg = lexical.index_stats(lex)
    live = _spans(spark).where("status <> 'skipped'")
    return lexical.bm25(lexical.phrase_matches(live, lexical.postings(lex)), n, avg).select("qid", "span", "src_table", "src_column", "src_rowid", "f", "score")


@query(f"""with {LEX_SQL}, {_span_values()} select qid, span, src_table, src_column, src_rowid from spans s join lex l on length(s.text) >= 3 and contains(lower(l.value), lower(s.text)) where status <> 'skipped'""")
def trigram_channel(spark, d):
    live = _spans(spark).where("status <> 'skipped'")
    return lexical.trigram_matches(live, _lex(spark, d)).select("qid", "span", "src_table", "src_column", "src_rowid")


@query(f"""with {LEX_SQL}, c as (select src_table, src_column, value, count(*) n from lex group by all),
r as (select *, count(*) over (partition by src_table, src_column) d, row_number() over (partition by src_table, src_column order by n desc, value) k from c),
h as (select *, src_table || '.' || src_column || ' · ' || d || ' distinct values · e.g. ' head from r),
u as (select *, length(head) + sum(length(value) + 2) over (partition by src_table, src_column order by k rows unbounded preceding) - 2 used from h),
o as (select *, max(case when used > 300 then 1 else 0 end) over (partition by src_table, src_column order by k rows unbounded preceding) over_ from u)
select src_table, src_column, any_value(head) || coalesce(string_agg(case when over_ = 0 then value end, ', ' order by k), '') card from o group by src_table, src_column""")
def column_cards(spark, d):
    return lexical.column_cards(_lex(spark, d))


@query(f"""with {ALL_SQL}, v as (select distinct src_table || '.' || src_column k, value_norm from lex), n as (select k, count(*) n from v group by k),
p as (select x.k a, y.k b, count(*) shared from v x join v y on x.value_norm = y.value_norm and x.k < y.k group by all)
select a, b, shared, na.n na, nb.n nb, 2 * shared > least(na.n, nb.n) copied from p join n na on na.k = a join n nb on nb.k = b""")
def copied_columns(spark, d):
    return lexical.copied_pairs(test_tables(spark, d).lexical_values()).select("a", "b", "shared", "na", "nb", "copied")


@query("""with cells as (select 'documents' src_table, 'text' src_column, doc_id src_rowid, md5(text) content_hash from documents),
queue as (select 'documents' src_table, 'text' src_column, case when doc_id % 5 < 3 then doc_id else -1 - doc_id end src_rowid, case when doc_id % 3 = 0 then 'stale' else md5(text) end old_hash, case when doc_id % 2 = 0 then 'done' else 'pending' end status from documents),
vec as (select distinct doc_id src_rowid from labels),
j as (select coalesce(c.src_rowid, q.src_rowid) src_rowid, content_hash, old_hash, status from cells c full join queue q using (src_table, src_column, src_rowid))
select 'documents' src_table, 'text' src_column, j.src_rowid, case when content_hash is null then 'drop' when status is null then 'new' when old_hash <> '' and old_hash <> content_hash then 'changed' when status = 'done' and v.src_rowid is null then 'requeue' else 'keep' end as action
from j left join vec v on v.src_rowid = j.src_rowid""")
def queue_actions(spark, d):
    docs = _read(spark, d, "documents")
    key = [F.lit("documents").alias("src_table"), F.lit("text").alias("src_column")]
    cells = docs.select(*key, F.col("doc_id").alias("src_rowid"), F.md5("text").alias("content_hash"))
    place = F.when(F.col("doc_id") % 5 < 3, F.col("doc_id")).otherwise(-1 - F.col("doc_id"))  # the others are queued under rows that aren't there
    queue = docs.select(*key, place.alias("src_rowid"), F.when(F.col("doc_id") % 3 == 0, "stale").otherwise(F.md5("text")).alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, "done").otherwise("pending").alias("status"))
    return lexical.queue_actions(cells, queue, _read(spark, d, "labels").select(*key, F.col("doc_id").alias("src_rowid")))


# vectors


def _vectors(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("""with p as (select q.vec_id qid, t.vec_id id, round(list_reduce(list_transform(range(1, 65), lambda k: cast(q.embedding[k] as double) * t.embedding[k]), lambda x, y: x + y) / (sqrt(list_reduce(list_transform(range(1, 65), lambda k: cast(q.embedding[k] as double) * q.embedding[k]), lambda x, y: x + y)) * sqrt(list_reduce(list_transform(range(1, 65), lambda k: cast(t.embedding[k] as double) * t.embedding[k]), lambda x, y: x + y))), 9) cos
  from embeddings q, embeddings t), r as (select *, row_number() over (partition by qid order by cos desc, id) k from p) select qid, id, cos, cast(k as int) k from r where k <= 5""")
def knn_exact(spark, d):
    v = _vectors(spark, d)
    return vectors.knn(v.withColumnRenamed("id", "qid"), v, 5)


@query()
def knn_approximate(spark, d):
    v = _vectors(spark, d)
    return vectors.knn_approximate(v.withColumnRenamed("id", "qid"), v, 5)


@query()
def vector_geometry(spark, d):
    return vectors.geometry(_vectors(spark, d))


@query()
def ann_shadow(spark, d):
    v = _vectors(spark, d)
    q = v.withColumnRenamed("id", "qid")
    return ev.shadow_compare(vectors.knn(q, v, 5), vectors.knn_approximate(q, v, 5), 0.05)


# graph


@query()
def schema_graph(spark, d):
    nodes, edges = graph.schema_layer(test_tables(spark, d))
    return edges.join(nodes.select(F.col("key").alias("dst"), F.col("kind").alias("dst_kind")), "dst")


@query()
def inclusion_dependencies(spark, d):
    cat = test_tables(spark, d)
    for t, keep in (("orders", ()), ("labels", ())):
        x = cat.tables[t]
        cat.tables = cat.tables | {t: type(x)(x.name, x.rowid, x.primary_key, keep)}  # as if these keys weren't declared
    return graph.inclusion_dependencies(cat)


@query(f"""with t as (select doc_id, unnest({toks_sql('text')}) term from documents), n as (select count(*) n from documents),
s as (select term, count(distinct doc_id) df, count(*) cf from t group by term),
a as (select s.* from s, n where length(term) >= 4 and df >= 5 and df <= ceil(cast(0.25 as double) * n) and not regexp_matches(term, '[0-9]') order by df desc, term limit 4000)
select term, df, cf, round(cf / df * (1 + ln(df)), 9) burst from a order by burst desc, term limit 200""")
def term_shortlist(spark, d):
    return graph.term_shortlist(_read(spark, d, "documents"), "text", "doc_id")


@query(f"""with t as (select doc_id, unnest({toks_sql('text')}) term from documents), n as (select count(*) n from documents),
s as (select term, count(distinct doc_id) df, count(*) cf from t group by term),
a as (select s.* from s, n where length(term) >= 4 and df >= 5 and df <= ceil(cast(0.25 as double) * n) and not regexp_matches(term, '[0-9]') order by df desc, term limit 4000),
b as (select term from a order by round(cf / df * (1 + ln(df)), 9) desc, term limit 200),
u as (select distinct doc_id, term from t semi join b using (term)), f as (select term, count(*) n from u group by term)
select x.term a, y.term b, count(*) "both", any_value(fa.n) df_a, any_value(fb.n) df_b, round(count(*) / least(any_value(fa.n), any_value(fb.n)), 9) ratio
from u x join u y on x.doc_id = y.doc_id and x.term < y.term join f fa on fa.term = x.term join f fb on fb.term = y.term group by x.term, y.term""")
def term_cooccurrence(spark, d):
    docs = _read(spark, d, "documents")
    return graph.cooccurrence(docs, "text", "doc_id", graph.term_shortlist(docs, "text", "doc_id"))


@query()
def textrank(spark, d):
    docs = _read(spark, d, "documents")
    return graph.textrank(graph.cooccurrence(docs, "text", "doc_id", graph.term_shortlist(docs, "text", "doc_id")))


@query()
def graph_centrality(spark, d):
    return graph.pagerank(graph.schema_layer(test_tables(spark, d))[1], rounds=10)


@query()
def phrase_entities(spark, d):
    return graph.phrase_entities(_read(spark, d, "documents"), "text")


_FK = [(t, rt, f"{c} → {rc}") for t, x in sorted(__import__("plumbline.sources.catalog", fromlist=["TPCH"]).TPCH.items()) for c, rt, rc in x.foreign_keys]
_FK_SQL = "e as (select * from (values " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in _FK) + ") v(s, t, k)), u as (select * from e union all select t, s, k from e)"


@query(f"""with {_FK_SQL}, p1 as (select s "start", t "end", [s, t] seen, [k] path from u), p2 as (select "start", u.t "end", list_append(seen, u.t) seen, list_append(path, u.k) path from p1 join u on p1."end" = u.s and not list_contains(seen, u.t))
select "start", "end", cast(len(path) as int) hops, array_to_string(seen, ' → ') route, array_to_string(path, '; ') keys from (select * from p1 union all select * from p2)""")
def join_paths(spark, d):
    edges = graph.schema_layer(test_tables(spark, d))[1].where("kind = 'fk'")
    return graph.join_paths(edges.select(F.substring_index("src", ":", -1).alias("src"), F.substring_index("dst", ":", -1).alias("dst"), "label"))


# resolution


def _resolved(spark, d):
    lex = _lex(spark, d).withColumn("is_doc", F.lit(False))  # no column of these tables is a document column
    spans = _spans(spark).withColumn("kg_alias", F.lit(False))
    live = spans.where("status <> 'skipped'")
    n, avg = lexical.index_stats(lex)
    exact = lexical.exact_channel(live, lexical.interpretations(lex)).withColumn("is_doc", F.lit(False))
    words = lexical.ranked_channel(lexical.bm25(lexical.phrase_matches(live, lexical.postings(lex)), n, avg), lex, "bm25")
    grams = lexical.ranked_channel(lexical.bm25(lexical.trigram_matches(live, lex), n, 12.0), lex, "trigram")
    hits = exact.unionByName(words).unionByName(grams)
    candidates = resolve.fuse(hits, live)
    return spans, candidates, resolve.select_mentions(spans, candidates)


@query()
def resolve_candidates(spark, d):
    _, candidates, chosen = _resolved(spark, d)
    return resolve.decide(candidates, chosen).withColumn("channels", F.to_json("channels"))


@query()
def resolve_outcomes(spark, d):
    _, candidates, chosen = _resolved(spark, d)
    decided = resolve.decide(candidates, chosen)
    return resolve.outcomes(_questions(spark), decided, resolve.ambiguous_spans(decided))


@query()
def resolve_clarifications(spark, d):
    _, candidates, chosen = _resolved(spark, d)
    decided = resolve.decide(candidates, chosen)
    return resolve.clarifications(decided, resolve.ambiguous_spans(decided))


@query("select n_name, count(distinct o_orderkey) reach from nation join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by n_name")
def value_reach(spark, d):
    chain = [(_read(spark, d, "customer"), "n_nationkey", "c_nationkey"), (_read(spark, d, "orders"), "c_custkey", "o_custkey")]
    return resolve.reach(_read(spark, d, "nation"), chain, "n_name", "o_orderkey")


@query("""with r as (select r_name, n_name, count(distinct o_orderkey) reach from region join nation on r_regionkey = n_regionkey join customer on n_nationkey = c_nationkey join orders on c_custkey = o_custkey group by all)
select r_name, case when count(*) >= 2 then round(max(reach) / greatest(min(reach), 1), 9) else 0 end divergence from r where reach > 0 group by r_name""")
def reach_divergence(spark, d):
    chain = [(_read(spark, d, "customer"), "n_nationkey", "c_nationkey"), (_read(spark, d, "orders"), "c_custkey", "o_custkey")]
    n = _read(spark, d, "nation").join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for table, left, right in chain:
        n = n.join(table, F.col(left) == F.col(right))
    return resolve.divergence(n.groupBy("r_name", "n_name").agg(F.count_distinct("o_orderkey").alias("reach")), "r_name")


@query("select lower(n_name) value_a, lower(c_mktsegment) value_b, cast(min(n_nationkey) as int) row_a, min(c_custkey) row_b, count(*) n from nation join customer on n_nationkey = c_nationkey group by 1, 2")
def value_links(spark, d):
    return resolve.value_links(_read(spark, d, "nation"), _read(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "n_name", "c_mktsegment", "n_nationkey", "c_custkey")


# evaluation


def _graded(spark, d) -> DataFrame:
    """Documents as answers: a score in [0, 1) from their hash, and whether they are of good quality."""
    s = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("long") / 16777216.0
    return _read(spark, d, "labels").select("doc_id", s.alias("score"), (F.col("quality") == 1).alias("hit"), "toxic")


_GRADED = "g as (select doc_id, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 6) as bigint) / 16777216.0 score, quality = 1 hit, toxic from labels)"


@query(f"""with {_GRADED}, b as (select cast(least(floor(score * 10), 9) as int) bucket, count(*) n, round(avg(score), 9) mean_score, round(avg(cast(hit as double)), 9) hit_rate from g group by 1)
select cast(range as int) bucket, coalesce(n, 0) n, mean_score, hit_rate from range(10) left join b on bucket = range""")
def calibration_curve(spark, d):
    return ev.calibration(_graded(spark, d))


@query(f"""with {_GRADED}, o as (select toxic = 1 nil, score < 0.3 said_nil from g)
select count(*) filter (nil and said_nil) "both", count(*) filter (nil) gold, count(*) filter (said_nil) said, round(count_if(nil and said_nil) / nullif(count_if(said_nil), 0), 9) "precision", round(count_if(nil and said_nil) / nullif(count_if(nil), 0), 9) recall from o""".replace('"precision"', '"precision"'))
def nil_report(spark, d):
    return ev.nil_report(_graded(spark, d).select((F.col("toxic") == 1).alias("nil"), (F.col("score") < 0.3).alias("said_nil")))


_NEAR = """p as (select q.vec_id qid, q.label ql, t.vec_id id, t.label tl, round(list_reduce(list_transform(range(1, 65), lambda k: cast(q.embedding[k] as double) * t.embedding[k]), lambda x, y: x + y) / (sqrt(list_reduce(list_transform(range(1, 65), lambda k: cast(q.embedding[k] as double) * q.embedding[k]), lambda x, y: x + y)) * sqrt(list_reduce(list_transform(range(1, 65), lambda k: cast(t.embedding[k] as double) * t.embedding[k]), lambda x, y: x + y))), 9) cos from embeddings q, embeddings t where q.vec_id <> t.vec_id),
r as (select *, row_number() over (partition by qid order by cos desc, id) - 1 place from p)"""


def _ranked_labels(spark, d) -> DataFrame:
    """Each vector as a query whose target is its own label among its 10 nearest others."""
    e = _read(spark, d, "embeddings")
    v = _vectors(spark, d)
    k = vectors.knn(v.withColumnRenamed("id", "qid"), v, 24).where("qid <> id")
    w = Window.partitionBy("qid").orderBy(F.desc("cos"), "id")
    k = k.withColumn("place", F.row_number().over(w) - 1).where("place < 10")
    return k.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("target")), "id").select("qid", "target", "place")


@query(f"""with {_NEAR}, h as (select e.vec_id qid, e.label target, min(place) rank from embeddings e left join r on r.qid = e.vec_id and r.tl = e.label and r.place < 10 group by all)
select qid, count(*) targets, count(*) filter (rank < 5) found, round(count(*) filter (rank < 5) / count(*), 9) recall, round(avg(coalesce(1.0 / (rank + 1), 0)), 9) mrr, cast(min(rank) as int) "first" from h group by qid""")
def query_outcomes(spark, d):
    t = _read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("target"))
    return ev.query_outcomes(ev.target_ranks(t, _ranked_labels(spark, d), ["qid", "target"]))


@query(f"""with {_NEAR}, h as (select e.vec_id qid, e.label target, min(place) rank from embeddings e left join r on r.qid = e.vec_id and r.tl = e.label and r.place < 10 group by all),
o as (select target tier, case when rank < 5 then 1 else 0 end found, round(coalesce(1.0 / (rank + 1), 0), 9) mrr from h),
c as (select tier, count(*) n, round(avg(found), 9) macro_recall, round(avg(mrr), 9) mrr, round(sum(found) / count(*), 9) micro_recall, round(sum(found) / (5 * count(*)), 9) "precision" from o group by tier)
select *, round(case when 4 * "precision" + micro_recall > 0 then 5 * "precision" * micro_recall / (4 * "precision" + micro_recall) else 0 end, 9) f2 from c""")
def evaluation_cells(spark, d):
    t = _read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").alias("target"))
    ranks = ev.target_ranks(t, _ranked_labels(spark, d), ["qid", "target"])
    o = ev.query_outcomes(ranks).join(t.withColumnRenamed("target", "tier"), "qid").withColumn("selected", F.lit(5))
    return ev.cells(o, ["tier"])


@query()
def paired_comparison(spark, d):
    g = _graded(spark, d).select(F.col("doc_id").alias("qid"), F.lit("all").alias("tier"), "score", F.col("hit").cast("double").alias("hit"))
    return ev.compare_runs(g.select("qid", "tier", F.col("score").alias("v")), g.select("qid", "tier", F.col("hit").alias("v")), "tier", "v")


# enrichment


@query(f"""with {LEX_SQL}, r as (select distinct src_table, src_column, value_norm from lex where src_column in ('p_brand', 'p_type', 'c_mktsegment')),
rows_ as (select distinct lex.src_table, lex.src_column, lex.value_norm, src_rowid from lex semi join r using (src_table, src_column, value_norm)),
n as (select a.src_table, a.src_column, a.value_norm, o.src_column other, o.value_norm vn, count(*) n, min(o.value) v from rows_ a join lex o on a.src_table = o.src_table and a.src_rowid = o.src_rowid and a.src_column <> o.src_column group by all),
f as (select src_table, src_column, value_norm, list(' · ' || replace(other, '_', ' ') || ': ' || v order by other) frag from (select *, sum(n) over (partition by src_table, src_column, value_norm, other) total from n) where 2 * n > total group by all),
m as (select src_table, src_column, value_norm, value from (select *, row_number() over (partition by src_table, src_column, value_norm order by n desc, value) k from (select src_table, src_column, value_norm, value, count(*) n from lex group by all)) where k = 1)
select src_table, src_column, value_norm, replace(src_table, '_', ' ') || ' · ' || replace(src_column, '_', ' ') || ' · ' || value || coalesce(array_to_string(list_slice(frag, 1, 2), ''), '') card
from m semi join r using (src_table, src_column, value_norm) left join f using (src_table, src_column, value_norm)""")
def interpretation_cards(spark, d):
    lex = _lex(spark, d)
    return enrich.interpretation_cards(lex, lex.where("src_column in ('p_brand', 'p_type', 'c_mktsegment')").select(*lexical.READING).distinct())


@query(f"""with {LEX_SQL}, t as (select src_table, src_column, src_rowid, unnest(list_distinct({toks_sql('value')})) term from lex), n as (select term, src_table, src_column, count(*) n from t group by all having count(*) >= 2)
select term, src_table, src_column, n from (select *, row_number() over (partition by term order by n desc, src_table, src_column) k from n) where k <= 4""")
def term_column_affinity(spark, d):
    lex = _lex(spark, d)
    index = lexical.postings(lex)
    return enrich.term_column_affinity(index, index, lex.select(*lexical.COLUMN).distinct())


@query(f"""with {LEX_SQL}, {_span_values()}, e as (select distinct qid, span from spans s join lex on lower(trim(s.text)) = value_norm and length(value) <= 120)
select qid, span, text from (select s.*, row_number() over (partition by qid order by end_ - start_ desc, span) k from spans s anti join e using (qid, span) where status <> 'skipped') where k <= 4""")
def dense_targets(spark, d):
    spans = _spans(spark)
    exact = lexical.exact_channel(spans.where("status <> 'skipped'"), lexical.interpretations(_lex(spark, d)))
    return enrich.dense_targets(spans, exact).select("qid", "span", "text")


@query("select text as query, max(conv_id) asked_at, max(role) source from conversations group by text order by asked_at desc, query limit 8")
def question_history(spark, d):
    c = _read(spark, d, "conversations").select(F.col("text").alias("query"), F.col("conv_id").alias("asked_at"), F.col("role").alias("source"))
    return enrich.history(c)


@query("select n_nationkey, c_custkey, 'nation #' || n_nationkey || ' ←c_nationkey— customer #' || c_custkey path from nation join customer on n_nationkey = c_nationkey")
def rendered_paths(spark, d):
    j = _read(spark, d, "nation").join(_read(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select("n_nationkey", "c_custkey", enrich.render_path(F.col("n_nationkey"), F.col("c_custkey"), [("c_nationkey", "customer", False, True)], ["nation"]).alias("path"))


# mining


@query("""with t as (select doc_id, list_distinct(regexp_extract_all(text, '(?:CC BY[A-Z-]*|version|Version) ([0-9]+\\.?[0-9]*)', 1)) v from documents) select v "version", count(*) n from (select doc_id, unnest(v) v from t) group by v""".replace("\\\\", "\\"))
def license_versions(spark, d):
    v = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:CC BY[A-Z-]*|version|Version) ([0-9]+\.?[0-9]*)"), 1))
    return _read(spark, d, "documents").select("doc_id", F.explode(v).alias("version")).groupBy("version").agg(F.count("*").alias("n"))


@query("""with t as (select distinct doc_id, unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+[a-z]|[0-9]{1,3}(?:[.][0-9]{1,3}){3}')) term from documents),
f as (select term, count(*) df from t where length(term) >= 6 group by term having count(*) between 2 and 15000), u as (select * from t semi join f using (term)),
p as (select a.doc_id a, b.doc_id b, count(*) shared, round(sum(1.0::double / df), 9) weight from u a join u b on a.term = b.term and a.doc_id <> b.doc_id join f on f.term = a.term group by all having count(*) >= 2)
select a, b, shared from (select *, row_number() over (partition by a order by shared desc, weight desc, b) k from p) where k = 1""")
def topical_partners(spark, d):
    t = _read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9.]+[a-z]|[0-9]{1,3}(?:[.][0-9]{1,3}){3}"), 0)).alias("term"))
    return mining.topical_partners(t, "doc_id", t, low=2)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
