"""Operator 9: benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import HASHES, cut, shingle_hashes, text_slices, trim, without, word_hashes, words

#: Words in a shingle.
N = 5
#: Share of an item's distinct shingles that one window of the item's length must hold.
THRESHOLD = 0.8
#: Benchmark shingles that are broadcast at once; the documents are read again for the next so many.
SHIPPED_SHINGLES = 4_000_000
_SIEVE = 1 << 22


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def item_shingles(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, item_words, ipos, tok): every shingle of every item with its position."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(text)
                t = shingle_hashes(word_hashes(ws), n)
                for col, x in zip(out, (np.full(len(t), item, np.int64), np.full(len(t), len(ws), np.int32), np.arange(len(t), dtype=np.int32), _signed(t))):
                    col.append(x)
            yield pa.RecordBatch.from_pydict({k: np.concatenate(c) if c else [] for k, c in zip(("item_id", "item_words", "ipos", "tok"), out)})

    return items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(explode, "item_id long, item_words int, ipos int, tok long")


def _hits(docs: DataFrame, known, n: int, short: set[int]) -> DataFrame:
    """(doc_id, pos, tok, n_words) of the documents' shingles that are in known."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toks = known.value
        sieve = np.zeros(_SIEVE, bool)  # a look at it spares most shingles the search
        sieve[(toks & np.uint64(_SIEVE - 1)).view(np.int64)] = True
        for b in batches:
            for start, texts in text_slices(b.column(0)):
                split = [words(t) for t in texts]
                lens = np.array([len(w) for w in split], np.int64)
                h = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(split)), np.uint64, int(lens.sum()))
                doc = np.repeat(np.arange(len(texts)), lens)
                begin = np.repeat(np.cumsum(lens) - lens, lens)
                for m in sorted({n, *short}):
                    if m > len(h):
                        continue
                    t = shingle_hashes(h, m)
                    at = np.flatnonzero(sieve[(t & np.uint64(_SIEVE - 1)).view(np.int64)])
                    at = at[doc[at] == doc[at + m - 1]]
                    at = at[toks[np.minimum(np.searchsorted(toks, t[at]), len(toks) - 1)] == t[at]]
                    if len(at):
                        ids = b.column(1).take(pa.array(doc[at] + start))
                        yield pa.RecordBatch.from_arrays([ids, pa.array((at - begin[at]).astype(np.int32)), pa.array(_signed(np.ascontiguousarray(t[at]))), pa.array(lens[doc[at]].astype(np.int32))], names=["doc_id", "pos", "tok", "n_words"])
        trim()

    return docs.where("doc_id is not null").select("text", F.col("doc_id").cast("long")).mapInArrow(scan, "doc_id long, pos int, tok long, n_words int")


def best_windows(pair: np.ndarray, pos: np.ndarray, tok: np.ndarray, span: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, matched, start) of the pairs some of whose windows of span positions have need distinct tokens or more.

    Rows are ordered by pair and position; span and need are alike within a pair. A window's distinct tokens are
    its rows less those whose token was in it before.
    """
    rows = len(pair)
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(rows)
    group = np.cumsum(np.concatenate([[0], pair[1:] != pair[:-1]]))
    wide = int(pos.max()) + int(span.max()) + 2
    place = group * wide + pos
    end = np.searchsorted(place, place + span, "left")  # never beyond the group
    count = end - at
    order = np.lexsort((at, tok, group))
    same = (group[order][1:] == group[order][:-1]) & (tok[order][1:] == tok[order][:-1])
    before, after = order[:-1][same], order[1:][same]
    # row `after` repeats its token in the windows that begin in (begin of those that reach it, before]
    delta = np.zeros(rows + 1, np.int64)
    low = np.searchsorted(place, place[after] - span[after], "right")
    inside = low <= before
    np.add.at(delta, low[inside], 1)
    np.add.at(delta, before[inside] + 1, -1)
    count = count - np.cumsum(delta[:-1])
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    most = np.maximum.reduceat(count, starts)
    hit = at[count == most[group]]
    _, k = np.unique(group[hit], return_index=True)
    good = most >= need[starts]
    return starts[good], most[good], pos[hit[k]][good]


def _windows(found: DataFrame) -> DataFrame:
    """The best windows of rows that come ordered by document, item and position; a pair may go over from batch to batch."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: list[np.ndarray]) -> pa.RecordBatch:
            doc, item, pos, tok, need, span, size = x
            pair = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else doc
            first, matched, start = best_windows(pair, pos.astype(np.int64), tok, span.astype(np.int64), need)
            return pa.RecordBatch.from_pydict({"doc_id": doc[first], "item_id": item[first], "matched": matched.astype(np.int32), "size": size[first].astype(np.int32), "start_word": start.astype(np.int32)})

        held: list[list[np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = [c.to_numpy() for c in b.columns]
            last = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            if len(last):
                k = last[-1] + 1
                yield out([np.concatenate(c) for c in zip(*held, [c[:k] for c in new])])
                held = [[c[k:] for c in new]]
            elif held and (held[-1][0][-1] != new[0][0] or held[-1][1][-1] != new[1][0]):
                yield out([np.concatenate(c) for c in zip(*held)])
                held = [new]
            else:
                held.append(new)
        if held:
            yield out([np.concatenate(c) for c in zip(*held)])

    return found.mapInArrow(scan, "doc_id long, item_id long, matched int, size int, start_word int")


def contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, shipped: int = SHIPPED_SHINGLES) -> DataFrame:
    """(doc_id, item_id, matched, containment, start_word): each document that holds a benchmark item.

    Words are runs of word characters in lower case; an item's set is its distinct n-word shingles (an item of
    fewer words has one, all of it). A document holds an item if some window of as many words as the item has
    contains at least ceil(threshold x size) of them; matched is the most in any window, start_word its first
    matching word (the first such window on ties), containment is matched / size. The result is exact.

    Documents are read once for each `shipped` benchmark shingles, which are broadcast; only positions of
    shingles that some item has leave the scan, texts don't move. Their document frequency, over all documents,
    orders each item's shingles by rarity; only the size - need + 1 rarest are joined to find candidates. Length
    bound: the document has at least need shingles. Positional bound: a pair must have a hit of its prefix in a
    window, and windows, of the item's length, are counted for such pairs only.

    Null or wordless texts and items hold nothing and are in nothing; rows without id are left out. Repeated
    items are separate items if their ids differ; rows repeating an id count as one document or item that
    has the hits of all its rows. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ish = cut(item_shingles(items, n).distinct())
    # an item of fewer than n words is one shingle of its own length
    short = {r[0] for r in ish.where(F.col("item_words") < n).select("item_words").distinct().collect()}
    sets = ish.groupBy("item_id", "tok").agg(F.max("item_words").alias("item_words"))
    toks = cut(ish.select("tok").distinct())
    passes = max(1, math.ceil(toks.count() / shipped))
    parts, sent = [], []
    for k in range(passes):
        some = toks.where(F.pmod(F.xxhash64("tok"), F.lit(passes)) == k).toArrow().column("tok").to_numpy().astype(np.int64)
        if len(some):
            sent.append(spark.sparkContext.broadcast(np.sort(some.view(np.uint64))))
            parts.append(cut(_hits(docs, sent[-1], n, short)))
    hits = parts[0] if parts else spark.createDataFrame([], "doc_id long, pos int, tok long, n_words int")
    for x in parts[1:]:
        hits = hits.unionByName(x)
    for x in sent:
        x.destroy()
    df = hits.groupBy("tok").agg(F.countDistinct("doc_id").alias("df"))
    rank = Window.partitionBy("item_id").orderBy("df", "tok")
    whole = Window.partitionBy("item_id")
    ranked = sets.join(df, "tok", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("r", F.row_number().over(rank)).withColumn("size", F.count("*").over(whole)).withColumn("words", F.max("item_words").over(whole))
    ranked = ranked.withColumn("need", F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    ranked = ranked.withColumn("span", F.greatest(F.col("words") - F.least(F.lit(n), F.col("words")) + 1, F.lit(1)))
    prefix = ranked.where(F.col("r") <= F.col("size") - F.col("need") + 1).select("tok", "item_id", "need", "span")
    long_enough = F.col("n_words") - n + 1 >= F.when(F.col("span") > 1, F.col("need")).otherwise(F.lit(-n))
    pairs = cut(hits.join(prefix, "tok").where(long_enough).select("doc_id", "item_id").distinct())
    wanted = pairs.join(ranked.select("item_id", "tok", "need", "span", F.col("size").cast("int").alias("size")), "item_id")
    found = hits.select("doc_id", "pos", "tok").join(wanted, ["doc_id", "tok"]).select("doc_id", "item_id", "pos", "tok", "need", "span", "size").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs.count() / 20_000))
    best = _windows(found.repartition(tasks, "doc_id", "item_id").sortWithinPartitions("doc_id", "item_id", "pos"))
    return best.select("doc_id", "item_id", "matched", (F.col("matched") / F.col("size")).alias("containment"), "start_word")


def decontaminate(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """The rows of docs, all columns kept, that hold no benchmark item. Rows without doc_id or text stay; an empty table gives no rows."""
    return without(docs, contaminated(docs, items, **params).select("doc_id"))


SQL = f"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') w from documents where doc_id is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') w from benchmark where item_id is not null),
it as (select item_id, len(w) words, unnest(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda k: array_to_string(w[k:k + {N - 1}], ' '))) tok from i where len(w) > 0),
iset as (select item_id, tok, max(words) over (partition by item_id) words, count(*) over (partition by item_id) size from (select item_id, tok, max(words) words from it group by all)),
dt as (select doc_id, p, tok from (
  select doc_id, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) p, unnest(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda k: array_to_string(w[k:k + {N - 1}], ' '))) tok from d where len(w) > 0)),
h as (select distinct doc_id, item_id, p, tok, words, size from dt join iset using (tok)),
win as (
  select a.doc_id, a.item_id, a.p, a.size, count(distinct b.tok) matched
  from h a join h b on a.doc_id = b.doc_id and a.item_id = b.item_id and b.p between a.p and a.p + a.words - {N} group by all),
best as (select doc_id, item_id, size, max(matched) matched from win group by all),
first_at as (select doc_id, item_id, min(p) - 1 start_word from win join best using (doc_id, item_id, size, matched) group by all)
select doc_id, item_id, cast(matched as int) matched, matched / size containment, cast(start_word as int) start_word
from best join first_at using (doc_id, item_id) where matched >= ceil(size * {THRESHOLD} - 1e-9)
"""
