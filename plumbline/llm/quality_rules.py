"""Operator 1: hashed n-gram log-likelihood ratio between trusted documents and the raw corpus."""

from __future__ import annotations

import atexit
import hashlib
import math
import os
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import FILE, ROW, RowMap, located, mounted, rows_of, shared_dir, text_slices, trim

#: A token is a run of word characters or a run of other visible characters, as written.
TOKEN = re.compile(r"\w+|[^\w\t\n\f\r ]+")
#: Least number of buckets of the table, and most features a bucket before the table gets larger.
BUCKETS = 1 << 18
LOAD = 64
#: Buckets that are summed at once.
CHUNK = 1 << 18
_MUL = 1_000_003
#: Micro-nats a feature; below it a document goes.
THRESHOLD = -250_000
#: Pseudo-occurrences of a bucket in the raw corpus; in the trusted one they count by its share of all features.
ALPHA = 16.0
#: Features that a task holds before it counts them, and distinct ones that it holds with their counts.
_HELD, _COUNTED = 2_000_000, 4_000_000


class _Md5(dict):
    """token -> the first 28 bits of its md5."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        h = self[token] = int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)
        return h


_HASH = _Md5()


def features_of(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the tokens and of the token pairs of texts; a token that follows itself counts in bucket `buckets`."""
    split = [TOKEN.findall(t) if t else [] for t in texts]
    lens = np.array([len(x) for x in split], np.int64)
    h = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(split)), np.int64, int(lens.sum()))
    text = np.repeat(np.arange(len(texts)), lens)
    pairs = (h[:-1] * _MUL + h[1:]) % buckets
    pairs[h[:-1] == h[1:]] = buckets
    inside = text[:-1] == text[1:]
    return np.concatenate([text, text[:-1][inside]]), np.concatenate([h % buckets, pairs[inside]])


def feature_totals(flagged: DataFrame, trusted: RowMap) -> tuple[int, int]:
    """Features of (all documents, trusted documents), counted by a pass over the texts. flagged: text, __file, __row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2, np.int64)
        for b in batches:
            good = trusted.find(b.column(1).to_numpy(), b.column(2).to_numpy())[0]
            for start, texts in text_slices(b.column(0)):
                for k, t in enumerate(texts, start):
                    size = max(0, 2 * len(TOKEN.findall(t)) - 1) if t else 0
                    n += (size, size * good[k])
        yield pa.RecordBatch.from_pydict({"n": pa.array([n[0]], pa.int64()), "good": pa.array([n[1]], pa.int64())})

    r = flagged.mapInArrow(count, "n long, good long").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    return r.n or 0, r.good or 0


def buckets_for(n_features: int, least: int = BUCKETS, load: int = LOAD) -> int:
    """The least power of two from `least` on that holds n_features at no more than `load` a bucket."""
    return max(least, 1 << max(0, math.ceil(n_features / load) - 1).bit_length())


def _packed(at: np.ndarray, raw: np.ndarray, good: np.ndarray) -> bytes:
    """Gaps of ascending buckets and counts, each byte's place apart: runs of zeros, and bytes of one distribution for Huffman's code."""
    planes = np.stack([np.diff(at, prepend=0), raw, good]).astype("<u4").view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)
    z = zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS, 9, zlib.Z_RLE)
    return z.compress(planes.tobytes()) + z.flush()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, (raw, good) rows) of _packed."""
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(3, 4, -1)
    gaps, *both = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]
    return np.cumsum(gaps, dtype=np.int64), np.stack(both, axis=1)


def ngram_counts(flagged: DataFrame, trusted: RowMap, buckets: int) -> DataFrame:
    """(chunk, counts) rows to be summed: the feature counts of all and of trusted documents, sparse and packed.

    Each task sorts its features and counts those it has, so neither what it holds nor what is shuffled grows
    with the table of buckets; a bucket that it has often is one entry, unless it has more than _COUNTED. A chunk
    is a range of CHUNK buckets. flagged: text, __file, __row.
    """
    kind = np.uint32 if buckets < 2**32 else np.int64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = total = 0  # features since the last merge, and since the last flush
        at, sums = np.zeros(0, kind), np.zeros((2, 0), np.uint32)

        def merge() -> None:
            nonlocal held, size, at, sums
            new = [np.unique(np.concatenate([at[:0], *x]), return_counts=True) for x in held]
            held, size = [[], []], 0
            every = np.sort(np.concatenate([at, *(x for x, _ in new)]))
            every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]  # np.unique without counts hashes: 60 times slower here
            both = np.zeros((2, len(every)), np.uint32)
            both[:, np.searchsorted(every, at)] = sums
            for k, (x, n) in enumerate(new):
                to = np.searchsorted(every, x)
                both[: k + 1, to] += n.astype(np.uint32)
            at, sums = every, both

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total, at, sums
            chunks, starts = np.unique(at // CHUNK, return_index=True)
            for c, x, n in zip(chunks, np.split(at, starts[1:]), np.split(sums, starts[1:], axis=1)):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([_packed(x.astype(np.int64) - int(c) * CHUNK, *n)], pa.binary())})
            total, at, sums = 0, at[:0], sums[:, :0]

        for b in batches:
            good = trusted.find(b.column(1).to_numpy(), b.column(2).to_numpy())[0]
            for start, texts in text_slices(b.column(0)):
                text, f = features_of(texts, buckets)
                mine = good[text + start]
                held[0].append(f[~mine].astype(kind))
                held[1].append(f[mine].astype(kind))
                size, total = size + len(f), total + len(f)
                if size > _HELD:
                    merge()
                    if len(at) > _COUNTED or total > 2**31:  # counts are packed as 32 bits
                        yield from flush()
        merge()
        yield from flush()
        trim()

    return flagged.mapInArrow(count, "chunk int, counts binary")


def log_ratios(raw: np.ndarray, good: np.ndarray, n_raw: np.ndarray | int, n_good: np.ndarray | int, share: float, buckets: int, alpha: float = ALPHA) -> np.ndarray:
    """log(p_trusted / p_raw) in whole micro-nats of buckets with these counts. Both are smoothed alike: a bucket
    that nothing is known of has ratio 1."""
    a = alpha * share
    good = np.log(good + a) - np.log(n_good + a * (buckets + 1))
    return np.rint((good - (np.log(raw + alpha) - np.log(n_raw + alpha * (buckets + 1)))) * 1e6).astype(np.int64)


def counts_file(counts: DataFrame, buckets: int) -> str:
    """A file of buckets + 1 pairs (raw count, trusted count; uint32): its path in the shared folder, or the name
    of an added file, for SparkFiles, where that folder isn't mounted.

    Executors sum the chunks and write each at its place in the one file, so nothing passes the driver and there
    are no copies. A folder that isn't mounted can't be mapped: chunks pass the driver one partition at a
    time on their way into a file that is sent to the executors. Workers map the file, so those of an executor share
    its pages and none holds it as a whole.
    """
    spark = counts.sparkSession
    shared = mounted(shared_dir(spark))
    name = f"counts-{uuid.uuid4().hex}"
    if shared:
        folder = f"{shared}/{name}"
        os.makedirs(folder)
    else:
        folder = tempfile.mkdtemp(prefix="plumbline-")  # the driver's copy of what addFile sends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{name}"
    with open(path, "wb") as f:  # a bucket of a chunk that nothing fell into is never looked up
        f.truncate(8 * (buckets + 1))

    def put(chunk: int, data: bytes) -> None:
        with open(path, "r+b") as f:
            f.seek(8 * chunk * CHUNK)
            f.write(data)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        both = np.zeros((min(CHUNK, buckets + 1 - chunk * CHUNK), 2), np.int64)
        for x in pdf["counts"]:
            at, n = _unpacked(x)
            both[at] += n
        data = np.minimum(both, 2**32 - 1).astype(np.uint32).tobytes()
        if shared:
            put(chunk, data)
        return pd.DataFrame({"chunk": [chunk], "counts": [b"" if shared else zlib.compress(data, 1)]})

    summed = counts.groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    if shared:
        summed.agg(F.count("counts")).first()
        return path
    for r in summed.toLocalIterator():
        put(r.chunk, zlib.decompress(r.counts))
    spark.sparkContext.addFile(path)
    return name


def score_texts(texts: list[str | None], good: np.ndarray, table: np.ndarray, totals: tuple[int, int], buckets: int, alpha: float = ALPHA) -> np.ndarray:
    """(micro-nats, features) of each text, its own features left out of both multinomials."""
    out = np.zeros((len(texts), 2), np.int64)
    text, f = features_of(texts, buckets)
    out[:, 1] = np.bincount(text, minlength=len(texts))
    if len(f) and totals[1]:
        key, own = np.unique(text * (buckets + 1) + f, return_counts=True)
        text, f = key // (buckets + 1), key % (buckets + 1)
        both, mine, n = table[f].astype(np.int64), good[text], out[text, 1]
        w = log_ratios(both[:, 0] - own, both[:, 1] - own * mine, totals[0] - n, totals[1] - n * mine, totals[1] / totals[0], buckets, alpha)
        np.add.at(out[:, 0], text, w * own)
    return out


def _scorer(name: str, trusted: RowMap, totals: tuple[int, int], buckets: int, alpha: float):
    @F.pandas_udf("struct<total: bigint, n: bigint>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = np.memmap(name if os.path.isabs(name) else SparkFiles.get(name), np.uint32, "r").reshape(-1, 2)
        for texts, files, rows in batches:
            good = trusted.find(files.to_numpy(), rows.to_numpy())[0]
            out = [score_texts(list(texts[k : k + 500]), good[k : k + 500], table, totals, buckets, alpha) for k in range(0, len(texts), 500)]
            yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["total", "n"])
        trim()

    return score


def scored(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, buckets: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """docs with n_features, score (mean log ratio of a feature, in nats) and keep, for every row.

    trusted holds the doc_ids of the trusted target (others in it are ignored, repeats count once). A document's
    own features are left out of both multinomials when it is scored, so trusted documents have no better
    scores than others of their kind; both are smoothed towards the same distribution, so features that no other
    document has say nothing. Ratios are whole micro-nats, so score and keep don't depend on how rows are spread
    over tasks. A text that is null or has no token has 0 features, a null score, and isn't kept. Rows that
    repeat count as often as they are there. Without trusted documents every ratio is 0 and each document with
    a token is kept. Columns of docs named n_features, score or keep are replaced.

    Without a number of buckets, the table grows with the counted features (buckets_for): up to LOAD * BUCKETS
    features it is the table of the SQL. Which rows are trusted is told by their place in the files, so texts don't move.
    """
    return _scored(docs, trusted, threshold, buckets, alpha).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in ("n_features", "score", "keep")], F.col("__s.n").alias("n_features"), _mean().alias("score"), _keep(threshold).alias("keep")
    )


def _mean():
    return F.when(F.col("__s.n") > 0, F.col("__s.total") / (F.col("__s.n") * 1_000_000))


def _keep(threshold: int):
    return (F.col("__s.n") > 0) & (F.col("__s.total") >= F.col("__s.n") * threshold)


def _scored(docs: DataFrame, trusted: DataFrame, threshold: int, buckets: int | None, alpha: float) -> DataFrame:
    place = located(docs)
    good = RowMap(rows_of(place, trusted))
    flagged = place.select("text", FILE, ROW)
    totals = feature_totals(flagged, good)
    buckets = buckets or buckets_for(totals[0])
    score = _scorer(counts_file(ngram_counts(flagged, good, buckets), buckets), good, totals, buckets, alpha)
    return place.withColumn("__s", score("text", FILE, ROW))


def filter_quality(docs: DataFrame, trusted: DataFrame, threshold: int = THRESHOLD, buckets: int | None = None, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs that scored() keeps, with the columns of docs as they are."""
    return _scored(docs, trusted, threshold, buckets, alpha).where(_keep(threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled of good quality."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


SQL = f"""
with toks as (
  select row_number() over () r, doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\t\\n\\f\\r ]+') ts from documents),
good as (select distinct doc_id from labels where quality = 1 and doc_id is not null),
hs as (select r, doc_id, list_transform(coalesce(ts, []), lambda t: cast('0x' || substr(md5(t), 1, 7) as bigint)) h from toks),
fs as (
  select r, doc_id, case when g.doc_id is null then 0 else 1 end mine, list_concat(list_transform(h, lambda x: x % {BUCKETS}),
    list_transform(range(1, len(h)), lambda k: case when h[k] = h[k + 1] then {BUCKETS} else (h[k] * {_MUL} + h[k + 1]) % {BUCKETS} end)) f from hs left join good g using (doc_id)),
flat as (select r, mine, len(f) n, unnest(f) b from fs),
own as (select r, mine, n, b, count(*) o from flat group by all),
counts as (select b, sum(o) cr, sum(o * mine) ct from own group by b),
totals as (select cast(sum(cr) as bigint) nr, cast(sum(ct) as bigint) nt, {ALPHA} * (nt / nr) a from counts),
ratios as (
  select r, n, o, case when nt = 0 then 0 else cast(round_even(((ln(ct - o * mine + a) - ln(nt - n * mine + a * {BUCKETS + 1})) - (ln(cr - o + {ALPHA}) - ln(nr - n + {ALPHA} * {BUCKETS + 1}))) * 1e6, 0) as bigint) end w
  from own join counts using (b), totals),
sums as (select r, cast(sum(w * o) as bigint) total, any_value(n) n from ratios group by r)
select fs.doc_id, coalesce(n, 0) n_features, total / (n * 1000000) score, coalesce(total >= n * ({THRESHOLD}), false) keep
from fs left join sums using (r)
"""
