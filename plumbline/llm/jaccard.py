"""Operator 8: exact n-gram Jaccard self-join, size-aware: subsets of small sets, inverted lists of large ones."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import FILE, HASHES, ROW, RowMap, cut, located, shingle_hashes, stored, text_slices, trim, words
from plumbline.llm.components import components

#: Words in an n-gram, and the least Jaccard similarity of a pair.
N = 2
THRESHOLD = 0.7
#: Size of the subsets that are enumerated of a small set.
K = 2
#: Largest size that counts as small, whatever the cost says.
LIGHT_MAX = 40
#: Counters of the n-gram sketch and of the word sketch that estimate how rare an n-gram is. The estimate is the
#: same for all documents, so the join is exact whatever collides.
SKETCH, WORDS = 1 << 22, 1 << 18
_CHUNKS, _BITS = 16, 1 << 14
#: Minimum-hash keys of a set, and values in a key.
_KEYS, _VALUES = 12, 4
#: Least number of token ranges: above a few per n-gram of a set's prefix, posting blocks look alike at every size.
_LEAST_PARTS = 192
_ROWS_A_PART = 1_500
#: Sets of a block of a large component, of which two are compared at once, and n-grams that a task gets of them.
_BLOCK_SETS, _BLOCK_GRAMS = 2_500, 1 << 20
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_SID = np.uint64(0x9FB21C651E98DF25)
_HASH = np.uint64((1 << 56) - 1)


class Texts:
    """The n-gram hashes of a run of texts, taken together so that few array operations serve many texts."""

    def __init__(self, texts: list[str | None], n: int):
        split = [words(t) for t in texts]
        lens = np.array([len(w) for w in split], np.int64)
        self.words = np.fromiter(map(HASHES.__getitem__, chain.from_iterable(split)), np.uint64, int(lens.sum()))
        self.n, self.lens, self.starts = n, lens, np.cumsum(lens) - lens
        self.grams = self._hash(self.words) if len(self.words) >= n else self.words[:0]

    def _hash(self, w: np.ndarray) -> np.ndarray:
        return shingle_hashes(w, self.n) >> np.uint64(8)  # 56 bits: the other 8 are for frequency

    def ngrams(self, k: int) -> np.ndarray:
        """With repeats; a text of fewer than n words has one n-gram, all of it."""
        at, size = self.starts[k], self.lens[k]
        return self.grams[at : at + size - self.n + 1] if size >= self.n else self._hash(self.words[at : at + size])

    def expected(self, counts: np.ndarray) -> np.ndarray:
        """Of each of self.grams: how often it would be there if its words met by chance."""
        c = counts[self.words & np.uint64(WORDS - 1)].astype(np.float64)
        total = max(float(counts.sum()), 1.0)
        out = c[: len(self.grams)].copy()
        for j in range(1, self.n):
            out *= c[j : j + len(self.grams)] / total
        return out


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    if len(h) > 1:
        keep = np.ones(len(h), bool)
        np.not_equal(h[1:], h[:-1], out=keep[1:])
        h = h[keep]
    return h


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    """The distinct n-gram hashes of a text, ascending."""
    return distinct(Texts([text], n).ngrams(0))


def _parity_bits(size: int) -> int:
    """Twice the set's size and up, a power of two, within bounds."""
    return min(max(1 << (2 * size - 1).bit_length(), 256), _BITS)


def parity(s: np.ndarray) -> bytes:
    """A bit for each residue of the n-grams' hashes: the parity of how many fall on it. So two sets differ in as
    many n-grams, at least, as bits; a longer bitmap folds to a shorter one by xor."""
    bits = _parity_bits(len(s))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def set_id(s: np.ndarray) -> int:
    """A hash of a set of distinct n-gram hashes, in any order."""
    with np.errstate(over="ignore"):
        m = s * _SID
        m ^= m >> np.uint64(32)
        return (xxhash.xxh3_64_intdigest((m * _SID).sum().tobytes()) ^ len(s)) >> 1


def _missing(size: int, t: float) -> int:
    """How many of its n-grams a set of this size may lack in a partner."""
    return size - math.ceil(size * t - 1e-9)


def set_keys(s: np.ndarray) -> np.ndarray:
    """Minimum-hash keys of an ascending set: the range of hashes is cut in bins, the least hash from a bin's
    beginning on is its value, and each key is a hash of some values. Similar sets are likely to share a key."""
    edges = (np.arange(_KEYS * _VALUES, dtype=np.uint64) << np.uint64(56)) // np.uint64(_KEYS * _VALUES)
    v = s[np.searchsorted(s, edges) % len(s)].reshape(_VALUES, _KEYS)
    out = np.arange(_KEYS, dtype=np.uint64) + _SID
    with np.errstate(over="ignore"):
        for x in v:
            out = (out ^ x) * _PAIR
            out ^= out >> np.uint64(29)
    return out


_SCANNED = f"chunk int, counts binary, doc_id long, {FILE} long, {ROW} long, sid long, size int, bits binary, keys binary"


def _read_sets(place: DataFrame, n: int) -> DataFrame:
    """One pass over the text: a row for each document with its set's id, size, bitmap and keys (chunk = -1; no id
    without words), and chunks of the sketches (chunk >= 0), to which a task counts each distinct set once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, by_word = np.zeros(SKETCH, np.uint32), np.zeros(WORDS, np.uint32)
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def flush() -> None:
            nonlocal held, size
            if held:
                at, many = np.unique(np.concatenate(held), return_counts=True)
                counts[at] += many.astype(np.uint32)
            held, size = [], 0

        for b in batches:
            for start, texts in text_slices(b.column(0)):
                run = Texts(texts, n)
                by_word += np.bincount((run.words & np.uint64(WORDS - 1)).view(np.int64), minlength=WORDS).astype(np.uint32)
                sids, sizes, bits, keys = [], [], [], []
                for k in range(len(texts)):
                    if not run.lens[k]:
                        sids.append(None), sizes.append(0), bits.append(None), keys.append(None)
                        continue
                    s = distinct(run.ngrams(k))
                    sids.append(set_id(s)), sizes.append(len(s)), bits.append(parity(s)), keys.append(set_keys(s).tobytes())
                    if sids[-1] not in seen:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(sids[-1])
                        held.append((s & np.uint64(SKETCH - 1)).view(np.int64))
                        size += len(s)
                if size > SKETCH >> 2:
                    flush()
                rows, where = len(texts), slice(start, start + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1] * rows, pa.int32()), pa.nulls(rows, pa.binary()), *[b.column(c)[where] for c in (1, 2, 3)], pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())],
                    names=["chunk", "counts", "doc_id", FILE, ROW, "sid", "size", "bits", "keys"],
                )
        flush()
        if counts.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in np.array_split(np.concatenate([counts, by_word]), _CHUNKS)]
            none = [pa.nulls(_CHUNKS, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array(packed, pa.binary()), *none], names=["chunk", "counts", "doc_id", FILE, ROW, "sid", "size", "bits", "keys"])
        del counts, by_word, held, seen
        trim()

    return place.select("text", "doc_id", FILE, ROW).mapInArrow(scan, _SCANNED)


class Rarity:
    """Estimates of n-gram frequency: what the n-grams' sketch counts, and what their words let expect, which is surer of the two."""

    def __init__(self, both: np.ndarray):
        noise = float(both[:SKETCH].mean(dtype=np.float64))
        # less what others add to a counter on average, and their usual deviation
        self.grams = both[:SKETCH].astype(np.float32)
        self.grams -= np.float32(noise + math.sqrt(noise))
        np.maximum(self.grams, 0, out=self.grams)
        self.words = both[SKETCH:]

    def ranked(self, run: Texts, k: int, expected: np.ndarray) -> np.ndarray:
        """The set of text k as keys from rare to frequent: 8 bits of frequency level over the hash."""
        h = run.ngrams(k)
        est = self.grams[h & np.uint64(SKETCH - 1)].astype(np.float64) + 1.0
        if run.lens[k] >= run.n:
            est += 4.0 * expected[run.starts[k] : run.starts[k] + len(h)]
        level = (est.view(np.int64) >> 50) - (1023 << 2)  # four levels an octave, read off the float
        return distinct((np.minimum(level, 255).astype(np.uint64) << np.uint64(56)) | h)


def _sketches(scanned: DataFrame) -> np.ndarray:
    """The summed sketches, of fixed size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["counts"])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

    rows = scanned.where("chunk >= 0").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, counts binary").collect()
    if not rows:
        return np.zeros(SKETCH + WORDS, np.uint32)
    return np.concatenate([np.frombuffer(zlib.decompress(r.counts), np.uint32) for r in sorted(rows, key=lambda r: r.chunk)])


def subset_tokens(prefix: np.ndarray) -> np.ndarray:
    """A token for every 2-subset of the prefix, the first two n-grams first."""
    i, j = np.triu_indices(len(prefix), 1)
    with np.errstate(over="ignore"):
        x = (np.minimum(prefix[i], prefix[j]) * _PAIR) ^ (np.maximum(prefix[i], prefix[j]) + _PAIR)
        x ^= x >> np.uint64(31)
        return x * _PAIR


def choose_boundary(costs: dict[int, tuple[int, int, float]], t: float) -> int:
    """The size from which sets count as large: the cheapest b in 2 .. LIGHT_MAX + 1.

    costs: size -> (sets, n-grams of their prefixes, expected length of the lists they scan). A small set costs
    its subsets; a large one its postings and the lists; small sets of at least t x b also need postings, as
    large ones may be their partners.
    """
    best, at = math.inf, 2
    for b in range(2, LIGHT_MAX + 2):
        cost = 0.0
        for s, (sets, postings, scans) in costs.items():
            if s < b:
                m = _missing(s, t)
                cost += sets * math.comb(m + K, K) + (postings if s >= t * b else 0)
            else:
                cost += postings + scans
        if cost < best:
            best, at = cost, b
    return at


def _costs(docs: DataFrame, sketch, n: int, t: float) -> dict[int, tuple[int, int, float]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LIGHT_MAX + 1, 3))
        rarity = Rarity(sketch.value)
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                run = Texts(texts, n)
                expected = run.expected(rarity.words)
                for k in range(len(texts)):
                    key = rarity.ranked(run, k, expected)
                    if 0 < len(key) <= LIGHT_MAX:
                        m = _missing(len(key), t) + 1
                        total[len(key)] += 1, m, (2.0 ** ((key[:m] >> np.uint64(56)) / 4.0) - 1).sum() / 2
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_pydict({"size": pa.array(at, pa.int32()), "sets": total[at, 0], "postings": total[at, 1], "scans": total[at, 2]})

    short = docs.where(F.length("text") <= 16 * LIGHT_MAX).select("text")  # an estimate: the result is the same for any boundary
    rows = short.mapInArrow(scan, "size int, sets double, postings double, scans double").groupBy("size").agg(F.sum("sets"), F.sum("postings"), F.sum("scans")).collect()
    return {r[0]: (int(r[1]), int(r[2]), r[3]) for r in rows}


_POSTING = "part int, small boolean, tok binary, ids binary, size binary, pos binary"


def _alone(size: np.ndarray | int, t: float):
    """Whether sets of at most this size may be similar with one n-gram in common: subsets of two don't find them."""
    return t * size <= 1 + 1e-9


def _postings(place: DataFrame, labels: RowMap, sketch, n: int, t: float, boundary: int, parts: int) -> DataFrame:
    """Posting lists of the distinct sets in packed blocks, one for each (run of texts, part, kind); part is a
    range of token hashes. labels: -1 for rows whose set another row stands for, else the group of the row's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = Rarity(sketch.value)
        kinds: tuple[list, list] = ([], [])
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for small, kind in enumerate(kinds):
                if not kind:
                    continue
                lens = np.array([len(x[0]) for x in kind])
                with np.errstate(over="ignore"):
                    tok = np.concatenate([x[0] for x in kind]) * _PAIR
                part = (tok >> np.uint64(33)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                ids = np.repeat(np.array([x[1:3] for x in kind], np.int64), lens, axis=0)
                pos = np.arange(len(tok), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
                cols = [tok.astype(np.uint32), ids, np.repeat(np.array([x[3] for x in kind], np.int32), lens), pos.astype(np.int32)]
                cols = [c[order] for c in cols]
                at = np.flatnonzero(np.diff(part[order], prepend=-1))
                ends = [*at[1:], len(order)]
                yield pa.RecordBatch.from_pydict({"part": pa.array(part[order][at], pa.int32()), "small": pa.array([bool(small)] * len(at))} | {k: pa.array([c[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for k, c in zip(("tok", "ids", "size", "pos"), cols)})
                kind.clear()

        for b in batches:
            found, label = labels.find(b.column(1).to_numpy(), b.column(2).to_numpy())
            for start, texts in text_slices(b.column(0)):
                texts = [None if found[k] and label[k] < 0 else x for k, x in enumerate(texts, start)]
                run = Texts(texts, n)
                expected = run.expected(rarity.words)
                for k in range(len(texts)):
                    if not run.lens[k]:
                        continue
                    ranked = rarity.ranked(run, k, expected)
                    size, sid = len(ranked), set_id(ranked & _HASH)
                    m, group = _missing(size, t), int(label[start + k]) if found[start + k] else sid
                    if 2 <= size < boundary:
                        kinds[1].append((subset_tokens(ranked[: m + K]), sid, group, size))
                    if size >= t * boundary or _alone(size, t):
                        kinds[0].append((ranked[: m + 1], sid, group, size))
                        held += m
                if held > 400_000:
                    yield from flush()
                    held = 0
        yield from flush()
        del rarity
        trim()

    return place.select("text", FILE, ROW).mapInArrow(scan, _POSTING)


def _pairs_of(tok: np.ndarray, ids: np.ndarray, size: np.ndarray, pos: np.ndarray, small: bool, t: float, boundary: int, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different groups that share a token where the length and positional bounds hold, least id first.

    The positional bound holds at the first token that two similar sets share. Pairs of one group aren't
    formed: a list of a thousand near copies costs as much as its length.
    """
    order = np.lexsort((ids[:, 0], ids[:, 1], tok))
    tok, sid, group, size, pos = tok[order], ids[order, 0], ids[order, 1], size[order].astype(np.int64), pos[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
    tok, sid, group, size, pos = (x[new] for x in (tok, sid, group, size, pos))
    if not len(tok):
        return
    first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    run = np.flatnonzero(np.concatenate([[True], (tok[1:] != tok[:-1]) | (group[1:] != group[:-1])]))
    list_end = np.repeat(np.append(first[1:], len(tok)), np.diff(np.append(first, len(tok))))
    run_end = np.repeat(np.append(run[1:], len(tok)), np.diff(np.append(run, len(tok))))
    left = np.flatnonzero(list_end > run_end)
    many = (list_end - run_end)[left]
    done = np.concatenate([[0], np.cumsum(many)])
    start = 0
    while start < len(left):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + most, "right")) - 1)
        n = many[start:stop]
        i = np.repeat(left[start:stop], n)
        j = run_end[i] + np.arange(len(i)) - np.repeat(done[start:stop] - done[start], n)
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = t * high <= low + 1e-9
        if not small:
            ok &= (high >= boundary) | _alone(high, t)
            ok &= np.minimum(size[i] - pos[i], size[j] - pos[j]) >= np.ceil(t / (1 + t) * (low + high) - 1e-9)
        i, j = sid[i[ok]], sid[j[ok]]
        if len(i):
            yield np.minimum(i, j), np.maximum(i, j)
        start = stop


def _distinct_pairs(got: list) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate([x[k] for x in got]) for k in range(2))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[at], b[at]


def _candidates(postings: DataFrame, t: float, boundary: int, tasks: int) -> DataFrame:
    """Distinct pairs (a, b) of sets of different groups that meet in a posting list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            tok, ids, sizes, pos = (np.frombuffer(b"".join(x[k] for x in held), kind) for k, kind in enumerate((np.uint32, np.int64, np.int32, np.int32)))
            got, size = [], 0
            for pair in _pairs_of(tok, ids.reshape(-1, 2), sizes, pos, key[1], t, boundary):
                got.append(pair)
                size += len(pair[0])
                if size > 400_000:
                    got = [_distinct_pairs(got)]
                    size = len(got[0][0])
                    if size > 200_000:
                        yield pa.RecordBatch.from_pydict(dict(zip(("a", "b"), got[0])))
                        got, size = [], 0
            if got:
                yield pa.RecordBatch.from_pydict(dict(zip(("a", "b"), _distinct_pairs(got))))

        for batch in batches:
            cols = [batch.column(k) for k in range(6)]
            for r in range(batch.num_rows):
                k = (cols[0][r].as_py(), cols[1][r].as_py())
                if k != key and held:
                    yield from flush()
                    held = []
                key = k
                held.append(tuple(cols[c][r].as_py() for c in range(2, 6)))
        if held:
            yield from flush()
        held = []
        trim()

    spread = postings.repartition(tasks, "part", "small").sortWithinPartitions("part", "small")
    return spread.mapInArrow(scan, "a long, b long").distinct()


def _near_keys(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of a set and the least set that has a minimum-hash key with it: as many as keys at most."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64), "b": np.repeat(b.column(0).to_numpy(), _KEYS)})

    keys = sets.select("sid", "keys").mapInArrow(explode, "key long, b long")
    least = keys.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("key", "a")
    return keys.join(least, "key").where("a <> b").select("a", "b").distinct()


def _plausible(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs whose bitmaps differ in no more bits than similar sets of their sizes may differ in n-grams."""
    ends = [sets.select(F.col("sid").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")) for x in ("a", "b")]
    j = pairs.join(ends[0], "a").join(ends[1], "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            xs, ys = b.column(3).to_pylist(), b.column(5).to_pylist()
            widths = np.array([(len(x), len(y)) for x, y in zip(xs, ys)])
            differ = np.zeros(b.num_rows, np.int64)
            for p, q in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == (p, q)).all(1))
                x, y = (np.frombuffer(b"".join(z[k] for k in at), np.uint8).reshape(len(at), -1) for z in (xs, ys))
                differ[at] = ones[_fold(x, min(p, q)) ^ _fold(y, min(p, q))].sum(1)
            total = b.column(2).to_numpy().astype(np.int64) + b.column(4).to_numpy()
            ok = pa.array(differ <= (1 - t) / (1 + t) * total + 1e-9)
            yield pa.RecordBatch.from_pydict({"a": b.column(0).filter(ok), "b": b.column(1).filter(ok)})
        trim()

    return j.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(check, "a long, b long")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of xs shares with each of ys: frequent n-grams as a product of 0-1 matrices,
    those that few sets have by their pairs of sets."""
    nx, ny = len(xs), len(ys)
    lens = np.array([len(s) for s in chain(xs, ys)])
    flat, at = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    row = np.repeat(np.arange(nx + ny), lens)
    left = row < nx
    x = np.bincount(at[left], minlength=len(flat))
    y = np.bincount(at[~left], minlength=len(flat))
    out = np.zeros((nx, ny), np.float32)
    dense = x.astype(np.float64) * y > max(nx * ny / 200, 1)
    name = np.full(len(flat), -1)
    name[dense] = np.arange(dense.sum())
    d = name[at]
    for start in range(0, int(dense.sum()), 1024):
        some = (d >= start) & (d < start + 1024)
        a, b = np.zeros((nx, 1024), np.float32), np.zeros((ny, 1024), np.float32)
        a[row[some & left], d[some & left] - start] = 1
        b[row[some & ~left] - nx, d[some & ~left] - start] = 1
        out += a @ b.T
    rare = (x > 0) & (y > 0) & ~dense
    p, q = np.flatnonzero(rare[at] & left), np.flatnonzero(rare[at] & ~left)
    q = q[np.argsort(at[q], kind="stable")]
    begins = np.concatenate([[0], np.cumsum(np.where(rare, y, 0))])
    many = y[at[p]]
    done = np.concatenate([[0], np.cumsum(many)])
    start = 0
    while start < len(p):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + 500_000, "right")) - 1)
        n = many[start:stop]
        i = np.repeat(row[p[start:stop]], n)
        k = np.repeat(begins[at[p[start:stop]]], n) + np.arange(len(i)) - np.repeat(done[start:stop] - done[start], n)
        cell, times = np.unique(i * ny + (row[q[k]] - nx), return_counts=True)
        out.reshape(-1)[cell] += times
        start = stop
    return out


def _reaches(both: np.ndarray, sx: np.ndarray, sy: np.ndarray, t: float) -> np.ndarray:
    """Which sets, of sizes sx and sy with these overlaps, reach Jaccard similarity t."""
    out = np.zeros(both.shape, bool)
    sx, sy = sx.astype(np.float64), sy.astype(np.float64)
    for k in range(0, len(sx), 256):
        o = both[k : k + 256].astype(np.float64)
        out[k : k + 256] = o / (sx[k : k + 256, None] + sy - o) >= t - 1e-12
    return out


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """Edges (vertex, another it is connected with) that connect what rows and columns, numbered after the rows, the matrix connects."""
    nx, ny = similar.shape
    free, out = similar.any(1), []
    for i in range(nx):
        if not free[i]:
            continue
        rows, cols = np.zeros(nx, bool), np.zeros(ny, bool)
        rows[i], new = True, np.array([i])
        while len(new):
            more = similar[new].any(0) & ~cols
            cols |= more
            more = similar[:, more].any(1) & ~rows
            rows |= more
            new = np.flatnonzero(more)
        free &= ~rows
        out += [(i, int(k)) for k in np.flatnonzero(rows) if k != i] + [(i, nx + int(k)) for k in np.flatnonzero(cols)]
    return out


_SHIPPED = "g long, lo int, hi int, part int, root long, side int, sid long, size int, body binary"
_FOUND = "g long, lo int, hi int, a long, b long, links long, x binary, y binary, cells binary"


def _links(similar: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> list[tuple]:
    """(a, b, links) rows of a block of pairs of sets, named by x and y."""
    if same:
        np.fill_diagonal(similar, False)
    out = [(x[k], None, v) for k, v in enumerate(similar.sum(1)) if v]
    if not same:
        out += [(y[k], None, v) for k, v in enumerate(similar.sum(0)) if v]
    names = np.concatenate([x, y])
    return out + [(names[i], names[j], None) for i, j in _forest(similar) if names[i] != names[j]]


def _summed(counted: DataFrame, t: float) -> DataFrame:
    """The links of block pairs whose overlaps come in parts, of which one is held at a time."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, x, y = None, None, None, None

        def out() -> pa.RecordBatch:
            rows = _links(_reaches(total, x[:, 1], y[:, 1], t), x[:, 0], y[:, 0], key[1] == key[2])
            cols = zip(*rows) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array([None if v is None else int(v) for v in c], pa.int64()) for c in cols], names=["a", "b", "links"])

        for b in batches:
            for r in range(b.num_rows):
                g, lo, hi, p, q, cells = (c[r].as_py() for c in b.columns)
                if (g, lo, hi) != key:
                    if key is not None:
                        yield out()
                    key, x, y = (g, lo, hi), np.frombuffer(p, np.int64).reshape(-1, 2), np.frombuffer(q, np.int64).reshape(-1, 2)
                    total = np.zeros((len(x), len(y)), np.float32)
                total += np.frombuffer(zlib.decompress(cells), np.uint32).reshape(total.shape)
        if key is not None:
            yield out()
        trim()

    keys = ("g", "lo", "hi")
    return counted.select(*keys, "x", "y", "cells").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(scan, "a long, b long, links long")


def _verify(place: DataFrame, sets: DataFrame, roots: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b, links): for each set of the candidates' components the number of sets in it that are similar to it (b
    null), in parts to be summed, and edges (links null) that connect what similar pairs connect.

    All pairs of a component are compared, as products of blocks of sets. Small components go to their task as
    texts. Of a large one the n-grams are shipped, to each pair of blocks of so many sets; if those have too many
    n-grams for a task they are cut in ranges of hashes, whose overlaps are added up. So a component is copied
    as often as it has blocks of sets, whatever their lengths.
    """
    sized = roots.select(F.col("v").alias("sid"), "root").join(sets.select("sid", "size", FILE, ROW), "sid")
    many = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("size").alias("grams"))
    many = many.withColumn("blocks", F.ceil(F.col("sets") / F.lit(_BLOCK_SETS)).cast("long"))
    many = many.withColumn("parts", F.ceil(F.col("grams") * F.when(F.col("blocks") > 1, 2).otherwise(1) / F.col("blocks") / F.lit(_BLOCK_GRAMS)).cast("long"))
    many = cut(many)
    groups = max(1, math.ceil((many.agg(F.sum("grams")).first()[0] or 0) / _BLOCK_GRAMS))
    where = RowMap(sized.join(many, "root"), ("root", "blocks", "parts"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, root, blocks, parts = where.find(b.column(1).to_numpy(), b.column(2).to_numpy())
            out: list[tuple] = []
            held = 0
            for k in np.flatnonzero(found):
                r, m, p = int(root[k]), int(blocks[k]), int(parts[k])
                text = b.column(0)[int(k)].as_py()
                if m == p == 1:
                    out.append((-1 - r % groups, 0, 0, -1, r, 0, 0, 0, text.encode("utf-8", "surrogatepass")))
                    held += len(text)
                else:
                    s = ngram_set(text, n)
                    sid = set_id(s)
                    own = sid % m
                    ends = np.searchsorted(s, ((np.arange(1, p, dtype=np.uint64) << np.uint64(56)) // np.uint64(p)))
                    for part, piece in enumerate(np.split(s, ends)):
                        out += [(r, min(own, o), max(own, o), part, r, own, sid, len(s), piece.tobytes()) for o in range(m)]
                        held += len(piece) * 8 * m
                if len(out) >= 2000 or held > 4_000_000:
                    yield _rows_of(out)
                    out, held = [], 0
            if out:
                yield _rows_of(out)
        trim()

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        g0, lo, hi, part = (int(pdf[c].iloc[0]) for c in ("g", "lo", "hi", "part"))
        if part >= 0:
            pdf = pdf.sort_values("sid", kind="stable").drop_duplicates("sid")
            x, y = pdf[pdf["side"] == lo], pdf[pdf["side"] == hi]
            cells = overlaps(*([np.frombuffer(v, np.uint64) for v in z["body"]] for z in (x, y)))
            names = [z[["sid", "size"]].to_numpy(np.int64).tobytes() for z in (x, y)]
            trim()
            return pd.DataFrame({"g": [g0], "lo": [lo], "hi": [hi], "a": pd.array([None], "Int64"), "b": pd.array([None], "Int64"), "links": pd.array([None], "Int64"), "x": [names[0]], "y": [names[1]], "cells": [zlib.compress(cells.astype(np.uint32).tobytes(), 1)]})
        out: list[tuple] = []
        for _, g in pdf.groupby("root", sort=False):
            grams = [ngram_set(x.decode("utf-8", "surrogatepass"), n) for x in g["body"]]
            ids = np.array([set_id(s) for s in grams])
            sizes = np.array([len(s) for s in grams])
            out += _links(_reaches(overlaps(grams, grams), sizes, sizes, t), ids, ids, True)
        cols = zip(*out) if out else ([], [], [])
        found = pd.DataFrame({c: pd.array([None if v is None else int(v) for v in x], "Int64") for c, x in zip(("a", "b", "links"), cols)})
        found[["g", "lo", "hi"]] = g0, lo, hi
        found[["x", "y", "cells"]] = None
        return found[["g", "lo", "hi", "a", "b", "links", "x", "y", "cells"]]

    shipped = place.select("text", FILE, ROW).mapInArrow(spread, _SHIPPED)
    found = stored(shipped.groupBy("g", "lo", "hi", "part").applyInPandas(check, _FOUND))
    return found.where("cells is null").select("a", "b", "links").unionByName(_summed(found.where("cells is not null"), t))


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["g", "lo", "hi", "part", "root", "side", "sid", "size", "body"])


def _classes(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, n_copies, n_links) of every doc_id, and (doc_id, __file, __row) of the rows of docs, located."""
    spark = docs.sparkSession
    place = located(docs).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, ROW)
    scanned = stored(_read_sets(place, n))
    rows = scanned.where("chunk = -1").drop("chunk", "counts")
    ids = rows.where("sid is not null")
    sets = ids.groupBy("sid").agg(F.min(F.struct("doc_id", FILE, ROW)).alias("least"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("keys").alias("keys"))
    sets = stored(sets.select("sid", "size", "bits", "keys", *[F.col("least")[c].alias(c) for c in ("doc_id", FILE, ROW)]))
    near = cut(_plausible(_near_keys(sets), sets, t))
    known = components(near, "a", "b").withColumnRenamed("v", "sid")
    marks = sets.join(known, "sid").select(FILE, ROW, F.col("root").alias("label"))
    stands = sets.select(FILE, ROW)
    marks = marks.unionByName(ids.select(FILE, ROW).join(stands, [FILE, ROW], "left_anti").withColumn("label", F.lit(-1).cast("long")))
    total = sets.count()
    tasks = max(4, math.ceil(total / (4 * _ROWS_A_PART)))
    sketch = spark.sparkContext.broadcast(_sketches(scanned))
    boundary = choose_boundary(_costs(place, sketch, n, t), t)
    postings = _postings(place, RowMap(marks, ("label",)), sketch, n, t, boundary, max(_LEAST_PARTS, 4 * tasks))
    across = cut(_plausible(_candidates(postings, t, boundary, tasks), sets, t))
    sketch.destroy()
    found = cut(_verify(place, sets, components(near.unionByName(across), "a", "b"), n, t))
    links = found.where("b is null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    # a doc_id with several texts holds their sets together
    of_doc = ids.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z")
    bridges = ids.join(of_doc, "doc_id").select("a", F.col("sid").alias("b")).where("a <> b")
    roots = components(found.where("b is not null").select("a", "b").unionByName(bridges), "a", "b").withColumnRenamed("v", "sid")
    copies = ids.groupBy("sid").agg(F.count_distinct("doc_id").alias("copies"))
    named = copies.join(sets.select("sid", F.col("doc_id").alias("least")), "sid").join(roots, "sid", "left").join(links, "sid", "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("sid", "class_id", "copies", "links")
    out = rows.select("doc_id", "sid").distinct().join(named, "sid", "left").groupBy("doc_id").agg(
        F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("n_copies"),
        F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("n_links"),
    )
    return out, rows.select("doc_id", FILE, ROW)


def similarity_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links) for every doc_id of docs: the join of all pairs of documents whose sets
    of word n-grams reach the threshold of Jaccard similarity, told per document.

    Words are runs of word characters in lower case. n_copies counts the other documents that have the same set,
    n_links the different sets that reach the threshold with the document's own: each similar pair of different
    sets is found and counted, for any number of partners. class_id is the least doc_id that similar pairs lead
    to, the document's own if it has none.

    Exact but for collisions of 56-bit hashes. Of equal sets one stands for all. A set of size s may lack m =
    s - ceil(t s) n-grams in a partner, so with n-grams ordered by rarity partners share k of their m + k rarest.
    Small sets (size under a boundary) enumerate the 2-subsets of their m + 2 rarest and meet in equal subsets;
    sets from t x boundary on list their m + 1 rarest in inverted lists, which are scanned for pairs with a large
    set, under length and positional bounds; so are sets so small that one common n-gram may do. The boundary is
    the one of least estimated cost, rarity an estimate from all documents in a table of fixed size. Candidates
    must pass a bitmap bound and are counted by comparing whole components of candidates, block by block.

    Near copies never become pairs: minimum-hash keys first link sets with the least set of their key, these
    groups are compared as wholes anyhow, and lists only form pairs of different groups.

    Texts that are null or have no word are alone in their class. Rows without doc_id are left out. Rows that
    repeat a doc_id make one document: its sets are in one class, its counts are added up over distinct sets.
    Texts shorter than n words have one n-gram, the whole text. Empty tables give no rows; other columns are ignored.
    """
    return _classes(docs, n, threshold)[0]


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class of similarity_classes, that of the least doc_id; all columns kept.

    Of rows that repeat a doc_id one stays. Rows without doc_id stay, and so does a document without a word. Which
    rows go is told by their places in the files, so texts don't move. An empty table gives no rows.
    """
    docs = located(docs)
    kept = [c for c in docs.columns if c not in (FILE, ROW)]
    classes, rows = _classes(docs.select("doc_id", "text", FILE, ROW), n, threshold)
    gone = rows.join(classes.where("class_id <> doc_id").select("doc_id"), "doc_id", "left_semi")
    first = rows.groupBy("doc_id").agg(F.min(F.struct(FILE, ROW)).alias("x"), F.count("*").alias("n")).where("n > 1")
    again = rows.join(first, "doc_id").where(F.struct(FILE, ROW) != F.col("x"))
    mark = RowMap(gone.select(FILE, ROW).unionByName(again.select(FILE, ROW)).distinct())
    return docs.where(~mark.column()).select(*[F.col(f"`{c}`") for c in kept])


SQL = f"""
with recursive d as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') w from documents where doc_id is not null),
s as (select distinct doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {N - 1}, 1) + 1), lambda k: array_to_string(w[k:k + {N - 1}], ' ')))) g from d where len(w) > 0),
class as (select min(doc_id) x, count(distinct doc_id) n, g from s group by g),
flat as (select x, len(g) size, unnest(g) tok from class),
shared as (select a.x a, b.x b, a.size sa, b.size sb, count(*) n from flat a join flat b on a.tok = b.tok and a.x < b.x and least(a.size, b.size) >= {THRESHOLD} * greatest(a.size, b.size) - 1e-9 group by all),
near as (select a, b from shared where n / (sa + sb - n) >= {THRESHOLD} - 1e-12),
ends as (select a, b from near union all select b, a from near),
links as (select a x, count(*) n from ends group by a),
reach as (select x v, x root from class union select e.b, r.root from reach r join ends e on e.a = r.v),
roots as (select v x, min(root) class_id from reach group by v)
select doc_id, coalesce(min(class_id), doc_id) class_id, cast(coalesce(sum(class.n - 1), 0) as bigint) n_copies, cast(coalesce(sum(links.n), 0) as bigint) n_links
from (select distinct doc_id from d) left join s using (doc_id) left join class using (g) left join roots using (x) left join links using (x) group by doc_id
"""
