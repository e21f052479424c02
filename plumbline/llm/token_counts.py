"""Operator 7: unigram token counts by dynamic programming shared along a trie of pre-tokens."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sentencepiece model whose ranked pieces are the vocabulary; a parameter everywhere.
MODEL = os.environ.get("PLUMBLINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
_SPLIT = re.compile("[^ \t\n\r\f]+")
_UNKNOWN = 10_000_000
_MOST = 400_000


def load_pieces(path: str = MODEL) -> dict[str, int]:
    """piece -> cost in micro-nats.

    A unigram model's scores are log probabilities and are taken as they are. Other models only rank their pieces
    by frequency (their scores are ranks): there, rank r has probability ~ 1 / (r + 2).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    scores = [sp.get_score(sp.piece_to_id(p)) for p in pieces]
    if pieces and any(x != round(x) for x in scores):
        return {p: round(-1e6 * x) for p, x in zip(pieces, scores)}
    norm = math.log(sum(1 / (r + 2) for r in range(len(pieces))))
    return {p: round(1e6 * (math.log(r + 2) + norm)) for r, p in enumerate(pieces)}


class Counter:
    """Tokens of pre-tokens on the cheapest segmentation; on equal cost the one of fewest tokens.

    A character that no piece covers is spelt in bytes, at a cost above any piece's for each.
    """

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces), default=1)
        self.byte_cost = max(pieces.values(), default=0) + _UNKNOWN
        self.found = ahocorasick.Automaton()
        for p, cost in pieces.items():
            self.found.add_word(p, (len(p), cost))
        self.found.make_automaton()
        self.counts: dict[str, int] = {}

    def learn(self, pre_tokens: Iterable[str]) -> None:
        """Counts of distinct pre-tokens.

        In sorted order they are the leaves of their trie from left to right: best and fewest are the forward
        scores of the nodes on the path to the last one, and only the nodes below the branching point, which
        is the common prefix with the next one, are computed. A terminal's count is stored under its pre-token.
        """
        best, fewest, last = [0], [0], ""
        for token in sorted(pre_tokens):
            word = SPACE + token
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], fewest[shared + 1 :]
            last = word
            for c in word[shared:]:
                n = len(c.encode("utf-8", "surrogatepass"))
                best.append(best[-1] + n * self.byte_cost)
                fewest.append(fewest[-1] + n)
            # matches come in order of their ends, so each is relaxed after all that end where it begins;
            # a spelling in bytes is passed on before the matches that end at its character
            at = shared
            for end, (size, cost) in self.found.iter(word, max(0, shared + 1 - self.longest)):
                end += 1
                if end <= shared or size > end:
                    continue
                while at < end:
                    at += 1
                    self._spell(word, at, best, fewest)
                score, n = best[end - size] + cost, fewest[end - size] + 1
                if score < best[end] or (score == best[end] and n < fewest[end]):
                    best[end], fewest[end] = score, n
            while at < len(word):
                at += 1
                self._spell(word, at, best, fewest)
            self.counts[token] = fewest[-1]

    def _spell(self, word: str, at: int, best: list[int], fewest: list[int]) -> None:
        n = len(word[at - 1].encode("utf-8", "surrogatepass"))
        best[at], fewest[at] = best[at - 1] + n * self.byte_cost, fewest[at - 1] + n

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """(pre-tokens, tokens) of each text."""
        split = [_SPLIT.findall(t) if t else [] for t in texts]
        all_words = set().union(*split)
        new = all_words - self.counts.keys()
        if len(self.counts) + len(new) > _MOST:
            self.counts.clear()
            new = all_words
        self.learn(new)
        out = np.zeros((len(texts), 2), np.int64)
        for k, ws in enumerate(split):
            out[k] = len(ws), sum(map(self.counts.__getitem__, ws))
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each worker process: what it learnt of a batch serves the next ones."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(load_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs.

    Pre-tokens are the runs of visible characters, each with a leading word mark; tokens are the pieces of its
    most probable segmentation under the unigram model (see Counter). Each distinct pre-token of a task's batch
    is scored once, along a trie, and counts are kept for its later batches, up to a bound of memory: so the
    work grows with distinct pre-tokens and nothing is shuffled. model, a path on the driver, is sent to each
    executor once as a file.

    Texts that are null or blank have 0 of both. Long texts and words are counted whole. Repeated rows are
    counted alike, null doc_ids are kept, an empty table gives no rows, and other columns are ignored.
    """

    docs.sparkSession.sparkContext.addFile(model)
    name = os.path.basename(model)

    @F.pandas_udf("struct<words: bigint, tokens: bigint>")
    def count(texts: pd.Series) -> pd.DataFrame:
        c, rows, held = counter(SparkFiles.get(name)), [], 0
        parts: list[list[str | None]] = [[]]
        for t in texts:
            parts[-1].append(t)
            held += len(t or "")
            if held > 8_000_000:
                parts.append([])
                held = 0
        rows = [c.of_texts(p) for p in parts if p]
        return pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 2), np.int64), columns=["words", "tokens"])

    return docs.select("doc_id", count("text").alias("c")).select("doc_id", F.col("c.words").alias("n_pretokens"), F.col("c.tokens").alias("n_tokens"))
