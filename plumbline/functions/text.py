"""Text functions: column expressions where Spark has them, plain Python for driver-sized inputs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARTICLES, _VERBS = "the a an that", "is was were are do does did"
_SMALL, _ASKING = "of in on at to by for from with and or s it", "who what which where when how"
STOPWORDS = frozenset(" ".join((_ARTICLES, _VERBS, _SMALL, _ASKING)).split())
SPLIT = r"[^\p{L}\p{N}]+"
MAX_SPAN_TOKENS = 4


def norm(c: Column) -> Column:
    """The normal form under which cells are compared."""
    return F.lower(F.trim(c))


def loose_norm(c: Column) -> Column:
    """Lower case, runs of white space as one blank, no % or _ wildcards at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), r"^[%_]+|[%_]+$", "")


def tokens(c: Column) -> Column:
    """Letter-or-digit runs of a text in lower case, in order."""
    return F.filter(F.split(F.lower(c), SPLIT), lambda x: x != "")


def humanize(c: Column) -> Column:
    return F.translate(c, "_", " ")


def clip(c: Column, most: int) -> Column:
    """The first `most` characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def render_template(template: str, query: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{query}"), query)


def fnv1a(text: str) -> str:
    """FNV-1a over UTF-8 bytes, 64 bits, 16 hexadecimal digits."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


@F.pandas_udf(T.StringType())
def content_hash(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fnv1a(t))


def tokenize(query: str) -> list[tuple[str, int, int, bool]]:
    """(token, first byte, end byte, stopword) of every run of alphanumeric characters."""
    out: list[tuple[str, int, int, bool]] = []
    at, start, word = 0, 0, ""
    for ch in query + " ":
        if ch.isalnum():
            if not word:
                start = at
            word += ch
        elif word:
            out.append((word, start, at, word.lower() in STOPWORDS))
            word = ""
        at += len(ch.encode())
    return out


def spans_of(query: str) -> list[tuple[int, str, int, int, int, str]]:
    """(span, text, start, end, tokens, status) of every run of 1 to 4 tokens; stopwords alone are skipped."""
    toks, raw, out = tokenize(query), query.encode(), []
    for i in range(len(toks)):
        for n in range(1, min(MAX_SPAN_TOKENS, len(toks) - i) + 1):
            part = toks[i : i + n]
            lo, hi = part[0][1], part[-1][2]
            out.append((len(out), raw[lo:hi].decode(), lo, hi, n, "skipped" if all(t[3] for t in part) else "selected"))
    return out


def whole_span(query: str) -> list[tuple[int, str, int, int, int, str]]:
    """The question from its first token to its last, numbered after its spans; none if it is a span already."""
    toks = tokenize(query)
    if len(toks) <= MAX_SPAN_TOKENS:
        return []
    lo, hi = toks[0][1], toks[-1][2]
    return [(len(spans_of(query)), query.encode()[lo:hi].decode(), lo, hi, len(toks), "selected")]


SPAN_SCHEMA = "qid long, span int, text string, start int, end int, n_tokens int, status string"


def enumerate_spans(queries: DataFrame, whole: bool = False) -> DataFrame:
    """Spans of each (qid, query), all queries at once; whole adds the question as a span of its own if it has more tokens than spans do."""

    def run(batches):
        for pdf in batches:
            rows = [(q, *s) for q, t in zip(pdf["qid"], pdf["query"]) for s in spans_of(t or "") + (whole_span(t or "") if whole else [])]
            yield pd.DataFrame(rows, columns=["qid", "span", "text", "start", "end", "n_tokens", "status"])

    return queries.select("qid", "query").mapInPandas(run, SPAN_SCHEMA)
