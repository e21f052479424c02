"""Operator 2: URL prefix rules by a sort-merge range join on reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: (rule_id, pattern, action): the production list. A bare host covers its subdomains, a host with a path its own pages under it.
RULES = [
    (1, "spam-farm.example.org", "block"),
    (2, "spam-farm.example.org/en/", "allow"),
    (3, "spam-farm.example.org/en/1", "block"),
    (4, "example.net", "allow"),
    (5, "blog.tionsh.example.net", "block"),
    (6, "blog.tionsh.example.net/en/", "allow"),
    (7, "m.ththth.example.net/en/7", "block"),
    (8, "example.com", "allow"),
    (9, "tionble.example.com", "block"),
    (10, "www.tionble.example.com/fr/", "allow"),
    (11, "www.ththwh.example.org/de/5", "block"),
    (12, "ads.example.com", "block"),
    (13, "blog.tionsh.example.net", "allow"),
]
_ROWS_A_PART = 50_000
_MOST_PARTS = 20_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def url_key(url: Column) -> Column:
    """org,example,www,)/path?query: the host's labels in lower case and reversed, then the path as written.

    Scheme, user, port and fragment don't count; an empty path is /. Null if there is no scheme or host.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    path = F.regexp_extract(url, _PATH, 1)
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.length(host) > 0, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(",)"), path))


def rule_key(pattern: Column) -> Column:
    """The key prefix that a rule's pattern, host or host/path, stands for; null for a pattern without host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, r"^([^/]*)", 1)), r"\.+$", "")
    labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","))
    path = F.regexp_extract(pattern, r"^[^/]*(/.*)$", 1)
    return F.when(F.length(host) > 0, F.when(F.length(path) > 0, F.concat(labels, F.lit(")"), path)).otherwise(labels))


def _bounds(keys: DataFrame, rows_a_part: int) -> list[str]:
    """Keys that cut the pages in parts of about equal size: where they lie affects speed only."""
    n = keys.count()
    parts = min(_MOST_PARTS, -(-n // rows_a_part))
    if parts < 2:
        return []
    step = max(1, n // (32 * parts))
    # equal keys are thinned by their page, so one that is very frequent weighs as much as it should
    some = sorted(r.key for r in keys.where(F.pmod(F.xxhash64("page_id", "key"), F.lit(step)) == 0).select("key").collect())
    return sorted({some[k * len(some) // parts] for k in range(1, parts)}) if some else []


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (part, key, rules before pages): rules open intervals that nest, the stack holds the open ones."""
    part, stack = None, []
    for b in batches:
        pages: list[tuple] = []
        for p, key, kind, page, url, rule, action in zip(*(b.column(k).to_pylist() for k in range(7))):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, action))
            else:
                pages.append((page, url, stack[-1][1] if stack else None, stack[-1][2] if stack else None, len(stack)))
        cols = list(zip(*pages)) if pages else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32()))], names=["page_id", "url", "rule_id", "action", "n_rules"])


def filtered(pages: DataFrame, rules: DataFrame, rows_a_part: int = _ROWS_A_PART) -> DataFrame:
    """(page_id, url, rule_id, action, n_rules, keep) for every row of pages.

    A rule (rule_id, pattern, action block or allow) covers the interval of keys that begin with its key; these
    intervals nest or are apart. n_rules is how many cover the page, rule_id and action are those of the
    innermost, keep is false if it blocks. Of rules with one key a block lies inside an allow, and of equal
    actions the least rule_id is innermost. A page that no rule covers has null rule_id and action and is kept.

    Pages are cut in key ranges; a rule is copied to each range that its interval meets; every range is
    sorted once and swept with a stack of the open rules. Memory is the nesting depth, and neither side is
    broadcast: only the range bounds are, one for 50,000 pages and 20,000 at most.

    A null or hostless url is covered by no rule. Rules with null id, a null or hostless pattern or another
    action are ignored, repeated rows of rules count once. Repeated pages each give their row. Empty tables
    are fine; other columns are ignored.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", url_key(F.col("url")).alias("key"))
    r = rules.select(F.col("rule_id").cast("long").alias("rule_id"), rule_key(F.col("pattern")).alias("key"), "action")
    r = r.where("rule_id is not null and key is not null and action in ('block', 'allow')").distinct()
    bounds = pages.sparkSession.sparkContext.broadcast(_bounds(p.where("key is not null"), rows_a_part))

    @F.pandas_udf("int")
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds.value, object), keys.to_numpy(), "right").astype(np.int32)) if bounds.value else pd.Series(np.zeros(len(keys), np.int32))

    top = "\U0010ffff"
    r = r.withColumn("part", F.explode(F.sequence(part_of("key"), part_of(F.concat("key", F.lit(top))))))
    left = r.select("part", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "rule_id", "action")
    right = p.where("key is not null").select(part_of("key").alias("part"), "key", F.lit(1).alias("kind"), "page_id", "url", F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"))
    both = left.unionByName(right).repartition(max(1, len(bounds.value) + 1), "part")
    both = both.sortWithinPartitions("part", "key", "kind", "action", F.col("rule_id").desc())
    swept = both.mapInArrow(_sweep, "page_id long, url string, rule_id long, action string, n_rules int")
    none = p.where("key is null").select("page_id", "url", F.lit(None).cast("long").alias("rule_id"), F.lit(None).cast("string").alias("action"), F.lit(0).alias("n_rules"))
    return swept.unionByName(none).withColumn("keep", F.coalesce(F.col("action") != "block", F.lit(True)))


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id long, pattern string, action string")


_VALUES = ", ".join(f"({i}, '{p}', '{a}')" for i, p, a in RULES)
SQL = f"""
with r as (select rule_id, action, array_to_string(list_reverse(string_split(regexp_extract(pattern, '^([^/]*)', 1), '.')), ',') || ',' ||
    case when contains(pattern, '/') then ')' || regexp_extract(pattern, '^[^/]*(/.*)$', 1) else '' end rkey from (values {_VALUES}) v(rule_id, pattern, action)),
p as (select page_id, url, lower(regexp_extract(url, '{_HOST}', 1)) host, regexp_extract(url, '{_PATH}', 1) path from pages),
k as (select page_id, url, case when host <> '' then array_to_string(list_reverse(string_split(regexp_replace(host, '\\.+$', ''), '.')), ',') || ',)' ||
    case when path like '/%' then path else '/' || path end end key from p),
m as (select page_id, url, rule_id, action, row_number() over (partition by page_id, url order by length(rkey) desc nulls last, action desc, rule_id) n, count(rule_id) over (partition by page_id, url) n_rules
  from k left join r on starts_with(key, rkey))
select page_id, url, cast(rule_id as bigint) rule_id, action, cast(n_rules as int) n_rules, coalesce(action <> 'block', true) keep from m where n = 1
"""
