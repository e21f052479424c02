"""Each corpus operator against a brute-force version, and its defined results on awkward input."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, decontaminate, jaccard, mixing, pii, quality_classifier, quality_rules, sharding, token_counts, url_filters, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(7)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def text(n: int, r: random.Random = rng) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(t: str, share: float, r: random.Random) -> str:
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in t.split())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = [(k, text(r.randint(1, 120), r), f"s{k % 3}") for k in range(60)]
    out += [(100 + k, edited(out[k % 7][1], 0.04, r), "s0") for k in range(40)]
    out += [(200 + k, out[5][1], "s1") for k in range(6)] + [(300 + k, out[6][1].upper() + " !!", None) for k in range(3)]
    out += [(400, None, "s1"), (401, "", "s1"), (402, " \n ", "s1"), (None, "no id here at all", "s2"), (403, "one", None), (404, "one", "s1"), (405, text(20000, r), "s2")]
    return out + [out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).withColumns({c: F.lit("clash") for c in ("sid", "key", "k", "b", "w", "keep", "score", "tokens", "size", "v", "root", "shard", "n_pii", "old_shard", "moved")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


# 1 quality rules


def brute_scores(rows, good):
    def feats(t):
        toks = re.findall(r"\w+|[^\w\t\n\f\r ]+", t or "")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in toks]
        b = quality_rules.BUCKETS
        return [x % b for x in h] + [b if x == y else (x * 1_000_003 + y) % b for x, y in zip(h, h[1:])]

    raw, trusted = {}, {}
    for i, t, _ in rows:
        for f in feats(t):
            raw[f] = raw.get(f, 0) + 1
            if i in good:
                trusted[f] = trusted.get(f, 0) + 1
    nb, nr, nt, a = quality_rules.BUCKETS + 1, sum(raw.values()), sum(trusted.values()), quality_rules.ALPHA
    s = a * nt / max(nr, 1)
    out = []
    for i, t, _ in rows:
        fs, total = feats(t), 0
        mine = i in good
        for f in set(fs) if nt else ():
            own = fs.count(f)
            g = math.log((trusted.get(f, 0) - own * mine + s) / (nt - len(fs) * mine + s * nb))
            total += own * round(1e6 * (g - math.log((raw[f] - own + a) / (nr - len(fs) + a * nb))))
        out.append((i, len(fs), total))
    return out


def test_quality_rules_match_brute_force(spark, docs, rows):
    good = {k for k in range(0, 60, 2)} | {99_999}
    got = quality_rules.scored(docs, spark.createDataFrame([(k,) for k in [*good, 2]], "doc_id long")).select("doc_id", "n_features", "score", "keep").collect()
    want = brute_scores(rows, good)
    assert len(got) == len(rows)
    by = {i: (n, total) for i, n, total in want}
    for r in got:
        n, total = by[r.doc_id]
        assert r.n_features == n and (r.score is None) == (n == 0)
        if n:
            assert abs(r.score - total / n / 1e6) < 2e-6
            assert r.keep == (total >= n * quality_rules.THRESHOLD) or abs(total / n - quality_rules.THRESHOLD) < 2
        else:
            assert not r.keep


def test_quality_rules_without_trusted_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in quality_rules.scored(docs, none).where("n_features > 0").collect()} == {0.0}
    kept = quality_rules.filter_quality(docs, none)
    assert {r.score for r in kept.select("score").collect()} == {"clash"} and kept.count() == quality_rules.scored(docs, none).where("n_features > 0").count()
    assert quality_rules.scored(empty, none).count() == 0
    assert quality_rules.filter_quality(docs, none).columns == docs.columns


def test_quality_rules_table_grows_with_the_features(spark, docs, rows, monkeypatch):
    load = quality_rules.LOAD
    assert quality_rules.buckets_for(0) == quality_rules.buckets_for(load << 18) == quality_rules.BUCKETS
    assert quality_rules.buckets_for((load << 18) + 1) == 1 << 19 and quality_rules.buckets_for(3 * load << 20) == 1 << 22
    # the same rows with a table that had to grow, in several chunks, as with one given at that size
    trusted = spark.createDataFrame([(k,) for k in range(0, 60, 2)], "doc_id long")
    seen = []
    monkeypatch.setattr(quality_rules, "buckets_for", lambda n: seen.append(n) or 1 << 20)
    grown = sorted(quality_rules.scored(docs, trusted).select("doc_id", "n_features", "score").collect(), key=str)
    b = quality_rules.BUCKETS
    monkeypatch.setattr(quality_rules, "BUCKETS", 1 << 20)
    want = {i: (n, total) for i, n, total in brute_scores(rows, set(range(0, 60, 2)))}
    assert seen == [len(quality_rules.features_of([t for _, t, _ in rows])[0])] and b < 1 << 20
    for r in grown:
        n, total = want[r.doc_id]
        assert r.n_features == n and (not n or abs(r.score - total / n / 1e6) < 2e-6)


def test_quality_rules_ship_each_bucket_once_and_densely(spark):
    # at 30 GB a task has some 2.8 million of 2^29 buckets: 1.44 + log2(190) bits for the gap, 2 for the counts
    r = np.random.default_rng(5)
    at = np.sort(r.choice(1 << 18, 1400, replace=False))
    raw = 1 + (r.random(1400) < 0.1)
    good = (r.random(1400) < 0.5) * raw
    packed = quality_rules._packed(at, raw, good)
    back, both = quality_rules._unpacked(packed)
    assert (back == at).all() and (both == np.stack([raw, good], axis=1)).all() and len(packed) < 2 * len(at)
    assert [len(x) for x in quality_rules._unpacked(quality_rules._packed(at[:0], raw[:0], good[:0]))] == [0, 0]
    most = np.array([0, 2**32 - 1, 2**32 - 1])[:, None]
    assert [x.tolist() for x in quality_rules._unpacked(quality_rules._packed(*most))] == [[0], [[2**32 - 1] * 2]]
    # 1.2 million distinct features twice in one task: a row a chunk, not one for each half a million
    once = [" ".join(str(k) for k in range(n, n + 60_000)) for n in range(0, 600_000, 60_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(once + once)], "doc_id long, text string").coalesce(1)
    place = quality_rules.located(docs)
    good = quality_rules.RowMap(quality_rules.rows_of(place, spark.createDataFrame([(0,)], "doc_id long")))
    got = quality_rules.ngram_counts(place.select("text", "__file", "__row"), good, 1 << 20).collect()
    assert sorted(x.chunk for x in got) == list(range(4))
    n = np.sum([quality_rules._unpacked(x.counts)[1].sum(axis=0) for x in got], axis=0)
    assert n.tolist() == [20 * 119_999, 119_999]


@pytest.mark.parametrize("shared", [True, False])
def test_quality_rules_write_the_table_once(spark, docs, monkeypatch, tmp_path, shared):
    """Into the shared folder, where it can be mapped; else through the driver to the executors. The counts are the same."""
    texts = ["a b a b c", None, "", "b b b", "c d"]
    counted = docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    place = quality_rules.located(counted)
    good = quality_rules.RowMap(quality_rules.rows_of(place, spark.createDataFrame([(0,), (3,)], "doc_id long")))
    b = 1 << 20
    counts = quality_rules.ngram_counts(place.select("text", "__file", "__row"), good, b)
    monkeypatch.setattr(quality_rules, "shared_dir", lambda _: f"file://{tmp_path}")
    if not shared:
        monkeypatch.setattr(quality_rules, "mounted", lambda _: None)
    name = quality_rules.counts_file(counts, b)
    assert name.startswith(str(tmp_path)) == shared and len(list(tmp_path.iterdir())) == shared
    table = np.fromfile(name if shared else quality_rules.SparkFiles.get(name), np.uint32).reshape(-1, 2)
    want = np.zeros((b + 1, 2), np.uint32)
    for k, t in enumerate(texts):
        np.add.at(want, quality_rules.features_of([t], b)[1], [1, k in (0, 3)])
    assert table.shape == want.shape and (table == want).all() and want[b].tolist() == [2, 2]


# 2 URL filters


def py_key(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    if not m or not m.group(1).rstrip("."):
        return None
    path = re.match(r"[^:]*://[^/?#]*([^#]*)", url).group(1)
    return ",".join(reversed(m.group(1).lower().rstrip(".").split("."))) + ",)" + (path if path.startswith("/") else "/" + path)


def py_rule(p):
    host, slash, path = (p or "").partition("/")
    host = host.lower().rstrip(".")
    return None if not host else ",".join(reversed(host.split("."))) + "," + (")" + slash + path if slash else "")


@pytest.mark.parametrize("rows_a_part", [7, 10_000])
def test_url_filters_match_brute_force(spark, rows_a_part):
    r = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "ba.com", "x.org", "Y.x.org", "x.org."]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', ':80', ''])}{r.choice(['', '/', '/p', '/p/q?x=1', '/é/z#f', '?q=a/b'])}" for _ in range(150)] + [None, "", "nohost", "http:///p", "https://u:p@b.a.com/p/q"]
    pats = ["a.com", "a.com/p", "b.a.com", "b.a.com/p/q", "x.org", "x.org/", "x.org/é", "c.b.a.com", "a.com", "com", None, "", "/p", "b.a.com/p/"]
    rules = [(k, p, "block" if k % 3 else "allow") for k, p in enumerate(pats)] + [(None, "a.com", "block"), (90, "a.com", "other"), (0, "a.com", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://a.com/p"), (3, urls[3])], "page_id long, url string").withColumns({"key": F.lit(1), "part": F.lit(2), "rule_id": F.lit(3)})
    got = url_filters.filtered(pages, spark.createDataFrame(rules, "rule_id long, pattern string, action string"), rows_a_part).collect()
    want = []
    for i, u in [*enumerate(urls), (None, "http://a.com/p"), (3, urls[3])]:
        k = py_key(u)
        hit = sorted({(-len(py_rule(p)), a != "block", rid, a) for rid, p, a in rules if rid is not None and a in ("block", "allow") and py_rule(p) and k and k.startswith(py_rule(p))})
        want.append((i, u, hit[0][2] if hit else None, hit[0][3] if hit else None, len(hit), not hit or hit[0][3] != "block"))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert url_filters.filtered(pages.limit(0), spark.createDataFrame(rules, "rule_id long, pattern string, action string")).count() == 0
    assert url_filters.filtered(pages, spark.createDataFrame([], "rule_id long, pattern string, action string")).where("keep").count() == len(want)


def test_url_filters_with_many_deep_rules(spark):
    """Rules that nest thirty deep, and one that covers a third of all pages."""
    r = random.Random(8)
    path = [f"d{k}" for k in range(30)]
    rules = [(k, "deep.example.org/" + "/".join(path[:k]), r.choice(["block", "allow"])) for k in range(1, 31)]
    rules += [(100 + k, f"h{r.randint(0, 40)}.example.org" + r.choice(["", "/", "/a", f"/a/{r.randint(0, 5)}"]), r.choice(["block", "allow"])) for k in range(300)] + [(999, "hot.net", "block")]
    pages = [(k, "http://deep.example.org/" + "/".join(path[: r.randint(0, 30)])) for k in range(150)]
    pages += [(200 + k, f"http://h{r.randint(0, 50)}.example.org/a/{r.randint(0, 9)}") for k in range(150)] + [(400 + k, "http://www.hot.net/same") for k in range(150)]
    table = spark.createDataFrame(rules, "rule_id long, pattern string, action string")
    got = {x.page_id: (x.rule_id, x.action, x.n_rules) for x in url_filters.filtered(spark.createDataFrame(pages, "page_id long, url string"), table, 20).collect()}
    for i, url in pages:
        hits = [(len(k), a == "block", -q, q, a) for q, p, a in rules if (k := py_rule(p)) and py_key(url).startswith(k)]
        best = max(hits, default=None)
        assert got[i] == ((best[3], best[4], len(hits)) if best else (None, None, 0)), (url, got[i], best)


# 3 quality classifier


def labelled(spark, n=240):
    r = random.Random(11)
    rows = [(k, " ".join(w + r.choice(["***", "###"]) for w in text(30, r).split()) if k % 3 == 0 else text(r.randint(5, 60), r).capitalize() + ".", "s") for k in range(n)]
    return docs_of(spark, rows), spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")


def test_classifier_on_held_out_labels_and_against_numpy(spark):
    d, labels = labelled(spark)
    got = {r.doc_id: r for r in quality_classifier.classified(d, labels.where("doc_id < 160")).collect()}
    assert sum(got[k].keep == (k % 3 != 0) for k in range(160, 240)) >= 0.95 * 80
    stats = quality_classifier.with_stats(d).orderBy("doc_id").select(*quality_classifier.STATS).toPandas().to_numpy()
    x = {c: stats[[k for k in range(160) if int(k % 3 != 0) == c]] for c in (0, 1)}
    both = sum(len(v) * np.cov(v.T, bias=True) for v in x.values()) / 160
    logp = []
    for c in (0, 1):
        s = 0.9 * np.cov(x[c].T, bias=True) + 0.1 * both
        s = 0.99 * s + 0.01 * np.trace(s) / len(s) * np.eye(len(s))
        e = stats - x[c].mean(0)
        logp.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) - 0.5 * np.linalg.slogdet(s)[1])
    want = logp[1] - logp[0] + math.log(len(x[1]) / len(x[0]))
    assert np.allclose([got[k].score for k in range(240)], want, rtol=1e-6, atol=1e-6)


def test_statistics_match_brute_force(spark, docs, rows):
    extra = [(900, "Ünïcode ÀÉ Wörd 123 -- a_b\tx\r\n\fy {|}~", "s"), (901, "x" * 300_000, "s"), (902, "A1 A1 a1 !", "s"), (903, "\u00a0 z", "s")]
    got = quality_classifier.with_stats(docs.select("doc_id", "text").unionByName(docs_of(spark, extra).select("doc_id", "text"))).collect()

    def stats(t):
        ws = [w for w in re.split("[ \t\n\r\f]+", (t or "").lower()) if w]
        if not ws:
            return (None,) * 6
        v = re.sub("[ \t\n\r\f]+", "", t)
        odds = lambda n, usual: math.log((p := (n + 30 * usual) / (len(v) + 30)) / (1.0001 - p))
        count = lambda f: sum(map(f, v))
        n = len(ws)
        return (
            math.log(1 + n), odds(count(lambda c: c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), 0.03), odds(count(lambda c: "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ"), 0.03),
            math.log((len(set(ws)) + 30) / (min((n + 1) ** 0.9, n) + 30)), math.log((len(v) + 180) / (n + 30)), odds(count(lambda c: c in "0123456789"), 0.002),
        )

    want = [(i, *stats(t)) for i, t, _ in rows + extra]
    got = sorted(((r.doc_id, *[r[c] for c in quality_classifier.STATS]) for r in got), key=lambda x: (str(x[0]), str(x[1])[:6]))
    want = sorted(want, key=lambda x: (str(x[0]), str(x[1])[:6]))
    assert [x[0] for x in got] == [x[0] for x in want]
    for g, w in zip(got, want):
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(g[1:], w[1:])), (g, w)


def test_classifier_moments_are_exact(spark):
    """Large means and small deviations: floating sums of squares would cancel."""
    far = [(k, *[20.0 + (k * j % 7) * 1e-6 for j in range(1, 7)]) for k in range(200)]
    stats = spark.createDataFrame(far, "doc_id long, " + ", ".join(f"{c} double" for c in quality_classifier.STATS))
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    n, one, two = quality_classifier.class_moments(stats, labels)[1]
    u = quality_classifier.UNIT
    x = [[round(v * u) for v in r[1:]] for r in far if r[0] % 2]
    assert n == 100 and one == [sum(c) for c in zip(*x)] and two == [[sum(a * b for a, b in zip(p, q)) for q in zip(*x)] for p in zip(*x)]


def test_classifier_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classified(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is None for r in got)
    assert {r.doc_id for r in got if not r.keep} == {400, 401, 402}
    labels = labels.unionByName(spark.createDataFrame([(5, 0, 0), (5, 0, 0), (5, 1, 0)], labels.schema))
    got = quality_classifier.classified(docs, labels).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.score is None} == {400, 401, 402}
    assert quality_classifier.classified(empty, labels).count() == 0


# 4 WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a.com/x?y=1", "<p>é\r\n\r\nz</p>"), (2, "http://b.org", ""), (3, None, None), (None, "http://c.de/", "x" * 50_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"type": F.lit(1), "capture_id": F.lit(2), "payload": F.lit(3)})
    got = {r.page_id: r for r in warc.captures_of_pages(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for i, url, html in pages:
        r = got[i]
        assert r.response.body.decode() == (html or "") and r.response.status == 200 and r.n_records == 3
        assert r.target_uri == (url or None) and r.request.method == "GET" and r.metadata[0].fields[0].value == str(i if i is not None else "null")
        assert {h.name: h.value for h in r.response.headers}["Content-Length"] == str(len((html or "").encode()))
    assert got[1].request.target == "/x?y=1" and got[2].request.target == "/"
    raws = [bytes(r.raw) for r in warc.pages_as_records(df).collect()]
    import gzip

    (tmp_path / "a.warc").write_bytes(b"".join(raws[:5]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in raws[5:]))
    again = warc.assembled(warc.parsed(warc.read_warc(spark, str(tmp_path))))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, warc.assembled(warc.parsed(warc.pages_as_records(df))).collect()))


def brute_captures(pages):
    """What the captures of pages must hold, without any record in between."""
    out = set()
    for i, url, html in {(i, u, h) for i, u, h in pages}:
        body = (html or "").encode()
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
        out.add((i, url or None, 200, body, str(len(body)), "GET", (m.group(2) if m else "") or "/", m.group(1) if m else "", 1, 3))
    return out


def test_warc_matches_brute_force(spark, tmp_path):
    r = random.Random(12)
    pages = [(k % 40, r.choice(["http://a.com/x", "https://b.org?q=1#f", "http://c.de", None]), r.choice(["", "<p>a</p>", "é\r\n\r\nb\r\n", None, "\r\n\r\n", "x" * 3000])) for k in range(120)]
    pages += [(7, "http://a.com/x", "one"), (7, "http://a.com/x", "two"), (7, "http://a.com/x", "two"), (None, "http://n.o", "WARC/1.0\r\nWARC-Type: response")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("raw", "type", "record_id", "payload", "date", "concurrent_to")})
    name = lambda hs, n: next(h.value for h in hs if h.name == n)
    for records in (warc.pages_as_records(df), None):
        if records is None:
            raws = [bytes(x.raw) for x in warc.pages_as_records(df).collect()]
            r.shuffle(raws)
            (tmp_path / "deep").mkdir()
            (tmp_path / "deep" / "a.warc").write_bytes(b"\r\n".join(raws))
            records = warc.read_warc(spark, str(tmp_path))
        rows = warc.assembled(warc.parsed(records)).collect()
        page = lambda x: next(h.value for h in x.metadata[0].fields if h.name == "page_id")
        got = {(None if page(x) == "null" else int(page(x)), x.target_uri, x.response.status, bytes(x.response.body), name(x.response.headers, "Content-Length"), x.request.method, x.request.target, name(x.request.headers, "Host"), len(x.metadata), x.n_records) for x in rows}
        # pages that differ in null and '' only are two captures that look alike
        assert got == brute_captures(pages) and len(rows) == len(set(pages))
    assert warc.captures_of_pages(df).count() == len(set(pages)) and warc.captures_of_pages(df.limit(0)).count() == 0


def test_warc_links(spark):
    def rec(i, kind, to=(), body=b"a: b"):
        return (i, kind, "u:" + (i or ""), "d", None, list(to), body)

    rows = [
        rec("r1", "response", ["q1"]), rec("q1", "request"), rec("m1", "metadata", ["q1"]),  # named by the response, and two hops
        rec("r2", "response"), rec("r3", "response"), rec("m2", "metadata", ["r3", "r2"]), rec("m2", "metadata", ["r3", "r2"]),  # several, and a repeat
        rec("q9", "request", ["gone"]), rec("m9", "metadata", ["gone"]), rec(None, "request", ["r2"]), rec("w", "warcinfo"), rec("q2", "request", ["r2"], None), rec("q0", "request", ["r2"]),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, target_uri string, date string, content_type string, concurrent_to array<string>, payload binary")
    got = {r.capture_id: (r.response and r.response.record_id, r.request and r.request.record_id, [m.record_id for m in r.metadata], r.n_records) for r in warc.assembled(df).collect()}
    assert got == {"r1": ("r1", "q1", ["m1"], 3), "r2": ("r2", "q0", ["m2"], 4), "r3": ("r3", None, [], 1), "gone": (None, "q9", ["m9"], 2)}
    assert warc.assembled(df.limit(0)).count() == 0
    assert warc.parsed(spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"junk"),), (bytearray(b"WARC/1.0\r\nWARC-Type: request"),)], "raw binary")).count() == 1


# 5 PII


def test_permutations_are_bijections():
    for size in (1, 2, 5, 100, 1000):
        assert sorted(pii.permute(k, size, b"k", "t") for k in range(size)) == list(range(size))
    assert len({pii._date(f"2001-{m:02d}-{d:02d}", b"k") for m in range(1, 13) for d in range(1, 29)}) == 12 * 28
    valid = [f"{k:012d}" for k in range(4000) if pii.luhn(f"{k:012d}")]
    out = {pii._number(x, b"k") for x in valid}
    assert len(out) == len(valid) and all(pii.luhn(x) and len(x) == 12 for x in out)
    assert pii._number("1234567890123456", b"k") is None
    names = {f"{a}{b}@x.cn" for a in "абвгдł王" for b in "éñö"}
    assert len({pii._email(x, b"k") for x in names}) == len(names) and all(pii._email(x, b"k") != x for x in names)
    assert len({pii._hex(f"{k:0130x}", b"k") for k in range(300)}) == 300


def slow_permute(value, size, key, tweak):
    """The same network, written down again: halves as bit strings, walked until a value falls in the range."""
    bits = 2
    while 1 << bits < size or bits % 2:
        bits += 1
    half = bits // 2
    while True:
        left, right = divmod(value, 2**half)
        for r in range(10):
            n = (half + 7) // 8
            f = int.from_bytes(hashlib.blake2b(right.to_bytes(n, "big") + f"|{tweak}|{size}|{r}".encode(), key=key, digest_size=max(8, n)).digest(), "big") % 2**half
            left, right = right, left ^ f
        value = left * 2**half + right
        if value < size:
            return value


def test_pseudonyms_match_brute_force():
    key, r = b"k" * 16, random.Random(3)
    for _ in range(200):
        size = r.randint(1, 10 ** r.randint(1, 30))
        v = r.randrange(size)
        assert pii.permute(v, size, key, "t") == slow_permute(v, size, key, "t")
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    check = lambda d: next(d + c for c in "0123456789" if sum(int(x) if k % 2 == 0 else (2 * int(x)) // 10 + (2 * int(x)) % 10 for k, x in enumerate(reversed(d + c))) % 10 == 0)
    for _ in range(100):
        card, phone, day = check(digits(15)), digits(10), 365 + r.randrange(70_000)
        body = str(slow_permute(int(card[:-1]), 10**15, key, "luhn")).zfill(15)
        new = str(slow_permute(int(phone), 10**10, key, "phone1")).zfill(10)
        first = __import__("datetime").date(1900, 1, 1).toordinal()
        d, e = (__import__("datetime").date.fromordinal(first + x) for x in (day, slow_permute(day, 73049, key, "date")))
        layouts = (lambda p: f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}", lambda p: f"+1{p}", lambda p: f"({p[:3]}) {p[3:6]}-{p[6:]}")
        text = " ; ".join([card, *(f(phone) for f in layouts), f"{d:%Y-%m-%d}", f"{d:%d.%m.%Y}"])
        want = " ; ".join([check(body), *(f(new) for f in layouts), f"{e:%Y-%m-%d}", f"{e:%d.%m.%Y}"])
        assert pii.pseudonymise(text, key) == (want, 6)


def test_pseudonyms_of_odd_texts():
    import time

    for t in ("иван@mail.ru", "王@x.cn", "Łukasz@x.pl", "a" * 5000 + "@x.org", "f0" * 72, "Ab" * 40):
        new, n = pii.pseudonymise(f"see {t}, and")
        assert n == 1 and new != f"see {t}, and" and len(new) == len(t) + 9 and new[:4] == "see " and (new.rpartition("@")[2] == f"{t.rpartition('@')[2]}, and" or "@" not in t)
        assert new.split()[1][0].isupper() == t[0].isupper() and new.split()[1][1].isupper() == t[1].isupper()
    assert pii.pseudonymise("1234567890123456 and 12345678901234567890 a@b 0@ @x.org ..@x.org") == ("1234567890123456 and 12345678901234567890 a@b 0@ @x.org ..@x.org", 0)
    assert pii.pseudonymise("a@x.org@y.org b.c+d@z.org")[1] == 2
    for unit in ("a", "a.", "0", "a@", "f0", "1-", "A1"):
        start = time.perf_counter()
        pii.pseudonymise(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - start < 4, unit


def test_pseudonyms_keep_format_and_links(spark):
    t = "+1 (743) 555-3824, 227.5.221.1; 4532015112830366!! die.55@mail4.example.com x 1999-12-31 31.12.1999 12/31/1999 078-05-1120 DE89 3704 0044 0532 0130 00 token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd00\""
    plain = "Version 2.0, 3.141592, 999.1.1.1, 2001-02-30, 000-12-1234, room 12, 31/31/2000, 1-2-3."
    df = docs_of(spark, [(1, t, "s"), (2, "see " + t, "s"), (3, plain, "s"), (4, None, "s"), (5, "", "s"), (6, "word " * 50_000 + "227.5.221.1", "s"), (1, t, "s")]).withColumn("n_pii", F.lit("x"))
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymised(df).collect()}
    new, n = got[1]
    assert n == 10 and got[2] == ("see " + new, 10) and got[3] == (plain, 0) and got[4] == (None, 0) and got[5] == ("", 0)
    assert got[6][1] == 1 and got[6][0].startswith("word word") and got[6][0].split()[-1] in new
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]+", "9", s))
    assert shape(re.sub("token.*", "", new)) == shape(re.sub("token.*", "", t))
    assert re.fullmatch(r'.*token = "[0-9a-f]{40}"', new)
    for value in ("743", "227.5.221.1", "4532015112830366", "die.55@", "1999", "078-05-1120", "3704 0044", "2321bac4"):
        assert value not in new
    y, m, d = re.search(r"x (\d{4})-(\d\d)-(\d\d) ", new).groups()
    assert f"{d}.{m}.{y} {m}/{d}/{y}" in new
    assert pii.luhn(re.search(r"; (\d{16})!!", new).group(1))
    iban = re.search(r"DE\d\d[ \d]+", new).group().replace(" ", "")
    assert pii._mod97(iban[4:] + iban[:4]) == 1
    assert pii.pseudonymise(t, b"another key 0123")[0] != new
    assert pii.pseudonymised(df.limit(0)).count() == 0


# 6 mixing


def brute_queue(rows, weights, default, fraction, seed):
    seen = {}
    for i, t, s in rows:
        if i is not None:
            n, best = seen.get(i, (0, None))
            seen[i] = (n + len(re.findall("[^ \t\n\r\f]+", t or "")), min(x for x in (best, s) if x is not None) if (best or s) else None)
    q, cum, total = [], {}, 0
    for i, (n, s) in sorted(seen.items(), key=lambda x: (int(hashlib.md5(f"{seed}:{x[0]}".encode()).hexdigest()[:15], 16), x[0])):
        w = weights.get(s, default)
        if w > 0:
            cum[s] = cum.get(s, 0) + n
            total += n
            q.append((cum[s] / w, s is not None, s or "", int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16), i, n, cum[s]))
    out, used = [], 0
    for v, _, s, _, i, n, c in sorted(q):
        used += n
        if used > math.floor(total * fraction):
            break
        out.append((i, n, c, v, used))
    return out


@pytest.mark.parametrize("block", [5, 50_000])
def test_fair_queue_matches_brute_force(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(mixing, "_ROWS_A_BLOCK", block)
    weights = {"s0": 2.0, "s1": 0.5}
    got = mixing.fair_queue(docs, weights, 1.0, budget_fraction=0.5, seed="z").collect()
    assert [(r.doc_id, r.tokens, r.source_tokens, r.virtual_finish, r.total_tokens) for r in got] == brute_queue(rows, weights, 1.0, 0.5, "z")
    assert mixing.fair_queue(empty).count() == 0
    assert {r.source for r in mixing.fair_queue(docs, {"s0": 0.0}, 1.0, budget_fraction=1.0).collect()} == {None, "s1", "s2"}
    kept = mixing.mix(docs, weights=weights, budget_fraction=0.5, seed="z")
    assert kept.columns == docs.columns[:1] + docs.columns[1:] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got}


# 7 token counts


def brute_tokens(word, pieces, byte_cost):
    w = "▁" + word
    best = [(0, 0)]
    for e in range(1, len(w) + 1):
        n = len(w[e - 1].encode())
        options = [(best[e - 1][0] + n * byte_cost, best[e - 1][1] + n)]
        options += [(best[b][0] + pieces[w[b:e]], best[b][1] + 1) for b in range(e) if w[b:e] in pieces]
        best.append(min(options))
    return best[-1][1]


def test_token_counts_match_brute_force(spark, docs, rows, empty):
    pieces = token_counts.load_pieces()
    cost = max(pieces.values()) + token_counts._UNKNOWN
    odd = [(500, "naïve 漢字 ☃☃ été internationalisation " + "z" * 3000 + " a aa aaa aaaa b", "s"), (501, " x", "s")]
    all_rows = rows + odd
    got = token_counts.token_counts(docs.select("doc_id", "text").unionByName(docs_of(spark, odd).select("doc_id", "text"))).collect()
    assert len(got) == len(all_rows)
    cache = {}
    want = sorted((str(i), len(ws := re.findall("[^ \t\n\r\f]+", t or "")), sum(cache.setdefault(w, brute_tokens(w, pieces, cost)) if w in cache or not cache.update({w: brute_tokens(w, pieces, cost)}) else 0 for w in ws)) for i, t, _ in all_rows)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(empty).count() == 0


def test_tries_of_random_vocabularies():
    r = random.Random(2)
    for _ in range(30):
        pieces = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))): r.randint(1, 5) for _ in range(r.randint(1, 12))}
        c = token_counts.Counter(pieces)
        ws = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(40)]
        c.learn(set(ws))
        assert {w: c.counts[w] for w in ws} == {w: brute_tokens(w, pieces, c.byte_cost) for w in ws}


def test_a_full_cache_is_emptied_between_batches(monkeypatch):
    monkeypatch.setattr(token_counts, "_MOST", 3)
    c = token_counts.Counter({"▁": 1, "a": 1, "ab": 1})
    assert [c.of_texts(["ab ba", None, "a b ab"]).tolist(), c.of_texts(["ab c ab"]).tolist()] == [[[2, 5], [0, 0], [3, 6]], [[3, 6]]]


# 8 Jaccard join


def brute_pairs(rows, n, t):
    sets = {}
    for i, x, _ in rows:
        ws = re.findall(r"\w+", (x or "").lower())
        if i is not None and ws:
            sets.setdefault(i, set()).add(frozenset(tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))))
    names = {}
    for i, ss in sets.items():
        for s in ss:
            names[s] = min(i, names.get(s, i))
    out = {}
    for i, ss in sets.items():
        for s in ss:
            if names[s] != i:
                out[names[s], i] = 1.0
    items = list(names.items())
    for k, (s, a) in enumerate(items):
        for z, b in items[:k]:
            j = len(s & z) / len(s | z)
            if a != b and j >= t - 1e-12:
                out[min(a, b), max(a, b)] = max(j, out.get((min(a, b), max(a, b)), 0))
    return out


def brute_classes(rows, n, t):
    sets = {}
    for i, x, _ in rows:
        ws = re.findall(r"\w+", (x or "").lower())
        if i is not None:
            sets.setdefault(i, set())
            if ws:
                sets[i].add(frozenset(tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))))
    every = sorted({s for ss in sets.values() for s in ss}, key=sorted)
    of = {s: [i for i, ss in sets.items() if s in ss] for s in every}
    near = {s: [z for z in every if z is not s and len(s & z) / len(s | z) >= t - 1e-12] for s in every}
    parent = {i: i for i in sets}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for s in every:
        for z in [s, *near[s]]:
            for i in of[z]:
                x, y = sorted((find(of[s][0]), find(i)))
                parent[y] = x
    return sorted((i, find(i), sum(len(of[s]) - 1 for s in ss), sum(len(near[s]) for s in ss)) for i, ss in sets.items())


def tiny_rows(first, r):
    """Sets of one to six n-grams out of a few words, many of them similar."""
    return [(first + k, " ".join(r.choice("abc") for _ in range(r.randint(1, 7))), "s") for k in range(70)]


@pytest.mark.parametrize("boundary,t", [(None, 0.7), (2, 0.3), (41, 0.5), (5, 0.5), (15, 0.9)])
def test_jaccard_join_matches_brute_force(spark, docs, rows, empty, boundary, t, monkeypatch):
    if boundary:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda costs, t: boundary)
    monkeypatch.setattr(jaccard, "_BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "_BLOCK_GRAMS", 1 << 20 if t > 0.6 else 60)
    r = random.Random(9)
    base = [text(r.randint(2, 30), r) for _ in range(12)]
    extra = [(600 + k, edited(base[k % 12], 0.05, r), "s") for k in range(60)] + tiny_rows(700, r) + [(600, "another text of a row that repeats its id", "s")]
    both = docs.select("doc_id", "text", "sid").unionByName(docs_of(spark, extra).select("doc_id", "text", F.lit("x").alias("sid")))
    got = sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in jaccard.similarity_classes(both, threshold=t).collect())
    assert got == brute_classes(rows + extra, 2, t)
    if boundary is None:
        assert jaccard.similarity_classes(empty).count() == 0


def test_jaccard_join_without_hints_finds_the_same(spark, docs, rows, monkeypatch):
    """Posting lists alone, without groups of near copies, lead to every similar pair; and with groups of all sets there are none."""
    monkeypatch.setattr(jaccard, "_near_keys", lambda sets: sets.limit(0).select(F.col("sid").alias("a"), F.col("sid").alias("b")))
    got = sorted((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in jaccard.similarity_classes(docs, threshold=0.6).collect())
    assert got == brute_classes(rows, 2, 0.6)


def test_pairs_of_lists():
    r = np.random.default_rng(1)
    for small, boundary, t in [(False, 4, 0.7), (True, 9, 0.7), (False, 2, 0.4)]:
        n = 300
        sid = r.integers(0, 60, n)
        size, group = (sid * 7) % 8 + 2, np.where(sid < 20, 1, sid)
        tok, pos = r.integers(0, 40, n).astype(np.uint32), r.integers(0, 2, n).astype(np.int32)
        first = {}
        for k in range(n):
            first.setdefault((tok[k], sid[k]), k)
        keep = sorted(first.values())
        got = set()
        for most in (7, 10**6):
            got = {(int(a), int(b)) for x, y in jaccard._pairs_of(tok[keep], np.stack([sid, group], 1)[keep], size[keep].astype(np.int32), pos[keep], small, t, boundary, most) for a, b in zip(x, y)}
            want = set()
            for i in keep:
                for j in keep:
                    lo, hi = sorted((size[i], size[j]))
                    if tok[i] == tok[j] and sid[i] < sid[j] and group[i] != group[j] and t * hi <= lo + 1e-9:
                        if small or ((hi >= boundary or t * hi <= 1) and min(size[i] - pos[i], size[j] - pos[j]) >= math.ceil(t / (1 + t) * (lo + hi) - 1e-9)):
                            want.add((int(sid[i]), int(sid[j])))
            assert got == want


def test_overlaps():
    r = random.Random(6)
    xs, ys = ([np.array(sorted(r.sample(range(90), r.randint(1, 40))), np.uint64) for _ in range(m)] for m in (37, 23))
    got = jaccard.overlaps(xs, ys)
    assert all(got[i, j] == len(set(x.tolist()) & set(y.tolist())) for i, x in enumerate(xs) for j, y in enumerate(ys))


def test_deduplicate_keeps_one_of_each_group(spark, docs, rows):
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {}
    for a, b in brute_pairs(rows, 2, 0.7):
        x, y = groups.get(a, {a}), groups.get(b, {b})
        for v in x | y:
            groups[v] = x | y
    want = {i for i, _, _ in rows if i is None or i == min(groups.get(i, {i}))}
    assert set(ids) == want and len(ids) == len(set(ids))


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)] + [(7, 7)]
    got = {x.v: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {v: find(v) for v in parent}


# 9 decontamination


def brute_leaks(rows, items, n, t):
    texts = {}
    out = {}
    for item, it in items:
        iw = re.findall(r"\w+", (it or "").lower())
        if item is None or not iw:
            continue
        m = min(n, len(iw))
        s = {tuple(iw[k : k + m]) for k in range(len(iw) - m + 1)}
        span = len(iw) - m + 1
        for i, x, _ in rows:
            ws = re.findall(r"\w+", (x or "").lower())
            if i is None:
                continue
            hits = [(k, tuple(ws[k : k + m])) for k in range(len(ws) - m + 1) if tuple(ws[k : k + m]) in s]
            best = max(((len({y for q, y in hits if p <= q < p + span}), -p) for p, _ in hits), default=(0, 0))
            if best[0] >= math.ceil(len(s) * t - 1e-9) and best[0] and (best[0], best[1]) > out.get((i, item), (0, -(10**9), 0))[:2]:
                out[i, item] = (best[0], best[1], best[0] / len(s))
    return {k: (v[0], v[2], -v[1]) for k, v in out.items()}


@pytest.mark.parametrize("shipped", [2_000_000, 40])
def test_decontamination_matches_brute_force(spark, rows, empty, shipped):
    r = random.Random(6)
    items = [(k, text(r.randint(6, 40), r)) for k in range(8)] + [(20, "two words"), (21, "tiny"), (22, ""), (23, None), (None, "x y z"), (24, "aa bb " * 12)]
    leaky = [(700 + k, text(20, r) + " " + edited(items[k % 8][1], [0, 0.02, 0.05, 0.3][k % 4], r).upper() + "! " + text(9, r), "s") for k in range(40)]
    leaky += [(800, "so two words, and a TINY one", "s"), (801, items[0][1][: len(items[0][1]) // 2] + " gap " * 50 + items[0][1][len(items[0][1]) // 2 :], "s"), (802, "aa bb " * 30, "s")]
    docs = docs_of(spark, rows + leaky).withColumns({"item_id": F.lit(1), "tok": F.lit(2), "pos": F.lit(3)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = {(x.doc_id, x.item_id): (x.matched, x.containment, x.start_word) for x in decontaminate.contaminated(docs, bench, shipped=shipped).collect()}
    assert got == brute_leaks(rows + leaky, items, 5, 0.8)
    kept = decontaminate.decontaminate(docs, bench, shipped=shipped)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, _, _ in rows + leaky} - {i for i, _ in got}
    assert decontaminate.contaminated(empty, bench, shipped=shipped).count() == 0 and decontaminate.contaminated(docs, bench.limit(0), shipped=shipped).count() == 0


# 10 sharding


def test_min_cost_flow_is_optimal():
    r = random.Random(8)
    for _ in range(40):
        sizes = {f"a{k}": r.randint(0, 30) for k in range(r.randint(1, 5))}
        caps = {f"a{k}": r.randint(0, 40) for k in range(r.randint(1, 6))}
        if sum(sizes.values()) > sum(caps.values()):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(sizes, caps)
            continue
        flows = sharding.min_cost_flow(sizes, caps)
        for x in sizes:
            assert sum(n for a, _, n in flows if a == x) == sizes[x]
        for x in caps:
            assert sum(n for _, b, n in flows if b == x) <= caps[x]
        assert sum(n for a, b, n in flows if a != b) == sum(max(0, n - caps.get(x, 0)) for x, n in sizes.items())


def brute_shards(rows, sizes, flows):
    """(doc_id, old, new) of every row: documents of a shard in the order of their hash, each where it begins."""
    size = lambda t: len((t or "").encode())
    key = lambda i: (int(hashlib.md5(f"{sharding.SEED}:{'' if i is None else i}".encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i)
    out = []
    for shard in sizes:
        parts, at = [], 0
        for old, new, n in flows:
            if old == shard:
                parts.append((at, new))
                at += n
        begin = 0
        of_id = {}
        for i, t, s in rows:
            if (s or "") == shard:
                of_id[key(i)] = of_id.get(key(i), []) + [(i, size(t))]
        for k in sorted(of_id):
            new = [to for lo, to in parts if lo <= begin][-1]
            out += [(i, shard, new) for i, _ in of_id[k]]
            begin += sum(n for _, n in of_id[k])
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [1, 64, 1 << 20])
def test_resharding(spark, docs, rows, empty, tmp_path, blocks):
    got = sharding.assign(docs, new_shards=2, blocks=blocks)
    assert got.columns == [c for c in docs.columns if c not in ("old_shard", "moved")] + ["old_shard", "new_shard", "moved"] and got.count() == len(rows)
    size = lambda t: len((t or "").encode())
    sizes, new = {}, {}
    for i, t, s in rows:
        sizes[s or ""] = sizes.get(s or "", 0) + size(t)
    for r in got.collect():
        new[r.new_shard] = new.get(r.new_shard, 0) + size(r.text)
        assert r.moved == (r.old_shard != r.new_shard)
    cap = math.ceil(sum(sizes.values()) / 6)
    flows = sharding.min_cost_flow(sizes, {s: cap for s in [*sizes, "new0", "new1"]})
    assert sorted([(r.doc_id, r.old_shard, r.new_shard) for r in got.collect()], key=str) == brute_shards(rows, sizes, flows)
    biggest = max(size(t) for _, t, _ in rows)
    assert all(n < cap + biggest * sum(to == x for _, to, _ in flows) for x, n in new.items())
    if blocks > 1:
        return
    assert sharding.assign(empty).count() == 0
    root = str(tmp_path / "out")
    plain = docs.select("doc_id", "text", "source")
    sharding.assign(plain, new_shards=0, capacities={s: 10**9 for s in ("", "s0", "s1", "s2")}).drop("old_shard", "moved").write.partitionBy("new_shard").parquet(root)
    touched = sharding.rewrite(plain, root, new_shards=2)
    back = spark.read.parquet(root)
    assert back.count() == len(rows) and touched and set(touched) <= {"", "s0", "s1", "s2", "new0", "new1"}


def test_flows_between_many_shards_are_found_quickly():
    r = random.Random(1)
    sizes = {f"{k:06d}": r.randint(0, 1000) for k in range(20_000)}
    cap = math.ceil(sum(sizes.values()) / 20_000)
    flows = sharding.min_cost_flow(sizes, {s: cap for s in sizes})
    assert sum(n for a, b, n in flows if a != b) == sum(max(0, n - cap) for n in sizes.values())


def test_resharding_writes_and_drops_emptied_shards(spark, docs, rows, tmp_path, monkeypatch):
    plain = docs.select("doc_id", "text", "source")
    for name in ("s0", ""):  # the old shard has no capacity: all of its rows move and its folder goes
        root = str(tmp_path / f"out{name}")
        caps = {s: 10**9 for s in ("", "s0", "s1", "s2")}
        sharding.assign(plain, capacities=caps).drop("old_shard", "moved").write.partitionBy("new_shard").parquet(root)
        touched = sharding.rewrite(plain, root, capacities={s: n for s, n in caps.items() if s != name})
        back = spark.read.parquet(root)
        assert name in touched and back.count() == len(rows) and not back.where(F.coalesce("new_shard", F.lit("")) == name).count()
    monkeypatch.setattr(sharding, "shared_dir", lambda spark: str(tmp_path / "shared"))
    planned = sharding.assign(docs, new_shards=2, blocks=64)
    got = sharding.resharded(docs, new_shards=2, blocks=64)
    assert got.columns == planned.columns and sorted(got.collect(), key=str) == sorted(planned.collect(), key=str)
    (root,) = (tmp_path / "shared").iterdir()
    moved = planned.where("moved").select("old_shard", "new_shard").collect()
    changed = {x for r in moved for x in r}
    assert spark.read.parquet(str(root)).count() == planned.where(F.col("new_shard").isin(list(changed))).count() > 0
    sharding.sharded(docs)
    assert len(list((tmp_path / "shared").iterdir())) == 2
