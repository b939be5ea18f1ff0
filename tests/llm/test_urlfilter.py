import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import urlfilter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:n], rest[n:]
    m = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:m]


def brute(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v == "block") for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[2], "block" if best[3] else "allow"


def judged(df, rules, **kw):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(df, rules, **kw).collect()}


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "cc", "d-d", "é", "long" * 3])
    host = lambda k: ".".join(label() for _ in range(k))
    path = lambda: "".join("/" + rng.choice(["x", "yy", "en", "z%20"]) for _ in range(rng.randrange(4)))
    rules = list({(host(rng.randrange(1, 4)), path() + rng.choice(["", "/", "/p"])): rng.choice(U.VERDICTS) for _ in range(900)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http{rng.choice('s ')}://{rng.choice(['', 'WWW.', 'm.'])}{host(rng.randrange(1, 5))}{path()}{rng.choice(['', '/', '/pq', '?a=/x', '#f?', '?'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "://", "x://A.b", "x://a.b/y://z", "http://cc./x", "http:///en/x", "http://a\n.b/x\ny", "http://" + "a." * 4000 + "b/" + "x/" * 9000]
    urls += ["http://hot.a.b/x/yy"] * 700
    return rules, list(enumerate(urls))


@pytest.mark.parametrize("filter_bytes", [U.FILTER_BYTES, 700])
def test_equals_brute_force(spark, many, filter_bytes):
    rules, urls = many
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(3)
    got = judged(df, spark.createDataFrame(rules, "host string, path string, verdict string"), filter_bytes=filter_bytes)
    assert got == {i: brute(u, rules) for i, u in urls}
    assert len({v[2] for v in got.values()}) > 100


def test_more_shapes_than_are_listed(spark, many, monkeypatch):
    monkeypatch.setattr(U, "SHAPES", 3)
    rules, urls = many
    few = urls[:200]
    got = judged(spark.createDataFrame(few, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got == {i: brute(u, rules) for i, u in few}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(60_000).select(F.col("id").cast("string").alias("k")).select(*U._hashes(F.col("k")))
    listed = keys.sample(0.02, seed=3).withColumn("verdict", F.lit("block"))
    n = listed.count()
    cascade = U.cascades(listed, keys.union(keys.limit(9000)), {"block": (n, n / 60_000), "allow": (0, 0.5)})["block"]
    want = {(r.a, r.b) for r in listed.collect()}
    rows = keys.collect()
    a, b = (np.array([r[i] for r in rows], np.int64).view(np.uint64) for i in range(2))
    assert [bool(x) for x in cascade.contains(a, b)] == [(r.a, r.b) in want for r in rows]
    assert len(cascade.levels) > 3 and cascade.nbytes * 8 < 20 * n  # levels alternate; a few bits a listed key


def test_nulls_ties_repeats_empty_clashes(spark):
    rules = spark.createDataFrame([("a.b", None, "allow"), ("a.b", "", "block"), ("A.B", "", "allow"), (None, "/", "block"), ("", "/", "block"), ("b", "/aa", "block"), ("ab.b", "/", "allow")], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "x://a.b/", 7), (1, "x://a.b/", 7), (None, None, 7), (2, "x://ab.b/aa", 7), (3, "x://q.a.b", 7)], "page_id long, url string, rule int")
    got = U.judge(df, rules)
    assert got.columns == ["page_id", "url", "rule", "host", "path", "verdict"]
    rows = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect())))
    want = [(1, "a.b", "/", "a.b", "block")] * 2 + [(None, "", "", None, "allow"), (2, "ab.b", "/aa", "ab.b/", "allow"), (3, "q.a.b", "", "a.b", "block")]
    assert rows == sorted(map(str, want))
    assert U.judge(df.limit(0), rules).collect() == []
    assert {r.verdict for r in U.judge(df, rules.limit(0), otherwise="block").collect()} == {"block"}
