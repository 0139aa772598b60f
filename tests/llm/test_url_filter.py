"""URL rules, canonical URLs, and a Bloom filter whose false positives never show."""

import re

import pytest
from pyspark.sql import functions as F

from tabulith.llm import url_filter as uf

URLS = [
    None, "", "no address", "http://", "http://NET", "http://net/", "http://a.NET/x", "https://a.example.net/en/1", "https://example.net/en", "http://xnet/", "http://b.example.com/de/9?x=1#/fr/",
    "http://q.org/fr/", "http://q.org/fr?u=http://a.net/", "http://q.org?/fr/", "ftp://u:p@WWW.Bad.test:443//a//b/index.html?utm_source=f&z=1&a=2#top", "http://bad.test/a/b?a=2&z=1", "http://bad.test/a/b?a=2",
    "http://bad.test/a/b/?z=1&a=2&ref=x", "http://bad.test:8080/a/b?a=2&z=1", "http://ä.test/ü", "http://bad.test/c", "http://bad.test/c" + "/long" * 20000,
]


def test_canonical(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "i long, url string")
    got = {r.i: r.c for r in df.select("i", uf.canonical_url(F.col("url")).alias("c")).collect()}
    assert [got[i] for i in (0, 1, 2)] == [None] * 3
    assert got[14] == got[15] == got[17] == "bad.test/a/b?a=2&z=1"
    assert got[16] == "bad.test/a/b?a=2" and got[18] == "bad.test:8080/a/b?a=2&z=1" and got[19] == "ä.test/ü"


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


@pytest.mark.parametrize("max_blocks", [1, 1 << 18])
def test_brute_force(spark, max_blocks):
    """One block takes all 3000 list entries here: nearly every page is a possible hit, and none is judged otherwise."""
    urls = URLS + [f"https://h{i % 50}.test/p/{i}" for i in range(2000)] * 2
    listed = [f"http://www.h{i % 50}.test//p/{i}/?gclid=7" for i in range(0, 6000, 2)] + ["http://bad.test/a/b?z=1&a=2", None, "nothing"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Verdict string")
    got = uf.judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "u string"), uf.RULES, listed_col="u", max_blocks=max_blocks)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "listed", "verdict"]
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, action = plain(u, uf.RULES)
        bad = i in (14, 15, 17) or (i >= len(URLS) and (i - len(URLS)) % 2 == 0)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == (action or ("block" if bad else "allow")), u
        assert rows[i].listed == (None if rule else bad), u


def test_filter_never_misses_and_is_bounded(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits, blocks = uf.bloom_filter(keys, "key", 20000, 1 << 18)
    assert blocks == 2048 and bits.count() <= 2048
    asked = spark.range(40000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    met = asked.join(bits, uf._block(F.col("key"), blocks) == F.col("block"))
    for i, m in enumerate(uf._masks(F.col("key"))):
        met = met.where(F.col(f"w{i}").bitwiseAND(m) == m)
    seen = {r.id for r in met.select("id").collect()}
    assert seen >= set(range(20000)) and len(seen) < 20000 + 200


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert uf.judge_urls(none, one.select("url"), uf.RULES).count() == 0
    assert [r.verdict for r in uf.judge_urls(one, none.select("url")).collect()] == ["allow"]


def test_plan_is_native(spark):
    plan = uf.op11_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastNestedLoop" not in plan
