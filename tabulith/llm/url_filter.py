"""URL filter: host rules, and a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only.

A listed URL sets two bits in each of the four 64-bit words of one block of the filter; ``bit_or`` builds
the blocks, combining before its shuffle. The filter is broadcast: it has at most ``max_blocks`` rows of
five longs, whatever the length of the list (a longer list only lets more false positives pass). Pages
whose bits aren't all set are done without a shuffle. The possible hits go on to an exact join with the
list on the canonical URL, which takes the false positives out again; the list is a table of its own, so
that join is one of two plain shuffles and adaptive execution splits it when one URL has a third of them.

Rules (action, host, path) decide before the list: a rule fits its host and all subdomains if the path
starts with the rule's, the longest rule text wins (then block before allow, then the lesser text).

Defined cases: a null URL or one without ``://`` has an empty host and path, fits only what these fit, and
is never listed; an empty list or no rules allow everything; repeated pages and repeated list entries are
judged each for itself and once; columns of the input that carry an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, replaced, stage, table

#: Query parameters that only say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Bits of the filter for each listed URL, as long as ``max_blocks`` allows: false positives well below 1 in 1000.
BITS_PER_URL = 16
WORDS = 4

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    """What stands after the first ``://``, null without it."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)://(.*)", 1))


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One text for the ways to write a page's address, null if it isn't one.

    Scheme, user, default port, ``www.``, fragment, tracking parameters, repeated and last slashes and the
    index page's name go; parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^.*@", ""), r"\.?(:(80|443))?$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url_path(url), r"/+", "/"), r"/index\.(html?|php)$", "/"), r"/$", "")
    asked = F.filter(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _masks(canon: Column) -> list[Column]:
    """The two bits of each word that a URL sets."""
    h = F.xxhash64(F.lit(1), canon)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(2 * WORDS)]
    return [bit[2 * w].bitwiseOR(bit[2 * w + 1]) for w in range(WORDS)]


def _block(canon: Column, blocks: int) -> Column:
    return F.xxhash64(canon).bitwiseAND(blocks - 1)


def bloom_filter(listed: DataFrame, canon: str, n: int, max_blocks: int) -> tuple[DataFrame, int]:
    """The blocks that have bits, and how many blocks there are: a power of two for ``n`` URLs, at most ``max_blocks``."""
    blocks = 1
    while blocks * 64 * WORDS < n * BITS_PER_URL and blocks * 2 <= max_blocks:
        blocks *= 2
    words = [m.alias(f"m{i}") for i, m in enumerate(_masks(F.col(canon)))]
    bits = listed.select(_block(F.col(canon), blocks).alias("block"), *words)
    return bits.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(action, text) of the rule that decides, null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("text"))) for a, h, p in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<action:string,text:string>")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), url_col: str = "url", listed_col: str = "url", max_blocks: int = 1 << 18) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its text), ``listed`` and ``verdict`` (allow or block).

    ``listed`` is null where a rule decided. ``max_blocks`` bounds the broadcast: 40 bytes a block.
    """
    keys = stage(listed.select(canonical_url(F.col(listed_col)).alias("key")).where("key IS NOT NULL").distinct())
    bits, blocks = bloom_filter(keys, "key", keys.count(), max_blocks)

    url = pages[url_col]
    read = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("row"), url_host(url).alias("host_"), url_path(url).alias("path_"), canonical_url(url).alias("canon_"))
    ruled = read.withColumn("rule_", rule_of(F.col("host_"), F.col("path_"), rules))
    asks = ruled.withColumn("block_", F.when(F.col("rule_").isNull(), _block(F.col("canon_"), blocks)))
    met = asks.join(F.broadcast(bits), F.col("block_") == F.col("block"), "left")
    all_set = F.lit(True)
    for i, m in enumerate(_masks(F.col("canon_"))):
        all_set &= F.col(f"w{i}").bitwiseAND(m) == m
    passed = met.withColumn("maybe", F.coalesce(all_set & F.col("rule_").isNull() & F.col("canon_").isNotNull(), F.lit(False))).select("row", "host_", "path_", "canon_", "rule_", "maybe")

    hits = passed.where("maybe").join(keys.withColumn("found", F.lit(True)), F.col("canon_") == F.col("key"), "left")
    rest = passed.where("NOT maybe").withColumn("found", F.lit(None).cast("boolean"))
    both = hits.select("row", "host_", "path_", "rule_", "found").unionByName(rest.select("row", "host_", "path_", "rule_", "found"))
    is_listed = F.when(F.col("rule_").isNull(), F.coalesce("found", F.lit(False)))
    flat = both.select("row.*", F.struct("host_", "path_", F.col("rule_.text").alias("text"), is_listed.alias("listed"), F.coalesce("rule_.action", F.when(is_listed, "block").otherwise("allow")).alias("verdict")).alias("__judged"))
    return replaced(flat, host=F.col("__judged.host_"), path=F.col("__judged.path_"), rule=F.col("__judged.text"), listed=F.col("__judged.listed"), verdict=F.col("__judged.verdict")).drop("__judged")


#: The contract's rules.
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Host labels whose pages are listed in the query: sites that exist to sell, track or lure.
BAD_SITES = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)"


def op11_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page judged; the list holds the canonical URLs of the crawl's pages at BAD_SITES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_host(F.col("url")).rlike(BAD_SITES)).select("url")
    return judge_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)://(.*)', 1) END AS rest FROM pages
), parts AS (
  SELECT page_id, rest IS NOT NULL AS ok,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&') AS query
  FROM cut
), canon AS (
  SELECT page_id, host, path,
         CASE WHEN ok THEN regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:(80|443))?$', ''), '^www\.', '')
           || regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/index\.(html?|php)$', '/'), '/$', '')
           || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canon
  FROM parts
), listed AS (
  SELECT DISTINCT canon FROM canon WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)(\.|$)')
), rules(action, h, p) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), ruled AS (
  SELECT c.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.action, length(r.h || r.p)) AS action
  FROM canon c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY c.page_id
)
SELECT c.page_id, c.host, c.path, r.rule, coalesce(r.action, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN ruled r ON c.page_id = r.page_id LEFT JOIN listed l ON c.canon = l.canon
"""
