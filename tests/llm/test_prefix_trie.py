"""The trie against one built from rebuilt texts, over many ranges and with colliding names and nulls."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tabulith.llm import prefix_trie as pt


def plain(rows, group=20, heads=4):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [v[1:] for v in sorted(v, key=lambda v: v[0])] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % heads, int(c - (abs(c) % group) * (1 if c >= 0 else -1))
        built[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        m = members[k]
        leaves = sum(out[x][4] for x in kids.get(k, [])) or 1
        saved = sum(out[x][5] for x in kids.get(k, [])) + (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out[k] = (min(m), len(k), min(members[k[:-1]]) if k else None, (len(m), len(kids.get(k, []))), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted((a, d, p if p is not None else -(10**9), *n, le, s, e) for a, d, p, n, le, s, e in out.values())


def got(spark, rows, schema="conv_id long, turn long, role string, text string"):
    out = pt.prefix_trie(spark.createDataFrame(rows, schema))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((r[0], r[1], r[2] if r[2] is not None else -(10**9), *r[3:]) for r in out.collect())


def test_brute_force(spark):
    """One conversation has a third of all turns, many share beginnings, and a few are whole prefixes of others."""
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", None, "", "d\te f"])) for c in [*range(-45, 130, 2), 400, 407] for t in range(rnd.randint(0, 6))]
    rows += [(41, t, "user", f"w{t % 3} x") for t in range(len(rows) // 2)]
    rows += [(c, t, "user", "hot turn") for c in range(1000, 1060) for t in range(5)]
    rows += [(None, 1, "user", "no conversation"), (77, None, "system", "first")]
    rnd.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    assert got(spark, []) == []
    # 8 has h = 2 and 7 has h = 2 or so: without a base what remains may be nothing
    rows = [(7, 0, "u", "x"), (8, 0, "u", "x")]
    assert got(spark, rows) == plain(rows)
    # a repeated row is a turn of its own; other columns don't disturb
    rows = [(20, 0, "u", "x" * 100_000), (20, 0, "u", "x" * 100_000), (20, None, None, None)]
    wide = [(*r, 9, "y") for r in rows]
    assert got(spark, wide, "conv_id long, turn long, role string, text string, depth int, pos string") == plain(rows)


def test_sums_over_ranges(spark):
    """A key of one row more than it takes to cross every border: same as with one range."""
    df = spark.range(1000).select(F.when(F.col("id") < 700, 5).otherwise(F.col("id") % 7).cast("long").alias("k"), "id", (F.col("id") * 7919 % 1000).alias("h1"), F.lit(3).cast("long").alias("h2"))
    order = [F.col("id")]
    terms = dict(zip(pt._sums("s"), pt._terms(F.col("h1"), F.col("h2"), F.col("pos")), strict=True))
    many = pt.running_sums(pt._dealt(df, "k", order), "k", order, terms, pt.BASES)
    assert many.select("pid").distinct().count() > 1
    one = pt.running_sums(df.withColumn("pid", F.lit(0)), "k", order, terms, pt.BASES)
    cols = ["k", "id", "pos", *pt._sums("s"), *[f"s{j}_term" for j in range(4)]]
    assert sorted(map(tuple, many.select(cols).collect())) == sorted(map(tuple, one.select(cols).collect()))
    rows = {}
    for r in sorted(one.collect(), key=lambda r: (r.k, r.id)):
        n, s = rows.get(r.k, (0, 0))
        rows[r.k] = n, s = n + 1, (s + r.h1 * pow(pt.BASES[0], n + 1, pt.PRIME)) % pt.PRIME
        assert (r.pos, r.s0) == (n, s)


def test_deep_chains(spark):
    """Chains that hang on chains over many levels: totals need several rounds of doubling."""
    links = [(i, i - 1 if i else None, 1, 1, i) for i in range(37)] + [(100 + i, 5, 2, 1, 1) for i in range(50)]
    df = spark.createDataFrame(links, "chain long, up long, at long, leaves long, saved long")
    got = {r.chain: (r.leaves, r.saved) for r in pt.chain_totals(df).collect()}
    for i in range(37):
        more = 50 if i <= 5 else 0
        assert got[i] == (37 - i + more, sum(range(i, 37)) + more)
    assert got[100] == (1, 1)
