import difflib
import random
import re

from pyspark.sql import functions as F

from tabulith.operators import entities as e


def key(name):
    return re.sub("[^A-Za-z]", "", re.sub(r"^\s*[0-9]+[.)]?\s*", "", name)).lower()


def plain(label, master, cutoff):
    """Exact keys first, then the best sequence ratio, the master's key first and ties to the greater key."""
    k = key(label)
    keys = {key(m): m for m in sorted(master) if key(m)}
    if not k:
        return None
    if k in keys:
        return keys[k], 1.0
    best = max(((difflib.SequenceMatcher(None, x, k).ratio(), x) for x in keys), default=(0.0, ""))
    return (keys[best[1]], best[0]) if best[0] >= cutoff else None


def test_similar_is_plain_difflib(spark):
    rng = random.Random(11)
    syllables = ["ci", "pa", "tu", "jah", "sa", "lo", "man", "ga", "ra", "ja", "wa", "sing", "par", "na", "kar", "ang"]
    master = sorted({"".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))).title() for _ in range(60)}) + ["12", ""]
    labels = {"", "3.", "!!", "Zzz"}
    for m in master:
        for _ in range(12):
            c = list(m)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(c) + 1)
                c[at : at + rng.choice([0, 1, 1])] = rng.choice(["", "x", "a", " ", "-", "aa"])
            labels.add(rng.choice(["", "1. ", "22) "]) + "".join(c))
    x = spark.createDataFrame([(v,) for v in sorted(labels)], "label string")
    for cutoff in (0.82, 0.93, 0.75, 0.6):
        got = {r.label: (r.entity, r.ratio) for r in e.resolve(x, spark.createDataFrame([(m,) for m in master], "entity string"), "label", cutoff).collect()}
        want = {v: p for v in labels if (p := plain(v, master, cutoff))}
        assert got.keys() == want.keys() and len(got) > 80
        for v in got:
            assert got[v][0] == want[v][0] and abs(got[v][1] - want[v][1]) < 1e-12, v


def test_missing_entities(spark):
    rows = spark.createDataFrame([(1, "A", False), (1, "B", False), (2, "A", True), (2, None, False)], "t int, entity string, is_total boolean")
    master = spark.createDataFrame([("A",), ("B",), ("A",)], "entity string")
    assert [tuple(r) for r in e.missing_entities(rows, master, ["t"]).collect()] == [(2, "B")]


def test_index_leaves_few_candidates(spark):
    """Far fewer pairs than those of near lengths are compared, no pair above the cutoff is lost, and no key of the join is hot."""
    rng = random.Random(5)
    syllables = [a + b + c for a in "bcdgjklmnprstw" for b in "aiueo" for c in ("", "", "ng", "n", "r")]
    names = sorted({"".join(rng.choice(syllables) for _ in range(rng.randrange(3, 6))) for _ in range(1500)})
    labels = set()
    for n in names:
        for _ in range(4):
            c = list(n)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = rng.choice("aeiknr")
            labels.add("".join(c))
    x, y = (spark.createDataFrame([(v,) for v in v_], f"{c} string").repartition(4) for v_, c in ((sorted(labels), "key"), (names, "mkey")))
    got = {tuple(r) for r in e.similar_candidates(x, y, 0.82).collect()}
    near = sum(1 for k in labels for m in names if abs(len(k) - len(m)) * 100 <= 18 * (len(k) + len(m)))
    assert len(got) < near / 15, (len(got), near)
    some = rng.sample(sorted(labels), 200)
    want = {(k, m) for k in some for m in names if difflib.SequenceMatcher(None, m, k).quick_ratio() >= 0.82 and difflib.SequenceMatcher(None, m, k).ratio() >= 0.82}
    assert want <= got and len(want) > 80
    parts = e._cut_in_parts(y, "mkey", "lb", "la", 0.82)
    most, total = parts.groupBy(F.substring("mkey", F.col("at") + 1, F.col("chars")), "i", "la", "lb").count().agg(F.max("count"), F.sum("count")).first()
    assert most < total / 200
