import random
import re

import numpy as np
import pytest

from tabulith.llm import jaccard_join as j
from tabulith.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, pct):
    """Each row is a document; texts whose smallest id is the same are in one component."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    least = {}
    for d, x in sets:
        if d is not None and x:
            least[frozenset(x)] = min(d, least.get(frozenset(x), d))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = [0] * len(sets)
    for i, (a, x) in enumerate(sets):
        for k, (b, y) in enumerate(sets[:i]):
            if None not in (a, b) and x and y and 100 * len(x & y) >= pct * len(x | y):
                links[i] += 1
                links[k] += 1
                r, s = sorted((find(least[frozenset(x)]), find(least[frozenset(y)])))
                root[s] = r
    return sorted([(d, len(s), find(least[frozenset(s)]) if s and d is not None else d, n) for (d, s), n in zip(sets, links, strict=True)], key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (1, 2, 3, 5, 9, 12, 20, 33, 60, 140, 400)]
    shared = [rng.choice(vocab) for _ in range(30)]
    out = []
    for k in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 8])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
        if rng.random() < 0.2:
            w += shared
        out.append((k, rng.choice([" ", "\n", "\t "]).join(w).upper() if k % 7 == 0 else " ".join(w)))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "W1"), (1004, "w1")]


@pytest.mark.parametrize(("size", "pct", "block"), [(3, 90, 1_000_000), (5, 80, 700), (2, 50, 300), (3, 100, 1_000_000)])
def test_is_brute_force(spark, monkeypatch, size, pct, block):
    monkeypatch.setattr(j, "BLOCK", block)
    rows = corpus(size)
    got = j.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size, pct)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, size, pct)


@pytest.mark.parametrize("pct", [60, 80, 90])
def test_search_finds_all_pairs(pct):
    rng = np.random.default_rng(pct)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = rng.choice(base, rng.integers(5, 250), replace=False) if rng.random() < 0.3 else base[rng.random(300) < 0.95]
        sets.append(np.unique(own))
    for side in (np.zeros(120, dtype=int), rng.integers(0, 2, 120)):
        found = {(q, int(y)) for q, c in j.search(sets, side, pct, side.max() > 0) for y in c}
        same = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * (k := same(a, b)) >= pct * (len(sets[a]) + len(sets[b]) - k) and (side.max() == 0 or side[a] != side[b])}
        assert found == want and want


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, "A b c d e f", "z"), (3, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = sorted([(r.id, r.component_id) for r in j.jaccard_groups(docs).collect()], key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (2, 1), (3, 3)], key=str)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == [1, 1, 3, None]
    assert j.jaccard_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_rows_that_share_an_id(spark, monkeypatch, block):
    monkeypatch.setattr(j, "BLOCK", block)
    rng = random.Random(1)
    texts = [" ".join(f"g{g}w{rng.randrange(99)}" for _ in range(40)) for g in range(12)]
    rows = []
    for g in range(0, 12, 2):
        a, b, k = texts[g], texts[g + 1], 10 * g
        rows += [(k + 1, a), (k + 1, b), (k + 2, b + " more"), (k + 3, a + " more"), (k + 1, a), (None, a)]
    got = j.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90)
    got = sorted([tuple(r) for r in got.collect()], key=str)
    assert got == brute(rows, 3, 90)
    assert all(c == i // 10 * 10 + 1 and n >= 1 for i, _, c, n in got if i is not None)
    kept = j.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([k for g in range(0, 12, 2) for k in [10 * g + 1] * 3 + [None]], key=str)


def test_hub_of_largest_id(spark):
    rng = random.Random(3)
    edges = [(9999, 7000 + i) for i in range(400)] + [(5000 + i, 5001 + i) for i in range(300)] + [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a != b]
    root = {}
    for a, b in real:
        root.setdefault(a, {a}).add(b)
        root.setdefault(b, {b}).add(a)
    want = {}
    for x in sorted(root):
        if x not in want:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in want:
                    want[y] = x
                    todo += root[y]
    assert got == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (200, 151), (151, 160)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 150: 150, 151: 150, 160: 150, 200: 150}


def test_large_texts_with_shared_parts_are_no_group(spark, monkeypatch):
    """Texts in a row, each with half of the next: no two are similar, so none is to be sent to a search."""
    rng = random.Random(5)
    parts = [" ".join(f"p{rng.randrange(10**9)}" for _ in range(3000)) for _ in range(13)]
    rows = [(i, parts[i] + " " + parts[i + 1]) for i in range(12)] + [(20, parts[3] + " " + parts[4] + " more")]
    grouped, stage = [], j.stage

    def seen(df):
        out = stage(df)
        if "grp" in out.columns and "rep" not in out.columns:
            grouped.extend(r.id for r in out.where("grp is not null").collect())
        return out

    monkeypatch.setattr(j, "stage", seen)
    got = j.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80)
    assert sorted([(r.id, r.component_id, r.n_links) for r in got.collect()]) == [(i, i, int(i == 3)) for i in range(12)] + [(20, 3, 1)]
    assert sorted(grouped) == [3, 20]


def test_texts_of_no_group_are_not_dealt_out(spark):
    """Texts meet the few that are in a group by slots before they are shuffled."""
    texts = [" ".join(f"t{i}w{k}" for k in range(60)) for i in range(40)]
    rows = [*enumerate(texts), (100, texts[7] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    passed, taken = [], type(docs).mapInArrow

    def seen(self, f, schema, *rest):
        if "component" not in self.columns and "grp" in self.columns:
            passed.append(self._jdf.queryExecution().optimizedPlan().toString())
        return taken(self, f, schema, *rest)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(docs), "mapInArrow", seen)
        got = {r.id: r.component_id for r in j.jaccard_groups(docs, 3, 90).collect()}
    assert got == {i: i for i in range(40)} | {100: 7}
    assert len(passed) == 1 and "LeftSemi" in passed[0]


@pytest.mark.parametrize("pct", [50, 80, 90])
def test_bounds_keep_every_link(pct):
    rng = np.random.default_rng(pct)
    levels = rng.integers(0, 40, 1 << 12).astype(np.uint8)
    for n in (1, 2, 9, 127, 128, 129, 900, 1023, 1025, 5000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < keep], rng.integers(0, 2**63, more).astype(np.uint64)])) for keep in (1, 0.97, 0.93, 0.8) for more in (0, 1, n // 12, n // 3)]
        sets = [s for s in sets if len(s)]
        sizes, bins = np.array([len(s) for s in sets]), [j.histogram(s) for s in sets]
        joined = {k: r for k, r in j.local_roots(*([x[i] for x in j.near_on_list(sizes, bins, pct)] for i in (0, 1))).items()}
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                assert j.differences([bins[a]], [bins[b]])[0] <= len(sets[a]) + len(sets[b]) - 2 * both
                if 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                    assert len(np.intersect1d(*[j.rarest(sets[i], pct, levels) for i in (a, b)])) >= j.least_shared(min(len(sets[a]), len(sets[b])), pct)
                    assert joined[a] == joined[b]
