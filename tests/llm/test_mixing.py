import random

import numpy as np
import pytest

from tabulith.llm import mixing as m


def test_pivot_keeps_words_and_odds():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 90, 40).astype(float)
    p = rng.random(40)
    p[3], p[9] = 0.0, 1.0
    total = np.zeros(40)
    for _ in range(4000):
        out, left = m.pivot(sizes, p, rng)
        whole = np.delete(out, left) if left >= 0 else out
        assert set(np.unique(whole)) <= {0.0, 1.0}
        assert abs(sizes @ out - sizes @ p) < 1e-6
        if left >= 0:
            out[left] = rng.random() < out[left]
        total += out
    assert np.abs(total / 4000 - p).max() < 0.05
    assert m.pivot(np.empty(0), np.empty(0), rng)[1] == -1


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free or not total:
            return {s: cap * sizes[s] for s in names}
        level = (total - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


@pytest.mark.parametrize("group", [8192, 5])
def test_mix(spark, monkeypatch, group):
    monkeypatch.setattr(m, "GROUP", group)
    monkeypatch.setattr(m, "FAN_IN", 3)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "é", "b", None, "Z", "z"]), 1) for i in range(400)]
    rows += [(400 + i, "w " * 50, "hot", 2) for i in range(300)] + [(900, None, "a", 1), (901, "", "empty", 1), (None, "x y", "a", 1), (5, "x", "a", 1), (5, "x", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = m.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60, s
    assert sorted(map(str, got)) == sorted(map(str, m.mix_sources(docs.repartition(7)).collect()))


def test_empty(spark):
    assert m.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = m.mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in one] == [(0, 0.0, 0)]
