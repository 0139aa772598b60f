import random
import re
import time
from itertools import product

import numpy as np

from tabulith.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(WORD.search(line)) and line in lines[:i]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(rep)


def texts():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["a", "b ", "ü", "\n", "a b c\n", "##", " |", "\t", "日 "]) for _ in range(n))
    return [None, "", "\n", "a", "\n\na\na\n", *[make(rng.randrange(0, 120)) for _ in range(60)], make(4000)]


def test_figures(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a a a a")]
    got = q.judge(spark.createDataFrame(rows, "doc_id long, text string"), None, ["doc_id"]).collect()
    want = {i: brute(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id], r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(1)
    chain = q.Chain(rng.normal(size=4), rng.normal(size=2), rng.normal(size=(2, 2)))
    sizes = [1, 5, 3, 7, 1, 6]
    x = rng.integers(0, 2, (sum(sizes), 4)).astype(float)
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = chain.viterbi(x, first)
    for d, n in enumerate(sizes):
        e = x[first[d] : first[d + 1]] @ chain.w
        score = lambda y: chain.start[y[0]] + sum(chain.move[a, b] for a, b in zip(y, y[1:])) + sum(v * k for v, k in zip(e, y))  # noqa: B023, E731
        best = max(product((0, 1), repeat=n), key=score)
        assert abs(score([int(v) for v in got[first[d] : first[d + 1]]]) - score(best)) < 1e-9


def test_long_sequences_are_decoded_alike(monkeypatch):
    rng = np.random.default_rng(2)
    chain = q.Chain(rng.normal(size=4), rng.normal(size=2), rng.normal(size=(2, 2)))
    for sizes in ([700, 3, 1, 650, 9, 9, 2, 700, 30, 5], [5], [1, 1], [2000, 1], []):
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        x = rng.integers(0, 2, (sum(sizes), 4)).astype(float)
        got = {}
        for few in (0, 1, 4, 100):
            monkeypatch.setattr(q, "FEW", few)
            got[few] = chain.viterbi(x, first).tolist()
        assert got[0] == got[1] == got[4] == got[100]
    x = rng.integers(0, 2, (400_000, 4)).astype(float)
    began = time.process_time()
    chain.viterbi(x, np.array([0, 3, 400_000]))
    assert time.process_time() - began < 10


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(5)
    x, size, y = q.padded([(rng.integers(0, 2, (n, 3)).astype(float), v) for n, v in ((1, 0), (4, 1), (6, 0), (2, 1), (1, 1))])
    theta = rng.normal(size=9)
    value, g = q.likelihood(theta, x, size, y)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert abs((q.likelihood(theta + step, x, size, y)[0] - q.likelihood(theta - step, x, size, y)[0]) / 2e-6 - g[i]) < 1e-6
    # the value itself, over all labellings
    w, start, move = theta[:3], theta[3:5], theta[5:].reshape(2, 2)
    total = 0.0
    for d, n in enumerate(size):
        score = lambda lab: start[lab[0]] + sum(move[a, b] for a, b in zip(lab, lab[1:])) + sum(v * (x[t, d] @ w) for t, v in enumerate(lab))  # noqa: B023, E731
        z = np.log(sum(np.exp(score(lab)) for lab in product((0, 1), repeat=int(n))))
        total += (score([y[d]] * n) - z) * 0.5 / size[y == y[d]].sum()
    assert abs(total - value) < 1e-9


def test_training_separates(spark):
    good = " ".join(f"word{i} goes{i * 7} on{i % 9} with sense{i}." for i in range(30))
    bad = " ".join(f"BUY{i}!! NOW{i}!! ###" for i in range(40))
    rows = [(i, (good if i % 2 else bad) + "\n" + (good if i % 2 else bad)[: 200 + i], "x") for i in range(40)] + [(None, good, None), (99, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    chain = q.train_chain(docs, labels)
    kept = q.keep_good(docs, chain)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(40) if i % 2} | {None}
    assert q.train_chain(docs, labels.limit(0)) is None
    assert q.judge(docs.limit(0), chain, ["doc_id"]).count() == 0
