import random
import zlib

import numpy as np

from tabulith.llm import langid

PARTS = {"en": ["the", "tion", "ing", "and", "th", "er"], "fr": ["é", "eau", "tion", "le", "ou", "ç"], "de": ["ß", "sch", "ung", "ü", "der", "ein"]}


def make(lang, rng, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def grams(text):
    """The blended spectrum, plainly."""
    folded = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    return {tuple(folded[i : i + n]) for n in langid.LENGTHS for i in range(len(folded) - n + 1)}


def plain_code(g):
    c = 0
    for b in g:
        c = c * 155 + (0 if b == 32 else b - 96 if b < 128 else b - 101)
    return c + (0, 155, 155 + 155**2)[len(g) - 1]


def test_spectra_are_brute_force():
    rng = random.Random(0)
    texts = ["", "a", "A!", "日本 é", *[make(k, rng, n) for k in PARTS for n in (1, 30, 3000)], "a"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    for t, codes in zip(texts, langid.spectra(data, offsets), strict=True):
        assert sorted(codes.tolist()) == sorted(plain_code(g) for g in grams(t)), t[:20]


def test_scores_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 3000)
    rng = random.Random(7)
    rows = [(i, make(k := rng.choice(list(PARTS)), rng, rng.choice([2, 40, 500])), k) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=20, landmarks=12)
    of = {frozenset(plain_code(g) for g in grams(t)): (t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 5}
    marks = [of[frozenset(z.tolist())] for z in model.landmarks]  # landmarks are whole training texts
    assert len(marks) == 12 and [k for _, k in marks[:3]] == ["de", "en", "fr"]
    kernel = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    for r in langid.predict(docs, model).collect():
        k = np.array([kernel(rows[r.id][1], z) for z, _ in marks])
        total = k @ model.alpha + model.bias
        assert r.lang_pred == model.langs[int(total.argmax())]
        odds = np.exp(4 * (total - total.max()))
        assert abs(r.score - 1 / odds.sum()) < 1e-4
    # the weights solve the ridge equations of kernel values made plainly
    assert langid.train(docs.repartition(5), per_lang=20, landmarks=12).alpha.shape == (12, 3)


def test_fit_is_brute_force():
    rng = np.random.default_rng(3)
    marks = [np.unique(rng.integers(0, 400, 60)).astype(np.int32) for _ in range(6)]
    sets = [np.unique(rng.integers(0, 300 + 100 * (i % 2), 60)) for i in range(40)]
    langs = ["a" if i % 2 else "b" for i in range(40)]
    k = lambda x, y: len(np.intersect1d(x, y)) / (len(x) * len(y)) ** 0.5
    kernel = np.array([[k(x, z) for z in marks] for x in sets])
    model = langid.fit(kernel, langs, marks)
    # Nystroem features span the kernel columns, so scores are K w + b of the least penalised squares
    own = np.array([[k(x, z) for z in marks] for x in marks])
    target = np.array([[float(v == n) for n in ("a", "b")] for v in langs])
    w = lambda alpha, bias: 1 * ((target - kernel @ alpha - bias) ** 2).sum() + 1e-2 * 40 / 7 * np.trace(alpha.T @ own @ alpha)
    best = w(model.alpha, model.bias)
    for _ in range(200):
        assert w(model.alpha + 1e-3 * rng.normal(size=model.alpha.shape), model.bias + 1e-3 * rng.normal(size=2)) >= best - 1e-9


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, make(k := rng.choice(list(PARTS)), rng, rng.choice([8, 40, 900])), k, "x") for i in range(300)]
    rows += [(1000, None, "en", "x"), (1001, "12 !! 4", "fr", "x"), (1002, "", None, "x"), (1003, make("de", rng, 20_000), None, "x"), (None, "the thing and other", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.train(docs, per_lang=60)
    got = {r.id: r for r in langid.predict(docs, model).collect()}
    for i, _, lang, _ in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1
    held = [(got[i].lang_pred, lang) for i, _, lang, _ in rows[:300] if got[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "de" and got[None].held_out and got[None].lang_pred == "en"
    again = {r.id: tuple(r) for r in langid.predict(docs.repartition(6), langid.train(docs.repartition(3), per_lang=60)).collect()}
    assert {k: v[2] for k, v in again.items()} == {k: v.lang_pred for k, v in got.items()}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.train(docs) is None
    assert [tuple(r)[2:] for r in langid.predict(docs, None).collect()] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), None).count() == 0
