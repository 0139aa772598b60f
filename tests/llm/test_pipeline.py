"""The pipeline, stage by stage, against a plain version of each decision on a small corpus."""

import random
import re

import pytest

import corpus_pipeline as cp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    sentence = lambda n=12: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    text = lambda n=9: "\n".join(sentence() for _ in range(n))
    items = [(i, sentence(20)) for i in range(5)]
    rows, labels = [], []
    add = lambda t, kind: rows.append((len(rows), t, "en", rng.choice(["a", "b", "c", None]), len(t), kind))
    for i in range(80):
        add(text() + ("\nShare this page now" if i % 4 == 0 else ""), "clean")
        labels.append((len(rows) - 1, 1, 0))
    for _ in range(30):
        add("\n".join(" ".join(f"{rng.choice(vocab).upper()}!! ###" for _ in range(12)) for _ in range(8)), "junk")
        labels.append((len(rows) - 1, 0, 0))
    for i in range(6):
        add(rows[i * 7 + 1][1], "copy")
        add(rows[i * 7 + 1][1].replace(rows[i * 7 + 1][1].split()[5], "changed", 1), "near")
    for i in range(5):
        add(text(4) + "\nsee " + items[i][1].upper() + "\n" + text(4), "leak")
    add("too short", "short")
    d = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(spark.createDataFrame([(9000, None, None, None, None)], docs.schema)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {r[0]: r for r in rows}


def test_stages(spark, corpus):
    d, rows = corpus
    kinds = {i: r[5] for i, r in rows.items()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {}
    for name, f in cp.STAGES:
        before = docs.columns
        docs = spark.createDataFrame((got := f(spark, docs, d)).collect(), got.schema)
        assert name == "source_mix" or docs.columns == before
        out[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in out.items()}
    of = lambda *k: {i for i, v in kinds.items() if v in k}

    assert ids["quality_rules"] == of("clean", "copy", "near", "leak")
    assert ids["line_dedup"] == ids["quality_rules"]
    for r in out["line_dedup"]:
        assert r.text == rows[r.doc_id][1].replace("\nShare this page now", "") and r.n_chars == len(r.text)
    # of each group the smallest id stays; changing one of about 108 words leaves a similarity over 0.8
    assert ids["jaccard_join"] == of("clean", "leak")
    assert ids["decontamination"] == of("clean")
    mix = out["source_mix"]
    assert {r.doc_id for r in mix} == of("clean")
    for s in {r.source for r in mix}:
        own = [r for r in mix if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert abs(sum({r.source: r.target for r in mix}.values()) - sum(r["size"] for r in mix)) < 1e-6
    assert all(r["size"] == len(WORD.findall(next(x.text for x in out["decontamination"] if x.doc_id == r.doc_id))) for r in mix)


def test_empty(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, f in cp.STAGES:
        got = f(spark, docs.limit(0), d)
        assert got.count() == 0
