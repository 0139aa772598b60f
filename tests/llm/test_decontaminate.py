import random
import re

from tabulith.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).update([] if item is None else [str(item)])
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if (own := wins.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = ["the", "Öl", "näh", "a1", "Zed", "cat", "Dog", "日本", "x"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(0, 9))) for i in range(12)] + [(3, text(6)), (None, "the the"), (77, None), (78, "!! ..")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(100, None), (101, ""), (None, text(30)), (7, text(9)), (7, text(9))]
    docs += [(102, "lead " + items[0][1].upper() + " tail"), (103, text(9000))]
    return docs, items


def test_scan_is_brute_force(spark):
    docs, items = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 400):
        got = dc.scan_documents(d, b, size=4, block=block)
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()], key=str) == brute(docs, items, 4), block


def test_modes(spark):
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Ünd: One, TWO three four. rest", "z"), (2, "one two three", "y"), (3, None, None)], "doc_id long, text string, items string")
    assert {r.doc_id for r in dc.decontaminate(docs, b, size=4).collect()} == {2, 3}
    cut = {r.doc_id: (r.text, r["items"]) for r in dc.decontaminate(docs, b, size=4, mode="spans").collect()}
    assert cut == {1: ("Ünd: . rest", "z"), 2: ("one two three", "y"), 3: (None, None)}


def test_items_without_an_id(spark):
    b = spark.createDataFrame([(None, "one two three four")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x one two three four"), (2, "one two three")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in dc.scan_documents(docs, b, size=4).collect()) == [(1, 4, []), (2, 0, [])]
    assert [r.doc_id for r in dc.decontaminate(docs, b, size=4).collect()] == [2]


def test_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in dc.scan_documents(docs, b).collect()] == [(2, 0, [])]
    assert dc.decontaminate(docs.limit(0), b).count() == 0


def test_one_long_id_and_many_windows(spark):
    """An id of 2000 characters among many costs its own length, not everybody's; windows come in bounded batches."""
    items = [("x" * 2000 if i == 7 else str(i), " ".join(f"w{i}_{j}" for j in range(40))) for i in range(3000)]
    b = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(f"w7_{j}" for j in range(12))), (2, " ".join(f"w9_{j}" for j in range(10)))], "doc_id long, text string")
    assert {r.doc_id: r["items"] for r in dc.scan_documents(docs, b).collect()} == {1: ["x" * 2000], 2: ["9"]}
    known = dc._Windows(dc.benchmark_windows(b, 10, "item_id", "text").toArrow())
    assert len(known.names) == 3000 and known.names.nbytes < 100_000
