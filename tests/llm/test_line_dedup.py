import random

from tabulith.llm.line_dedup import dedup_lines


def key(line):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return low.strip(" \t\n\x0b\x0c\r")


def brute(rows, least, chars=1):
    seen = {}
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= chars:
                seen.setdefault(key(line), set()).add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < least]
        out.append((d, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    pool = ["Home | About", " home | about\t", "ÉCOLE", "École", "x", "", "  ", "a\x0b", "unique-ish"]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return out + [(100, None), (101, ""), (102, "\n\n"), (7, "Home | About\nother"), (7, "Home | About\nother"), (None, "x\ny"), (103, "\n".join(f"l{i}\nx" for i in range(5000)))]


def test_is_brute_force(spark):
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows()], "doc_id long, text string, N_Lines string, drop int")
    for least, chars in ((10, 1), (3, 2)):
        out = dedup_lines(docs, least, chars)
        assert sorted(out.columns) == ["doc_id", "drop", "n_dropped", "n_lines", "text"]
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], key=str) == brute(rows(), least, chars)


def test_copies_and_empty(spark):
    docs = spark.createDataFrame([(i, "a copy\nof one text") for i in range(20)], "doc_id long, text string")
    assert {r.text for r in dedup_lines(docs, 10).collect()} == {""}
    assert {r.text for r in dedup_lines(docs, 10, distinct_texts=True).collect()} == {"a copy\nof one text"}
    assert dedup_lines(docs.limit(0)).count() == 0
    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_near_copies_by_texts(spark):
    """A line of ten or more versions of a text goes under either count, and no other line of them."""
    rows = [(i, f"shared by all\nown of {i}") for i in range(12)] + [(100 + i, "whole copy") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for by_text, copies in ((False, ""), (True, "whole copy")):
        got = {r.doc_id: r.text for r in dedup_lines(docs, 10, distinct_texts=by_text).collect()}
        assert got == {i: f"own of {i}" for i in range(12)} | {100 + i: copies for i in range(12)}
