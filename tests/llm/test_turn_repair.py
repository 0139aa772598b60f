"""Repairs against all sequences of edits, against a plain search over strings, and over many ranges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabulith.llm import turn_repair as tr

SOUND = re.compile(r"(s?(ua)+)?")


def every_edit(codes):
    """The least (cost, audit) by trying all edits with up to two inserts in a place."""
    best = None
    per_row = [[("D", 2, "")] + ([] if c == "-" else [("K", 5 * c.isupper(), c.lower())] + [("R", 1 + 5 * c.isupper(), r) for r in "ua"]) for c in codes]
    gaps = ["", "u", "a", "ua", "au"]
    for rows in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(codes) + 1):
            roles = ins[0] + "".join(r[2] + i for r, i in zip(rows, ins[1:]))
            if SOUND.fullmatch(roles):
                got = sum(r[1] for r in rows) + 5 * sum(map(len, ins)), "I" * len(ins[0]) + "".join(r[0] + "I" * len(i) for r, i in zip(rows, ins[1:]))
                best = min(best or got, got)
    return best


def plain(codes):
    """The least (cost, audit) by a search over what the last role was."""
    order = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    put = lambda ways, key, way: ways.update({key: min(ways.get(key, way), way)})

    def grown(ways):
        for _ in range(3):
            for at, (c, a) in list(ways.items()):
                for r in "ua":
                    if (at, r) in order:
                        put(ways, r, (c + 5, a + "I"))
        return ways

    ways = grown({"": (0, "")})
    for code in codes:
        now = {}
        for at, (c, a) in ways.items():
            put(now, at, (c + 2, a + "D"))
            for r in "sua" if code != "-" else "":
                if (at, r) in order and (r == code.lower() or r != "s"):
                    put(now, r, (c + 5 * code.isupper() + (r != code.lower()), a + "KR"[r != code.lower()]))
        ways = grown(now)
    return min(w for at, w in ways.items() if at in ("", "a"))


def test_all_edits():
    for n in range(4):
        for codes in itertools.product("suaxSUA-", repeat=n):
            assert tr.closed(tr.parse("".join(codes), "0"))[:2] == every_edit(codes), codes


@pytest.mark.parametrize("letters", ["suaxSUAX-", "ua", "aaU", "xX", "s"])
def test_long_and_in_pieces(letters):
    rnd = random.Random(letters)
    for n in [5, 9, 30, 60] * 15:
        codes = "".join(rnd.choice(letters) for _ in range(n))
        want = plain(codes)
        assert tr.closed(tr.parse(codes, "0"))[:2] == want, codes
        ways, at = {"0": (0, "")}, 0
        for cut in [*sorted(rnd.sample(range(n), 3)), n]:
            now = {}
            for top, (c, a) in ways.items():
                for end, (c2, a2) in tr.parsed(codes[at:cut], top).items():
                    now[end] = min(now.get(end, (c + c2, a + a2)), (c + c2, a + a2))
            ways, at = now, cut
        assert tr.closed(ways)[:2] == want, codes


def test_very_long():
    cost, audit, _ = tr.closed(tr.parse("xa" * 50_000, "0"))
    assert cost == 50_000 and audit == "RK" * 50_000


def expected(rows):
    """op12's row of one conversation, from its damaged rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, codes, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        codes += tr.row_code(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit = plain(codes)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out, it = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(it)
        if edit != "D":
            due = "assistant" if out and out[-1][0][:1] == "u" else "user"
            out.append((row[1] if edit == "K" else due, row[2] if row else ""))
    assert SOUND.fullmatch("".join(r[0][:1] for r in out))
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def damaged(rows):
    for c, t, r, x in rows:
        r, x = r if r is not None else " ", x if x is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub(r"[.!?]", "", x) if kind == 2 else x
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield c, t, "user" if kind == 4 else r, x


def some_rows():
    rnd = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "a!\n ", " \t", None, "Why?", ""]
    rows = [(c, t, roles[rnd.choice([0, 0, 1, 1, 2, 3, 4, 5])], rnd.choice(texts) if rnd.random() < 0.4 else f"{t} is {rnd.random()}.") for c in range(120) for t in range(rnd.randint(1, 8))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"Turn {t % 37}." if t % 5 else f"Turn {t}.") for t in range(700)]  # more than half of all
    rows += [(None, None, "user", "No id."), (None, 2, None, None), (3, None, "system", "First."), (7, 1, "user", "Again."), (7, 1, "user", "Again."), (9, -4, "user", "Long " * 50_000 + ".")]
    rnd.shuffle(rows)
    return rows


def test_query(spark, tmp_path):
    rows = some_rows()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    by = {r[0]: [] for r in rows}
    for c, *rest in damaged(rows):
        by[c].append(tuple(rest))
    got = tr.op12_turn_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", *tr.DIGEST, "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in got.collect()}
    assert got == {c: expected(v) for c, v in by.items()}


def test_hot_conversation_lies_in_several_tasks(spark):
    rows = [r for r in some_rows() if r[0] is not None]
    edited = tr.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    hot = [r for r in edited if r.conv_id == 500]
    assert all(r.border for r in hot) and len({r.seq >> 33 for r in hot}) > 1
    assert sum(r.edit != "I" for r in edited) == len(rows)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert tr.op12_turn_repair(spark, str(tmp_path)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in tr.op12_turn_repair(spark, str(tmp_path)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
