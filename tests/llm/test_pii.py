import datetime
import hashlib
import re

from pyspark.sql import functions as F

from tabulith.llm import pii

TEXT = (
    "Mail bosbt.42@mail8.example.com or Bo+x@a-b.org; ip 42.144.35.254. Call +1 (988) 555-2485, (988) 555-2485 or 988-555-2485; "
    "card 4337166598464399 = 4337-1665-9846-4399, born 1984-02-29 (29.02.1984, 02/29/1984); ssn 078-05-1120. IBAN GB82 WEST 1234 5698 7654 32 DE89370400440532013000 ü日"
)
STAYS = "v 1.2.3.999, 4337166598464398, 2023-02-30, 666-12-3456, DE88370400440532013000, 1000-01-01, 12345, CC BY 4.0. a@b x@ @y.z 300.1.1.1 123456789012"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def f(tweak, i, x):
    return int(hashlib.sha256(f"k|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(tweak, left, right, a, b):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + f(tweak, i, right)) % a
        else:
            right = (right + f(tweak, i, left)) % b
    return left, right


def plain_digits(tweak, d):
    h = len(d) // 2
    left, right = feistel(f"{tweak}:{len(d)}", int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return (str(left).zfill(h) if h else "") + str(right).zfill(len(d) - h)


def into(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def plain_day(d):
    late, first = d.day > 12, datetime.date(1900, 1, 1)
    every = [x for x in (first + datetime.timedelta(n) for n in range(80_000)) if (x.day > 12) == late]
    side = 211 if late else 170
    x, y = feistel("late day" if late else "day", *divmod(every.index(d), side), side, side)
    return every[x * side + y]


def plain(kind, m):
    """The pseudonym of one value, step by step."""
    if kind == "card":
        d = plain_digits("card", re.sub(r"\D", "", m)[:-1])
        return into(m, d + next(c for c in "0123456789" if luhn(d + c)))
    if kind == "phone":
        d = re.sub(r"\D", "", m)
        kept = len(re.match(pii._COUNTRY, d)[0]) if m[0] == "+" else 0
        return into(m, d[:kept] + plain_digits("phone", d[kept:]))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        a, r = feistel("ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return f"{a + 1 + (a >= 665):03}-{r // 9999 + 1:02}-{r % 9999 + 1:04}"
    if kind == "iban":
        rest = m.replace(" ", "")[4:]
        moved = into(rest, plain_digits("iban" + re.sub(r"\d", "", rest), re.sub(r"\D", "", rest)))
        value = int("".join(str(int(c, 36)) for c in moved + m[:2])) * 100
        return m[:2] + into(m[2:], f"{98 - value % 97:02}" + re.sub(r"\D", "", moved))
    if kind == "ip":
        q = list(map(int, m.split(".")))
        left, right = feistel("ip", q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536)
        return ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if kind == "date":
        form = "%Y-%m-%d" if m[4] == "-" else f"%m{m[2]}%d{m[2]}%Y" if int(m[3:5]) > 12 else f"%d{m[2]}%m{m[2]}%Y"
        return plain_day(datetime.datetime.strptime(m, form).date()).strftime(form)
    name, host = m.split("@")
    h = len(name) // 2
    half = [name[:h], name[h:]]
    for i in range(pii.ROUNDS):
        own, other = half[i % 2], half[1 - i % 2]
        key = hashlib.sha256(f"k|email:{len(name)}|{i}|{other}".encode()).digest()
        turn = lambda c, by: next((chr((ord(c) - ord(lo) + by) % n + ord(lo)) for lo, hi, n in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)) if lo <= c <= hi), c)
        half[i % 2] = "".join(turn(c, key[k % 32]) for k, c in enumerate(own))
    return "".join(half) + "@" + host


VALUES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"],
    "phone": ["+49 30 1234567", "+1 (988) 555-2485", "(988) 555-2485", "+380 44 123 4567", "988.555.2485"],
    "ssn": ["078-05-1120", "899-99-9999", "667-01-0001", "665-01-0001"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "ES91 2100 0418 4502 0005 1332"],
    "ip": ["10.0.0.1", "255.255.255.255", "0.0.0.0"],
    "date": ["1984-02-29", "29.02.1984", "02/29/1984", "01.01.1900", "12/31/1999", "05/06/2020", "2100-08-12"],
    "email": ["bosbt.42@mail8.example.com", "B+x@a-b.org", "q@r.st"],
}


def test_is_plain_feistel(spark):
    pairs = [(k, m) for k, own in VALUES.items() for m in own]
    got = run(spark, [f"v: {m}, w" for _, m in pairs])
    for i, (k, m) in enumerate(pairs):
        assert got[i].text == f"v: {plain(k, m)}, w" and got[i][f"n_{k}"] == 1, (m, got[i].text)
    assert re.match(r"v: \+49 ", got[3].text) and re.match(r"v: \+380 ", got[6].text)
    back = run(spark, [got[i].text for i in range(len(pairs))], inverse=True)
    assert [back[i].text for i in range(len(pairs))] == [f"v: {m}, w" for _, m in pairs]


def test_long_candidates(spark):
    """Hosts, digits, dots, blanks and groups without end take neither stack nor time."""
    ends = ["a." * 30_000 + "com", "a" * 60_000 + ".com", "a-" * 30_000 + "b.com"]
    texts = [f"x@{e}" for e in ends] + ["1" * 60_000, "1." * 30_000, "1 " * 30_000, "(" * 60_000, "+1 " * 20_000, "1234 " * 5_000, "AB12 " * 12_000, "12-" * 20_000, "a@" * 30_000, "." * 60_000 + "@x.y"]
    got = run(spark, texts)
    assert len(got) == len(texts) and [got[i].n_email for i in range(3)] == [1, 1, 1]
    assert all(got[i].text.endswith(ends[i]) for i in range(3)) and got[3].text == texts[3]


def run(spark, texts, **how):
    rows = [(i, t, "kept") for i, t in enumerate(texts)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, found string"), "k", **how)
    return {r.doc_id: r for r in out.collect()}


def test_formats_links_and_round_trip(spark):
    got = run(spark, [TEXT, STAYS, None, "", "no candidates", "x 4337 1665 9846 4399 y bosbt.42@mail8.example.com", "w " * 50_000 + "10.0.0.1"])
    new = got[0].text
    form = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]+", "9", s)))
    assert form(re.sub(r"[\d.]{7,}", "ip", new)) == form(re.sub(r"[\d.]{7,}", "ip", TEXT))
    assert tuple(got[0][f"n_{k}"] for k in pii.KINDS) == (2, 1, 3, 2, 1, 3, 2)
    for old in ("bosbt.42", "42.144.35.254", "555-2485", "4337166598464399", "1984-02-29", "29.02.1984", "078-05-1120", "1234 5698", "370400440532013000"):
        assert old not in new, old
    phones = re.search(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", new).groups()
    assert phones[:3] == phones[3:6] == phones[6:]
    a, b = re.search(r"card (\d{16}) = ([\d-]{19})", new).groups()
    assert a == b.replace("-", "") and luhn(a) and a in got[5].text.replace(" ", "")
    days = re.search(r"born (\S+) \((\S+), (\S+)\)", new).groups()
    day = datetime.date.fromisoformat(days[0])
    assert day.strftime("%d.%m.%Y") == days[1] and day.strftime("%m/%d/%Y") == days[2] and day.day > 12
    assert re.search(r"Mail (\S+)@", new)[1] == re.search(r"y (\S+)@", got[5].text)[1]
    assert all(0 <= int(x) <= 255 for x in re.search(r"ip ([\d.]+)\. ", new)[1].split("."))
    assert got[1].text == STAYS and sum(got[1][f"n_{k}"] for k in pii.KINDS) == 0
    assert (got[2].text, got[3].text, got[4].text, got[2].n_card) == (None, "", "no candidates", 0)
    assert got[6].n_ip == 1 and got[0].found == "kept"
    back = run(spark, [got[0].text, got[5].text], inverse=True)
    assert back[0].text == TEXT and back[1].text.startswith("x 4337 1665 9846 4399 y bosbt.42@")


def test_is_a_permutation(spark):
    key = "k"
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = d.select("d", pii.permuted_digits(key, F.lit("t"), F.col("d")).alias("e")).select("d", "e", pii.permuted_digits(key, F.lit("t"), F.col("e"), inverse=True).alias("back")).collect()
    assert len({r.e for r in out}) == 1000 and all(r.back == r.d and len(r.e) == 3 for r in out) and sum(r.d == r.e for r in out) < 20
    days = spark.range(80_000).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    both = days.where(pii._day_place(F.col("d")).isNotNull()).select("d", pii._date(key, F.col("d"), False).alias("e"))
    both = both.select("d", "e", pii._date(key, F.col("e"), True).alias("back")).collect()
    assert len(both) == len({r.e for r in both}) == pii._EARLY**2 + pii._LATE**2 and {r.e for r in both} == {r.d for r in both}
    assert all(r.back == r.d and (int(r.d[8:]) > 12) == (int(r.e[8:]) > 12) for r in both)


def test_plan_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = pii.pseudonymise(docs, "k")
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
BESIDE = {
    "{c} 123": 1, "{c} 12/27": 1, "no 3 {c}": 1, "no 33 12 {c}": 1, "2024 {c}": 1, "{c} 1984-02-29": 1, "{c} 078-05-1120": 1, "{c} {c}": 2, "3 4111111111111111 7": 1, "3782 822463 10005 123": 1,
    "6212-3456-7890-0000-003": 1, "{i} EUR": 1, "{i} {c}": 1, "AB12 {i}": 1, "ES9121000418450200051332 EUR": 1, "1 2 3 4 5 6 7 8 9 0 1 2 4": 0,
}


def test_numbers_beside_cards_and_ibans(spark):
    texts = [t.format(c=CARD, i=IBAN) for t in BESIDE]
    got = run(spark, [*texts, CARD, IBAN])
    new_card, new_iban = got[len(texts)].text, got[len(texts) + 1].text
    for k, (t, n) in enumerate(BESIDE.items()):
        r = got[k]
        assert (r.n_card + r.n_iban) == n + (t == "{i} {c}"), (t, r.text)
        if "{" in t and "1984" not in t and "078" not in t:
            assert r.text == t.format(c=new_card, i=new_iban), t
    for k, t in enumerate(BESIDE):
        if "1984" in t or "078" in t:
            assert got[k].text.startswith(new_card) and got[k].n_date + got[k].n_ssn == 1 and texts[k][-5:] not in got[k].text
        elif BESIDE[t]:
            assert got[k].text != texts[k]
    back = run(spark, [got[k].text for k in range(len(texts))], inverse=True)
    again = [t for k, t in enumerate(texts) if back[k].text != t]
    assert again in ([], ["2024 " + CARD])
