"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

Texts are split at candidates by one pattern; each candidate that its own check validates is replaced
by a keyed permutation of its kind's domain, a Feistel network over two halves whose round function is
SHA-256 with the key. Equal values get equal pseudonyms in all documents, whatever separators they are
written with, and different values stay different; the holder of the key can turn them back.

========  ==============================================  =====================================
kind      check                                           what is permuted
========  ==============================================  =====================================
email     name@host.tld                                   letters and digits of the name
ip        four numbers to 255                             the 32-bit address
date      a day from 1900-01-01 on, to 2100-05-10          the day, written in the same form
iban      remainder 1 modulo 97                           digits of the account; check digits follow
ssn       area, group and serial that are issued          the number among those
phone     7 to 15 digits in a phone's form                all but the country code after a plus
card      12 to 19 digits with a right Luhn digit         all but the Luhn digit, which follows
========  ==============================================  =====================================

Cards and IBANs are found in the forms they are usually written in, and where other groups of digits or
letters stand beside them, by testing the runs of groups. Beside such groups a run may become valid by
chance when another is replaced (one in ten for cards that have no usual form or groups of four before
them), and is then not turned back by the key.

Days to the 12th are permuted among themselves, and so are the others: a date that can only be read month
first stays one. Forms that are not looked for: dates without leading zeros or with month names, phones
without a country code but those of ten digits, IPv6. The key is part of the query's plan, so event logs
that show plans have to be kept as safe as the key.

Documents without an ``@`` and without a digit have no candidates and pass unchanged, no shuffle is
made. Defined cases: null text stays null with zero counts; candidates that fail their check stay as
they are; columns of the input that carry an output's name are replaced; rows are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 10
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # possessive: long hosts take no stack
_IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
_ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
_DAY = r"(?<![\d./])\d{2}[./]\d{2}[./]\d{4}(?!\d|[./]\d)"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])"
# IBAN lengths by country, as registered.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_USUAL = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_CARD_USUAL = r"(?<!\d)\d{4}[ -](?:\d{4}[ -]\d{4}[ -]\d{4}|\d{6}[ -]\d{4,5})(?!\d)"
# Cards in the usual groups with the groups beside them, but for those that begin another kind; then any other run.
_NEXT = r"(?!\d|[./-]\d)"
_CARD_FOURS = rf"(?<!\d)\d{{4}}(?:[ -]\d{{4}}(?!\d|-\d{{2}}-\d{{2}}(?!\d)|[./]\d)){{3,}}+(?:[ -]\d{{1,3}}{_NEXT})?"
_CARD_SIXES = rf"(?<!\d)\d{{4}}[ -]\d{{6}}[ -]\d{{4,5}}(?!\d)(?:[ -]\d{{1,4}}{_NEXT})?"
_CARD = "|".join([_CARD_FOURS, _CARD_SIXES, rf"(?<!\d)\d(?:[ -]?(?!{_CARD_USUAL}|{_IP}|{_ISO}|{_DAY}|{_SSN}|{_PHONE})\d){{11,18}}(?!\d)"])
_PATTERN = "|".join([_EMAIL, _IP, _ISO, _DAY, _IBAN_USUAL, _IBAN, _SSN, _PHONE, _CARD])
KINDS = ("email", "ip", "date", "iban", "ssn", "phone", "card")
# Country codes of phones with one or two digits; others have three.
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
_FIRST_DAY = "1900-01-01"
#: Sides of the squares of days to the 12th of their months, and of later days; both end in 2100 or 2101.
_EARLY, _LATE = 170, 211
#: Days after the 12th that a month has on average.
_LATE_DAYS = 365.2425 / 12 - 12


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _f(key: str, tweak: Column, i: Column, x: Column) -> Column:
    """60 bits of SHA-256 over key, kind, round and half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column, inverse: bool = False) -> Column:
    """A permutation of pairs (left < a, right < b): struct(l, r)."""

    def turn(s: Column, i: Column) -> Column:
        move = lambda x, half, m: F.pmod(x - _f(key, tweak, i, half) % m if inverse else x + _f(key, tweak, i, half) % m, m)
        even = F.struct(move(s["l"], s["r"], a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), move(s["r"], s["l"], b).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(_rounds(inverse), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permuted_digits(key: str, tweak: Column, digits: Column, inverse: bool = False) -> Column:
    """A permutation of digit strings of one length (36 digits at most)."""
    def of(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        moved = feistel(key, F.concat_ws(":", tweak, n.cast("string")), F.coalesce(F.nullif(F.substr(d, F.lit(1), h), F.lit("")).cast("long"), F.lit(0)), F.substr(d, h + 1).cast("long"), _power10(h), _power10(n - h), inverse)
        padded = lambda out: F.concat(F.when(h > 0, F.lpad(out["l"].cast("string"), h, F.lit("0"))).otherwise(""), F.lpad(out["r"].cast("string"), (n - h).cast("int"), F.lit("0")))
        return F.when(n > 0, let(moved, padded)).otherwise("")

    return let(digits, of)


def _into(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by those of ``digits``, which are as many."""
    return F.array_join(F.zip_with(F.split(form, "[0-9]", -1), F.concat(F.split(digits, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The weighted sum of payload digits, the last of which counts twice."""

    def add(t: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 0
        return t + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _mod97(s: Column) -> Column:
    """The remainder of digits and letters (A is 10) read as a number."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, F.when(c == "", F.lit("0")).otherwise(c))))


def _email(key: str, m: Column, inverse: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    n = F.length(name)
    h = F.floor(n / 2).cast("int")
    tweak = F.concat_ws(":", F.lit("email"), n.cast("string"))

    def shifted(half: Column, other: Column, i: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), other).cast("binary"), 256)

        def one(c: Column, k: Column) -> Column:
            by = F.conv(F.substr(hashed, (k % 32 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            by = -by if inverse else by
            move = lambda base, size: F.char(F.pmod(F.ascii(c) - base + by, F.lit(size)) + base)
            return F.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).when(c.between("0", "9"), move(48, 10)).otherwise(c)

        return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), one), ""))

    def turn(s: Column, i: Column) -> Column:
        even = F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    moved = F.aggregate(_rounds(inverse), F.struct(F.substr(name, F.lit(1), h).alias("l"), F.substr(name, h + 1).alias("r")), turn)
    return let(moved, lambda out: F.concat(out["l"], out["r"], F.substr(m, n + 1)))


def _ip(key: str, m: Column, inverse: bool) -> Column:
    q = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    moved = feistel(key, F.lit("ip"), q[0] * 256 + q[1], q[2] * 256 + q[3], F.lit(65536), F.lit(65536), inverse)
    return let(moved, lambda out: F.concat_ws(".", *[x.cast("string") for h in (out["l"], out["r"]) for x in (F.floor(h / 256), h % 256)]))


def _iso_day(m: Column) -> Column:
    """A date's text as year-month-day: day first, or month first where only that is a date."""
    y, x1, x2 = F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))
    return F.when(m.rlike(r"^\d{4}-"), m).when(x2 <= "12", F.concat_ws("-", y, x2, x1)).otherwise(F.concat_ws("-", y, x1, x2))


def _month_start(month: Column) -> Column:
    return F.add_months(F.lit(_FIRST_DAY).cast("date"), month.cast("int"))


def _late_before(month: Column) -> Column:
    """Days after the 12th in the months before."""
    return F.date_diff(_month_start(month), F.lit(_FIRST_DAY).cast("date")) - 12 * month


def _day_place(m: Column) -> Column:
    """struct(late, at): a date's place among the days to the 12th or among the later ones; null if it is none."""

    def of(d: Column) -> Column:
        month = (F.year(d) - 1900) * 12 + F.month(d) - 1
        late = F.dayofmonth(d) > 12
        at = F.when(late, _late_before(month) + F.dayofmonth(d) - 13).otherwise(12 * month + F.dayofmonth(d) - 1)
        return F.when((F.year(d) >= 1900) & (at < F.when(late, _LATE**2).otherwise(_EARLY**2)), F.struct(late.alias("late"), at.cast("long").alias("at")))

    return let(_iso_day(m).try_cast("date"), of)


def _day_at(late: Column, at: Column) -> Column:
    """The day of a place."""

    def later(guess: Column) -> Column:
        month = guess + F.when(_late_before(guess + 1) <= at, 1).when(_late_before(guess) > at, -1).otherwise(0)
        return let(month, lambda k: F.date_add(_month_start(k), (at - _late_before(k) + 12).cast("int")))

    early = F.date_add(_month_start(F.floor(at / 12)), (at % 12).cast("int"))
    return F.when(late, let(F.floor(at / _LATE_DAYS).cast("long"), later)).otherwise(early)


def _date(key: str, m: Column, inverse: bool) -> Column:
    def written(day: Column) -> Column:
        y, x1, x2 = F.substr(day, F.lit(1), F.lit(4)), F.substr(day, F.lit(9), F.lit(2)), F.substr(day, F.lit(6), F.lit(2))
        sep = F.substr(m, F.lit(3), F.lit(1))
        month_first = F.substr(m, F.lit(4), F.lit(2)) > "12"
        return F.when(m.rlike(r"^\d{4}-"), day).when(month_first, F.concat(x2, sep, x1, sep, y)).otherwise(F.concat(x1, sep, x2, sep, y))

    def moved(p: Column) -> Column:
        side = F.when(p["late"], _LATE).otherwise(_EARLY)
        tweak = F.when(p["late"], "late day").otherwise("day")
        out = feistel(key, tweak, F.floor(p["at"] / side), p["at"] % side, side, side, inverse)
        return let(let(out, lambda o: _day_at(p["late"], o["l"] * side + o["r"])).cast("string"), written)

    return let(_day_place(m), moved)


def _iban_rest(m: Column) -> Column:
    return F.substr(F.regexp_replace(m, " ", ""), F.lit(5))


def _iban(key: str, m: Column, inverse: bool) -> Column:
    country = F.substr(m, F.lit(1), F.lit(2))

    def checked(moved: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, _into(F.substr(m, F.lit(3)), F.concat(check, _digits(moved))))

    account = lambda rest: _into(rest, permuted_digits(key, F.concat(F.lit("iban"), F.regexp_replace(rest, "[0-9]", "")), _digits(rest), inverse))
    return let(let(_iban_rest(m), account), checked)


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(F.split(m, "-")[k].cast("long") for k in range(3))


def _ssn(key: str, m: Column, inverse: bool) -> Column:
    area, group, serial = _ssn_parts(m)
    moved = feistel(key, F.lit("ssn"), area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), inverse)

    def written(out: Column) -> Column:
        a = out["l"] + 1 + F.when(out["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(out["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((out["r"] % 9999 + 1).cast("string"), 4, "0"))

    return let(moved, written)


def _phone(key: str, m: Column, inverse: bool) -> Column:
    def of(d: Column) -> Column:
        kept = F.when(m.startswith("+"), F.length(F.regexp_extract(d, f"^(?:{_COUNTRY})", 0))).otherwise(0)
        return _into(m, F.concat(F.substr(d, F.lit(1), kept), permuted_digits(key, F.lit("phone"), F.substr(d, kept + 1), inverse)))

    return let(_digits(m), of)


def _card(key: str, m: Column, inverse: bool) -> Column:
    moved = permuted_digits(key, F.lit("card"), _payload(m), inverse)
    return let(moved, lambda payload: _into(m, F.concat(payload, ((10 - _luhn_sum(payload) % 10) % 10).cast("string"))))


def _payload(m: Column) -> Column:
    """A card's digits without the last."""
    return F.regexp_replace(_digits(m), "[0-9]$", "")


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes its check, else null."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    area, group, serial = _ssn_parts(m)
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(whole(_IP), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), "ip"))
        .when(m.rlike(rf"^(?:\d{{4}}-\d\d-\d\d|\d\d[./]\d\d[./]\d{{4}})$"), F.when(_day_place(m).isNotNull(), "date"))
        .when(m.rlike("^[A-Z]"), F.when(_right_iban(m), "iban"))
        .when(whole(_SSN), F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), "ssn"))
        .when(whole(_PHONE), F.when(F.length(_digits(m)).between(7, 15), "phone"))
        .otherwise(let(_digits(m), lambda d: F.when(F.length(d).between(12, 19) & _right_luhn(d), "card")))
    )


def _right_iban(m: Column) -> Column:
    return _mod97(F.concat(_iban_rest(m), F.substr(m, F.lit(1), F.lit(4)))) == 1


def _right_luhn(d: Column) -> Column:
    return (_luhn_sum(F.substr(d, F.lit(1), F.length(d) - 1)) + F.substr(d, F.length(d)).cast("int")) % 10 == 0


def _inside(m: Column, kind: str) -> Column:
    """A candidate for ``kind`` cut at its groups into pieces, array of struct(m, kind): runs of groups
    that are valid and don't overlap. Usual forms come first, without them the whole, then other runs in
    between; of two that overlap the earlier one is taken, of those that begin together the longer.

    Other runs than the whole have only groups of four and more but for the last, so lists of short
    numbers, some run of which is always valid, stay.
    """
    sep, char, most = ("[ -]", "[0-9]", 19) if kind == "card" else (" ", "[A-Z0-9]", 34)
    bare = lambda s: F.regexp_replace(s, f"^{sep}", "")

    def run(tokens: Column, i: Column, size: Column) -> Column:
        def of(r: Column) -> Column:
            if kind == "card":
                usual = r.rlike(f"^(?:{_CARD_USUAL}|[0-9]{{12,19}})$")
                right = let(_digits(r), lambda d: F.when(F.length(d).between(12, 19), _right_luhn(d)))
            else:
                usual = r.rlike(f"^{_IBAN_USUAL}$")
                right = F.when(r.rlike("^[A-Z]{2}[0-9]{2}") & F.length(F.regexp_replace(r, " ", "")).between(12, most), _right_iban(r))
            whole = size == F.size(tokens)
            formed = usual | whole | r.rlike(f"^(?:{char}{{4,}}{sep})*{char}+$")
            return F.when(formed & right, F.struct(i.alias("i"), (-size).alias("size"), usual.alias("usual"), whole.alias("whole"), r.alias("r")))

        return let(bare(F.array_join(F.slice(tokens, i, size), "")), of)

    def chosen(valid: Column, taken: Column) -> Column:
        """Of runs in order those that begin after the last one's end and end before the next one taken."""
        room = lambda got, r: F.coalesce(F.try_element_at(got, F.lit(-1))["i"] - F.try_element_at(got, F.lit(-1))["size"] <= r["i"], F.lit(True))
        apart = lambda r: ~F.exists(taken, lambda g: (r["i"] < g["i"] - g["size"]) & (g["i"] < r["i"] - r["size"]))
        return F.aggregate(F.filter(valid, apart), F.slice(valid, 1, 0), lambda got, r: F.when(room(got, r), F.array_append(got, r)).otherwise(got))

    def cut(tokens: Column, got: Column) -> Column:
        as_is = lambda x: F.struct(x.alias("m"), F.lit(None).cast("string").alias("kind"))

        def before(r: Column, k: Column) -> Column:
            end = F.coalesce(F.get(got, k - 1)["i"] - F.get(got, k - 1)["size"], F.lit(1))
            return F.array(as_is(F.concat(F.array_join(F.slice(tokens, end, r["i"] - end), ""), F.regexp_extract(F.get(tokens, r["i"] - 1), f"^{sep}?", 0))), F.struct(r["r"].alias("m"), F.lit(kind).alias("kind")))

        end = F.coalesce(F.try_element_at(got, F.lit(-1))["i"] - F.try_element_at(got, F.lit(-1))["size"], F.lit(1))
        rest = F.array_join(F.slice(tokens, end, F.size(tokens) - end + 1), "")
        return F.concat(F.flatten(F.transform(got, before)), F.array(as_is(rest)))

    def of(tokens: Column) -> Column:
        n = F.size(tokens)
        runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(n - i + 1, F.lit(most))), lambda size: run(tokens, i, size))))
        none = lambda valid: F.slice(valid, 1, 0)

        def both(valid: Column) -> Column:
            usual = chosen(F.filter(valid, lambda r: r["usual"]), none(valid))
            whole = F.filter(valid, lambda r: r["whole"])
            others = lambda taken: F.array_sort(F.concat(taken, chosen(F.filter(valid, lambda r: ~r["usual"] & ~r["whole"]), taken)))
            return let(usual, lambda taken: F.when((F.size(taken) == 0) & (F.size(whole) > 0), whole).otherwise(others(taken)))

        return let(let(F.array_sort(F.filter(runs, lambda r: r.isNotNull())), both), lambda got: cut(tokens, got))

    return let(F.regexp_extract_all(m, F.lit(f"{sep}?{char}+"), F.lit(0)), of)


def pieces(m: Column) -> Column:
    """A candidate as array of struct(m, kind); one piece but for groups of numbers beside one another."""
    one = F.array(F.struct(m.alias("m"), kind_of(m).alias("kind")))
    card = m.rlike(r"^[0-9](?:[0-9]|[ -](?=[0-9]))*+$") & ~m.rlike(rf"^(?:{_ISO}|{_SSN}|{_PHONE}|{_CARD_USUAL}|[0-9]+)$")
    iban = m.rlike("^[A-Z]") & ~F.contains(m, F.lit("@")) & F.contains(m, F.lit(" ")) & ~_right_iban(m)
    return F.when(card, _inside(m, "card")).when(iban, _inside(m, "iban")).otherwise(one)


_BY_KIND: dict[str, Callable[[str, Column, bool], Column]] = {"email": _email, "ip": _ip, "date": _date, "iban": _iban, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in the text, and a count ``n_<kind>`` of each kind; ``inverse`` undoes it."""
    text = docs[text_col]
    some = text.contains("@") | text.rlike("[0-9]")
    found = F.transform(F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0)), pieces)

    def changed(x: Column) -> Column:
        out = F.when(x["kind"].isNull(), x["m"])
        for kind, f in _BY_KIND.items():
            out = out.when(x["kind"] == kind, f(key, x["m"], inverse))
        return out

    split = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], text.alias("text"), F.when(some, found).alias("found"))
    parts = F.concat(F.transform("found", lambda x: F.array_join(F.transform(x, changed), "")), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split("text", _PATTERN, -1), parts, lambda a, b: F.concat(a, b)), "")
    count = lambda k: F.coalesce(F.size(F.filter(F.flatten("found"), lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    new = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    flat = split.select(*[F.col(f"c{i}") for i in range(len(docs.columns))], new.alias("new"), *[F.when(F.col("found").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"k{k}") for k in KINDS])
    taken = {text_col.lower(), *[f"n_{k}" for k in KINDS]}
    return flat.select(*[F.col("new" if c.lower() == text_col.lower() else f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() == text_col.lower() or c.lower() not in taken], *[F.col(f"k{k}").alias(f"n_{k}") for k in KINDS])


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus key 1")
