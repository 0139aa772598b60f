"""Text and number functions of statistical tables, as Column expressions.

Numbers are written the Indonesian way: ``.`` between thousands, ``,`` before decimals. A missing value
has a flag beside it, not just a null: present, nil (a dash), unavailable (dots or blank), to check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the exchange format.
PRESENT, NIL, UNAVAILABLE, TO_CHECK, CORRECTED = "ada", "nihil", "tidak_tersedia", "perlu_cek", "auto_corrected"
DASHES = "-–—"
DECIMAL = "decimal(24,4)"
# The characters that Unicode calls white space.
WHITE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.btrim(s, F.lit(WHITE))


def strip0(s: Column) -> Column:
    """Stripped, and null becomes empty."""
    return F.coalesce(strip(s), F.lit(""))


def squeeze(s: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def as_decimal(s: Column) -> Column:
    """Stripped text in plain notation as a decimal, null where it is none; exponents and names of numbers don't count."""
    return F.when(s.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), s.try_cast(DECIMAL))


def clean_num(raw: Column) -> Column:
    """struct(num, text, flag) of a printed cell.

    A leading minus is not a sign here (dashes are dropped), brackets are.
    """
    text = strip0(raw)
    # each is used as few times as can be, for what stands in branches is computed wherever it is used
    number = F.replace(F.regexp_replace(text, "[^0-9,]", ""), F.lit(","), F.lit(".")).try_cast(DECIMAL)
    dots = F.contains(text, F.lit("...")) | text.isin("..", "…")
    digit = text.rlike("[0-9]")
    dash = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in DASHES])
    signed = F.when(F.startswith(text, F.lit("(")) & F.endswith(text, F.lit(")")), -number).otherwise(number).cast(DECIMAL)
    flag = F.when(dots, UNAVAILABLE).when(~digit, F.when(dash, NIL).otherwise(UNAVAILABLE)).when(number.isNull(), TO_CHECK).otherwise(PRESENT)
    return F.struct(F.when(~dots & digit, signed).alias("num"), text.alias("text"), flag.alias("flag"))


def cell_number(raw: Column) -> Column:
    """The number of a printed cell, or null."""
    return clean_num(raw)["num"]


def parse_entry(text: Column) -> Column:
    """A number as typed into an entry grid; here a minus is a sign."""
    return as_decimal(strip(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))


def to_decimal(text: Column) -> Column:
    """A number in plain notation, null for blank or bad text."""
    return as_decimal(strip(text))


def to_year(text: Column) -> Column:
    """The first run of four digits as a number, or null."""
    return F.nullif(F.regexp_extract(text, "[0-9]{4}", 0), F.lit("")).cast("int")


def entity_key(name: Column) -> Column:
    """What labels are matched by: no leading numbering, letters only, lower case."""
    bare = F.regexp_replace(name, r"(?U)^\s*[0-9]+[.)]?\s*", "")
    return F.lower(F.regexp_replace(bare, "[^A-Za-z]", ""))


def is_grand_total(name: Column, phrase: str) -> Column:
    """Whether a label names the whole area (``phrase``, lower case), but not "... in ..." (dalam)."""
    plain = F.regexp_replace(F.lower(name), "[^a-z ]", " ")
    return ~F.contains(plain, F.lit("dalam")) & F.contains(plain, F.lit(phrase))


def norm_label(label: Column) -> Column:
    """A row label with one kind of dash and without scanning debris."""
    return strip(F.translate(label, "–—ûΓ", "---"))


def norm_indicator(name: Column) -> Column:
    """The key by which spellings of an indicator are one."""
    low = strip(F.lower(F.coalesce(name, F.lit(""))))
    return _one_spelling(low)


def bare_indicator(name: Column) -> Column:
    """``norm_indicator`` of a name that is stripped and not null."""
    return _one_spelling(F.lower(name))


def _one_spelling(low: Column) -> Column:
    # plain replacements are far cheaper than regular expressions, and single spaces don't match the one that is left
    put = lambda x, old, new: F.replace(x, F.lit(old), F.lit(new))
    spaced = F.regexp_replace(put(put(low, "–", "-"), "—", "-"), r"(?U)\s{2,}|[^\S ]", " ")
    return put(put(spaced, " /", "/"), "/ ", "/")


def region_kind(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("kabupaten") | low.contains("kota"), "kabupaten").when(low.contains("provinsi"), "provinsi").otherwise("kecamatan")


def clean_text(raw: Column) -> Column:
    """Text without one-character tokens, unless nothing else is there."""
    text = strip0(raw)
    long = F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda t: F.length(t) > 1), " ")
    return F.when(long == "", text).otherwise(long)


def format_id(value: Column) -> Column:
    """A decimal as 1.946.197 or 2.706,82; trailing zeros go, null is empty."""
    return F.coalesce(F.translate(F.call_function("format_number", value.cast(DECIMAL), F.lit("#,##0.####")), ",.", ".,"), F.lit(""))


def slug(text: Column, default: str = "data") -> Column:
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def cut(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def shown_cut(text: Column, n: int) -> Column:
    """At most n characters, the last of them an ellipsis where something was cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def caption(indicator: Column, year: Column, unit: Column) -> Column:
    with_year = F.concat(indicator, F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))
    u = strip0(unit)
    return F.concat(with_year, F.when(~u.isin("", "-"), F.concat(F.lit(" — "), u)).otherwise(""))


def display_cell(num: Column, text: Column, flag: Column) -> Column:
    """How a table shows a cell; a null flag is a cell that is not there."""
    return F.when(flag.isNull(), "·").when(flag == NIL, "–").when(flag == UNAVAILABLE, "…").when(num.isNotNull(), format_id(num)).otherwise(F.coalesce(text, F.lit("")))


def anomaly(flag: Column) -> Column:
    """The class by which a cell is marked: to check, or missing."""
    return F.when(flag == TO_CHECK, "check").when(flag.isin(NIL, UNAVAILABLE), "missing").otherwise("")


def display_name(short: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), title)


def subject(region: Column, category: Column) -> Column:
    return F.coalesce(region, category, F.lit("-"))


def unit_of(header: Column) -> Column:
    """The unit in a header: the rightmost bracket that says something."""
    inside = F.transform(F.regexp_extract_all(header, F.lit(r"\(([^)]*)\)"), F.lit(1)), strip)
    real = F.filter(F.reverse(inside), lambda p: ~p.isin("", "1", "2", "3", "4", "5", "6"))
    first = F.transform(real, lambda p: strip(F.regexp_replace(strip(F.split(p, "/")[0]), r"[a-z]\.[a-z].*", "")))
    return F.coalesce(F.get(F.filter(first, lambda p: p != ""), F.lit(0)), F.lit(""))


# English words that begin a translation after a slash.
ENGLISH_HEADERS = ("Teachers", "Public", "Private", "Total", "Schools", "Pupils", "Male", "Female")


def column_name(header: Column, english: tuple[str, ...] = ENGLISH_HEADERS) -> Column:
    """A header without brackets and without a translation after a slash."""
    bare = F.regexp_replace(header, r"\([^)]*\)", "")
    bare = F.regexp_replace(bare, rf"(?i)/\s*(?:{'|'.join(english)}).*$", "")
    return strip(F.btrim(squeeze(bare), F.lit(" /")))


def only_years(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[\s/\-–—]", "").rlike(r"^(?:(?:19|20)[0-9]{2})+$")


def without_years(text: Column) -> Column:
    """A header line without the years that end it."""
    return strip(F.regexp_replace(text, r"(?U)\s+(?:(?:19|20)[0-9]{2}(?:[/\-–—](?:19|20)[0-9]{2})?\s*)+$", ""))


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, "(?:19|20)[0-9]{2}", 0)


def legacy_label(label: Column, keep_code: bool = False) -> Column:
    """A row label without the digits and dots that lead it."""
    return strip(label if keep_code else F.regexp_replace(label, r"(?U)^[0-9.\s]+", ""))


def title_indicator(title: Column) -> Column:
    """What a table is about: the words before "Menurut", at most 120 characters."""
    return F.substring(F.rtrim(strip(F.split(F.coalesce(title, F.lit("")), r"\bMenurut\b", 2)[0]), F.lit(",")), 1, 120)
