"""Queries over the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import views as v


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    """A subquery's columns num, text and flag from the text column x."""
    t = sql_strip(f"coalesce({x}, '')")
    keep = f"regexp_replace({t}, '[^0-9,.\\-–—]', '', 'g')"
    num = f"try_cast(replace(replace(regexp_replace({keep}, '[\\-–—]', '', 'g'), '.', ''), ',', '.') AS DECIMAL(24,4))"
    flag = f"CASE WHEN contains({t}, '...') OR {t} IN ('..', '…') THEN 'tidak_tersedia' WHEN NOT regexp_matches({keep}, '[0-9]') AND regexp_matches({keep}, '[\\-–—]') THEN 'nihil' WHEN NOT regexp_matches({keep}, '[0-9]') THEN 'tidak_tersedia' WHEN {num} IS NULL THEN 'perlu_cek' ELSE 'ada' END"
    return f"CASE WHEN {flag} = 'ada' THEN CASE WHEN {t} LIKE '(%)' THEN -{num} ELSE {num} END END AS num, {t} AS text, {flag} AS flag"


def sql_format_id(x: str) -> str:
    whole = f"replace(format('{{:,}}', trunc(abs({x}))::BIGINT), ',', '.')"
    part = f"rtrim(lpad(((abs({x}) - trunc(abs({x}))) * 10000)::BIGINT::VARCHAR, 4, '0'), '0')"
    return f"CASE WHEN {x} IS NULL THEN '' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || {whole} || CASE WHEN {part} = '' THEN '' ELSE ',' || {part} END END"


def sql_norm_indicator(x: str) -> str:
    return rf"regexp_replace(regexp_replace(translate({sql_strip(f'lower(coalesce({x}, {chr(39)}{chr(39)}))')}, '–—', '--'), '\s*/\s*', '/', 'g'), '\s+', ' ', 'g')"


def sql_region_kind(x: str) -> str:
    return f"CASE WHEN contains(lower({x}), 'kabupaten') OR contains(lower({x}), 'kota') THEN 'kabupaten' WHEN contains(lower({x}), 'provinsi') THEN 'provinsi' ELSE 'kecamatan' END"


def sql_key(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace({x}, '^\s*[0-9]+[.)]?\s*', ''), '[^A-Za-z]', '', 'g'))"


def e01_clean_num(spark, d) -> DataFrame:
    return v.raw_cells(spark, d).select("cell_id", s.clean_num(F.col("raw")).alias("c")).select("cell_id", "c.*")


def e02_e05_parsers(spark, d) -> DataFrame:
    c = v.raw_cells(spark, d)
    text = F.col("raw")
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return c.select("cell_id", s.parse_entry(text).alias("entry"), s.cell_number(text).alias("number"), s.to_decimal(plain).alias("dec"), s.to_year(text).alias("first4"))


def e08_e12_labels(spark, d) -> DataFrame:
    n = F.col("name")
    return v.names(spark, d).select(
        "name_id", s.is_grand_total(n, "kota").alias("is_total"), s.norm_label(n).alias("label"), s.norm_indicator(n).alias("indicator_key"), s.region_kind(n).alias("kind"), s.clean_text(n).alias("cleaned"), s.entity_key(n).alias("entity_key")
    )


def e13_format(spark, d) -> DataFrame:
    li = v.read(spark, d, "lineitem")
    value = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_extendedprice").cast("decimal(24,4)") * F.when(F.col("l_linenumber") == 3, -1).otherwise(1)).cast("decimal(24,4)")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), s.format_id(value).alias("shown"), s.format_id(F.col("l_quantity").cast("decimal(24,4)")).alias("quantity"))


def e14_e18_names(spark, d) -> DataFrame:
    n, size = F.col("name"), F.col("size")
    year = F.when(size % 2 == 0, 2000 + size)
    return v.names(spark, d).select(
        "name_id", s.slug(n).alias("slug"), s.slug(F.lit("!!")).alias("slug_default"), s.cut(n, 8).alias("cut8"), s.shown_cut(n, 10).alias("shown10"), s.caption(n, year, F.when(size % 3 == 0, "-").when(size % 3 == 1, " ton ").otherwise("")).alias("caption"),
        s.display_name(F.when(size % 4 == 0, "").when(size % 4 == 1, "short"), n).alias("display_name"), s.subject(F.when(size % 5 == 0, n), F.when(size % 5 == 1, F.col("original"))).alias("subject"),
    )


def e17_display(spark, d) -> DataFrame:
    c = v.raw_cells(spark, d).select("cell_id", F.when(F.col("cell_id") % 41 > 0, s.clean_num(F.col("raw"))).alias("c"))
    return c.select("cell_id", s.display_cell(F.col("c.num"), F.col("c.text"), F.col("c.flag")).alias("shown"), s.anomaly(F.col("c.flag")).alias("mark"))


def c07_c09_headers(spark, d) -> DataFrame:
    n = F.col("name")
    clean = s.column_name(n)
    return v.names(spark, d).select("name_id", s.unit_of(n).alias("unit"), clean.alias("clean"), s.without_years(clean).alias("no_years"), s.first_year(clean).alias("year"), s.only_years(F.regexp_extract(n, "[0-9/ ]+$", 0)).alias("years_only"))


def d13_e19_titles(spark, d) -> DataFrame:
    n = F.col("name")
    return v.names(spark, d).select("name_id", s.title_indicator(n).alias("about"), s.strip0(F.when(F.col("size") > 20, n)).alias("stripped"), s.legacy_label(n).alias("legacy"), s.legacy_label(n, keep_code=True).alias("legacy_code"))


QUERIES = {f.__name__: f for f in (e01_clean_num, e02_e05_parsers, e08_e12_labels, e13_format, e14_e18_names, e17_display, c07_c09_headers, d13_e19_titles)}

_clean_name = rf"regexp_replace({sql_strip(rf'''regexp_replace(regexp_replace(regexp_replace(name, '\([^)]*\)', '', 'g'), '(?i)/\s*(?:{'|'.join(s.ENGLISH_HEADERS)}).*$', ''), '\s+', ' ', 'g')''')}, '^[ /]+|[ /]+$', '', 'g')"
SQL = {
    "e01_clean_num": v.with_views("raw_cells", f"SELECT cell_id, {sql_clean('raw')} FROM raw_cells"),
    "e02_e05_parsers": v.with_views(
        "raw_cells",
        rf"""SELECT cell_id, CASE WHEN regexp_matches(p, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN try_cast(p AS DECIMAL(24,4)) END AS entry, num AS number,
        CASE WHEN regexp_matches(p, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$') THEN try_cast(p AS DECIMAL(24,4)) END AS dec, nullif(regexp_extract(raw, '[0-9]{{4}}'), '')::INT AS first4
        FROM (SELECT cell_id, raw, {sql_strip("replace(replace(raw, '.', ''), ',', '.')")} AS p, {sql_clean('raw')} FROM raw_cells)""",
    ),
    "e08_e12_labels": v.with_views(
        "names",
        rf"""SELECT name_id, NOT contains(q, 'dalam') AND contains(q, 'kota') AS is_total, {sql_strip("translate(name, '–—û', '---')")} AS label, {sql_norm_indicator('name')} AS indicator_key, {sql_region_kind('name')} AS kind,
        CASE WHEN len(list_filter(toks, lambda x: length(x) > 1)) = 0 THEN {sql_strip('name')} ELSE array_to_string(list_filter(toks, lambda x: length(x) > 1), ' ') END AS cleaned, {sql_key('name')} AS entity_key
        FROM (SELECT *, regexp_replace(lower(name), '[^a-z ]', ' ', 'g') AS q, string_split_regex({sql_strip('name')}, '\s+') AS toks FROM names)""",
    ),
    "e13_format": f"SELECT l_orderkey AS k, l_linenumber AS ln, {sql_format_id('x')} AS shown, {sql_format_id('q')} AS quantity FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 7 THEN NULL WHEN 3 THEN -(l_extendedprice::DECIMAL(24,4)) ELSE l_extendedprice::DECIMAL(24,4) END AS x, l_quantity::DECIMAL(24,4) AS q FROM lineitem)",
    "e14_e18_names": v.with_views(
        "names",
        rf"""SELECT name_id, coalesce(nullif(lower(regexp_replace(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'data') AS slug, 'data' AS slug_default, left(name, 8) AS cut8,
        CASE WHEN length(name) > 10 THEN left(name, 9) || '…' ELSE name END AS shown10,
        name || CASE WHEN size % 2 = 0 THEN ' (' || (2000 + size)::VARCHAR || ')' ELSE '' END || CASE WHEN size % 3 = 1 THEN ' — ton' ELSE '' END AS caption,
        CASE WHEN size % 4 = 1 THEN 'short' ELSE name END AS display_name, CASE size % 5 WHEN 0 THEN name WHEN 1 THEN original ELSE '-' END AS subject FROM names""",
    ),
    "e17_display": v.with_views(
        "raw_cells",
        f"""SELECT cell_id, CASE WHEN cell_id % 41 = 0 THEN '·' WHEN flag = 'nihil' THEN '–' WHEN flag = 'tidak_tersedia' THEN '…' WHEN num IS NOT NULL THEN {sql_format_id('num')} ELSE text END AS shown,
        CASE WHEN cell_id % 41 = 0 THEN '' WHEN flag = 'perlu_cek' THEN 'check' WHEN flag IN ('nihil', 'tidak_tersedia') THEN 'missing' ELSE '' END AS mark FROM (SELECT cell_id, {sql_clean('raw')} FROM raw_cells)""",
    ),
    "c07_c09_headers": v.with_views(
        "names",
        rf"""SELECT name_id, coalesce(list_filter(list_transform(list_filter(list_reverse(regexp_extract_all(name, '\(([^)]*)\)', 1)), lambda p: trim(p) NOT IN ('', '1', '2', '3', '4', '5', '6')), lambda p: trim(regexp_replace(trim(string_split(p, '/')[1]), '[a-z]\.[a-z].*', ''))), lambda p: p <> '')[1], '') AS unit,
        clean, {sql_strip(r"regexp_replace(clean, '\s+(?:(?:19|20)[0-9]{2}(?:[/\-–—](?:19|20)[0-9]{2})?\s*)+$', '')")} AS no_years, regexp_extract(clean, '(?:19|20)[0-9]{{2}}') AS year,
        regexp_full_match(regexp_replace(regexp_extract(name, '[0-9/ ]+$'), '[\s/\-–—]', '', 'g'), '(?:(?:19|20)[0-9]{{2}})+') AS years_only FROM (SELECT *, {_clean_name} AS clean FROM names)""",
    ),
    "d13_e19_titles": v.with_views(
        "names",
        rf"""SELECT name_id, left(rtrim({sql_strip("string_split(name, 'Menurut')[1]")}, ','), 120) AS about, CASE WHEN size > 20 THEN {sql_strip('name')} ELSE '' END AS stripped,
        {sql_strip(r"regexp_replace(name, '^[0-9.\s]+', '')")} AS legacy, {sql_strip('name')} AS legacy_code FROM names""",
    ),
}
