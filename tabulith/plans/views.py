"""The library's inputs, derived from the driver's tables, and the same constructions in SQL.

Every view covers its whole base table. ``SQL[name]`` is the body of a common table expression; a
query's SQL names the views it needs with ``with_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _printed(cents: Column) -> Column:
    """Cents as a printed number, 123.456,78."""
    whole = F.translate(F.format_number(F.floor(cents / 100).cast("long"), 0), ",", ".")
    return F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed prices of line items with damage by key: one cell a line item."""
    li = read(spark, sf_dir, "lineitem")
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 16
    t = _printed(F.round(F.col("l_extendedprice") * 100).cast("long"))
    damage = (
        F.when(m == 0, "...").when(m == 1, "-").when(m == 2, "").when(m == 3, F.concat(F.lit("("), t, F.lit(")"))).when(m == 4, "1,2,3").when(m == 5, "12 ...").when(m == 6, "–").when(m == 7, "..")
        .when(m == 8, "…").when(m == 9, F.concat(F.lit("  "), t, F.lit(" "))).when(m == 10, F.concat(F.lit("-"), t)).when(m == 11, "Kota-kota").when(m == 12, F.lit(None)).otherwise(t)
    )
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell_id"), F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("position"), damage.alias("raw"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with changes of case, spacing, dashes, brackets and years by key."""
    n, m = F.col("p_name"), F.col("p_partkey") % 10
    changed = (
        F.when(m == 0, F.upper(n)).when(m == 1, F.replace(n, F.lit(" "), F.lit("   "))).when(m == 2, F.concat(F.lit("  "), n, F.lit(" / desa "))).when(m == 3, F.concat(n, F.lit(" – a"))).when(m == 4, F.concat(n, F.lit(" (km2/sq.km) (1)")))
        .when(m == 5, F.concat(n, F.lit("/Total "), n)).when(m == 6, F.concat(n, F.lit(" 2019/2020"))).when(m == 7, F.concat(F.lit("12. "), n)).when(m == 8, F.concat(F.lit("Kota "), n, F.lit(" Menurut Kecamatan"))).otherwise(n)
    )
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name_id"), changed.alias("name"), n.alias("original"), F.col("p_size").alias("size"))


def long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange rows, all text but the sequence: one a line item, of its supplier's nation and region.

    A few share a key, some have no table number, no year or no category; spellings of indicators vary.
    """
    li = read(spark, sf_dir, "lineitem")
    nation = read(spark, sf_dir, "nation").select(
        "n_nationkey", "n_regionkey",
        F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"), F.lit(".1")).alias("number"),
        F.concat(F.lit("Tabel "), F.col("n_name"), F.lit(" Menurut Kecamatan")).alias("title"),
        F.concat(F.lit("Table "), F.col("n_name")).alias("title_en"),
        F.concat(F.lit("Kabupaten "), F.col("n_name")).alias("whole"),
    )
    # each small table joins by itself: their own join would count as the product of their sizes, and line items be shuffled for it
    j = li.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    indicator = F.when(ln % 4 == 0, F.when(k % 2 == 0, "Luas - Panen").otherwise("luas – panen")).when(ln % 4 == 1, "Produksi").when(ln % 4 == 2, F.when(k % 3 == 0, "Jumlah Desa / Kota").otherwise("Jumlah Desa/Kota")).otherwise("Rata  Rata")
    return j.select(
        (((k * 10 + ln) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("_seq"),
        F.col("r_name").alias("chapter"),
        F.when(k % 97 == 0, "  ").otherwise(F.col("number")).alias("table_no"),
        "title",
        "title_en",
        F.when(k % 13 == 0, F.col("whole")).when(k % 29 == 0, "").otherwise(F.col("s_name")).alias("region"),
        F.when(ln % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("category"),
        F.lit("Status").alias("category_group"),
        indicator.alias("indicator"),
        F.when(ln % 2 == 0, "ton").otherwise("ha").alias("unit"),
        F.when(k % 11 == 0, "").when(k % 7 == 0, F.concat(F.year("l_shipdate").cast("string"), F.lit("/"), (F.year("l_shipdate") + 1).cast("string"))).otherwise(F.year("l_shipdate").cast("string")).alias("year"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, "n.a.").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value_num"),
        F.when(k % 17 == 0, "-").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("value_text"),
        F.when(k % 17 == 0, "nihil").when(k % 23 == 0, "").when(k % 31 == 0, "perlu_cek").otherwise("ada").alias("flag"),
        F.lit("BPS").alias("source"),
    )


def page_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents, from conversations: number and continuation by turn and role."""
    c, t = F.col("conv_id"), F.col("turn")
    return read(spark, sf_dir, "conversations").select(
        c.alias("doc_id"),
        t.alias("page_no"),
        ((F.col("role") == "assistant") & (c % 3 != 0)).alias("continued"),
        F.when((c + t) % 5 == 0, "").otherwise(F.concat((c % 9 + 1).cast("string"), F.lit("."), (F.floor(t / 2) % 3 + 1).cast("string"))).alias("table_no"),
        F.col("text"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversation turns laid out on pages: eight to a line, with uneven tops."""
    # a small file of texts makes many glyphs: pages are dealt out before they are taken apart, and stay where they are after
    pages = read(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text").repartition("doc_id", "page_no")
    src = pages.select("doc_id", "page_no", F.posexplode(F.split(F.col("text"), r"[ \n]+")).alias("seq", "text"))
    p, col = F.col("seq"), F.col("seq") % 8
    x0 = F.lit(40.0) + col * 60.0
    top = F.lit(20.0) + F.floor(p / 8) * 12.0 + (p * 7 % 5) * 0.5
    return src.where("text <> ''").select(
        "doc_id", "page_no", "seq", "text", x0.cast("double").alias("x0"), (x0 + F.least(F.length("text"), F.lit(12)) * 4.5).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 9.0).cast("double").alias("bottom"),
        F.when((p * 5 + F.col("page_no")) % 7 == 0, "Myriad-It").otherwise("Myriad-Regular").alias("fontname"),
        F.when(p % 11 == 0, "x").when(p % 13 == 0, "-1").otherwise(((p * 37 + F.col("page_no")) % 100).cast("string")).alias("conf"),
    )


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of those words; every sixth word is printed twice (fake bold), some are rotated or black."""
    w = words(spark, sf_dir)
    each = w.select("doc_id", "page_no", "seq", "x0", "top", "bottom", "fontname", F.posexplode(F.split("text", "")).alias("k", "text")).withColumn("twice", F.explode(F.when(F.col("seq") % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    x0 = F.col("x0") + F.col("k") * 4.5 + F.col("twice") * 0.5
    return each.where("text <> ''").select(
        "doc_id", "page_no", ((F.col("seq") * 1000 + F.col("k")) * 2 + F.col("twice")).cast("long").alias("seq"), "text", x0.alias("x0"), (x0 + 4.25).alias("x1"), "top", "bottom",
        (F.lit(8.0) + F.col("seq") % 3).cast("double").alias("size"), "fontname",
        F.array(F.lit(1.0), F.when(F.col("seq") % 11 == 0, 0.5).otherwise(0.0), F.lit(0.0), F.lit(1.0)).alias("matrix"),
        F.when(F.col("seq") % 10 == 0, F.array(F.lit(0.0), F.lit(0.01))).when(F.col("seq") % 10 == 1, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), F.lit(0.0))).alias("color"),
    )


def rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, edges) drawn on pages: cells on even pages, one long edge on every third."""
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no")).distinct()
    cells = pages.where("page_no % 2 = 0").withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        "doc_id", "page_no", F.lit(0).alias("table_id"), "ordinal", (F.lit(38.0) + F.col("ordinal") * 60.0).alias("x0"), F.lit(24.0).alias("top"), (F.lit(98.0) + F.col("ordinal") * 60.0).alias("x1"), F.lit(50.0).alias("bottom")
    )
    edges = pages.where("page_no % 3 = 0").select("doc_id", "page_no", F.lit(38.0).alias("x0"), F.lit(518.0).alias("x1"), (F.lit(24.0) + F.col("page_no") % 4).cast("double").alias("top"), (F.lit(24.0) + F.col("page_no") % 4).cast("double").alias("bottom"))
    return cells, edges


def printed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(glyphs, words, rule cells, rule edges) of a table a nation, of two columns, with a row a supplier.

    Rows of odd suppliers and the total are on a second page, which continues the first.
    """
    nation, supplier = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    pages = nation.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    key = [F.col("n_regionkey").cast("long").alias("doc_id"), (F.col("n_nationkey") * 2 + F.col("part")).cast("long").alias("page_no")]
    number = F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), (F.col("n_nationkey") + 1).cast("string"))
    cents = F.abs(F.round(F.col("s_acctbal") * 100)).cast("long")
    rows = supplier.select(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 2).cast("int").alias("odd"), F.col("s_suppkey").alias("order"), F.col("s_name").alias("label"), cents.alias("v1"), (F.col("s_suppkey") + 1).alias("v2"))
    sums = rows.groupBy("n").agg(F.lit(1).alias("odd"), F.lit(1 << 60).alias("order"), F.lit("Kabupaten").alias("label"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    at = F.row_number().over(Window.partitionBy("n", "odd").orderBy("order"))
    lines = rows.unionByName(sums).withColumn("line", at)
    heights = lines.groupBy(F.col("n").alias("hn"), F.col("odd").alias("hodd")).agg(F.max("line").alias("last"))

    word = lambda text, x, top: F.struct((text if not isinstance(text, str) else F.lit(text)).alias("text"), F.lit(float(x)).alias("x0"), (top if not isinstance(top, (int, float)) else F.lit(float(top))).cast("double").alias("top"))
    foot = F.lit(146.0) + F.coalesce("last", F.lit(0)) * 12
    fixed = [word(F.col("r_name"), 40, 20), word("Tabel", 60, 60), word("Jumlah", 110, 60), word("Pemasok", 150, 60), word(F.col("n_name"), 190, 60), word("Nama", 60, 96), word("Saldo", 230, 96), word("(juta)", 256, 96), word("Kode", 400, 96), word("(1)", 100, 114), word("(2)", 260, 114), word("(3)", 420, 114), word("Sumber/Source:", 45, foot), word("BPS", 120, foot)]
    opening = F.when(F.col("part") == 0, F.array(word(number, 80, 45))).otherwise(F.array(word("Lanjutan", 60, 45), word("Tabel", 105, 45), word(number, 140, 45)))
    said = pages.join(heights, (F.col("n_nationkey") == F.col("hn")) & (F.col("part") == F.col("hodd")), "left").select(*key, F.explode(F.concat(F.array(*fixed), opening)).alias("w"))
    top = F.lit(122.0) + F.col("line") * 12
    told = lines.join(nation, F.col("n") == F.col("n_nationkey")).withColumn("part", F.col("odd")).select(*key, F.explode(F.array(word(F.col("label"), 45, top), word(_printed(F.col("v1")), 210, top), word(F.col("v2").cast("string"), 370, top))).alias("w"))
    words = said.unionByName(told).select("doc_id", "page_no", (F.col("w.top") * 1000 + F.col("w.x0")).cast("long").alias("seq"), "w.text", "w.x0", (F.col("w.x0") + F.length("w.text") * 4.5 - 0.25).alias("x1"), "w.top", (F.col("w.top") + 9).alias("bottom"), F.lit("Myriad-Regular").alias("fontname"))
    each = words.select("doc_id", "page_no", "seq", "x0", "top", "bottom", "fontname", F.posexplode(F.split("text", "")).alias("k", "text")).where("text <> ''")
    leaning = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    glyphs = each.select("doc_id", "page_no", (F.col("seq") * 1000 + F.col("k")).alias("seq"), "text", (F.col("x0") + F.col("k") * 4.5).alias("x0"), (F.col("x0") + F.col("k") * 4.5 + 4.25).alias("x1"), "top", "bottom", F.lit(8.0).alias("size"), "fontname", leaning.alias("matrix"))
    every = pages.select(*key)
    cells = every.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", "page_no", F.lit(0).alias("table_id"), "ordinal", (F.lit(40.0) + F.col("ordinal") * 160.0).alias("x0"), F.lit(90.0).alias("top"), (F.lit(200.0) + F.col("ordinal") * 160.0).alias("x1"), F.lit(110.0).alias("bottom"))
    edges = every.select("doc_id", "page_no", F.lit(40.0).alias("x0"), F.lit(520.0).alias("x1"), F.lit(90.0).alias("top"), F.lit(90.0).alias("bottom"))
    return glyphs, words, cells, edges


_PRINTED = "replace(format('{:,}', (c // 100)::BIGINT), ',', '.') || ',' || lpad((c % 100)::VARCHAR, 2, '0')"

SQL = {
    "raw_cells": f"""
SELECT l_orderkey * 10 + l_linenumber AS cell_id, l_orderkey AS row_id, l_linenumber AS position,
       CASE m WHEN 0 THEN '...' WHEN 1 THEN '-' WHEN 2 THEN '' WHEN 3 THEN '(' || t || ')' WHEN 4 THEN '1,2,3' WHEN 5 THEN '12 ...' WHEN 6 THEN '–' WHEN 7 THEN '..' WHEN 8 THEN '…'
              WHEN 9 THEN '  ' || t || ' ' WHEN 10 THEN '-' || t WHEN 11 THEN 'Kota-kota' WHEN 12 THEN NULL ELSE t END AS raw
FROM (SELECT *, {_PRINTED} AS t FROM (SELECT l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 16 AS m, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem))""",
    "names": """
SELECT p_partkey AS name_id, CASE p_partkey % 10 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '   ') WHEN 2 THEN '  ' || p_name || ' / desa ' WHEN 3 THEN p_name || ' – a' WHEN 4 THEN p_name || ' (km2/sq.km) (1)'
       WHEN 5 THEN p_name || '/Total ' || p_name WHEN 6 THEN p_name || ' 2019/2020' WHEN 7 THEN '12. ' || p_name WHEN 8 THEN 'Kota ' || p_name || ' Menurut Kecamatan' ELSE p_name END AS name, p_name AS original, p_size AS size
FROM part""",
    "long_rows": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS _seq, r_name AS chapter,
       CASE WHEN l_orderkey % 97 = 0 THEN '  ' ELSE (r_regionkey + 1)::VARCHAR || '.' || (n_nationkey + 1)::VARCHAR || '.1' END AS table_no,
       'Tabel ' || n_name || ' Menurut Kecamatan' AS title, 'Table ' || n_name AS title_en,
       CASE WHEN l_orderkey % 13 = 0 THEN 'Kabupaten ' || n_name WHEN l_orderkey % 29 = 0 THEN '' ELSE s_name END AS region,
       CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END AS category, 'Status' AS category_group,
       CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'Luas - Panen' ELSE 'luas – panen' END WHEN 1 THEN 'Produksi'
            WHEN 2 THEN CASE WHEN l_orderkey % 3 = 0 THEN 'Jumlah Desa / Kota' ELSE 'Jumlah Desa/Kota' END ELSE 'Rata  Rata' END AS indicator,
       CASE WHEN l_linenumber % 2 = 0 THEN 'ton' ELSE 'ha' END AS unit,
       CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN year(l_shipdate)::VARCHAR || '/' || (year(l_shipdate) + 1)::VARCHAR ELSE year(l_shipdate)::VARCHAR END AS year,
       CASE WHEN l_orderkey % 17 = 0 THEN '' WHEN l_orderkey % 19 = 0 THEN 'n.a.' ELSE l_quantity::INT::VARCHAR END AS value_num,
       CASE WHEN l_orderkey % 17 = 0 THEN '-' ELSE l_quantity::INT::VARCHAR END AS value_text,
       CASE WHEN l_orderkey % 17 = 0 THEN 'nihil' WHEN l_orderkey % 23 = 0 THEN '' WHEN l_orderkey % 31 = 0 THEN 'perlu_cek' ELSE 'ada' END AS flag, 'BPS' AS source
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "page_seq": """
SELECT conv_id AS doc_id, turn AS page_no, role = 'assistant' AND conv_id % 3 <> 0 AS continued,
       CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE (conv_id % 9 + 1)::VARCHAR || '.' || ((turn // 2) % 3 + 1)::VARCHAR END AS table_no, text
FROM conversations""",
    "words": """
SELECT doc_id, page_no, seq, text, x0, x0 + least(length(text), 12) * 4.5::DOUBLE AS x1, top, top + 9 AS bottom, fontname, conf
FROM (SELECT doc_id, page_no, p AS seq, parts[p + 1] AS text, 40::DOUBLE + (p % 8) * 60 AS x0, 20::DOUBLE + (p // 8) * 12 + (p * 7 % 5) * 0.5::DOUBLE AS top,
             CASE WHEN (p * 5 + page_no) % 7 = 0 THEN 'Myriad-It' ELSE 'Myriad-Regular' END AS fontname,
             CASE WHEN p % 11 = 0 THEN 'x' WHEN p % 13 = 0 THEN '-1' ELSE ((p * 37 + page_no) % 100)::VARCHAR END AS conf
      FROM (SELECT doc_id, page_no, parts, unnest(range(0, len(parts))) AS p FROM (SELECT conv_id AS doc_id, turn AS page_no, string_split_regex(text, '[ \\n]+') AS parts FROM conversations WHERE text IS NOT NULL)))
WHERE text <> ''""",
    "glyphs": """
SELECT doc_id, page_no, (seq * 1000 + k) * 2 + twice AS seq, c AS text, x0 + k * 4.5::DOUBLE + twice * 0.5::DOUBLE AS x0, x0 + k * 4.5::DOUBLE + twice * 0.5::DOUBLE + 4.25::DOUBLE AS x1, top, bottom,
       8::DOUBLE + seq % 3 AS size, fontname, [1::DOUBLE, CASE WHEN seq % 11 = 0 THEN 0.5 ELSE 0 END::DOUBLE, 0::DOUBLE, 1::DOUBLE] AS matrix,
       CASE WHEN seq % 10 = 0 THEN [0::DOUBLE, 0.01::DOUBLE] WHEN seq % 10 = 1 THEN []::DOUBLE[] ELSE [0.5::DOUBLE, 0::DOUBLE] END AS color
FROM (SELECT *, unnest(CASE WHEN seq % 6 = 0 THEN [0, 1] ELSE [0] END) AS twice, text[k + 1] AS c FROM (SELECT *, unnest(range(0, length(text))) AS k FROM words))""",
    "rule_cells": "SELECT doc_id, page_no, 0 AS table_id, o AS ordinal, 38::DOUBLE + o * 60 AS x0, 24::DOUBLE AS top, 98::DOUBLE + o * 60 AS x1, 50::DOUBLE AS bottom FROM (SELECT doc_id, page_no, unnest(range(0, 8)) AS o FROM (SELECT DISTINCT conv_id AS doc_id, turn AS page_no FROM conversations WHERE turn % 2 = 0))",
    "rule_edges": "SELECT doc_id, page_no, 38::DOUBLE AS x0, 518::DOUBLE AS x1, (24 + page_no % 4)::DOUBLE AS top, (24 + page_no % 4)::DOUBLE AS bottom FROM (SELECT DISTINCT conv_id AS doc_id, turn AS page_no FROM conversations WHERE turn % 3 = 0)",
}
_NEEDS = {"glyphs": ["words"]}


def with_views(names: str, body: str, /, **more: str) -> str:
    """``body`` after the views it needs, then further expressions in their order."""
    order: list[str] = []
    for n in names.split():
        order += [k for k in [*_NEEDS.get(n, []), n] if k not in order]
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages: text with column numbers and notes among it, a label, and two cells, by key."""
    w = read(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.posexplode(F.split("text", " ")).alias("i", "word"))
    m = F.col("doc_id") * 3 + F.col("page_no") + F.col("i")
    label = F.when(m % 5 == 0, "").when(m % 13 == 0, "Kabupaten Tasikmalaya").when(m % 17 == 0, "SubCowville").when(m % 19 == 0, "12. subfjdville").when(m % 23 == 0, "Ve–tnam").otherwise(F.col("word"))
    value = F.when(m % 4 == 0, "").when(m % 6 == 1, "–").otherwise(m.cast("string"))
    return w.select(
        "doc_id", "page_no", (F.lit(100.0) + F.col("i") * 12.5).alias("line_top"), (m % 7).cast("long").alias("n"), label.alias("label"),
        F.when(m % 31 == 3, "(1) (2)(3)").when(m % 37 == 5, "Sumber/Source: BPS").when(m % 29 == 7, "see (4) here").otherwise(F.col("word")).alias("text"), F.array(label, value, F.lit("")).alias("cols"),
    )


SQL["lines"] = """
SELECT doc_id, page_no, 100::DOUBLE + i * 12.5 AS line_top, m % 7 AS n, label,
       CASE WHEN m % 31 = 3 THEN '(1) (2)(3)' WHEN m % 37 = 5 THEN 'Sumber/Source: BPS' WHEN m % 29 = 7 THEN 'see (4) here' ELSE word END AS text,
       [label, CASE WHEN m % 4 = 0 THEN '' WHEN m % 6 = 1 THEN '–' ELSE m::VARCHAR END, ''] AS cols
FROM (SELECT *, CASE WHEN m % 5 = 0 THEN '' WHEN m % 13 = 0 THEN 'Kabupaten Tasikmalaya' WHEN m % 17 = 0 THEN 'SubCowville' WHEN m % 19 = 0 THEN '12. subfjdville' WHEN m % 23 = 0 THEN 'Ve–tnam' ELSE word END AS label
      FROM (SELECT doc_id, page_no, i, p[i + 1] AS word, doc_id * 3 + page_no + i AS m
            FROM (SELECT doc_id, page_no, p, unnest(range(0, len(p))) AS i FROM (SELECT conv_id AS doc_id, turn AS page_no, string_split(text, ' ') AS p FROM conversations WHERE text IS NOT NULL))))"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master list with spelt names, one a nation."""
    k = F.col("n_nationkey")
    name = F.concat(F.lit("Sub"), F.char(F.lit(65) + k), F.char(F.lit(97) + k * 7 % 26), F.char(F.lit(97) + k * 11 % 26), F.lit("ville"))
    return read(spark, sf_dir, "nation").select(k.alias("entity_id"), name.alias("entity"))


SQL["entities"] = "SELECT n_nationkey AS entity_id, 'Sub' || chr(65 + n_nationkey) || chr(97 + n_nationkey * 7 % 26) || chr(97 + n_nationkey * 11 % 26) || 'ville' AS entity FROM nation"
