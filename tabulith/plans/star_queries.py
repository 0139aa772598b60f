"""Queries over checks, loading and reading, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.stages import shared_dir, stage
from ..operators import validate as k
from ..sources import long_csv
from . import extract
from . import ingest as g
from . import reads as r
from . import search_index, store
from . import views as v
from .scalar_queries import sql_clean, sql_format_id, sql_norm_indicator, sql_region_kind

NAME, YEAR, PHRASE = "Dalam Angka", 2024, "kabupaten"


# --- checks ---------------------------------------------------------------------------------------
def _cells(spark, d) -> DataFrame:
    """Orders' cells in tables of about a hundred rows; the total row is the first order of a table."""
    c = v.raw_cells(spark, d).select((F.col("row_id") % 150).alias("t"), F.col("row_id").alias("row"), "position", (F.floor(F.col("row_id") / 150) == 1).alias("is_total"), "cell_id", s.clean_num(F.col("raw")).alias("c"))
    sums = c.groupBy("t", "position").agg(F.sum(F.when(~F.col("is_total"), F.col("c.num"))).alias("s"))
    j = c.join(sums, ["t", "position"])
    num = F.when(F.col("is_total") & (F.col("t") % 3 > 0), (F.col("s") + F.when(F.col("t") % 3 == 1, F.col("t")).otherwise(0)).cast(s.DECIMAL)).otherwise(F.col("c.num"))
    flag = F.when(F.col("is_total") & (F.col("t") % 3 > 0), s.PRESENT).otherwise(F.col("c.flag"))
    return j.select("t", "row", "position", "is_total", "cell_id", F.col("c.text").alias("text"), num.alias("num"), flag.alias("flag"))


def _gappy(spark, d) -> DataFrame:
    """The same with all gaps but one of a column filled by 1, so that repair applies."""
    c = _cells(spark, d)
    from pyspark.sql.window import Window

    gap = F.col("flag").isin(*k.GAPS) & ~F.col("is_total")
    n = F.sum(gap.cast("int")).over(Window.partitionBy("t", "position").orderBy("row", "cell_id"))
    fill = gap & (n > 1 + F.col("t") % 2)
    return c.withColumn("fill", fill).select("t", "row", "position", "is_total", "cell_id", "text", F.when(F.col("fill"), F.lit(1).cast(s.DECIMAL)).otherwise(F.col("num")).alias("num"), F.when(F.col("fill"), s.PRESENT).otherwise(F.col("flag")).alias("flag"))


def f01_totals(spark, d) -> DataFrame:
    return k.check_columns(_cells(spark, d), ["t"])


def f01_tables(spark, d) -> DataFrame:
    return k.check_tables(_cells(spark, d), ["t"])


def f02_repair(spark, d) -> DataFrame:
    return k.repair_gaps(_gappy(spark, d), ["t"]).select("t", "row", "position", "cell_id", "text", "num", "flag")


def f03_strict_totals(spark, d) -> DataFrame:
    return k.check_columns(_cells(spark, d), ["t"], share=0.0, least=0.01)


def f04_flags(spark, d) -> DataFrame:
    return k.flag_histogram(_cells(spark, d))


def f06_duplicates(spark, d) -> DataFrame:
    return k.duplicate_keys(v.long_rows(spark, d), ["table_no", "region", "year", "category"])


def f07_audit(spark, d) -> DataFrame:
    rows = g.prepare(v.long_rows(spark, d).withColumn("flag", F.when(F.col("_seq") % 37 == 0, "lain").otherwise(F.col("flag"))), NAME, YEAR)
    bad = k.outside_choices(rows, "flag", "flag").select("_seq", F.lit("flag").alias("fault"))
    chapters = v.read(spark, d, "region").where("r_regionkey < 4").select((F.col("r_regionkey") + 1).alias("chapter_no"))
    lost = k.dangling(rows, ["chapter_no"], chapters).select("_seq", F.lit("chapter").alias("fault"))
    return bad.unionByName(lost)


def _faulty(spark, d) -> dict[str, DataFrame]:
    """The schema with faults by key: repeated dimension rows, values outside choices, lost parents."""
    star = {k: stage(table) for k, table in _star(spark, d).items()}  # each is read by several rules
    twice = lambda t, when: star[t].unionByName(star[t].where(when))
    out = {k: twice(k, when) for k, when in {"publication": "pub_year = 2024", "chapter": "chapter_no % 2 = 0", "indicator": "length(indicator_key) < 10", "table_column": "year = 1995", "region": "region_kind = 'kabupaten'", "category": "category = 'A'"}.items()}
    out["publication"] = out["publication"].withColumn("kind", F.lit("kertas"))
    tables = star["stat_table"].unionByName(star["stat_table"].where("chapter_no = 3")).withColumn("status", F.when(F.col("chapter_no") == 2, "lain").otherwise(F.col("status"))).where("chapter_no <> 4")
    columns = star["table_column"].where("year is null or year <> 1996")
    placed = columns.where("year = 1997").withColumn("indicator_key", F.concat("indicator_key", F.lit(" lagi")))
    facts = star["fact"].withColumn("flag", F.when(F.col("year") == 1994, "?").otherwise(F.col("flag")))
    return star | out | {"stat_table": tables, "table_column": columns.unionByName(columns.where("year = 1995")).unionByName(placed), "fact": facts, "region": out["region"].where("region not like '%7'"), "category": out["category"].where("category <> 'N'")}


def f06_unique_keys(spark, d) -> DataFrame:
    return k.audit_keys(_faulty(spark, d))


def f07_schema_audit(spark, d) -> DataFrame:
    return k.audit_values(_faulty(spark, d))


# --- loading --------------------------------------------------------------------------------------
def _star(spark, d) -> dict[str, DataFrame]:
    return g.load(g.empty(spark), v.long_rows(spark, d), NAME, YEAR)[0]


def _batch(spark, d) -> DataFrame:
    rows = v.long_rows(spark, d)
    even = F.expr("_seq div 10") % 2 == 0
    return rows.withColumns({"region": F.when(even, F.concat(F.lit("Kota "), F.col("region"))).otherwise(F.col("region")), "value_text": F.concat("value_text", F.lit("b")), "indicator": F.when(F.col("_seq") % 9 == 0, "Baru").otherwise(F.col("indicator"))})


def _two_publications(spark, d) -> dict[str, DataFrame]:
    return g.load(_star(spark, d), _batch(spark, d), NAME, YEAR + 1)[0]


def _loaded(spark, d):
    return g.load(_star(spark, d), _batch(spark, d), NAME, YEAR)


def g01_g03_catalog(spark, d) -> DataFrame:
    star = _loaded(spark, d)[0]
    return star["stat_table"].join(star["chapter"], [*g.PUB, "chapter_no"]).join(star["publication"], g.PUB)


def g01_publications(spark, d) -> DataFrame:
    """Publications met by title and year, and by title alone, as the customers' segments name them."""
    have = v.read(spark, d, "customer").select(F.col("c_mktsegment").alias("publication"), (F.lit(2000) + F.col("c_nationkey")).alias("pub_year")).distinct()
    for title, year, by_title in (("BUILDING", 1990, False), ("BUILDING", 1991, True), ("STATISTIK", 2024, True), ("STATISTIK", 2025, True)):
        have = g.with_publication(have, title, year, by_title)
    return have


def g04_g05_indicators(spark, d) -> DataFrame:
    return _loaded(spark, d)[0]["indicator"]


def g06_columns(spark, d) -> DataFrame:
    return _loaded(spark, d)[0]["table_column"]


def g07_g08_dimensions(spark, d) -> DataFrame:
    star = _loaded(spark, d)[0]
    return star["region"].select(F.lit("region").alias("dim"), F.col("region").alias("name"), F.col("region_kind").alias("grp")).unionByName(star["category"].select(F.lit("category").alias("dim"), F.col("category").alias("name"), F.col("category_group").alias("grp")))


def g09_facts(spark, d) -> DataFrame:
    return _loaded(spark, d)[0]["fact"]


def g10_counters(spark, d) -> DataFrame:
    return _loaded(spark, d)[1]


def g11_skipped(spark, d) -> DataFrame:
    rows = v.long_rows(spark, d)
    return rows.join(g.prepare(rows, NAME, YEAR).select("_seq"), "_seq", "left_anti").select("_seq")


def _wide(spark, d) -> tuple[DataFrame, DataFrame]:
    o = v.read(spark, d, "orders")
    key = F.col("o_orderkey")
    cells = F.array(F.col("o_totalprice").cast("int").cast("string"), F.when(key % 5 == 0, "-").otherwise(F.concat(F.lit("a "), F.col("o_orderpriority"))), F.col("o_orderstatus"))
    rows = o.select((key % 4).cast("string").alias("table_no"), key.alias("row"), F.col("o_orderstatus").alias("label"), (key % 50 == 0).alias("is_total"), (key % 4 == 1).alias("by_category"), F.when(key % 3 == 0, F.slice(cells, 1, 2)).otherwise(cells).alias("cells"))
    c = v.read(spark, d, "nation").select((F.col("n_nationkey") % 4).cast("string").alias("table_no"), (F.floor(F.col("n_nationkey") / 4) + 1).cast("int").alias("position"), F.concat((F.lit(2000) + F.col("n_nationkey")).cast("string"), F.lit(" x")).alias("name"), F.lit("u").alias("unit"), F.lit(2019).alias("year"),
        F.when(F.col("n_nationkey") / 4 >= 1, F.when(F.col("n_nationkey") < 8, "teks").otherwise("numerik")).otherwise("numerik").alias("value_type"), F.when(F.col("n_nationkey") % 4 == 2, "year").when(F.col("n_nationkey") % 4 == 3, "kategori").alias("mode"), F.lit("Basis").alias("base"))
    return rows, c


def g12_g13_long(spark, d) -> DataFrame:
    return g.wide_to_long(*_wide(spark, d), area="Kabupaten X")


def _facts_by_id(spark, d) -> DataFrame:
    p = g.prepare(v.long_rows(spark, d), NAME, YEAR)
    return p.select(F.col("_seq").alias("fact_id"), "table_no", "value_num", "value_text", "flag", F.when(F.col("_seq") % 2 == 0, "teks").otherwise("numerik").alias("value_type"))


def g14_edits(spark, d) -> DataFrame:
    f = _facts_by_id(spark, d)
    m = F.col("fact_id") % 5
    edits = f.select("fact_id", F.when(m == 0, "").when(m == 1, F.col("value_text")).when(m == 2, " 1.234,5 ").when(m == 3, "-7").alias("new_text")).where("new_text is not null")
    return g.apply_edits(f, edits).select("fact_id", "value_num", "value_text", "flag", "changed")


def g15_marks(spark, d) -> DataFrame:
    f = _facts_by_id(spark, d)
    return g.mark_safe(f, f.where("flag = 'perlu_cek'").select("fact_id")).groupBy("flag").agg(F.count("*").alias("n"))


def g15_verified(spark, d) -> DataFrame:
    star = _two_publications(spark, d)
    return g.verify_tables(star["stat_table"], star["stat_table"].where(f"chapter_no % 2 = 0 AND pub_year = {YEAR}").select(*g.TAB)).select("pub_year", "table_no", "status")


def _definitions(spark, d) -> DataFrame:
    p = v.read(spark, d, "part")
    return p.select((F.col("p_partkey") % 100).cast("string").alias("table_no"), F.col("p_partkey").alias("at"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("p_type"))).alias("name"), F.col("p_brand").alias("unit"), (F.lit(2000) + F.col("p_size")).alias("year"), F.lit("numerik").alias("value_type"))


def g16_columns(spark, d) -> DataFrame:
    defs = _definitions(spark, d)
    columns, _ = g.define_columns(defs, defs.limit(0).select(F.col("name").alias("indicator")))
    edits = columns.where("position <= 3").select("table_no", "position", F.when(F.col("position") == 1, "Baru").otherwise(" ").alias("name"), F.lit("ha").alias("unit"), F.lit(1999).alias("year"), F.lit("teks").alias("value_type"))
    return g.edit_columns(columns, edits)


def g16_new_indicators(spark, d) -> DataFrame:
    defs = _definitions(spark, d)
    known = v.read(spark, d, "part").where("p_partkey <= 2").select(F.col("p_type").alias("indicator")).distinct()
    return g.define_columns(defs, known)[1]


def g17_deletes(spark, d) -> DataFrame:
    star = _star(spark, d)
    left = g.delete_tables(star, star["stat_table"].where("chapter_no = 2").select(*g.TAB))
    gone = g.delete_publications(left, left["publication"].where("pub_year = 1900"))
    held = g.protected(gone)
    return gone["fact"].agg(F.count("*").alias("facts")).join(F.broadcast(gone["table_column"].agg(F.count("*").alias("columns")))).join(F.broadcast(held["region"].agg(F.count("*").alias("regions")))).join(F.broadcast(held["indicator"].agg(F.count("*").alias("indicators"))))


# --- reading --------------------------------------------------------------------------------------
def h01_publications(spark, d) -> DataFrame:
    star = _star(spark, d)
    more = g.described(v.read(spark, d, "orders").select(F.lit("Statistik").alias("publication"), F.year("o_orderdate").alias("pub_year")).distinct())
    return r.publication_list(star | {"publication": star["publication"].unionByName(more)})


def h02_chapters(spark, d) -> DataFrame:
    star = _star(spark, d)
    more = v.read(spark, d, "nation").select(F.lit(NAME).alias("publication"), F.lit(YEAR).alias("pub_year"), (F.col("n_nationkey") + 100).alias("chapter_no"), F.col("n_name").alias("chapter"))
    return r.chapter_list(star | {"chapter": star["chapter"].unionByName(more)})


def h03_tables(spark, d) -> DataFrame:
    return r.table_list(_star(spark, d))


def h04_h05_cells(spark, d) -> DataFrame:
    return r.table_cells(_star(spark, d), PHRASE)


def h04_table_view(spark, d) -> DataFrame:
    """The pages of all tables of two publications whose tables have the same numbers."""
    return r.table_rows(_two_publications(spark, d), PHRASE).withColumn("cells", F.array_join("cells", "|"))


def h06_grid(spark, d) -> DataFrame:
    star = _star(spark, d)
    master = v.read(spark, d, "supplier").select(F.col("s_name").alias("entity"))
    return r.entry_grid(r.table_cells(star, PHRASE), star["table_column"], master, "Kabupaten", star["stat_table"])


def h07_dashboard(spark, d) -> DataFrame:
    return r.dashboard(_star(spark, d))


def h08_anomalies(spark, d) -> DataFrame:
    f = _facts_by_id(spark, d).withColumns({"publication": F.lit(NAME), "pub_year": F.lit(YEAR), "created": F.col("fact_id") % 1009})
    return r.newest_anomalies(f, _star(spark, d)["stat_table"]).select("fact_id", "created", "table_no", "title")


def h09_activity(spark, d) -> DataFrame:
    t = _star(spark, d)["stat_table"]
    t = t.withColumn("modified", F.length("title") * 10 + F.col("chapter_no")).withColumn("status", F.when(F.col("chapter_no") == 3, "draft").otherwise(F.col("status")))
    return r.recent_activity(t).select("table_no", "modified", "status")


def h10_by_chapter(spark, d) -> DataFrame:
    return r.facts_by_chapter(_star(spark, d))


def h11_search(spark, d) -> DataFrame:
    return r.search_text(v.read(spark, d, "documents"), "text", " LICENSE ", [F.col("doc_id")]).select("doc_id")


def _index(spark, rows: DataFrame, columns: list[str], key: str) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    search_index.build(rows, path, columns, [key], slots=32)
    return path


def h11_indexed_search(spark, d) -> DataFrame:
    """All documents with a phrase, through postings of trigrams."""
    docs = v.read(spark, d, "documents").select("doc_id", "text")
    return search_index.search(spark, _index(spark, docs, ["text"], "doc_id"), "text", " Apache LICENSE ").select("doc_id")


def h12_facets(spark, d) -> DataFrame:
    f = _facts_by_id(spark, d)
    return r.filter_facets(f, flag=["nihil", "perlu_cek"], value_type="teks").select("fact_id", "flag")


def h12_dimensions(spark, d) -> DataFrame:
    """Tables, regions, indicators and categories by their own facets."""
    star = _star(spark, d)
    found = {
        "stat_table": r.filter_facets(star["stat_table"], row_kind="kategori", status=["ekstrak", "draft"], publication=NAME).select(F.col("table_no").alias("name")),
        "region": r.filter_facets(star["region"], region_kind="kabupaten").select(F.col("region").alias("name")),
        "indicator": r.filter_facets(star["indicator"], value_type="numerik").select(F.col("indicator_key").alias("name")),
        "category": r.filter_facets(star["category"], category_group=["Status", "Jenis"]).select(F.col("category").alias("name")),
    }
    out = [df.select(F.lit(t).alias("dim"), "name") for t, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def h13_fields(spark, d) -> DataFrame:
    return r.search_fields(v.read(spark, d, "part"), ["p_name", "p_brand", "p_type"], "ECONOMY 1 ").select("p_partkey")


def h13_indexed_fields(spark, d) -> DataFrame:
    """Parts with each word in some column, through postings of trigrams; the second word is too short for one."""
    parts = v.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    columns = ["p_name", "p_brand", "p_type"]
    return search_index.search_words(spark, _index(spark, parts, columns, "p_partkey"), columns, "ECONOMY 1 ").select("p_partkey")


def h14_export(spark, d) -> DataFrame:
    return r.export_rows(_star(spark, d))


def h15_scope(spark, d) -> DataFrame:
    star = _star(spark, d)
    return r.export_rows(star, star["stat_table"].where("chapter_no = 1")).groupBy("table_no").agg(F.count("*").alias("n"))


def h16_picker(spark, d) -> DataFrame:
    p = v.read(spark, d, "customer").select(F.col("c_name").alias("publication"), (F.lit(1990) + F.col("c_nationkey")).alias("pub_year"), F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "a.pdf").alias("file"))
    return r.publication_picker(p)


def h17_indicators(spark, d) -> DataFrame:
    return r.indicator_names(_star(spark, d))


def h18_order(spark, d) -> DataFrame:
    return r.ranked(_star(spark, d)["fact"], ["table_no"], r.fact_order()).select("table_no", "region", "category", "year", "indicator_key", "place")


def _stored(spark, d, both: bool = True) -> tuple[SparkSession, str]:
    """One or two publications of one title in a store of their own, each published by a load of its year."""
    name = f"store_{uuid.uuid4().hex}"
    own = store.open_store(spark, name, f"{shared_dir(spark)}/{name}", buckets=8)
    store.publish_load(own, name, v.long_rows(own, d), NAME, YEAR)
    if both:
        store.publish_load(own, name, _batch(own, d), NAME, YEAR + 1)
    return own, name


def g09_stored_facts(spark, d) -> DataFrame:
    own, name = _stored(spark, d)
    return store.read_store(own, name)["fact"]


def h14_stored_export(spark, d) -> DataFrame:
    """The export of the publication of 2024, joined from stored tables as they lie."""
    own, name = _stored(spark, d, both=False)
    return r.export_rows(store.read_store(own, name, YEAR))


def b01_g09_pages_to_facts(spark, d) -> DataFrame:
    """Facts of printed pages: glyphs to lines, columns, headers, tables over two pages, checks and the load."""
    glyphs, words, cells, edges = v.printed_pages(spark, d)
    master = v.read(spark, d, "region").select(F.col("r_name").alias("entity"))
    rows = stage(extract.exchange_rows(glyphs, words, cells, edges, master, area="Wilayah", phrase=PHRASE))
    star = g.load(g.empty(spark), rows, NAME, YEAR)[0]
    f, t, c = star["fact"], star["stat_table"].select(*g.TAB, "title", "source", "row_kind"), star["table_column"].select(*g.COL, "position", "unit")
    found = f.join(t, g.TAB)
    return found.join(c, r.on_column(found, c)).select(found["table_no"], "title", "source", "row_kind", "position", "unit", found["indicator_key"], "region", "category", "value_num", "value_text", "flag")


def h03_h07_stored_counts(spark, d) -> DataFrame:
    """Counts by table as they are kept through loads, edits and deletes, without a look at the facts."""
    own, name = _stored(spark, d)
    asked = store.read_store(own, name, YEAR)["fact"].where("flag = 'perlu_cek' AND region_kind = 'kabupaten'")
    store.publish_edits(own, name, asked.select(*g.FACT, F.lit("987654").alias("new_text")), YEAR)
    star = store.read_store(own, name, YEAR + 1)
    store.publish_deletes(own, name, star["stat_table"].where("chapter_no = 2").select(*g.TAB), YEAR + 1)
    return store.read_store(own, name)["table_count"]


def a08_a10_round_trip(spark, d) -> DataFrame:
    """Exported rows written to CSV, read back and loaded again: the facts of the second load."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    long_csv.write_long_csv(r.export_rows(_star(spark, d)), path)
    again = stage(long_csv.read_long_csv(spark, path))
    return g.load(g.empty(spark), again, NAME, YEAR)[0]["fact"].drop("category_group")


def a01_a09_legacy(spark, d) -> DataFrame:
    path = f"{shared_dir(spark)}/legacy-{uuid.uuid4().hex}"
    long_csv.write_legacy_csv(v.long_rows(spark, d), path)
    old = {c: n for c, n in long_csv.COLUMNS.items() if c in long_csv.LEGACY}
    return long_csv.read_long_csv(spark, path, old).drop("_seq").groupBy("table_no", "indicator", "flag").agg(F.count("*").alias("n"))


# --- the same in SQL ------------------------------------------------------------------------------
_CELLS = {
    "c0": f"SELECT cell_id, row_id % 150 AS t, row_id AS row, position, row_id // 150 = 1 AS is_total, {sql_clean('raw')} FROM raw_cells",
    "su": "SELECT t, position, sum(num) FILTER (WHERE NOT is_total) AS s FROM c0 GROUP BY ALL",
    "cells": "SELECT t, row, position, is_total, cell_id, text, CASE WHEN is_total AND t % 3 > 0 THEN (s + CASE WHEN t % 3 = 1 THEN t ELSE 0 END)::DECIMAL(24,4) ELSE num END AS num, CASE WHEN is_total AND t % 3 > 0 THEN 'ada' ELSE flag END AS flag FROM c0 JOIN su USING (t, position)",
}


def _check(src: str, tol: str) -> str:
    return f"""SELECT t, position, CASE WHEN total IS NOT NULL AND s IS NOT NULL THEN round(s, 2) END AS rows_sum, total, CASE WHEN total IS NOT NULL AND s IS NOT NULL THEN round(s - total, 2) END AS diff,
      CASE WHEN total IS NOT NULL AND s IS NOT NULL THEN abs(s - total) <= {tol} END AS matches FROM (SELECT t, position, max(num) FILTER (WHERE is_total) AS total, sum(num) FILTER (WHERE NOT is_total) AS s FROM {src} GROUP BY ALL)"""


_TOL = "greatest(1::DECIMAL(24,6), abs(total) * 0.005)"
_GAPPY = {"gappy": """SELECT t, row, position, is_total, cell_id, text, CASE WHEN fill THEN 1 ELSE num END::DECIMAL(24,4) AS num, CASE WHEN fill THEN 'ada' ELSE flag END AS flag FROM (
  SELECT *, gap AND sum(gap::INT) OVER (PARTITION BY t, position ORDER BY row, cell_id) > 1 + t % 2 AS fill FROM (SELECT *, flag IN ('nihil', 'tidak_tersedia', 'perlu_cek') AND NOT is_total AS gap FROM cells))"""}


def _prep(src: str) -> str:
    return rf"""SELECT _seq, 'Dalam Angka' AS publication, 2024 AS pub_year, trim(table_no) AS table_no, try_cast(split_part(trim(table_no), '.', 1) AS INT) AS chapter_no, chapter, title, title_en, source, trim(indicator) AS indicator, {sql_norm_indicator('indicator')} AS indicator_key, unit,
      nullif(regexp_extract(year, '[0-9]{{4}}'), '')::INT AS year, nullif(trim(region), '') AS region, CASE WHEN trim(region) <> '' THEN {sql_region_kind('trim(region)')} END AS region_kind, nullif(trim(category), '') AS category, CASE WHEN trim(category) <> '' THEN category_group END AS category_group,
      CASE WHEN regexp_matches(trim(value_num), '^[0-9]+$') THEN trim(value_num)::DECIMAL(24,4) END AS value_num, trim(value_text) AS value_text, coalesce(nullif(flag, ''), 'ada') AS flag FROM {src} WHERE trim(table_no) <> ''"""


_KEY = "publication, pub_year, table_no, indicator_key, year, region, region_kind, category, category_group"
_P = {
    "batch": "SELECT * REPLACE (CASE WHEN (_seq // 10) % 2 = 0 THEN 'Kota ' || region ELSE region END AS region, value_text || 'b' AS value_text, CASE WHEN _seq % 9 = 0 THEN 'Baru' ELSE indicator END AS indicator) FROM long_rows",
    "p": _prep("long_rows"), "q": _prep("batch"),
    "f1": f"SELECT {_KEY}, value_num, value_text, flag FROM p QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY _seq DESC) = 1",
}
_FACTS2 = f"""SELECT {_KEY}, value_num, value_text, flag FROM (SELECT 1 AS src, * FROM p UNION ALL SELECT 2 AS src, * FROM q) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY src DESC, _seq DESC) = 1"""
_ALL = "SELECT 1 AS src, * FROM p UNION ALL SELECT 2, * FROM q"
_COLS = """SELECT publication, pub_year, table_no, indicator_key, year, row_number() OVER (PARTITION BY publication, pub_year, table_no ORDER BY src, seq0) AS position, unit, value_type FROM (
  SELECT publication, pub_year, table_no, indicator_key, year, min(src) AS src, arg_min(_seq, src * 1000000000000000000::HUGEINT + _seq) AS seq0, arg_min(unit, src * 1000000000000000000::HUGEINT + _seq) AS unit, arg_min(CASE WHEN value_num IS NULL THEN 'teks' ELSE 'numerik' END, src * 1000000000000000000::HUGEINT + _seq) AS value_type FROM ({src}) GROUP BY ALL)"""
_ONE = "SELECT 1 AS src, * FROM p"
_TABLES = "SELECT publication, pub_year, table_no, arg_min(chapter_no, _seq) AS chapter_no, arg_min(chapter, _seq) AS chapter, arg_min(title, _seq) AS title, arg_min(title_en, _seq) AS title_en, arg_min(source, _seq) AS source, CASE WHEN arg_min(coalesce(category, ''), _seq) <> '' THEN 'kategori' ELSE 'kecamatan' END AS row_kind, 'ekstrak' AS status FROM p GROUP BY ALL"
_SUBJ = f"""SELECT f.publication, f.pub_year, f.table_no, CASE WHEN row_kind = 'kategori' THEN category ELSE region END AS subject, position, value_num, value_text, flag,
  CASE WHEN row_kind = 'kategori' THEN contains(lower(category), 'kabupaten') ELSE region_kind <> 'kecamatan' END AS is_total
  FROM f1 f JOIN tabs t USING (publication, pub_year, table_no) JOIN cols c ON c.publication = f.publication AND c.pub_year = f.pub_year AND c.table_no = f.table_no AND c.indicator_key = f.indicator_key AND c.year IS NOT DISTINCT FROM f.year
  WHERE CASE WHEN row_kind = 'kategori' THEN category ELSE region END IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY f.publication, f.pub_year, f.table_no, subject, position ORDER BY coalesce(region_kind, '') DESC, coalesce(region, '') DESC, coalesce(category_group, '') DESC, coalesce(category, '') DESC) = 1"""
_STAR = {"p": _P["p"], "f1": _P["f1"], "tabs": _TABLES, "cols": _COLS.replace("{src}", _ONE), "subj": _SUBJ}
_IND = "SELECT indicator_key, arg_min(indicator, src * 1000000000000000000::HUGEINT + _seq) AS indicator, arg_min(unit, src * 1000000000000000000::HUGEINT + _seq) AS unit, CASE WHEN bool_or(value_num IS NOT NULL) THEN 'numerik' ELSE 'teks' END AS value_type FROM ({src}) GROUP BY ALL"
_EXPORT = """SELECT t.chapter, f.table_no, t.title, coalesce(region, '') AS region, coalesce(category, '') AS category, i.indicator, coalesce(nullif(c.unit, ''), i.unit) AS unit, coalesce(f.year::VARCHAR, '') AS year, coalesce(value_num::VARCHAR, '') AS value_num, coalesce(value_text, '') AS value_text, flag, t.source
  FROM f1 f JOIN tabs t USING (table_no) JOIN cols c ON c.table_no = f.table_no AND c.indicator_key = f.indicator_key AND c.year IS NOT DISTINCT FROM f.year JOIN ind i ON i.indicator_key = f.indicator_key"""
_EXP = _STAR | {"ind": _IND.replace("{src}", _ONE)}
_TWICE = lambda src, when: f"SELECT * FROM ({src}) UNION ALL SELECT * FROM ({src}) WHERE {when}"
_FAULTY = _EXP | {
    "x_publication": "SELECT 'Dalam Angka' AS publication, 2024 AS pub_year, 'kertas' AS kind FROM range(2)",
    "x_chapter": _TWICE("SELECT DISTINCT publication, pub_year, chapter_no FROM p", "chapter_no % 2 = 0"),
    "x_stat_table": "SELECT * REPLACE (CASE WHEN chapter_no = 2 THEN 'lain' ELSE status END AS status) FROM (" + _TWICE("SELECT * FROM tabs", "chapter_no = 3") + ") WHERE chapter_no <> 4",
    "x_indicator": _TWICE("SELECT * FROM ind", "length(indicator_key) < 10"),
    "x_table_column": _TWICE("SELECT * FROM cols WHERE year IS NULL OR year <> 1996", "year = 1995") + " UNION ALL SELECT * REPLACE (indicator_key || ' lagi' AS indicator_key) FROM cols WHERE year = 1997",
    "x_region": "SELECT * FROM (" + _TWICE("SELECT DISTINCT region, region_kind FROM p WHERE region IS NOT NULL", "region_kind = 'kabupaten'") + ") WHERE region NOT LIKE '%7'",
    "x_category": "SELECT * FROM (" + _TWICE("SELECT DISTINCT category, category_group FROM p WHERE category IS NOT NULL", "category = 'A'") + ") WHERE category <> 'N'",
    "x_fact": "SELECT * REPLACE (CASE WHEN year = 1994 THEN '?' ELSE flag END AS flag) FROM f1",
}
_P2 = "SELECT * FROM p UNION ALL SELECT * REPLACE (2025 AS pub_year) FROM q"
_TWO = {"p1": _P["p"], "batch": _P["batch"], "q": _P["q"], "p": _P2.replace("FROM p ", "FROM p1 "), "f1": _P["f1"], "tabs": _TABLES, "cols": _COLS.replace("{src}", _ONE), "subj": _SUBJ}
_FBI = {"p": _P["p"], "fi": "SELECT _seq AS fact_id, table_no, value_num, value_text, flag, CASE WHEN _seq % 2 = 0 THEN 'teks' ELSE 'numerik' END AS value_type FROM p"}
_shown = f"CASE WHEN flag = 'nihil' THEN '–' WHEN flag = 'tidak_tersedia' THEN '…' WHEN value_num IS NOT NULL THEN {sql_format_id('value_num')} ELSE value_text END"
w = v.with_views

_FIELDS = "SELECT p_partkey FROM part WHERE " + " AND ".join("(" + " OR ".join(f"contains(lower({c}), '{x}')" for c in ("p_name", "p_brand", "p_type")) + ")" for x in ("economy", "1"))
SQL = {
    "f01_totals": w("raw_cells", _check("cells", _TOL), **_CELLS),
    "f01_tables": w("raw_cells", f"SELECT t, bool_or(is_total) AS has_total, NOT bool_or(is_total) OR coalesce(bool_and(coalesce(matches, true)), true) AS all_match FROM cells LEFT JOIN ({_check('cells', _TOL)}) USING (t, position) GROUP BY t", **_CELLS),
    "f02_repair": w("raw_cells", f"""SELECT t, row, position, cell_id, CASE WHEN hit THEN replace(regexp_replace(regexp_replace(fill::VARCHAR, '0+$', ''), '\\.$', ''), '.', ',') ELSE text END AS text, CASE WHEN hit THEN fill ELSE num END AS num, CASE WHEN hit THEN 'auto_corrected' ELSE flag END AS flag FROM (
      SELECT *, coalesce(gap AND gaps = 1 AND fill <> 0, false) AS hit FROM (SELECT g.*, flag IN ('nihil', 'tidak_tersedia', 'perlu_cek') AND NOT is_total AS gap, count(*) FILTER (WHERE flag IN ('nihil', 'tidak_tersedia', 'perlu_cek') AND NOT is_total) OVER (PARTITION BY t, position) AS gaps, (-diff)::DECIMAL(24,4) AS fill
      FROM gappy g LEFT JOIN (SELECT t, position, diff FROM ({_check('gappy', _TOL)}) WHERE matches = false) USING (t, position)))""", **_CELLS, **_GAPPY),
    "f03_strict_totals": w("raw_cells", _check("cells", "0.01"), **_CELLS),
    "f04_flags": w("raw_cells", "SELECT flag, count(*) AS n FROM cells GROUP BY flag", **_CELLS),
    "f06_duplicates": w("long_rows", "SELECT table_no, region, year, category, count(*) AS n FROM long_rows GROUP BY ALL HAVING count(*) > 1"),
    "f07_audit": w("long_rows", "SELECT _seq, 'flag' AS fault FROM p WHERE _seq % 37 = 0 UNION ALL SELECT _seq, 'chapter' FROM p WHERE chapter_no > 4", p=_P["p"]),
    "f06_unique_keys": w("long_rows", " UNION ALL ".join(f"SELECT '{t}' AS table, '{', '.join(key)}' AS key, count(*) AS keys, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM x_{t} GROUP BY {', '.join(key)} HAVING count(*) > 1)" for t, key in k.UNIQUE), **_FAULTY),
    "f07_schema_audit": w("long_rows", " UNION ALL ".join(
        [f"SELECT '{t}' AS table, '{c}' AS rule, count(*) AS rows FROM x_{t} WHERE {c} IS NULL OR {c} NOT IN ({', '.join(repr(x) for x in k.CHOICES[c])})" for t, c in k.CHOSEN]
        + [f"SELECT '{t}', 'in {parent}', count(*) FROM x_{t} a WHERE ({' OR '.join(f'a.{c} IS NOT NULL' for c in key)}) AND NOT EXISTS (SELECT 1 FROM x_{parent} b WHERE {' AND '.join(f'a.{c} IS NOT DISTINCT FROM b.{c}' for c in key)})" for t, key, parent in k.REFERENCES]), **_FAULTY),
    "g01_publications": "SELECT DISTINCT c_mktsegment AS publication, 2000 + c_nationkey AS pub_year FROM customer UNION ALL SELECT 'BUILDING', 1990 UNION ALL SELECT 'STATISTIK', 2024",
    "h12_dimensions": w("long_rows", """SELECT 'stat_table' AS dim, table_no AS name FROM tabs WHERE row_kind = 'kategori' UNION ALL SELECT DISTINCT 'region', region FROM p WHERE region_kind = 'kabupaten'
      UNION ALL SELECT 'indicator', indicator_key FROM ind WHERE value_type = 'numerik' UNION ALL SELECT DISTINCT 'category', category FROM p WHERE category IS NOT NULL""", **_EXP),
    "g01_g03_catalog": w("long_rows", f"SELECT *, '' AS coverage, 'digital' AS kind, NULL::VARCHAR AS file, '' AS note FROM ({_TABLES})", **_P),
    "g04_g05_indicators": w("long_rows", _IND.replace("{src}", _ALL), **_P),
    "g06_columns": w("long_rows", _COLS.replace("{src}", _ALL), **_P),
    "g07_g08_dimensions": w("long_rows", f"SELECT DISTINCT 'region' AS dim, region AS name, region_kind AS grp FROM ({_ALL}) WHERE region IS NOT NULL UNION ALL SELECT DISTINCT 'category', category, category_group FROM ({_ALL}) WHERE category IS NOT NULL", **_P),
    "g09_facts": w("long_rows", _FACTS2, **_P),
    "g10_counters": w("long_rows", f"""SELECT n AS new_facts, (SELECT count(*) FROM q) - n AS updated_facts, 0 AS new_tables, (SELECT count(DISTINCT indicator_key) FROM q WHERE indicator_key NOT IN (SELECT indicator_key FROM p)) AS new_indicators,
      (SELECT count(*) FROM (SELECT DISTINCT region, region_kind FROM q WHERE region IS NOT NULL EXCEPT SELECT region, region_kind FROM p)) AS new_regions, 0 AS new_categories FROM (SELECT count(*) AS n FROM (SELECT DISTINCT {_KEY} FROM q EXCEPT SELECT {_KEY} FROM p))""", **_P),
    "g11_skipped": w("long_rows", "SELECT _seq FROM long_rows WHERE trim(table_no) = ''"),
    "g12_g13_long": f"""SELECT table_no, row, position, CASE WHEN is_total OR by_category THEN 'Kabupaten X' ELSE label END AS region, CASE WHEN by_category AND NOT is_total THEN label ELSE '' END AS category,
      CASE m WHEN 2 THEN 'Basis' WHEN 3 THEN 'Basis - ' || name ELSE name END AS indicator, 'u' AS unit, CASE WHEN m = 2 THEN left(name, 4)::INT ELSE 2019 END AS year, CASE WHEN NOT tx THEN num END AS value_num,
      CASE WHEN tx THEN CASE WHEN len(list_filter(string_split(text, ' '), lambda x: length(x) > 1)) = 0 THEN text ELSE array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) > 1), ' ') END ELSE text END AS value_text, CASE WHEN tx THEN CASE WHEN text = '' THEN 'kosong' ELSE 'ada' END ELSE flag END AS flag
      FROM (SELECT *, {sql_clean('raw')} FROM (SELECT o.*, n.position, n.name, n.m, n.tx, coalesce(CASE n.position WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN CASE WHEN row % 3 = 0 THEN NULL ELSE label END END, '') AS raw FROM (
      SELECT (o_orderkey % 4)::VARCHAR AS table_no, o_orderkey AS row, o_orderstatus AS label, o_orderkey % 50 = 0 AS is_total, o_orderkey % 4 = 1 AS by_category, trunc(o_totalprice)::INT::VARCHAR AS c1, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE 'a ' || o_orderpriority END AS c2 FROM orders) o
      JOIN (SELECT (n_nationkey % 4)::VARCHAR AS table_no, n_nationkey // 4 + 1 AS position, (2000 + n_nationkey)::VARCHAR || ' x' AS name, n_nationkey % 4 AS m, n_nationkey BETWEEN 4 AND 7 AS tx FROM nation) n USING (table_no)))""",
    "g14_edits": w("long_rows", r"""SELECT fact_id, CASE WHEN changed AND value_type = 'numerik' THEN num ELSE value_num END AS value_num, CASE WHEN changed THEN e ELSE value_text END AS value_text, CASE WHEN changed AND filled THEN 'ada' ELSE flag END AS flag, changed FROM (
      SELECT *, e IS NOT NULL AND CASE WHEN value_type = 'teks' THEN e IS DISTINCT FROM value_text ELSE num IS DISTINCT FROM value_num END AS changed, CASE WHEN value_type = 'teks' THEN e <> '' ELSE num IS NOT NULL END AS filled FROM (
      SELECT *, try_cast(replace(replace(e, '.', ''), ',', '.') AS DECIMAL(24,4)) AS num FROM (SELECT *, CASE fact_id % 5 WHEN 0 THEN '' WHEN 1 THEN value_text WHEN 2 THEN '1.234,5' WHEN 3 THEN '-7' END AS e FROM fi)))""", **_FBI),
    "g15_marks": w("long_rows", "SELECT CASE WHEN flag = 'perlu_cek' THEN 'ada' ELSE flag END AS flag, count(*) AS n FROM fi GROUP BY ALL", **_FBI),
    "g15_verified": w("long_rows", "SELECT pub_year, table_no, CASE WHEN chapter_no % 2 = 0 AND pub_year = 2024 THEN 'verifikasi' ELSE 'ekstrak' END AS status FROM tabs", **_TWO),
    "g16_columns": """SELECT table_no, position, CASE WHEN position = 1 THEN 'Baru' ELSE p_type END AS indicator, CASE WHEN position <= 3 THEN 'ha' ELSE p_brand END AS unit, CASE WHEN position <= 3 THEN 1999 ELSE 2000 + p_size END AS year, CASE WHEN position <= 3 THEN 'teks' ELSE 'numerik' END AS value_type
      FROM (SELECT *, (p_partkey % 100)::VARCHAR AS table_no, row_number() OVER (PARTITION BY p_partkey % 100 ORDER BY p_partkey) AS position FROM part WHERE p_size % 5 <> 0)""",
    "g16_new_indicators": "SELECT p_type AS indicator, arg_min(p_brand, (p_partkey % 100)::VARCHAR || '/' || lpad(p_partkey::VARCHAR, 12, '0')) AS unit, 'numerik' AS value_type FROM (SELECT * FROM part WHERE p_size % 5 <> 0) WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey <= 2) GROUP BY p_type",
    "g17_deletes": w("long_rows", "SELECT count(*) AS facts, (SELECT count(*) FROM cols WHERE table_no NOT LIKE '2.%') AS columns, count(DISTINCT region) AS regions, (SELECT count(DISTINCT indicator_key) FROM cols WHERE table_no NOT LIKE '2.%') AS indicators FROM f1 WHERE table_no NOT LIKE '2.%'", **_STAR),
    "h01_publications": w("long_rows", "SELECT 'Dalam Angka' AS publication, 2024 AS pub_year, (SELECT count(DISTINCT chapter_no) FROM p) AS chapters UNION ALL SELECT DISTINCT 'Statistik', year(o_orderdate), 0 FROM orders", p=_P["p"]),
    "h02_chapters": w("long_rows", "SELECT 'Dalam Angka' AS publication, 2024 AS pub_year, chapter_no, min(chapter) AS chapter, count(DISTINCT table_no) AS tables FROM p GROUP BY chapter_no UNION ALL SELECT 'Dalam Angka', 2024, n_nationkey + 100, n_name, 0 FROM nation", p=_P["p"]),
    "h03_tables": w("long_rows", "SELECT t.publication, t.pub_year, table_no, t.title, t.status, count(*) AS facts FROM tabs t JOIN f1 USING (table_no) GROUP BY ALL", **_STAR),
    "h04_h05_cells": w("long_rows", "SELECT * FROM subj", **_STAR),
    "h04_table_view": w("long_rows", """SELECT publication, pub_year, table_no, subject, is_total, array_to_string(list_transform(range(1, width + 1), lambda i: coalesce(texts[i][1], '·')), '|') AS cells FROM (
      SELECT publication, pub_year, table_no, subject, bool_or(is_total) AS is_total, map(list(position), list([shown])) AS texts FROM one GROUP BY ALL) JOIN (SELECT publication, pub_year, table_no, max(position) AS width FROM cols GROUP BY ALL) USING (publication, pub_year, table_no)""", **_TWO,
      one=f"SELECT *, {_shown} AS shown FROM subj"),
    "h06_grid": w("long_rows", f"SELECT c.publication, c.pub_year, c.table_no, n.subject, n.is_total, c.position, coalesce(CASE WHEN s.subject IS NOT NULL THEN coalesce(nullif(value_text, ''), {sql_format_id('value_num')}) END, '') AS text FROM cols c JOIN (SELECT table_no, s_name AS subject, false AS is_total FROM tabs, supplier WHERE row_kind <> 'kategori' UNION ALL SELECT table_no, 'Kabupaten', true FROM tabs WHERE row_kind <> 'kategori' UNION ALL SELECT s.table_no, s.subject, bool_or(s.is_total) FROM subj s JOIN tabs USING (table_no) WHERE row_kind = 'kategori' GROUP BY ALL) n USING (table_no) LEFT JOIN subj s ON s.table_no = c.table_no AND s.subject = n.subject AND s.position = c.position", **_STAR),
    "h07_dashboard": w("long_rows", "SELECT 1 AS publications, (SELECT count(*) FROM tabs) AS tables, count(*) AS facts, count(*) FILTER (WHERE flag = 'perlu_cek') AS to_check FROM f1", **_STAR),
    "h08_anomalies": w("long_rows", "SELECT fact_id, fact_id % 1009 AS created, table_no, title FROM fi JOIN (SELECT table_no, min(title) AS title FROM p GROUP BY ALL) USING (table_no) WHERE flag = 'perlu_cek' ORDER BY fact_id % 1009 DESC, fact_id DESC LIMIT 10", **_FBI),
    "h09_activity": w("long_rows", "SELECT table_no, length(title) * 10 + chapter_no AS modified, status FROM tabs WHERE chapter_no <> 3 ORDER BY modified DESC, table_no LIMIT 5", **_STAR),
    "h10_by_chapter": w("long_rows", "SELECT chapter, count(*) AS facts FROM f1 JOIN tabs USING (table_no) GROUP BY chapter ORDER BY facts DESC, chapter LIMIT 10", **_STAR),
    "h11_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 100",
    "h12_facets": w("long_rows", "SELECT fact_id, flag FROM fi WHERE flag IN ('nihil', 'perlu_cek') AND value_type = 'teks'", **_FBI),
    "h11_indexed_search": "SELECT doc_id FROM documents WHERE contains(lower(text), 'apache license')",
    "h13_indexed_fields": _FIELDS,
    "h13_fields": _FIELDS,
    "h14_export": w("long_rows", _EXPORT, **_EXP),
    "h14_stored_export": w("long_rows", _EXPORT, **_EXP),
    "g09_stored_facts": w("long_rows", f"SELECT {_KEY}, value_num, value_text, flag FROM f1", **_TWO),
    "h03_h07_stored_counts": w("long_rows", "SELECT f.publication, f.pub_year, table_no, count(*) AS facts, count(*) FILTER (WHERE flag = 'perlu_cek' AND NOT (f.pub_year = 2024 AND region_kind IS NOT DISTINCT FROM 'kabupaten')) AS to_check FROM f1 f JOIN tabs t USING (publication, pub_year, table_no) WHERE NOT (f.pub_year = 2025 AND chapter_no = 2) GROUP BY ALL", **_TWO),
    "b01_g09_pages_to_facts": """WITH r AS (SELECT (n_regionkey + 1)::VARCHAR || '.' || (n_nationkey + 1)::VARCHAR AS table_no, 'Jumlah Pemasok ' || n_name AS title, s_name AS category, abs(round(s_acctbal * 100))::BIGINT AS v1, s_suppkey + 1 AS v2 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      every AS (SELECT * FROM r UNION ALL SELECT table_no, title, NULL, sum(v1)::BIGINT, sum(v2)::BIGINT FROM r GROUP BY ALL),
      two AS (SELECT table_no, title, category, 1 AS position, 'juta' AS unit, 'saldo' AS indicator_key, (v1::DECIMAL(24,4) / 100)::DECIMAL(24,4) AS value_num, """ + v._PRINTED.replace("(c ", "(v1 ") + """ AS value_text FROM every UNION ALL SELECT table_no, title, category, 2, '', 'kode', v2::DECIMAL(24,4), v2::VARCHAR FROM every)
      SELECT table_no, title, 'BPS' AS source, 'kategori' AS row_kind, position, unit, indicator_key, 'Wilayah' AS region, category, value_num, value_text, 'ada' AS flag FROM two""",
    "h15_scope": w("long_rows", f"SELECT table_no, count(*) AS n FROM ({_EXPORT}) WHERE table_no LIKE '1.%' GROUP BY ALL", **_EXP),
    "h16_picker": """SELECT '{"publication":"' || c_name || '","pub_year":' || (1990 + c_nationkey)::VARCHAR || ',"has_file":' || CASE WHEN c_custkey % 3 = 1 THEN 'true' ELSE 'false' END || '}' AS entry FROM customer""",
    "h17_indicators": w("long_rows", f"SELECT indicator FROM ({_IND.replace('{src}', _ONE)})", **_STAR),
    "h18_order": w("long_rows", "SELECT table_no, region, category, year, indicator_key, row_number() OVER (PARTITION BY table_no ORDER BY publication NULLS FIRST, pub_year NULLS FIRST, region NULLS FIRST, region_kind NULLS FIRST, category_group NULLS FIRST, category NULLS FIRST, year NULLS FIRST, indicator_key NULLS FIRST) AS place FROM f1", **_STAR),
    "a08_a10_round_trip": w("long_rows", f"SELECT {_KEY.replace(', category_group', '')}, value_num, value_text, flag FROM f1", **_STAR),
    "a01_a09_legacy": w("long_rows", "SELECT nullif(table_no, '') AS table_no, indicator, nullif(flag, '') AS flag, count(*) AS n FROM long_rows GROUP BY ALL"),
}
QUERIES = {name: globals()[name] for name in SQL}
