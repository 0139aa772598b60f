"""Queries over headers, sources of pages, segmentation and assembly, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import assembly as a
from ..operators import entities as e
from ..operators import headers as h
from ..operators import layout as y
from . import views as v
from .scalar_queries import sql_key

EVENT_JSON = "struct<k:bigint>"


def _fenced(spark, d) -> DataFrame:
    p, m = F.col("props"), F.col("event_id") % 7
    text = F.when(m == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(m == 1, F.concat(F.lit("``` "), p, F.lit("```"))).when(m == 2, F.substring(p, 1, 4)).when(m == 3, "").when(m == 4, F.concat(F.lit("  "), p)).otherwise(p)
    return v.read(spark, d, "events").select("event_id", text.alias("text"))


def a04_model_json(spark, d) -> DataFrame:
    j = a.parse_json(F.col("text"), EVENT_JSON)
    return _fenced(spark, d).select("event_id", j["k"].alias("k"), j["k"].isNull().alias("bad"))


def _answers(spark, d) -> DataFrame:
    """A model's answer for each page: its words as headers and as a row, in fences, blank or broken by key."""
    p = v.page_seq(spark, d)
    words, m = F.split("text", " "), (F.col("doc_id") + F.col("page_no")) % 8
    row = lambda label: F.struct(label.alias("label"), words.alias("values"))
    page = F.struct(
        F.col("table_no").alias("nomor_tabel"), F.col("continued").alias("lanjutan"), F.col("text").alias("judul_id"), F.lit("").alias("judul_en"), F.lit("BPS").alias("sumber"), F.lit(None).cast("string").alias("bab"), F.transform(words, lambda w: F.struct(w.alias("nama"), F.lit("u").alias("satuan"), F.col("page_no").cast("string").alias("tahun"))).alias("headers"),
        F.lit("x").alias("label_kolom"), F.array(row(F.lit("a")), row(F.col("table_no"))).alias("rows"), F.when(F.col("page_no") % 3 == 0, row(F.lit("total"))).alias("total_row"),
    )
    p = p.withColumn("answer", F.to_json(page))
    text = F.col("answer")
    text = F.when(m == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(m == 1, F.concat(F.lit(" \n"), text)).when(m == 2, "").when(m == 3, F.concat(F.lit("Here: "), text)).when(m == 4, F.lit(None)).when(m == 5, F.expr("left(answer, length(answer) - 1)")).when(m == 6, F.replace("answer", F.lit('"rows":'), F.lit('"rows":,'))).otherwise(text)
    return p.where("text is not null").select("doc_id", "page_no", text.alias("answer"))


def a04_model_pages(spark, d) -> DataFrame:
    j = F.col("j")
    cells = lambda x: F.array_join(x["values"], "|")
    return _answers(spark, d).withColumn("j", a.parse_page_json(F.col("answer"))).select(
        "doc_id", "page_no", j.isNull().alias("bad"), j["table_no"].alias("table_no"), j["continued"].alias("continued"), j["title_id"].alias("title"), F.array_join(F.transform(j["headers"], lambda h: F.concat_ws("/", h["name"], h["unit"], h["year"])), "|").alias("headers"),
        F.array_join(F.transform(j["rows"], lambda r: F.concat_ws(":", r["label"], cells(r))), ";").alias("rows"), cells(j["total_row"]).alias("total"), j["chapter"].isNull().alias("no_chapter"),
    )


def a05_recognised_words(spark, d) -> DataFrame:
    return a.recognised_words(v.words(spark, d), dpi=144.0).select("doc_id", "page_no", "seq", "conf", "x0", "x1", "top", "bottom")


def _kinds(spark, d) -> DataFrame:
    pages = v.page_seq(spark, d).select("doc_id", "page_no", (F.col("doc_id") % 5 != 0).alias("readable"))
    return a.classify_pages(pages, v.words(spark, d), least=60)


def a06_page_kinds(spark, d) -> DataFrame:
    return _kinds(spark, d)


def a07_page_sources(spark, d) -> DataFrame:
    w = v.words(spark, d).select("doc_id", "page_no", "seq")
    recognised = a.recognised_words(v.words(spark, d), dpi=144.0).select("doc_id", "page_no", (F.col("seq") + 100_000).alias("seq"))
    return a.choose_source(_kinds(spark, d), w, recognised).select("doc_id", "page_no", "seq", "is_ocr")


def _bounds(spark, d) -> DataFrame:
    return v.page_seq(spark, d).select("doc_id", "page_no", (F.lit(24.0) + F.col("page_no") % 4).alias("table_top"), (F.lit(70.0) + F.col("page_no") % 5 * 12).alias("colnum_top"))


def _blocks(spark, d) -> DataFrame:
    return h.word_blocks(y.cluster_lines(h.header_words(v.words(spark, d), _bounds(spark, d)), 4.0))


def c01_c02_word_blocks(spark, d) -> DataFrame:
    return _blocks(spark, d)


def _in_columns(spark, d) -> DataFrame:
    cells, _ = v.rules(spark, d)
    edges = y.ruled_edges(cells)
    return h.to_header_columns(h.drop_titles(h.snap_to_cells(_blocks(spark, d), cells), edges))


def c03_c05_header_columns(spark, d) -> DataFrame:
    return _in_columns(spark, d).select("doc_id", "page_no", "line_top", "block", "span_x0", "span_x1", "col")


def c06_upright(spark, d) -> DataFrame:
    return h.drop_italic(_in_columns(spark, d)).select("doc_id", "page_no", "line_top", "block", "col")


def c09_c10_header_names(spark, d) -> DataFrame:
    n = v.names(spark, d)
    grouped = n.select((F.col("name_id") % 500).alias("doc_id"), F.lit(0).alias("page_no"), (F.col("name_id") % 3).alias("col"), F.col("name_id").cast("double").alias("line_top"), F.lit(0).alias("block"), F.when(F.col("size") % 6 == 0, "2024/2025").otherwise(F.col("name")).alias("text"))
    return h.parse_headers(grouped).select("doc_id", "col", "name", "unit", "year")


def c11_padded_headers(spark, d) -> DataFrame:
    n = v.names(spark, d)
    heads = n.select((F.col("name_id") % 300).alias("t"), (F.floor(F.col("name_id") / 300) + 1).cast("int").alias("position"), F.when(F.col("size") % 4 > 0, F.col("original")).otherwise("").alias("name"), F.lit("ton").alias("unit"), F.lit("2020").alias("year"))
    # as wide as the headers that there are, or up to two columns wider
    widths = heads.groupBy("t").agg((F.max("position") + F.first("t") % 3).alias("n"))
    return h.pad_headers(heads, widths, ["t"])


def _identity_text() -> F.Column:
    c, t = F.col("doc_id"), F.col("page_no")
    m = (c + t) % 6
    num = F.concat_ws(".", (c % 9 + 1).cast("string"), (t % 3 + 1).cast("string"))
    return F.when(m == 0, F.concat(F.lit("Lanjutan Tabel "), num, F.lit("\n"), F.col("text"))).when(m == 1, F.concat(F.lit("x\n  "), num, F.lit(" \nSumber/Source : BPS "), c.cast("string"), F.lit("\nend"))).when(m == 2, F.concat(F.col("text"), F.lit("\nSumber: Dinas\nContinued Table no "), num)).otherwise(F.col("text"))


def d01_d02_d05_identity(spark, d) -> DataFrame:
    p = v.page_seq(spark, d).select("doc_id", "page_no", _identity_text().alias("text"))
    t = F.col("text")
    return p.select("doc_id", "page_no", a.continued(t).alias("continued"), a.table_number(t).alias("table_no"), a.source_line(t).alias("source"))


def _title_words(spark, d) -> DataFrame:
    year = F.when((F.col("seq") == 13) & (F.col("doc_id") % 2 == 0), "2023").when((F.col("seq") == 8) & (F.col("doc_id") % 4 > 0), "Tabel").otherwise(F.col("text"))
    font = F.when(F.col("doc_id") % 3 == 0, "Plain").otherwise(F.col("fontname"))
    return v.words(spark, d).withColumn("text", year).withColumn("fontname", font)


def d03_titles(spark, d) -> DataFrame:
    return a.titles(_title_words(spark, d), _bounds(spark, d).select("doc_id", "page_no", (F.col("table_top") + 40).alias("table_top")))


def d04_chapters(spark, d) -> DataFrame:
    w = v.words(spark, d).withColumn("text", F.when(F.col("seq") == 0, F.when(F.col("doc_id") % 4 == 0, "3.1").when(F.col("doc_id") % 4 == 1, "DALAM ANGKA").otherwise("bab")).otherwise(F.regexp_replace("text", "[^a-z]", "")))
    return a.chapter_names(w, below=26.0)


def d06_segments(spark, d) -> DataFrame:
    return a.segment_pages(v.page_seq(spark, d)).select("doc_id", "page_no", "table_idx")


def d07_model_segments(spark, d) -> DataFrame:
    return a.segment_model_pages(v.page_seq(spark, d)).select("doc_id", "page_no", "table_idx")


def _cells(spark, d) -> DataFrame:
    w = v.words(spark, d).select("doc_id", "page_no", F.floor(F.col("seq") / 8).cast("int").alias("line"), (F.col("seq") % 8).cast("int").alias("col"), F.col("text"))
    idx = a.segment_pages(v.page_seq(spark, d)).select("doc_id", "page_no", "table_idx")
    label = w.where("col = 0").select("doc_id", "page_no", "line", F.substring("text", 1, 3).alias("label"))
    return w.where("col > 0").join(label, ["doc_id", "page_no", "line"]).join(idx, ["doc_id", "page_no"]).withColumnRenamed("text", "value")


def d08_merged_cells(spark, d) -> DataFrame:
    return a.merge_pages(_cells(spark, d)).select("doc_id", "table_idx", "label", "row", "position", "value")


def d09_merged_headers(spark, d) -> DataFrame:
    c = _cells(spark, d)
    heads = c.select("doc_id", "table_idx", "page_no").distinct().withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("name", F.concat_ws("-", "page_no", "col"))
    return a.merge_headers(heads, c).select("doc_id", "table_idx", "position", "name")


def d12_d17_spans(spark, d) -> DataFrame:
    p = a.segment_pages(v.page_seq(spark, d)).withColumn("is_ocr", F.col("page_no") % 4 == 3)
    spans = a.table_spans(p).withColumn("n_rows", F.size("pages") % 3).withColumn("table_no", F.when(F.col("doc_id") % 6 > 0, "1.1").otherwise(" "))
    chosen = spans.where("(doc_id + table_idx) % 4 <> 0")
    return a.selected_tables(spans, chosen).select("doc_id", "table_idx", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "page_first", "page_last", "is_ocr")


def d18_first_tables(spark, d) -> DataFrame:
    p = a.segment_pages(v.page_seq(spark, d)).withColumn("is_ocr", F.lit(False))
    return a.first_table(a.table_spans(p)).select("doc_id", "page_first", "page_last")


def _model_pages(spark, d) -> DataFrame:
    p = a.segment_model_pages(v.page_seq(spark, d).where("text is not null"))
    row = F.array(F.struct(F.col("page_no").cast("string").alias("label"), F.split("text", " ").alias("values")))
    heads = F.when(F.col("page_no") % 2 == 1, F.transform(F.split("text", " "), lambda x: F.concat(x, F.lit("'")))).otherwise(F.array().cast("array<string>"))
    return p.select("doc_id", "table_idx", "page_no", row.alias("rows"), heads.alias("headers"), F.when(F.col("page_no") % 3 == 0, F.concat(F.lit("total "), F.col("page_no").cast("string"))).alias("total"))


def d14_d15_model_merge(spark, d) -> DataFrame:
    m = a.merge_model_pages(_model_pages(spark, d))
    forced = F.transform("rows", lambda r: F.array_join(a.force_width(r["values"], F.col("n")), "|"))
    return m.select("doc_id", "table_idx", "n", "total", F.array_join("headers", "|").alias("headers"), F.array_join(forced, ";").alias("rows"))


def d16_already_loaded(spark, d) -> DataFrame:
    p = v.page_seq(spark, d).select((F.col("doc_id") % 20).alias("publication"), "table_no").distinct()
    return a.already_loaded(p, p.where("publication % 2 = 0 and table_no <> ''"))


def _labels(spark, d) -> DataFrame:
    n = F.col("c_name")
    j = v.read(spark, d, "customer").join(v.entities(spark, d), F.col("c_nationkey") == F.col("entity_id"))
    m, name = F.col("c_custkey") % 6, F.col("entity")
    label = F.when(m == 0, F.lower(name)).when(m == 1, F.concat(F.lit("3. "), name)).when(m == 2, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 30))).when(m == 3, F.concat(name, F.lit("X"))).when(m == 4, n).otherwise(name)
    return j.select("c_custkey", (F.col("c_custkey") % 40).alias("t"), label.alias("label"))


def _nations(spark, d) -> DataFrame:
    return v.entities(spark, d).select("entity")


def e06_exact_entities(spark, d) -> DataFrame:
    x = _labels(spark, d)
    return x.join(e.resolve_exact(x.select("label").distinct(), _nations(spark, d), "label"), "label", "left").select("c_custkey", "label", "entity")


def e07_similar_entities(spark, d) -> DataFrame:
    x = _labels(spark, d)
    return x.join(e.resolve(x.select("label").distinct(), _nations(spark, d), "label"), "label", "left").select("c_custkey", "label", "entity", F.round("ratio", 6).alias("ratio"))


def e07_edit_entities(spark, d) -> DataFrame:
    x = _labels(spark, d)
    return x.join(e.resolve_by_edits(x.select("label").distinct(), _nations(spark, d), "label"), "label", "left").select("c_custkey", "label", "entity", "edits")


def _rows(spark, d) -> DataFrame:
    x = _labels(spark, d)
    found = e.resolve_exact(x.select("label").distinct(), _nations(spark, d), "label")
    return x.join(found, "label", "left").select("t", "entity", s.is_grand_total(F.col("label"), "sub").alias("is_total"))


def d10_d11_row_kinds(spark, d) -> DataFrame:
    r = _rows(spark, d)
    return e.row_kind(r, ["t"], 14).join(e.row_kind_by_count(r, ["t"], 19).withColumnRenamed("row_kind", "by_count"), "t")


def f05_completeness(spark, d) -> DataFrame:
    return e.completeness(_rows(spark, d), _nations(spark, d), ["t"])


def f05_missing(spark, d) -> DataFrame:
    return e.missing_entities(_rows(spark, d), _nations(spark, d), ["t"])


_WORDS_HEAD = "SELECT w.*, w.top AS t FROM words w JOIN (SELECT DISTINCT conv_id AS doc_id, turn AS page_no FROM conversations) p USING (doc_id, page_no) WHERE w.top > 24 + page_no % 4 - 4 AND w.top < 70 + page_no % 5 * 12 - 1"
_CL = {
    "hw": "SELECT * EXCLUDE (t) FROM (" + _WORDS_HEAD + ")",
    "tops": "SELECT doc_id, page_no, list(DISTINCT top ORDER BY top) AS tops FROM hw GROUP BY ALL",
    "anch": "SELECT doc_id, page_no, list_reduce(list_transform(tops, lambda t: [t]), lambda a, x: CASE WHEN x[1] - a[-1] <= 4 THEN a ELSE list_concat(a, x) END) AS anchors FROM tops",
    "lined": "SELECT g.*, list_max(list_filter(anchors, lambda a: a <= top)) AS line_top FROM hw g JOIN anch USING (doc_id, page_no)",
    "blocks": """SELECT doc_id, page_no, line_top, block, string_agg(text, ' ' ORDER BY x0, seq) AS text, min(x0) AS x0, arg_max(x1, x0 * 100000 + seq) AS x1, max(bottom) AS bottom, bool_and(contains(lower(fontname), 'it')) AS italic
      FROM (SELECT *, sum(st) OVER (PARTITION BY doc_id, page_no, line_top ORDER BY x0, seq) AS block FROM (SELECT *, coalesce((x0 - lag(x1) OVER (PARTITION BY doc_id, page_no, line_top ORDER BY x0, seq) >= 8)::INT, 0) AS st FROM lined)) GROUP BY ALL""",
    "edges": "SELECT doc_id, page_no, list(DISTINCT x ORDER BY x) AS edges FROM (SELECT doc_id, page_no, unnest([x0, x1]) AS x FROM rule_cells) GROUP BY ALL",
    "cols": """SELECT doc_id, page_no, line_top, block, italic, sx0 AS span_x0, sx1 AS span_x1, col FROM (
      SELECT b.*, edges, coalesce(cx0, x0) AS sx0, coalesce(cx1, x1) AS sx1, unnest(range(0, len(edges) - 1)) AS col FROM blocks b JOIN edges USING (doc_id, page_no)
      LEFT JOIN (SELECT b.doc_id, b.page_no, b.line_top, b.block, arg_min(c.x0, ordinal) AS cx0, arg_min(c.x1, ordinal) AS cx1 FROM blocks b JOIN rule_cells c ON b.doc_id = c.doc_id AND b.page_no = c.page_no
        AND c.x0 - 5 <= b.x0 AND b.x1 <= c.x1 + 5 AND c.top - 5 <= b.line_top AND b.bottom <= c.bottom + 5 GROUP BY ALL) s USING (doc_id, page_no, line_top, block))
      WHERE NOT (sx1 - sx0 > (edges[-1] - edges[1]) * 0.55 AND length(trim(text)) > 30) AND (least(sx1, edges[col + 2]) - greatest(sx0, edges[col + 1]) > 5 OR (edges[col + 1] <= (sx0 + sx1) / 2 AND (sx0 + sx1) / 2 < edges[col + 2]))""",
}
_SEG = "SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY page_no) AS table_idx FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_no) = 1 OR (NOT continued AND table_no <> ''))::INT AS opens FROM page_seq)"
_MSEG = """SELECT * EXCLUDE (can, fst, before, opens), sum(opens) OVER (PARTITION BY doc_id ORDER BY page_no) AS table_idx FROM (
  SELECT *, (fst OR (can IS NOT NULL AND can <> coalesce(before, '')))::INT AS opens FROM (
  SELECT *, last_value(can IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
  SELECT *, fst0 AS fst, CASE WHEN fst0 OR (NOT continued AND table_no <> '') THEN table_no END AS can FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) = 1 AS fst0 FROM page_seq))))"""
_CELLS = {
    "seg": _SEG,
    "wd": "SELECT doc_id, page_no, seq // 8 AS line, seq % 8 AS col, text FROM words",
    "cells": "SELECT w.doc_id, w.page_no, w.line, w.col, w.text AS value, left(l.text, 3) AS label, table_idx FROM wd w JOIN wd l ON w.doc_id = l.doc_id AND w.page_no = l.page_no AND w.line = l.line AND l.col = 0 JOIN seg ON seg.doc_id = w.doc_id AND seg.page_no = w.page_no WHERE w.col > 0",
}
_IDTEXT = r"""SELECT doc_id, page_no, CASE (doc_id + page_no) % 6 WHEN 0 THEN 'Lanjutan Tabel ' || num || chr(10) || text WHEN 1 THEN 'x' || chr(10) || '  ' || num || ' ' || chr(10) || 'Sumber/Source : BPS ' || doc_id::VARCHAR || chr(10) || 'end'
  WHEN 2 THEN text || chr(10) || 'Sumber: Dinas' || chr(10) || 'Continued Table no ' || num ELSE text END AS text FROM (SELECT *, (doc_id % 9 + 1)::VARCHAR || '.' || (page_no % 3 + 1)::VARCHAR AS num FROM page_seq)"""
_LABELS = """SELECT c_custkey, c_custkey % 40 AS t, CASE c_custkey % 6 WHEN 0 THEN lower(entity) WHEN 1 THEN '3. ' || entity WHEN 2 THEN left(entity, 2) || substr(entity, 4, 30) WHEN 3 THEN entity || 'X' WHEN 4 THEN c_name ELSE entity END AS label
  FROM customer JOIN entities ON c_nationkey = entity_id"""
_ROWS = f"SELECT t, entity, contains(q, 'sub') AND NOT contains(q, 'dalam') AS is_total FROM (SELECT *, {sql_key('label')} AS key, regexp_replace(lower(label), '[^a-z ]', ' ', 'g') AS q FROM labels_) LEFT JOIN entities ON key <> '' AND key = {sql_key('entity')}"
_TITLE = """SELECT doc_id, page_no, seq, x0, top, CASE WHEN seq = 13 AND doc_id % 2 = 0 THEN '2023' WHEN seq = 8 AND doc_id % 4 > 0 THEN 'Tabel' ELSE text END AS text, doc_id % 3 <> 0 AND contains(lower(fontname), 'it') AS it FROM words"""

SQL = {
    "a04_model_json": """SELECT event_id, try_cast(json_extract_string(j, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(j, '$.k') AS BIGINT) IS NULL AS bad
      FROM (SELECT event_id, CASE event_id % 7 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE props END AS j FROM events)""",
    "a04_model_pages": v.with_views("page_seq", r"""SELECT doc_id, page_no, bad, CASE WHEN NOT bad THEN table_no END AS table_no, CASE WHEN NOT bad THEN continued END AS continued, CASE WHEN NOT bad THEN text END AS title,
      CASE WHEN NOT bad THEN array_to_string(list_transform(w, lambda x: x || '/u/' || page_no::VARCHAR), '|') END AS headers, CASE WHEN NOT bad THEN 'a:' || array_to_string(w, '|') || ';' || table_no || ':' || array_to_string(w, '|') END AS rows,
      CASE WHEN NOT bad AND page_no % 3 = 0 THEN array_to_string(w, '|') END AS total, true AS no_chapter FROM (SELECT *, string_split(text, ' ') AS w, (doc_id + page_no) % 8 IN (2, 3, 4, 5, 6) AS bad FROM page_seq WHERE text IS NOT NULL)"""),
    "a05_recognised_words": v.with_views("words", "SELECT doc_id, page_no, seq, c AS conf, x0 / 2 AS x0, x1 / 2 AS x1, top / 2 AS top, bottom / 2 AS bottom FROM (SELECT *, coalesce(try_cast(conf AS DOUBLE), -1) AS c FROM words) WHERE NOT (c >= 0 AND c < 30)"),
    "a06_page_kinds": v.with_views("words", "SELECT * FROM kinds", kinds=(_KINDS := r"""SELECT p.doc_id, p.page_no, CASE WHEN p.doc_id % 5 = 0 OR coalesce(n, 0) >= 60 THEN 'digital' ELSE 'scan' END AS kind FROM (SELECT conv_id AS doc_id, turn AS page_no FROM conversations) p
      LEFT JOIN (SELECT doc_id, page_no, count(*) FILTER (WHERE regexp_matches(text, '[\pL\pN_]')) AS n FROM words GROUP BY ALL) w USING (doc_id, page_no)""")),
    "a07_page_sources": v.with_views("words", """SELECT doc_id, page_no, seq, false AS is_ocr FROM words JOIN kinds USING (doc_id, page_no) WHERE NOT (kind = 'scan' AND (doc_id, page_no) IN (SELECT (doc_id, page_no) FROM rec))
      UNION ALL SELECT doc_id, page_no, seq + 100000, true FROM rec JOIN kinds USING (doc_id, page_no) WHERE kind = 'scan'""", kinds=_KINDS, rec="SELECT doc_id, page_no, seq FROM words WHERE NOT coalesce(try_cast(conf AS DOUBLE) >= 0 AND try_cast(conf AS DOUBLE) < 30, false)"),
    "c01_c02_word_blocks": v.with_views("words rule_cells", "SELECT * FROM blocks", **_CL),
    "c03_c05_header_columns": v.with_views("words rule_cells", "SELECT doc_id, page_no, line_top, block, span_x0, span_x1, col FROM cols", **_CL),
    "c06_upright": v.with_views("words rule_cells", "SELECT doc_id, page_no, line_top, block, col FROM (SELECT *, bool_or(NOT italic) OVER (PARTITION BY doc_id, page_no, col) AS up FROM cols) WHERE NOT (up AND italic)", **_CL),
    "c09_c10_header_names": v.with_views("names", r"""SELECT doc_id, col, trim(CASE WHEN year <> '' AND NOT regexp_matches(name, '[A-Za-z]') THEN '' ELSE name END) AS name, unit, year FROM (
      SELECT *, coalesce(at_end, CASE WHEN regexp_matches(whole, '^(19|20)[0-9]{2}') THEN whole END, CASE WHEN regexp_matches(digits, '^(19|20)[0-9]{2}') THEN digits END, '') AS year FROM (
      SELECT *, left(regexp_replace(name, '[^0-9]', '', 'g'), 4) AS digits FROM (
      SELECT doc_id, col, unit, CASE WHEN len(named) > 1 THEN '[' || named[1].name || '] ' || array_to_string(list_transform(named[2:], lambda p: p.name), ' ') ELSE coalesce(named[1].name, '') END AS name,
        list_filter(list_transform(named, lambda p: regexp_extract(substr(p.line, length(p.name) + 1), '(19|20)[0-9]{2}')), lambda y: y <> '')[1] AS at_end, left(regexp_replace(pure[1].line, '[^0-9]', '', 'g'), 4) AS whole FROM (
      SELECT *, list_filter(parts, lambda p: NOT (p.years OR p.name = '')) AS named, list_filter(parts, lambda p: p.years OR p.name = '') AS pure FROM (
      SELECT doc_id, col, list_transform(clean, lambda x: {'line': x, 'name': trim(regexp_replace(x, '\s+((19|20)[0-9]{2}([/\-–—](19|20)[0-9]{2})?\s*)+$', '')), 'years': regexp_matches(regexp_replace(x, '[\s/\-–—]', '', 'g'), '^((19|20)[0-9]{2})+$')}) AS parts,
        coalesce(list_filter(list_transform(list_filter(list_reverse(list_transform(regexp_extract_all(array_to_string(raw, ' '), '\(([^)]*)\)', 1), lambda p: trim(p))), lambda p: p NOT IN ('', '1', '2', '3', '4', '5', '6')), lambda p: trim(regexp_replace(trim(split_part(p, '/', 1)), '[a-z]\.[a-z].*', ''))), lambda p: p <> '')[1], '') AS unit FROM (
      SELECT doc_id, col, raw, list_filter(list_transform(raw, lambda x: trim(trim(trim(regexp_replace(regexp_replace(regexp_replace(x, '\([^)]*\)', '', 'g'), '(?i)/\s*(?:ENGLISH).*$', ''), '\s+', ' ', 'g')), ' /'))), lambda x: x <> '') AS clean FROM (
      SELECT name_id % 500 AS doc_id, name_id % 3 AS col, list(trim(CASE WHEN size % 6 = 0 THEN '2024/2025' ELSE name END) ORDER BY name_id) AS raw FROM names GROUP BY ALL)))))))""".replace("ENGLISH", "|".join(s.ENGLISH_HEADERS))),
    "c11_padded_headers": v.with_views("names", """SELECT t, position, coalesce(nullif(name, ''), 'Kolom ' || position::VARCHAR) AS name, coalesce(unit, '') AS unit, coalesce(year, '') AS year
      FROM (SELECT t, unnest(range(1, n + 1)) AS position FROM (SELECT t, max(position) + t % 3 AS n FROM (SELECT name_id % 300 AS t, name_id // 300 + 1 AS position FROM names) GROUP BY t))
      LEFT JOIN (SELECT name_id % 300 AS t, name_id // 300 + 1 AS position, CASE WHEN size % 4 > 0 THEN original ELSE '' END AS name, 'ton' AS unit, '2020' AS year FROM names) USING (t, position)"""),
    "d01_d02_d05_identity": v.with_views("page_seq", r"""SELECT doc_id, page_no, regexp_matches(text, 'Lanjutan|Continued') AS continued,
      coalesce(nullif(regexp_extract(text, '(?:Lanjutan\s+Tabel|Continued\s+Table)[^0-9]*([0-9]+(?:\.[0-9]+){1,3})', 1), ''), nullif(regexp_extract(text, '(?m)^\s*([0-9]+(?:\.[0-9]+){1,3})\s*$', 1), '')) AS table_no,
      trim(coalesce(nullif(regexp_extract(text, 'Sumber\s*/?\s*Source\s*:\s*(.+)', 1), ''), regexp_extract(text, 'Sumber\s*:\s*(.+)', 1))) AS source FROM idt""", idt=_IDTEXT),
    "d03_titles": v.with_views("words", r"""SELECT doc_id, page_no, coalesce(CASE WHEN some_it AND some_up THEN up WHEN regexp_matches(alls, '(19|20)[0-9]{2}') THEN trim(regexp_extract(alls, '^(.*?,?\s*(?:19|20)[0-9]{2})', 1)) ELSE alls END, '') AS title_id,
      coalesce(CASE WHEN some_it AND some_up THEN its WHEN regexp_matches(alls, '(19|20)[0-9]{2}') THEN trim(substr(alls, length(regexp_extract(alls, '^(.*?,?\s*(?:19|20)[0-9]{2})', 1)) + 1)) ELSE '' END, '') AS title_en
      FROM (SELECT DISTINCT doc_id, page_no FROM tw) LEFT JOIN (
        SELECT doc_id, page_no, string_agg(text, ' ' ORDER BY round_even(top, 0), x0, seq) AS alls, string_agg(text, ' ' ORDER BY round_even(top, 0), x0, seq) FILTER (WHERE NOT it) AS up, string_agg(text, ' ' ORDER BY round_even(top, 0), x0, seq) FILTER (WHERE it) AS its, bool_or(it) AS some_it, bool_or(NOT it) AS some_up
        FROM tw JOIN (SELECT doc_id, page_no, min(top) AS anchor FROM tw WHERE text IN ('Tabel', 'Table', 'Gambar', 'Figure') AND x0 < 75 GROUP BY ALL) USING (doc_id, page_no)
        WHERE x0 > 105 AND top >= anchor - 3 AND top < 24 + page_no % 4 + 40 - 3 GROUP BY ALL) USING (doc_id, page_no)""", tw=_TITLE),
    "d04_chapters": v.with_views("words", r"""SELECT doc_id, page_no, CASE WHEN bare <> '' AND NOT contains(upper(bare), 'DALAM ANGKA') AND length(bare) < 60 THEN array_to_string(list_transform(string_split(bare, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') ELSE '' END AS chapter FROM (
      SELECT doc_id, page_no, trim(regexp_replace(trim(string_agg(CASE WHEN seq > 0 THEN regexp_replace(text, '[^a-z]', '', 'g') WHEN doc_id % 4 = 0 THEN '3.1' WHEN doc_id % 4 = 1 THEN 'DALAM ANGKA' ELSE 'bab' END, ' ' ORDER BY x0, seq)), '^[0-9]+(?:\.[0-9]+)*\s*', '')) AS bare FROM words WHERE top < 26 GROUP BY ALL)"""),
    "d06_segments": v.with_views("page_seq", f"SELECT doc_id, page_no, table_idx FROM ({_SEG})"),
    "d07_model_segments": v.with_views("page_seq", f"SELECT doc_id, page_no, table_idx FROM ({_MSEG})"),
    "d08_merged_cells": v.with_views("page_seq words", """SELECT c.doc_id, c.table_idx, c.label, r.row, row_number() OVER (PARTITION BY c.doc_id, c.table_idx, c.label ORDER BY page_no, line, col) AS position, value FROM cells c
      JOIN (SELECT doc_id, table_idx, label, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY m) AS row FROM (SELECT doc_id, table_idx, label, min(page_no * 100000 + line) AS m FROM cells GROUP BY ALL)) r USING (doc_id, table_idx, label)""", **_CELLS),
    "d09_merged_headers": v.with_views("page_seq words", """SELECT doc_id, table_idx, row_number() OVER (PARTITION BY doc_id, table_idx ORDER BY page_no, k) AS position, page_no::VARCHAR || '-' || k::VARCHAR AS name FROM (
      SELECT DISTINCT c.doc_id, c.table_idx, c.page_no, unnest([1, 2, 3]) AS k FROM cells c JOIN (SELECT doc_id, table_idx, arg_min(label, page_no * 10000000 + line * 10 + col) AS label FROM cells GROUP BY ALL) f USING (doc_id, table_idx, label))""", **_CELLS),
    "d12_d17_spans": v.with_views("page_seq", f"""SELECT doc_id, table_idx, string_agg(page_no::VARCHAR, ',' ORDER BY page_no) AS pages, min(page_no) AS page_first, max(page_no) AS page_last, bool_or(page_no % 4 = 3) AS is_ocr
      FROM ({_SEG}) WHERE (doc_id + table_idx) % 4 <> 0 AND doc_id % 6 > 0 GROUP BY ALL HAVING count(*) % 3 > 0"""),
    "d18_first_tables": v.with_views("page_seq", f"SELECT doc_id, min(page_no) AS page_first, max(page_no) AS page_last FROM ({_SEG}) WHERE table_idx = 1 GROUP BY ALL"),
    "d14_d15_model_merge": v.with_views("page_seq", """SELECT doc_id, table_idx, n, total, heads AS headers, list_aggregate(list_transform(vals, lambda r: array_to_string(list_concat(r, list_transform(range(0, greatest(n - len(r), 0)), lambda i: '')), '|')), 'string_agg', ';') AS rows FROM (
      SELECT doc_id, table_idx, list(vals ORDER BY page_no) AS vals, arg_max(total, page_no) FILTER (WHERE total IS NOT NULL) AS total, array_to_string(arg_min(heads, page_no) FILTER (WHERE len(heads) > 0), '|') AS heads,
        greatest(max(len(vals)), coalesce(len(arg_min(heads, page_no) FILTER (WHERE len(heads) > 0)), 0)) AS n
      FROM (SELECT *, string_split(text, ' ') AS vals, CASE WHEN page_no % 2 = 1 THEN list_transform(string_split(text, ' '), lambda x: x || chr(39)) ELSE [] END AS heads, CASE WHEN page_no % 3 = 0 THEN 'total ' || page_no::VARCHAR END AS total FROM m) GROUP BY ALL)""",
      m=_MSEG.replace("FROM page_seq", "FROM page_seq WHERE text IS NOT NULL")),
    "d16_already_loaded": v.with_views("page_seq", "SELECT DISTINCT doc_id % 20 AS publication, table_no, (doc_id % 20) % 2 = 0 AND table_no <> '' AS loaded FROM page_seq"),
    "e06_exact_entities": v.with_views("entities", f"SELECT c_custkey, label, entity FROM (SELECT *, {sql_key('label')} AS key FROM labels_) LEFT JOIN entities ON key <> '' AND key = {sql_key('entity')}", labels_=_LABELS),
    "e07_edit_entities": v.with_views("entities", f"""SELECT c_custkey, label, entity, edits FROM (SELECT *, {sql_key('label')} AS key FROM labels_) LEFT JOIN (
      SELECT key, entity, ed AS edits FROM (SELECT key, entity, levenshtein(key, {sql_key('entity')}) AS ed FROM (SELECT DISTINCT {sql_key('label')} AS key FROM labels_), entities WHERE key <> '') WHERE ed <= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY ed, {sql_key('entity')} DESC) = 1) USING (key)""", labels_=_LABELS),
    "d10_d11_row_kinds": v.with_views("entities", "SELECT t, CASE WHEN count(DISTINCT entity) >= 14 THEN 'kecamatan' ELSE 'kategori' END AS row_kind, CASE WHEN count(entity) >= 19 THEN 'kecamatan' ELSE 'kategori' END AS by_count FROM r GROUP BY t", labels_=_LABELS, r=_ROWS),
    "f05_completeness": v.with_views("entities", "SELECT t, count(DISTINCT entity) AS found, (SELECT count(*) FROM entities) AS expected, bool_or(is_total) AS has_total, count(DISTINCT entity) = (SELECT count(*) FROM entities) AS complete FROM r GROUP BY t", labels_=_LABELS, r=_ROWS),
    "f05_missing": v.with_views("entities", "SELECT t, entity FROM (SELECT DISTINCT t FROM r), entities WHERE (t, entity) NOT IN (SELECT (t, entity) FROM r WHERE entity IS NOT NULL)", labels_=_LABELS, r=_ROWS),
}
QUERIES = {k: globals()[k] for k in [*SQL, "e07_similar_entities"]}
