"""Queries over the layout operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import layout as y
from . import views as v

PHRASE = "kabupaten tasikmalaya"


def joined(col: str) -> F.Column:
    """An array of doubles as text with one decimal, for comparison."""
    return F.array_join(F.transform(col, lambda e: F.format_string("%.1f", e)), ",").alias(col)


def a02_a03_page_range(spark, d) -> DataFrame:
    cells, _ = v.rules(spark, d)
    pages = v.page_seq(spark, d).select("doc_id", "page_no")
    return y.with_columns_only(y.page_range(pages, 4, 1), y.ruled_edges(cells))


def b01_b02_watermarks(spark, d) -> DataFrame:
    return y.drop_black_ink(y.drop_rotated(v.glyphs(spark, d))).select("doc_id", "page_no", "seq")


def b03_dedup_bold(spark, d) -> DataFrame:
    return y.dedup_bold(v.glyphs(spark, d)).select("doc_id", "page_no", "seq", "text")


def b04_dedup_line(spark, d) -> DataFrame:
    g = v.glyphs(spark, d)
    return y.dedup_bold(y.cluster_lines(g, y.tolerances(g)), line=["line_top"]).select("doc_id", "page_no", "line_top", "seq")


def b05_b07_lines(spark, d) -> DataFrame:
    g = v.glyphs(spark, d)
    return y.line_texts(y.cluster_lines(g, y.tolerances(g)))


def b08_b09_page_text(spark, d) -> DataFrame:
    return y.page_texts(y.word_glyphs(v.words(spark, d)))


def b10_gutters(spark, d) -> DataFrame:
    w = v.words(spark, d)
    wide = y.gutter_edges(w).select(*y.PAGE, joined("edges"))
    return wide.join(y.gutter_edges(w, 7.0).select(*y.PAGE, joined("edges").alias("edges7")), y.PAGE)


def b11_b12_edges(spark, d) -> DataFrame:
    cells, edges = v.rules(spark, d)
    return y.column_edges(v.words(spark, d), cells, y.table_tops(edges, cells)).select(*y.PAGE, joined("edges"))


def b13_b14_columns(spark, d) -> DataFrame:
    w = v.words(spark, d)
    cells, edges = v.rules(spark, d)
    lined = y.cluster_lines(w, 4.0)
    cols = y.to_columns(lined, y.column_edges(w, cells, y.table_tops(edges, cells)))
    return cols.select(*y.PAGE, "line_top", F.array_join("cols", "|").alias("cols"))


def b15_table_tops(spark, d) -> DataFrame:
    cells, edges = v.rules(spark, d)
    return y.table_tops(edges, cells)


def b16_column_numbers(spark, d) -> DataFrame:
    cells, edges = v.rules(spark, d)
    return y.column_number_tops(v.lines(spark, d), y.table_tops(edges, cells))


def b17_b18_bounds(spark, d) -> DataFrame:
    ln = v.lines(spark, d)
    old = y.legacy_body_bounds(ln).select(*y.PAGE, F.col("body_top").alias("old_top"), F.col("body_bottom").alias("old_bottom"))
    return y.body_bounds(ln).join(old, y.PAGE)


def _anchors(spark, d) -> DataFrame:
    from ..operators.entities import resolve_exact

    ln = v.lines(spark, d)
    master = v.entities(spark, d)
    return y.anchors(ln, resolve_exact(ln.select("label").distinct(), master, "label"), PHRASE)


def b19_anchors(spark, d) -> DataFrame:
    return _anchors(spark, d)


def b20_bands(spark, d) -> DataFrame:
    g = v.words(spark, d).select("doc_id", "page_no", "seq", (F.col("top") * 2).alias("top"))
    return y.in_bands(g, y.bands(_anchors(spark, d))).select(*y.PAGE, "seq", "line_top", "entity", "lo", "hi")


def b21_b22_category_rows(spark, d) -> DataFrame:
    return y.split_rows(v.lines(spark, d), PHRASE).select(*y.PAGE, "line_top", "label", "is_total")


def b23_legacy_rows(spark, d) -> DataFrame:
    ln = v.lines(spark, d)
    return ln.select(*y.PAGE, "line_top", s.legacy_label(F.col("label")).alias("label")).where(F.col("label") != "")


def b24_rule_segments(spark, d) -> DataFrame:
    w = v.words(spark, d)
    pieces = w.select(*y.PAGE, "x0", (F.col("x0") + 59.5).alias("x1"), (F.floor(F.col("top") / 12) * 12.0).alias("top"))
    merged = y.merge_segments(pieces)
    return y.blocks_over_rules(w.select(*y.PAGE, "seq", "x0", "x1", (F.col("bottom") - 9).alias("bottom")), merged).select(*y.PAGE, "seq", "rule_x0", "rule_x1", "rule_top")


_CLUSTER = {
    "tops": "SELECT doc_id, page_no, list(DISTINCT top ORDER BY top) AS tops FROM {src} GROUP BY ALL",
    "anch": "SELECT doc_id, page_no, list_reduce(list_transform(tops, lambda t: [t]), lambda a, x: CASE WHEN x[1] - a[-1] <= tol THEN a ELSE list_concat(a, x) END) AS anchors FROM tops JOIN tol USING (doc_id, page_no)",
    "lined": "SELECT g.*, list_max(list_filter(anchors, lambda a: a <= top)) AS line_top FROM {src} g JOIN anch USING (doc_id, page_no)",
}


def _cluster(src: str, tol: str) -> dict[str, str]:
    return {"tol": tol} | {k: q.format(src=src) for k, q in _CLUSTER.items()}


_MEDIAN_TOL = "SELECT doc_id, page_no, median(size) * 0.4 AS tol FROM glyphs GROUP BY ALL"
_fixed = lambda src, t: f"SELECT DISTINCT doc_id, page_no, {t}::DOUBLE AS tol FROM {src}"
_NEAR = "abs(x[1].x0 - a[-1].x0) < 2 AND abs(x[1].top - a[-1].top) < 2 AND x[1].text = a[-1].text"
_FOLD = f"list_reduce(list_transform(g, lambda e: [e]), lambda a, x: CASE WHEN {_NEAR} THEN a ELSE list_concat(a, x) END)"
_RULED = "SELECT doc_id, page_no, list(DISTINCT round(x, 1) ORDER BY round(x, 1)) AS edges FROM (SELECT doc_id, page_no, unnest([x0, x1]) AS x FROM rule_cells) GROUP BY ALL HAVING count(DISTINCT round(x, 1)) >= 3"
_TOPS = "SELECT doc_id, page_no, coalesce(rule, box) AS table_top FROM (SELECT doc_id, page_no, min(top) AS rule FROM rule_edges WHERE top = bottom AND x1 - x0 > 200 GROUP BY ALL) FULL JOIN (SELECT doc_id, page_no, min(top) AS box FROM rule_cells GROUP BY ALL) USING (doc_id, page_no)"


def _gutter(src: str, gap: str) -> str:
    return f"""SELECT doc_id, page_no, CASE WHEN len(edges) >= 3 THEN edges END AS edges FROM (
      SELECT doc_id, page_no, list(DISTINCT round(e, 1) ORDER BY round(e, 1)) AS edges FROM (
        SELECT doc_id, page_no, unnest([l, r]) AS e FROM (SELECT doc_id, page_no, min(x0) AS l, max(x1) AS r FROM {src} GROUP BY ALL)
        UNION ALL
        SELECT doc_id, page_no, (j + k) / 2 + l FROM (
          SELECT w.doc_id, w.page_no, l, gap, floor(before - l) + 1 AS j, floor(x0 - l) AS k
          FROM (SELECT *, max(x1) OVER (PARTITION BY doc_id, page_no ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {src}) w
          JOIN (SELECT doc_id, page_no, min(x0) AS l, {gap} AS gap FROM {src} GROUP BY ALL) b ON w.doc_id = b.doc_id AND w.page_no = b.page_no) WHERE k - j >= gap)
      GROUP BY ALL)"""


_EDGES = {
    "tt": _TOPS,
    "body": "SELECT w.* FROM words w LEFT JOIN tt USING (doc_id, page_no) WHERE w.top > coalesce(table_top - 5, 130) AND w.top < 560",
    "edges": f"SELECT doc_id, page_no, coalesce(a.edges, b.edges) AS edges FROM ({_RULED}) a FULL JOIN ({_gutter('body', 'median(x1 - x0) * 1.5')}) b USING (doc_id, page_no)",
}
_TEXT = lambda c: f"array_to_string(list_transform({c}, lambda e: format('{{:.1f}}', e)), ',')"
_ANCHORS = r"""SELECT doc_id, page_no, line_top, CASE WHEN NOT is_total THEN entity END AS entity, is_total FROM (
  SELECT l.*, entity, contains(q, 'kabupaten tasikmalaya') AND NOT contains(q, 'dalam') AS is_total
  FROM (SELECT *, regexp_replace(lower(label), '[^a-z ]', ' ', 'g') AS q, lower(regexp_replace(regexp_replace(label, '^\s*[0-9]+[.)]?\s*', ''), '[^A-Za-z]', '', 'g')) AS key FROM lines) l
  LEFT JOIN (SELECT entity, lower(entity) AS nkey FROM entities) ON key = nkey AND key <> '')
WHERE n >= 3 AND line_top >= 130 AND (is_total OR entity IS NOT NULL)"""
_COLNUM = r"regexp_full_match(trim(text), '(?:\(\d+\)\s*){2,}')"
_NOTE = r"regexp_matches(text, 'Catatan/|Sumber/|Note\s*:|Source\s*:')"

SQL = {
    "a02_a03_page_range": v.with_views("page_seq rule_cells", "SELECT doc_id, page_no FROM page_seq WHERE page_no BETWEEN 1 AND 4 AND (doc_id, page_no) IN (SELECT (doc_id, page_no) FROM rule_cells)"),
    "b01_b02_watermarks": v.with_views("glyphs", "SELECT doc_id, page_no, seq FROM glyphs WHERE NOT (abs(matrix[2]) > 0.1 OR abs(matrix[3]) > 0.1) AND NOT (len(color) > 0 AND len(list_filter(color, lambda c: abs(c) < 0.04)) = len(color))"),
    "b03_dedup_bold": v.with_views("glyphs", f"SELECT doc_id, page_no, k.seq AS seq, k.text AS text FROM (SELECT doc_id, page_no, unnest({_FOLD}) AS k FROM (SELECT doc_id, page_no, list({{'top': top, 'x0': x0, 'seq': seq, 'text': text}} ORDER BY top, x0, seq) AS g FROM glyphs GROUP BY ALL))"),
    "b04_dedup_line": v.with_views("glyphs", f"SELECT doc_id, page_no, line_top, k.seq AS seq FROM (SELECT doc_id, page_no, line_top, unnest({_FOLD}) AS k FROM (SELECT doc_id, page_no, line_top, list({{'top': top, 'x0': x0, 'seq': seq, 'text': text}} ORDER BY x0, seq) AS g FROM lined GROUP BY ALL))", **_cluster("glyphs", _MEDIAN_TOL)),
    "b05_b07_lines": v.with_views("glyphs", "SELECT doc_id, page_no, line_top, count(*) AS n, string_agg(text, '' ORDER BY x0, seq) AS text FROM lined GROUP BY ALL", **_cluster("glyphs", _MEDIAN_TOL)),
    "b08_b09_page_text": v.with_views(
        "words",
        r"SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY line_top) AS text FROM (SELECT doc_id, page_no, line_top, string_agg(text, '' ORDER BY x0, seq) AS line FROM lined GROUP BY ALL) GROUP BY ALL",
        **_cluster("words", _fixed("words", 3.5)),
    ),
    "b10_gutters": v.with_views("words", f"SELECT doc_id, page_no, {_TEXT('a.edges')} AS edges, {_TEXT('b.edges')} AS edges7 FROM ({_gutter('words', 'median(x1 - x0) * 1.5')}) a JOIN ({_gutter('words', '7')}) b USING (doc_id, page_no)"),
    "b11_b12_edges": v.with_views("words rule_cells rule_edges", f"SELECT doc_id, page_no, {_TEXT('edges')} AS edges FROM edges", **_EDGES),
    "b13_b14_columns": v.with_views(
        "words rule_cells rule_edges",
        r"""SELECT doc_id, page_no, line_top, string_agg(coalesce(cell, ''), '|' ORDER BY i) AS cols FROM (
        SELECT l.doc_id, l.page_no, l.line_top, i, cell FROM (SELECT DISTINCT doc_id, page_no, line_top, unnest(range(0, len(edges) - 1)) AS i FROM placed) l
        LEFT JOIN (SELECT doc_id, page_no, line_top, col, trim(regexp_replace(string_agg(text, '' ORDER BY x0, seq), '\s+', ' ', 'g')) AS cell FROM placed GROUP BY ALL) c ON l.doc_id = c.doc_id AND l.page_no = c.page_no AND l.line_top = c.line_top AND l.i = c.col) GROUP BY ALL""",
        **_EDGES, **_cluster("words", _fixed("words", 4)), placed="SELECT l.*, edges, len(list_filter(edges, lambda e: e <= (x0 + x1) / 2)) - 1 AS col FROM lined l JOIN edges USING (doc_id, page_no) WHERE edges IS NOT NULL",
    ),
    "b15_table_tops": v.with_views("rule_cells rule_edges", _TOPS),
    "b16_column_numbers": v.with_views(
        "lines rule_cells rule_edges",
        rf"""SELECT doc_id, page_no, coalesce(min(line_top) FILTER (WHERE line_top >= t - 2 AND {_COLNUM}), min(line_top) FILTER (WHERE line_top > t AND regexp_matches(trim(text), '\(\d+\)')), min(t) + 80) AS colnum_top, min(t) AS table_top
        FROM (SELECT l.*, coalesce(table_top, 110) AS t FROM lines l LEFT JOIN tt USING (doc_id, page_no)) GROUP BY ALL""",
        tt=_TOPS,
    ),
    "b17_b18_bounds": v.with_views(
        "lines",
        rf"""SELECT doc_id, page_no, coalesce(max(line_top) FILTER (WHERE {_COLNUM} AND (stop IS NULL OR line_top <= stop)) + 4, 130) AS body_top, coalesce(min(stop) - 2, 9999) AS body_bottom,
        coalesce(min(line_top) FILTER (WHERE starts_with(trim(text), '(1)') AND (stop IS NULL OR line_top < stop)) + 4, 150) AS old_top, coalesce(min(stop) - 2, 540) AS old_bottom
        FROM (SELECT *, min(CASE WHEN {_NOTE} THEN line_top END) OVER (PARTITION BY doc_id, page_no) AS stop FROM lines) GROUP BY ALL""",
    ),
    "b19_anchors": v.with_views("lines entities", _ANCHORS),
    "b20_bands": v.with_views(
        "lines words entities",
        """SELECT w.doc_id, w.page_no, w.seq, line_top, entity, lo, hi FROM words w JOIN (
        SELECT *, coalesce((lag(line_top) OVER p + line_top) / 2, line_top - 5) AS lo, coalesce((lead(line_top) OVER p + line_top) / 2, line_top + 6) AS hi FROM a WINDOW p AS (PARTITION BY doc_id, page_no ORDER BY line_top)) b
        ON w.doc_id = b.doc_id AND w.page_no = b.page_no AND lo < w.top * 2 AND w.top * 2 <= hi""",
        a=_ANCHORS,
    ),
    "b21_b22_category_rows": v.with_views(
        "lines",
        r"""SELECT doc_id, page_no, line_top, used AS label, contains(regexp_replace(lower(used), '[^a-z ]', ' ', 'g'), 'kabupaten tasikmalaya') AND NOT contains(regexp_replace(lower(used), '[^a-z ]', ' ', 'g'), 'dalam') AS is_total FROM (
        SELECT *, coalesce(lab, last_value(CASE WHEN NOT hv THEN lab END IGNORE NULLS) OVER (PARTITION BY doc_id, page_no, segment ORDER BY line_top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS used FROM (
        SELECT *, coalesce(sum(hv::INT) OVER (PARTITION BY doc_id, page_no ORDER BY line_top ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM (
        SELECT *, len(list_filter(cols[2:], lambda c: regexp_matches(c, '[0-9]') OR trim(c) IN ('-', '–', '—'))) > 0 AS hv, CASE WHEN regexp_matches(nl, '[A-Za-z0-9]') THEN nl END AS lab FROM (SELECT *, trim(translate(cols[1], '–—û', '---')) AS nl FROM lines)))) WHERE hv AND used IS NOT NULL""",
    ),
    "b23_legacy_rows": v.with_views("lines", r"SELECT doc_id, page_no, line_top, trim(regexp_replace(label, '^[0-9.\s]+', '')) AS label FROM lines WHERE trim(regexp_replace(label, '^[0-9.\s]+', '')) <> ''"),
    "b24_rule_segments": v.with_views(
        "words",
        """SELECT w.doc_id, w.page_no, w.seq, r.x0 AS rule_x0, r.x1 AS rule_x1, r.top AS rule_top FROM words w JOIN (
        SELECT doc_id, page_no, top, run, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(CASE WHEN x0 - before >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no, top ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (
        SELECT *, max(x1) OVER (PARTITION BY doc_id, page_no, top ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT doc_id, page_no, x0, x0 + 59.5 AS x1, floor(top / 12) * 12 AS top FROM words))) GROUP BY ALL) r
        ON w.doc_id = r.doc_id AND w.page_no = r.page_no AND r.top - (w.bottom - 9) BETWEEN 0 AND 20 AND (w.x0 + w.x1) / 2 BETWEEN r.x0 AND r.x1""",
    ),
}
QUERIES = {k: globals()[k] for k in SQL}
