"""From glyphs and words of pages to exchange rows in one run: lines, columns, headers, identity, tables, checks.

Everything down to the rows of a page is keyed by page, rows are then keyed by table. What several steps need
(lines, edges, bounds, rows) is written into the shared folder once: one plan of all steps would compute glyph work
again in each branch, and a lost executor would begin anew. Rows are lines of the page; tables are by region where their labels
are known entities, else by category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.stages import stage
from ..operators import assembly as a
from ..operators import entities as e
from ..operators import headers as h
from ..operators import layout as y
from ..operators import validate as k

PAGE, TABLE = y.PAGE, a.TABLE


def dealt_by_page(df: DataFrame) -> DataFrame:
    """``df`` by page, in as many parts as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE)


def page_rows(glyphs: DataFrame, rule_cells: DataFrame, tops: DataFrame, phrase: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with label and cols, edges, bounds of the header) of all pages that have columns."""
    inked = stage(y.dedup_bold(dealt_by_page(y.drop_rotated(glyphs))))
    lined = stage(y.cluster_lines(inked, y.tolerances(inked)))
    lines = stage(y.line_texts(lined))
    edges = stage(y.column_edges(inked, rule_cells, tops))
    bounds = stage(y.column_number_tops(lines, tops))
    grid = y.to_columns(lined, edges).join(y.body_bounds(lines), PAGE).where("line_top > body_top AND line_top < body_bottom")
    return stage(y.split_rows(grid.select(*PAGE, "line_top", "cols"), phrase)), edges, bounds


def page_headers(words: DataFrame, rule_cells: DataFrame, edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(col, name, unit, year) of all pages."""
    blocks = stage(h.word_blocks(y.cluster_lines(h.header_words(words, bounds), 4.0)))
    spans = h.drop_titles(h.snap_to_cells(blocks, rule_cells), edges)
    return h.parse_headers(h.drop_italic(h.to_header_columns(spans)))


def page_tables(words: DataFrame, tops: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages with columns, with the table that each belongs to and what they say about it."""
    lines = y.line_texts(y.cluster_lines(words, 3.5), " ")
    texts = lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_top", "text"))), lambda x: x["text"]), "\n").alias("text"))
    said = texts.select(*PAGE, a.continued(F.col("text")).alias("continued"), a.table_number(F.col("text")).alias("table_no"), a.source_line(F.col("text")).alias("source"))
    said = said.join(a.titles(words, tops), PAGE, "left").join(a.chapter_names(words), PAGE, "left")
    return stage(a.segment_pages(y.with_columns_only(said, edges)))


def exchange_rows(glyphs: DataFrame, words: DataFrame, rule_cells: DataFrame, rule_edges: DataFrame, master: DataFrame, area: str, phrase: str) -> DataFrame:
    """The tables of all pages as rows to load, checked against their totals and with single gaps filled."""
    tops = stage(y.table_tops(rule_edges, rule_cells))
    rows, edges, bounds = page_rows(glyphs, rule_cells, tops, phrase)
    words = stage(dealt_by_page(words))
    pages = page_tables(words, tops, edges)
    of_table = rows.join(pages.select(*PAGE, "table_idx"), PAGE)
    cells = of_table.select(*TABLE, "page_no", F.col("line_top").alias("line"), "label", "is_total", F.posexplode(F.slice("cols", F.lit(2), F.size("cols"))).alias("at", "value")).withColumn("col", F.col("at") + 1).drop("at")

    merged = stage(a.merge_pages(cells))
    widths = merged.groupBy(*TABLE).agg(F.max("position").alias("n"))
    headers = page_headers(words, rule_cells, edges, bounds).join(pages.select(*PAGE, "table_idx"), PAGE)
    named = h.pad_headers(a.merge_headers(headers, cells), widths, TABLE)

    typed = merged.withColumn("c", s.clean_num(F.col("value"))).select(*TABLE, "row", "position", "label", "is_total", F.col("c.text").alias("text"), F.col("c.num").alias("num"), F.col("c.flag").alias("flag"))
    repaired = stage(k.repair_gaps(typed, TABLE))
    known = e.resolve_exact(repaired.select("label").distinct(), master, "label")
    kinds = e.row_kind(repaired.join(known, "label", "left").select(*TABLE, "entity"), TABLE).withColumnRenamed("row_kind", "kind")

    first = F.min_by(F.struct("table_no", "title_id", "title_en", "chapter"), "page_no").alias("f")
    tables = pages.groupBy(*TABLE).agg(first, F.max_by("source", F.when(F.col("source") != "", F.col("page_no"))).alias("source")).select(*TABLE, "f.*", "source")
    full = repaired.join(named, [*TABLE, "position"]).join(tables, TABLE).join(kinds, TABLE).join(known, "label", "left")
    by_region = F.col("kind") == "kecamatan"
    return full.select(
        F.struct(*TABLE, "row", "position").alias("_seq"), "chapter", "table_no", F.col("title_id").alias("title"), "title_en",
        F.when(F.col("is_total") | ~by_region, area).otherwise(F.coalesce("entity", "label")).alias("region"), F.when(by_region | F.col("is_total"), "").otherwise(F.col("label")).alias("category"),
        F.col("name").alias("indicator"), "unit", "year", F.col("num").cast("string").alias("value_num"), F.col("text").alias("value_text"), "flag", "source",
    )
