"""From header words to column names, units and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as s
from .layout import PAGE


def is_italic(font: Column) -> Column:
    """Whether a font's name says italic or oblique."""
    low = F.lower(F.coalesce(font, F.lit("")))
    return low.contains("it") | low.contains("oblique")


def header_words(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """Words between the table's top and its column numbers. ``bounds``: table_top, colnum_top."""
    inside = words.join(bounds, PAGE).where((F.col("top") > F.col("table_top") - 4) & (F.col("top") < F.col("colnum_top") - 1))
    return inside.drop("table_top", "colnum_top")


def word_blocks(lined: DataFrame, gap: float = 8.0) -> DataFrame:
    """Blocks of consecutive words of a line less than ``gap`` apart: text, box, and whether all is italic."""
    w = Window.partitionBy(*PAGE, "line_top").orderBy("x0", "seq")
    start = F.coalesce((F.col("x0") - F.lag("x1").over(w) >= gap).cast("int"), F.lit(0))
    run = lined.withColumn("start", start).withColumn("block", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.array_sort(F.collect_list(F.struct("x0", "seq", "text")))
    return run.groupBy(*PAGE, "line_top", "block").agg(
        F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max_by("x1", F.struct("x0", "seq")).alias("x1"), F.max("bottom").alias("bottom"), F.bool_and(is_italic(F.col("fontname"))).alias("italic")
    )


def snap_to_cells(blocks: DataFrame, cells: DataFrame, slack: float = 5.0) -> DataFrame:
    """Blocks with the span of the first header cell around them, else their own."""
    c = cells.select(*PAGE, "ordinal", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("top").alias("ctop"), F.col("bottom").alias("cbottom"))
    inside = (F.col("cx0") - slack <= F.col("x0")) & (F.col("x1") <= F.col("cx1") + slack) & (F.col("ctop") - slack <= F.col("line_top")) & (F.col("bottom") <= F.col("cbottom") + slack)
    keys = [*PAGE, "line_top", "block"]
    hits = blocks.join(c, PAGE).where(inside).groupBy(*keys).agg(F.min_by(F.struct("cx0", "cx1"), "ordinal").alias("cell"))
    out = blocks.join(hits, keys, "left")
    return out.withColumn("span_x0", F.coalesce("cell.cx0", "x0")).withColumn("span_x1", F.coalesce("cell.cx1", "x1")).drop("cell")


def drop_titles(blocks: DataFrame, edges: DataFrame, share: float = 0.55, chars: int = 30) -> DataFrame:
    """Blocks but for long texts over more than ``share`` of the table's width; keeps ``edges``."""
    wide = blocks.join(edges.where("edges is not null"), PAGE)
    width = F.array_max("edges") - F.array_min("edges")
    return wide.where(~((width > 0) & (F.col("span_x1") - F.col("span_x0") > width * share) & (F.length(s.strip(F.col("text"))) > chars)))


def to_header_columns(blocks: DataFrame, least: float = 5.0) -> DataFrame:
    """Blocks by column: where they overlap more than ``least`` or have their middle; a block may be in several."""
    each = blocks.withColumn("col", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)))
    lo, hi = F.get(F.col("edges"), F.col("col")), F.get(F.col("edges"), F.col("col") + 1)
    mid = (F.col("span_x0") + F.col("span_x1")) / 2
    return each.where((F.least("span_x1", hi) - F.greatest("span_x0", lo) > least) | ((lo <= mid) & (mid < hi))).drop("edges")


def drop_italic(in_columns: DataFrame) -> DataFrame:
    """Where a column has upright blocks, only these."""
    w = Window.partitionBy(*PAGE, "col")
    return in_columns.withColumn("upright", F.bool_or(~F.col("italic")).over(w)).where(~(F.col("upright") & F.col("italic"))).drop("upright")


def parse_headers(in_columns: DataFrame) -> DataFrame:
    """(col, name, unit, year) of each column from its blocks, top to bottom."""
    ordered = F.array_sort(F.collect_list(F.struct("line_top", "block", F.trim("text").alias("text"))))
    lines = in_columns.groupBy(*PAGE, "col").agg(F.transform(ordered, lambda x: x["text"]).alias("raw"))
    clean = F.filter(F.transform("raw", lambda x: s.column_name(x)), lambda x: x != "")
    parts = F.transform(clean, lambda x: F.struct(x.alias("line"), s.without_years(x).alias("name"), s.only_years(x).alias("years")))
    return lines.select(*PAGE, "col", s.unit_of(F.array_join("raw", " ")).alias("unit"), parts.alias("parts")).select(*PAGE, "col", "unit", *_name_and_year(F.col("parts")))


def _name_and_year(parts: Column) -> list[Column]:
    pure = lambda p: p["years"] | (p["name"] == "")
    names = F.transform(F.filter(parts, lambda p: ~pure(p)), lambda p: p["name"])
    at_end = F.filter(F.transform(F.filter(parts, lambda p: ~pure(p)), lambda p: s.first_year(F.substr(p["line"], F.length(p["name"]) + 1))), lambda y: y != "")
    whole = F.get(F.transform(F.filter(parts, pure), lambda p: F.substring(F.regexp_replace(p["line"], "[^0-9]", ""), 1, 4)), F.lit(0))
    name = F.when(F.size(names) > 1, F.concat(F.lit("["), F.get(names, F.lit(0)), F.lit("] "), F.array_join(F.slice(names, 2, F.greatest(F.size(names), F.lit(1))), " "))).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("")))
    digits = F.substring(F.regexp_replace(name, "[^0-9]", ""), 1, 4)
    year_like = lambda x: F.when(x.rlike("^(?:19|20)[0-9]{2}"), x)
    year = F.coalesce(F.get(at_end, F.lit(0)), year_like(whole), year_like(digits), F.lit(""))
    return [s.strip(F.when((year != "") & ~name.rlike("[A-Za-z]"), "").otherwise(name)).alias("name"), year.alias("year")]


def pad_headers(headers: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Exactly n headers a table: missing ones are added, further ones go, unnamed ones become "Kolom N".

    ``headers``: keys, position from 1, name, unit, year; ``widths``: keys, n.
    """
    every = widths.select(*keys, F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))).alias("position"))
    out = every.join(headers, [*keys, "position"], "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    named = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Kolom "), F.col("position").cast("string")))
    return out.select(*keys, "position", named.alias("name"), blank(F.col("unit")).alias("unit"), blank(F.col("year")).alias("year"))
