"""From pages to tables: sources of pages, identity, segmentation, and merging over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as s
from .headers import is_italic
from .layout import PAGE

# The keys of a model's answer about a page, and their names in this library.
_HEADER_KEYS = {"nama": "name", "satuan": "unit", "tahun": "year"}
_PAGE_KEYS = {
    "nomor_tabel": "table_no", "lanjutan": "continued", "judul_id": "title_id", "judul_en": "title_en", "sumber": "source", "bab": "chapter",
    "headers": "headers", "label_kolom": "label_column", "rows": "rows", "total_row": "total_row",
}
_ROW = "struct<label:string,values:array<string>>"
_PAGE_TYPES = {"lanjutan": "boolean", "headers": f"array<struct<{','.join(f'{k}:string' for k in _HEADER_KEYS)}>>", "rows": f"array<{_ROW}>", "total_row": _ROW}
PAGE_JSON = f"struct<{','.join(f'{k}:{_PAGE_TYPES.get(k, "string")}' for k in _PAGE_KEYS)}>"


def parse_json(text: Column, schema: str) -> Column:
    """A model's answer without code fences as a struct; null where it is blank or isn't one whole JSON object."""
    bare = s.strip(F.regexp_replace(F.regexp_replace(s.strip0(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    # in brackets: what follows the object is an error, or a second member
    whole = F.concat(F.lit("["), bare, F.lit("]"))
    single = F.try_parse_json(whole).isNotNull() & (F.size(F.from_json(whole, "array<string>")) == 1)
    return F.when(bare.startswith("{") & single, F.from_json(bare, schema))


def parse_page_json(text: Column) -> Column:
    """A model's answer about a page, under this library's names; null where it can't be read, so the page can be set aside."""
    j = parse_json(text, PAGE_JSON)
    headers = F.transform(j["headers"], lambda h: F.struct(*[h[k].alias(n) for k, n in _HEADER_KEYS.items()]))
    return F.when(j.isNotNull(), F.struct(*[(headers if k == "headers" else j[k]).alias(n) for k, n in _PAGE_KEYS.items()]))


def unreadable_pages(answers: DataFrame, column: str) -> DataFrame:
    """Rows whose answer can't be read, to be asked for again."""
    return answers.where(parse_page_json(F.col(column)).isNull())


def recognised_words(words: DataFrame, dpi: float, least: float = 30.0) -> DataFrame:
    """Recognised words without blanks and without low confidence, in points. Unknown confidence is -1 and stays."""
    zoom = dpi / 72.0
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    real = words.withColumn("conf", conf).where((F.trim("text") != "") & ~((F.col("conf") >= 0) & (F.col("conf") < least)))
    return real.withColumns({c: F.col(c) / zoom for c in ("x0", "x1", "top", "bottom")})


def classify_pages(pages: DataFrame, words: DataFrame, least: int = 8) -> DataFrame:
    """(kind): digital from ``least`` words with a word character on, else scan; unreadable pages are digital.

    ``pages`` has ``readable``.
    """
    n = words.groupBy(*PAGE).agg(F.count_if(F.col("text").rlike(r"(?U)\w")).alias("n"))
    return pages.join(n, PAGE, "left").select(*PAGE, F.when(~F.col("readable") | (F.coalesce("n", F.lit(0)) >= least), "digital").otherwise("scan").alias("kind"))


def choose_source(kinds: DataFrame, digital: DataFrame, recognised: DataFrame, mode: str = "auto") -> DataFrame:
    """Each page's glyphs from one of two sources, with ``is_ocr``. ``mode``: auto, force or never.

    A page without recognised glyphs falls back to digital ones.
    """
    want = {"auto": F.col("kind") == "scan", "force": F.lit(True), "never": F.lit(False)}[mode]
    has = recognised.select(*PAGE).distinct().withColumn("has", F.lit(True))
    use = kinds.join(has, PAGE, "left").select(*PAGE, (want & F.coalesce("has", F.lit(False))).alias("is_ocr"))
    pick = lambda g, yes: g.join(use.where(F.col("is_ocr") == yes), PAGE)
    return pick(digital, False).unionByName(pick(recognised, True), allowMissingColumns=True)


def continued(text: Column) -> Column:
    return text.rlike("Lanjutan|Continued")


def table_number(text: Column) -> Column:
    """The number after a continuation's words, else a line that is only a number; null without one."""
    after = F.regexp_extract(text, r"(?:Lanjutan\s+Tabel|Continued\s+Table)[^0-9]*([0-9]+(?:\.[0-9]+){1,3})", 1)
    alone = F.regexp_extract(text, r"(?m)^\s*([0-9]+(?:\.[0-9]+){1,3})\s*$", 1)
    return F.coalesce(F.nullif(after, F.lit("")), F.nullif(alone, F.lit("")))


def source_line(text: Column) -> Column:
    """What follows "Sumber/Source:" in its line, or "Sumber:"."""
    both = F.regexp_extract(text, r"Sumber\s*/?\s*Source\s*:\s*(.+)", 1)
    return s.strip(F.coalesce(F.nullif(both, F.lit("")), F.regexp_extract(text, r"Sumber\s*:\s*(.+)", 1)))


def last_source(pages: DataFrame, keys: list[str]) -> DataFrame:
    """The source line of a table's last page that has one."""
    return pages.groupBy(*keys).agg(F.max_by(F.nullif(source_line(F.col("text")), F.lit("")), F.when(source_line(F.col("text")) != "", F.col("page_no"))).alias("source"))


def titles(words: DataFrame, tops: DataFrame) -> DataFrame:
    """(title_id, title_en): words right of the table's number, upright and italic, else split at the first year."""
    anchor = words.where(F.col("text").isin("Tabel", "Table", "Gambar", "Figure") & (F.col("x0") < 75)).groupBy(*PAGE).agg(F.min("top").alias("anchor"))
    pages = words.select(*PAGE).distinct().join(anchor, PAGE, "left").join(tops, PAGE, "left")
    region = words.where("x0 > 105").join(anchor, PAGE).join(tops, PAGE, "left").where((F.col("top") >= F.col("anchor") - 3) & (F.col("top") < F.coalesce("table_top", F.lit(9999.0)) - 3))
    part = lambda keep: s.squeeze(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.bround("top").alias("t"), "x0", "seq", "text")))), lambda x: x["text"]), " "))
    it = is_italic(F.col("fontname"))
    texts = region.groupBy(*PAGE).agg(part(~it).alias("up"), part(it).alias("it"), part(F.lit(True)).alias("all"), F.bool_or(it).alias("some_it"), F.bool_or(~it).alias("some_up"))
    head = F.regexp_extract("all", r"^(.*?,?\s*(?:19|20)[0-9]{2})", 1)
    both = F.col("some_it") & F.col("some_up")
    split = F.when(head != "", s.strip(head)).otherwise(F.col("all"))
    rest = F.when(head != "", s.strip(F.substr(F.col("all"), F.length(head) + 1))).otherwise("")
    out = texts.select(*PAGE, F.when(both, F.col("up")).otherwise(split).alias("title_id"), F.when(both, F.col("it")).otherwise(rest).alias("title_en"))
    return pages.select(*PAGE).join(out, PAGE, "left").select(*PAGE, F.coalesce("title_id", F.lit("")).alias("title_id"), F.coalesce("title_en", F.lit("")).alias("title_en"))


def chapter_names(words: DataFrame, below: float = 35.0) -> DataFrame:
    """(chapter) from the running head: without its number, in title case; blank for yearbook titles and long ones."""
    head = words.where(F.col("top") < below).groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda x: x["text"]), " ").alias("head"))
    bare = s.strip(F.regexp_replace(s.strip(F.col("head")), r"^[0-9]+(?:\.[0-9]+)*\s*", ""))
    ok = (bare != "") & ~F.upper(bare).contains("DALAM ANGKA") & (F.length(bare) < 60)
    return head.select(*PAGE, F.when(ok, F.initcap(bare)).otherwise("").alias("chapter"))


def segment_pages(pages: DataFrame) -> DataFrame:
    """Pages with ``table_idx``: a page with a number that is no continuation opens a table, so does the first."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    opens = (F.row_number().over(w) == 1) | (~F.col("continued") & (F.coalesce("table_no", F.lit("")) != ""))
    return pages.withColumn("opens", opens.cast("int")).withColumn("table_idx", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def segment_model_pages(pages: DataFrame) -> DataFrame:
    """The same for model pages: a table opens only where the number differs from that of the group's first page.

    That page's number is the latest one among pages that could have opened a group.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    number = F.coalesce("table_no", F.lit(""))
    first = F.row_number().over(w) == 1
    can = first | (~F.col("continued") & (number != ""))
    marked = pages.withColumn("can", F.when(can, number)).withColumn("first", first)
    before = F.last("can", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("first") | (F.col("can").isNotNull() & (F.col("can") != F.coalesce(before, F.lit(""))))
    return marked.withColumn("opens", opens.cast("int")).withColumn("table_idx", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("can", "first", "opens")


TABLE = ["doc_id", "table_idx"]


def merge_pages(cells: DataFrame) -> DataFrame:
    """Cells of a table with their final ``row`` and ``position``, in long form.

    ``cells``: table, page_no, line, col from 1, label, value. Cells of one label go on over pages as
    further columns; rows are in order of first appearance.
    """
    w = Window.partitionBy(*TABLE, "label").orderBy("page_no", "line", "col")
    placed = cells.withColumn("position", F.row_number().over(w))
    first = cells.groupBy(*TABLE, "label").agg(F.min(F.struct("page_no", "line")).alias("at"))
    ranked = first.withColumn("row", F.row_number().over(Window.partitionBy(*TABLE).orderBy("at"))).drop("at")
    return placed.join(ranked, [*TABLE, "label"])


def merge_headers(headers: DataFrame, cells: DataFrame) -> DataFrame:
    """Headers of the pages that have the table's first label, one after the other, with ``position``."""
    first = cells.groupBy(*TABLE).agg(F.min_by("label", F.struct("page_no", "line", "col")).alias("label"))
    across = cells.select(*TABLE, "page_no", "label").distinct().join(first, [*TABLE, "label"], "left_semi").select(*TABLE, "page_no").distinct()
    kept = headers.where("col > 0").join(across, [*TABLE, "page_no"], "left_semi")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(*TABLE).orderBy("page_no", "col"))).drop("page_no", "col")


def table_spans(pages: DataFrame) -> DataFrame:
    """Pages of each table: the list, the first and last, and whether any was recognised."""
    return pages.groupBy(*TABLE).agg(F.array_sort(F.collect_list("page_no")).alias("pages"), F.min("page_no").alias("page_first"), F.max("page_no").alias("page_last"), F.bool_or("is_ocr").alias("is_ocr"))


def force_width(values: Column, n: Column) -> Column:
    """A list of cells with exactly n members: blank ones are added, further ones go."""
    v = F.coalesce(values, F.array().cast("array<string>"))
    return F.slice(F.concat(v, F.array_repeat(F.lit(""), n.cast("int"))), F.lit(1), n.cast("int"))


def merge_model_pages(pages: DataFrame) -> DataFrame:
    """(headers, total, rows, n) of each table from its model pages: ``headers``, ``rows``, ``total`` per page.

    Rows of all pages in order, the last total, the first headers that there are, as wide as the widest.
    """
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", c))), lambda x: x[c]))
    has = F.size("headers") > 0
    out = pages.groupBy(*TABLE).agg(ordered("rows").alias("rows"), F.max_by("total", F.when(F.col("total").isNotNull(), F.col("page_no"))).alias("total"), F.min_by("headers", F.when(has, F.col("page_no"))).alias("headers"))
    widest = F.greatest(F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r["values"]))), F.lit(0)), F.coalesce(F.size("headers"), F.lit(0)))
    return out.withColumn("n", widest)


def already_loaded(tables: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables with ``loaded``: whether (publication, table_no) is in the catalog."""
    known = catalog.select("publication", "table_no").distinct().withColumn("loaded", F.lit(True))
    return tables.join(known, ["publication", "table_no"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(False)))


def selected_tables(tables: DataFrame, chosen: DataFrame) -> DataFrame:
    """Tables with rows and a number, of those that were chosen."""
    return tables.where((F.col("n_rows") > 0) & (s.strip0(F.col("table_no")) != "")).join(chosen.select(*TABLE).distinct(), TABLE, "left_semi")


def first_table(tables: DataFrame) -> DataFrame:
    """The first table of each document."""
    return tables.where("table_idx = 1")
