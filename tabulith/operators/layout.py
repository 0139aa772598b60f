"""From glyphs to a grid of cells. Frames are keyed by PAGE = (doc_id, page_no): one shuffle serves all.

A page holds at most some thousands of glyphs, so folds over a page's sorted array are bounded; what
can be a window or an aggregate is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as s

PAGE = ["doc_id", "page_no"]
COLUMN_NUMBERS = r"^(?:\(\d+\)\s*){2,}$"
NOTES = r"Catatan/|Sumber/|Note\s*:|Source\s*:"


def _page() -> Window:
    return Window.partitionBy(*PAGE)


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of a range given in either order."""
    return pages.where(F.col("page_no").between(min(first, last), max(first, last)))


def with_columns_only(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages that have column edges: others have no table."""
    return pages.join(edges.where("edges is not null").select(*PAGE).distinct(), PAGE, "left_semi")


def drop_rotated(glyphs: DataFrame) -> DataFrame:
    """Without rotated watermarks: glyphs whose matrix leans by more than 0.1."""
    m = F.col("matrix")
    return glyphs.where(~F.coalesce((F.size(m) >= 4) & ((F.abs(F.get(m, F.lit(1))) > 0.1) | (F.abs(F.get(m, F.lit(2))) > 0.1)), F.lit(False)))


def drop_black_ink(glyphs: DataFrame) -> DataFrame:
    """Without watermarks in near-black: glyphs with a colour, all of whose parts are below 0.04."""
    c = F.col("color")
    return glyphs.where(~F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: F.abs(x) < 0.04), F.lit(False)))


#: Items that one fold goes over: a fold copies what it has kept at each step.
BLOCK = 1000


def _keep_first(items: Column, near: Callable[[Column, Column], Column]) -> Column:
    """Members of a sorted array that aren't ``near`` (member, last kept one); the first is always kept.

    A fold of blocks, each of them a fold of its members, so that n items cost n * BLOCK + n^2 / BLOCK copies at most.
    """
    rest = F.size(items) - 1
    starts = F.slice(F.sequence(F.lit(0), F.floor(rest / BLOCK)), F.lit(1), F.ceil(rest / BLOCK).cast("int"))

    def add_block(kept: Column, i: Column) -> Column:
        block = F.transform(F.sequence(i * BLOCK + 1, F.least(rest, (i + 1) * BLOCK)), lambda k: F.get(items, k.cast("int")))
        own = F.aggregate(block, kept["last"], lambda done, x: F.when(near(x, F.element_at(done, -1)), done).otherwise(F.concat(done, F.array(x))))
        # the last one before the block leads the block's own
        ends = lambda o: F.struct(F.concat(kept["done"], F.array(F.slice(o, F.lit(2), F.size(o)))).alias("done"), F.slice(o, -1, 1).alias("last"))
        return F.get(F.transform(F.array(own), ends), F.lit(0))

    first = F.slice(items, 1, 1)
    return F.aggregate(starts, F.struct(F.array(first).alias("done"), first.alias("last")), add_block, lambda kept: F.flatten(kept["done"]))


def _overprint(g: Column, last: Column) -> Column:
    return (F.abs(g["x0"] - last["x0"]) < 2) & (F.abs(g["top"] - last["top"]) < 2)


def dedup_bold(glyphs: DataFrame, line: list[str] | None = None) -> DataFrame:
    """Without second prints of fake bold: glyphs like the last kept one, less than 2 away.

    In (top, x0) order of a page, or in x0 order of the lines that ``line`` names. The last kept glyph
    has the text of the one before, so only runs of equal text are folded. A glyph that is 2 or more behind the one
    before it in the leading order is that far from all before, so it begins a run too.
    """
    keys = [*PAGE, *(line or [])]
    order = [F.col("x0"), F.col("seq")] if line else [F.col("top"), F.col("x0"), F.col("seq")]
    w = Window.partitionBy(*keys).orderBy(*order)
    lead = "x0" if line else "top"
    far = F.coalesce(F.col(lead) - F.lag(lead).over(w) >= 2, F.lit(False))
    changed = (F.coalesce(F.lag("text").over(w) != F.col("text"), F.lit(True)) | far).cast("int")
    marked = glyphs.withColumn("changed", changed)
    marked = marked.withColumn("run", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("again", F.coalesce(F.lead("changed").over(w) == 0, F.lit(False)))
    alone = marked.where("changed = 1 and not again")
    first = ["x0", "seq"] if line else ["top", "x0", "seq"]
    rest = [c for c in glyphs.columns if c not in [*first, *keys]]
    runs = marked.where("changed = 0 or again").groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct(*first, *rest))).alias("g"))
    folded = runs.select(*keys, F.inline(_keep_first(F.col("g"), _overprint)))
    return alone.select(*glyphs.columns).unionByName(folded.select(*glyphs.columns))


def tolerances(glyphs: DataFrame, factor: float = 0.4) -> DataFrame:
    """Line tolerance of each page: a share of the median glyph size, 4 without sizes."""
    # a page has few sizes: a hash aggregate counts them, and the median is taken of the counts
    sizes = glyphs.groupBy(*PAGE, "size").agg(F.count("*").alias("n"))
    return sizes.groupBy(*PAGE).agg((F.coalesce(F.percentile("size", 0.5, F.col("n")), F.lit(10.0)) * factor).alias("tol"))


def cluster_lines(items: DataFrame, tol: DataFrame | float) -> DataFrame:
    """``items`` with ``line_top``, the top of the first item of their line.

    In order of tops, an item joins the newest line if its top is within the tolerance of the line's
    first. A top that is further than the tolerance from the one before begins a line whatever came before,
    so only runs of distinct tops between such gaps are folded. Items find their line by a running maximum.
    """
    w = Window.partitionBy(*PAGE).orderBy("top")
    tops = items.select(*PAGE, "top").where("top is not null").distinct()
    tops = tops.join(tol, PAGE) if isinstance(tol, DataFrame) else tops.withColumn("tol", F.lit(float(tol)))
    far = F.coalesce(F.col("top") - F.lag("top").over(w) > F.col("tol"), F.lit(True))
    runs = tops.withColumn("far", far.cast("int")).withColumn("run", F.sum("far").over(w)).groupBy(*PAGE, "run").agg(F.array_sort(F.collect_list("top")).alias("tops"), F.first("tol").alias("tol"))
    first = runs.select(*PAGE, F.explode(_keep_first(F.col("tops"), lambda x, last: x - last <= F.col("tol"))).alias("top"))
    marked = items.withColumn("first_top", F.lit(None).cast("double")).unionByName(first.withColumn("first_top", F.col("top")).withColumn("mark", F.lit(True)), allowMissingColumns=True)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("line_top", F.max("first_top").over(upto)).where("mark is null").drop("first_top", "mark")


def line_texts(lined: DataFrame, sep: str = "") -> DataFrame:
    """(line_top, n, text) of each line, items joined in x order."""
    texts = F.sort_array(F.collect_list(F.struct("x0", "seq", "text")))["text"]
    return lined.groupBy(*PAGE, "line_top").agg(F.count("*").alias("n"), F.array_join(texts, sep).alias("text"))


def page_texts(glyphs: DataFrame, tol: float = 3.5) -> DataFrame:
    """Each page's lines, from top to bottom, as one text."""
    lines = line_texts(cluster_lines(glyphs, tol))
    return lines.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_top", "text"))), lambda x: x["text"]), "\n").alias("text"))


def word_glyphs(words: DataFrame) -> DataFrame:
    """Characters of recognised words, each with the box of its whole word."""
    each = words.select(*PAGE, F.col("seq").alias("word"), F.posexplode(F.split("text", "")).alias("k", "text"), "x0", "x1", "top", "bottom")
    return each.where("text <> ''").select(*PAGE, (F.col("word").cast("long") * 2**31 + F.col("k")).alias("seq"), "text", "x0", "x1", "top", "bottom")


def gutter_edges(items: DataFrame, min_gap: float | None = None) -> DataFrame:
    """(edges) of each page from empty vertical strips between items; null below three edges.

    Pixels are whole; a strip of ``min_gap`` (1.5 median widths by default) or more empty pixels gives an
    edge in its middle. Gaps are found from the running right end, no pixels are made.
    """
    w = _page().orderBy("x0", "x1")
    bounds = items.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.lit(min_gap).alias("gap") if min_gap is not None else (F.median(F.col("x1") - F.col("x0")) * 1.5).alias("gap"))
    ends = items.select(*PAGE, "x0", "x1", F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before")).join(bounds, PAGE)
    j = F.floor(F.col("before") - F.col("left")) + 1
    k = F.floor(F.col("x0") - F.col("left"))
    inner = ends.where(k - j >= F.col("gap")).select(*PAGE, (((j + k) / 2) + F.col("left")).alias("e"))
    every = bounds.select(*PAGE, F.explode(F.array("left", "right")).alias("e")).unionByName(inner)
    return every.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.round("e", 1))).alias("edges")).select(*PAGE, F.when(F.size("edges") >= 3, F.col("edges")).alias("edges"))


def ruled_edges(cells: DataFrame, least: int = 3) -> DataFrame:
    """(edges) from the cells of a page's first ruled table; null below ``least``."""
    first = cells.withColumn("first", F.min("table_id").over(_page())).where("table_id = first")
    xs = first.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x"))
    return xs.groupBy(*PAGE).agg(F.array_sort(F.collect_set(F.round("x", 1))).alias("edges")).select(*PAGE, F.when(F.size("edges") >= least, F.col("edges")).alias("edges"))


def table_tops(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(table_top): the highest long horizontal rule, else the highest table box."""
    rules = edges.where("top = bottom and x1 - x0 > 200").groupBy(*PAGE).agg(F.min("top").alias("rule"))
    tables = boxes.groupBy(*PAGE).agg(F.min("top").alias("box"))
    return rules.join(tables, PAGE, "full").select(*PAGE, F.coalesce("rule", "box").alias("table_top"))


def column_edges(glyphs: DataFrame, cells: DataFrame, tops: DataFrame, bottom: float = 560.0, default_top: float = 130.0) -> DataFrame:
    """Ruled edges where a page has them, else gutters of the body's glyphs."""
    body = glyphs.join(tops, PAGE, "left").where((F.col("top") > F.coalesce(F.col("table_top") - 5, F.lit(default_top))) & (F.col("top") < bottom)).drop("table_top")
    ruled, gutter = ruled_edges(cells).withColumnRenamed("edges", "ruled"), gutter_edges(body).withColumnRenamed("edges", "gutter")
    return ruled.join(gutter, PAGE, "full").select(*PAGE, F.coalesce("ruled", "gutter").alias("edges"))


def to_columns(lined: DataFrame, edges: DataFrame, line: str = "line_top") -> DataFrame:
    """(line, cols): each line's text by column; glyphs belong where their centre is, outside ones nowhere."""
    placed = lined.join(edges.where("edges is not null"), PAGE)
    at = F.size(F.filter("edges", lambda e: e <= (F.col("x0") + F.col("x1")) / 2)) - 1
    placed = placed.withColumn("col", at).withColumn("width", F.size("edges") - 1)
    inside = placed.withColumn("col", F.when((F.col("col") >= 0) & (F.col("col") < F.col("width")), F.col("col")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "seq", "text"))), lambda x: x["text"]), "")
    cells = inside.groupBy(*PAGE, line, "width", "col").agg(s.squeeze(text).alias("cell"))
    found = cells.groupBy(*PAGE, line, "width").agg(F.map_from_entries(F.collect_list(F.when(F.col("col").isNotNull(), F.struct("col", "cell")))).alias("by"))
    cols = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("by", i), F.lit("")))
    return found.select(*PAGE, line, cols.alias("cols"))


def column_number_tops(lines: DataFrame, tops: DataFrame) -> DataFrame:
    """(colnum_top): the row (1)(2).. under the table's top, a looser match, or 80 below the top."""
    top = F.coalesce("table_top", F.lit(110.0))
    t = F.btrim("text")
    marked = lines.join(tops, PAGE, "left").withColumn("t", top)
    strict = F.min(F.when((F.col("line_top") >= F.col("t") - 2) & t.rlike(COLUMN_NUMBERS), F.col("line_top")))
    loose = F.min(F.when((F.col("line_top") > F.col("t")) & t.rlike(r"\(\d+\)"), F.col("line_top")))
    return marked.groupBy(*PAGE).agg(F.coalesce(strict, loose, F.first("t") + 80).alias("colnum_top"), F.first("t").alias("table_top"))


def body_bounds(lines: DataFrame) -> DataFrame:
    """(body_top, body_bottom): below the last column numbers, above the first notes."""
    stops = lines.groupBy(*PAGE).agg(F.min(F.when(F.col("text").rlike(NOTES), F.col("line_top"))).alias("stop"))
    both = lines.join(stops, PAGE)
    start = F.max(F.when(F.btrim("text").rlike(COLUMN_NUMBERS) & (F.col("stop").isNull() | (F.col("line_top") <= F.col("stop"))), F.col("line_top")))
    return both.groupBy(*PAGE).agg(F.coalesce(start + 4, F.lit(130.0)).alias("body_top"), F.coalesce(F.first("stop") - 2, F.lit(9999.0)).alias("body_bottom"))


def legacy_body_bounds(lines: DataFrame) -> DataFrame:
    """(body_top, body_bottom): below the first line that begins (1), above the first notes."""
    stops = lines.groupBy(*PAGE).agg(F.min(F.when(F.col("text").rlike(NOTES), F.col("line_top"))).alias("stop"))
    both = lines.join(stops, PAGE)
    start = F.min(F.when(F.btrim("text").startswith("(1)") & (F.col("stop").isNull() | (F.col("line_top") < F.col("stop"))), F.col("line_top")))
    return both.groupBy(*PAGE).agg(F.coalesce(start + 4, F.lit(150.0)).alias("body_top"), F.coalesce(F.first("stop") - 2, F.lit(540.0)).alias("body_bottom"))


def anchors(lines: DataFrame, resolved: DataFrame, phrase: str, least: int = 3, top: float = 130.0) -> DataFrame:
    """(line_top, entity): lines whose first column is a known entity; the grand total has a null entity.

    ``lines`` has (line_top, n, label); ``resolved`` maps labels to entities.
    """
    body = lines.where((F.col("n") >= least) & (F.col("line_top") >= top)).join(resolved, "label", "left")
    total = s.is_grand_total(F.col("label"), phrase)
    return body.where(total | F.col("entity").isNotNull()).select(*PAGE, "line_top", F.when(~total, F.col("entity")).alias("entity"), total.alias("is_total"))


def bands(anchor_lines: DataFrame) -> DataFrame:
    """Anchors with the band (lo, hi] of tops that belongs to each: to the middle of its neighbours."""
    w = _page().orderBy("line_top")
    t = F.col("line_top")
    return anchor_lines.withColumn("lo", F.coalesce((F.lag("line_top").over(w) + t) / 2, t - 5)).withColumn("hi", F.coalesce((F.lead("line_top").over(w) + t) / 2, t + 6))


def in_bands(glyphs: DataFrame, banded: DataFrame) -> DataFrame:
    """Glyphs with the anchor whose band they are in: an equi join by page, bands are disjoint."""
    return glyphs.join(banded, PAGE).where((F.col("lo") < F.col("top")) & (F.col("top") <= F.col("hi")))


def split_rows(rows: DataFrame, phrase: str) -> DataFrame:
    """Category rows of (line_top, cols): values with the label they take, and whether they are the total.

    A row of values without a label takes the latest label-only row since the last row of values.
    """
    values = F.exists(F.slice("cols", 2, F.size("cols")), lambda c: c.rlike("[0-9]") | F.btrim(c).isin("-", "–", "—"))
    label = s.norm_label(F.get(F.col("cols"), F.lit(0)))
    w = _page().orderBy("line_top")
    marked = rows.withColumn("has_values", values).withColumn("label", F.when(label.rlike("[A-Za-z0-9]"), label))
    # rows up to a row of values, that row included, are one segment
    marked = marked.withColumn("segment", F.coalesce(F.sum(F.col("has_values").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pending = F.last(F.when(~F.col("has_values"), F.col("label")), ignorenulls=True).over(Window.partitionBy(*PAGE, "segment").orderBy("line_top").rowsBetween(Window.unboundedPreceding, -1))
    used = marked.withColumn("label", F.coalesce("label", pending)).where("has_values and label is not null")
    return used.select(*PAGE, "line_top", "label", "cols", s.is_grand_total(F.col("label"), phrase).alias("is_total"))


def merge_segments(segments: DataFrame, near: float = 2.0, gap: float = 1.0) -> DataFrame:
    """Horizontal rule pieces of one height (tops less than ``near`` from the line's first) joined over small gaps."""
    lined = cluster_lines(segments, near - 1e-9)
    w = Window.partitionBy(*PAGE, "line_top").orderBy("x0", "x1")
    start = (F.col("x0") - F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= gap).cast("int")
    run = F.sum(F.coalesce(start, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lined.withColumn("run", run).groupBy(*PAGE, "line_top", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top")).drop("run", "line_top")


def blocks_over_rules(blocks: DataFrame, segments: DataFrame, least: float = 0.0, most: float = 20.0) -> DataFrame:
    """Blocks with the rules below them, ``least`` to ``most`` away, that their middle is over."""
    b = blocks.withColumn("mid", (F.col("x0") + F.col("x1")) / 2)
    r = segments.select(*PAGE, F.col("x0").alias("rule_x0"), F.col("x1").alias("rule_x1"), F.col("top").alias("rule_top"))
    return b.join(r, PAGE).where((F.col("rule_top") - F.col("bottom")).between(least, most) & F.col("mid").between(F.col("rule_x0"), F.col("rule_x1"))).drop("mid")
