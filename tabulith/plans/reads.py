"""Read queries over the star schema: lists, pivoted tables, entry grids, dashboard, search, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as s
from .ingest import COL, PUB, TAB


def fact_order() -> list[Column]:
    """The default order of facts: table, region, category, year, nulls first."""
    return [F.col(c).asc_nulls_first() for c in [*TAB, "region", "region_kind", "category_group", "category", "year", "indicator_key"]]


def publication_list(star: dict[str, DataFrame]) -> DataFrame:
    """Publications with their chapters, newest first."""
    n = star["chapter"].groupBy(*PUB).agg(F.count_distinct("chapter_no").alias("chapters"))
    return star["publication"].join(n, PUB, "left").select(*PUB, F.coalesce("chapters", F.lit(0)).alias("chapters")).orderBy(F.desc("pub_year"), "publication")


def chapter_list(star: dict[str, DataFrame]) -> DataFrame:
    """Chapters with their tables, by number."""
    n = star["stat_table"].groupBy(*PUB, "chapter_no").agg(F.count("*").alias("tables"))
    return star["chapter"].join(n, [*PUB, "chapter_no"], "left").withColumn("tables", F.coalesce("tables", F.lit(0))).orderBy(*PUB, "chapter_no")


def facts_per_table(star: dict[str, DataFrame]) -> DataFrame:
    """(TAB, facts, to_check): the counts that are stored, else counted."""
    if "table_count" in star:
        return star["table_count"]
    return star["fact"].groupBy(*TAB).agg(F.count("*").alias("facts"), F.count_if(F.col("flag") == s.TO_CHECK).alias("to_check"))


def table_list(star: dict[str, DataFrame]) -> DataFrame:
    """Tables with their facts, by number as text."""
    n = facts_per_table(star).select(*TAB, "facts")
    return star["stat_table"].join(n, TAB, "left").select(*TAB, "title", "status", F.coalesce("facts", F.lit(0)).alias("facts")).orderBy(*PUB, "table_no")


def on_column(a: DataFrame, b: DataFrame) -> Column:
    """Facts or columns of one column: only the year can be null, so the rest stay plain keys by which tables are stored."""
    return reduce(lambda x, y: x & y, [a[k] == b[k] for k in COL if k != "year"]) & a["year"].eqNullSafe(b["year"])


def is_total_subject(phrase: str) -> Column:
    return F.coalesce(F.col("region_kind") != "kecamatan", F.lit(False)) | F.coalesce(F.lower("category").contains(phrase), F.lit(False))


def table_cells(star: dict[str, DataFrame], phrase: str) -> DataFrame:
    """The cells that table pages show, in long form for all tables at once.

    The subject is the category of category tables, else the region; facts without one are left out. Of
    several facts for a subject and column the last in default order counts.
    """
    t = star["stat_table"].select(*TAB, "row_kind")
    f = star["fact"].join(t, TAB)
    by_category = F.col("row_kind") == "kategori"
    subject = F.when(by_category, F.col("category")).otherwise(F.col("region"))
    f = f.withColumn("subject", subject).where("subject is not null").withColumn("is_total", F.when(by_category, F.coalesce(F.lower("category").contains(phrase), F.lit(False))).otherwise(F.col("region_kind") != "kecamatan"))
    c = star["table_column"].select(*COL, "position")
    j = f.join(c, on_column(f, c)).select(*[f[k] for k in [*TAB, "subject", "is_total", "region", "region_kind", "category", "category_group", "value_num", "value_text", "flag"]], c["position"])
    blank = lambda k: F.coalesce(F.col(k), F.lit("")).alias(k)
    last = F.struct(blank("region_kind"), blank("region"), blank("category_group"), blank("category"))
    return j.groupBy(*TAB, "subject", "position").agg(F.max_by(F.struct("value_num", "value_text", "flag", "is_total"), last).alias("v")).select(*TAB, "subject", "position", "v.*")


def table_positions(star: dict[str, DataFrame], table: tuple[str, int, str]) -> list[int]:
    """The positions of all columns of a table (TAB's values). Collected: metadata of one table, a row a column."""
    return [x.position for x in _one(star["table_column"], table).select("position").distinct().orderBy("position").collect()]


def _one(df: DataFrame, table: tuple[str, int, str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(TAB, table, strict=True)]))


def _shown(cells: DataFrame) -> DataFrame:
    return cells.withColumn("shown", s.display_cell(F.col("value_num"), F.col("value_text"), F.col("flag")))


def table_view(star: dict[str, DataFrame], table: tuple[str, int, str], positions: list[int], phrase: str) -> DataFrame:
    """One table, known by TAB's values, a row a subject and a column a position, regular rows by name and totals after."""
    shown = _shown(table_cells(star | {k: _one(star[k], table) for k in ("stat_table", "table_column", "fact")}, phrase))
    wide = shown.groupBy("subject").pivot("position", positions).agg(F.first("shown"))
    totals = shown.groupBy("subject").agg(F.bool_or("is_total").alias("is_total"))
    return wide.join(totals, "subject").select("subject", "is_total", *[F.coalesce(F.col(f"`{p}`"), F.lit("·")).alias(f"c{p}") for p in positions]).orderBy("is_total", "subject")


def table_rows(star: dict[str, DataFrame], phrase: str) -> DataFrame:
    """The rows of all tables' pages at once: ``cells`` holds what is shown, one for each of the table's positions."""
    width = star["table_column"].groupBy(*TAB).agg(F.max("position").alias("width"))
    rows = _shown(table_cells(star, phrase)).groupBy(*TAB, "subject").agg(F.bool_or("is_total").alias("is_total"), F.map_from_entries(F.collect_list(F.struct("position", "shown"))).alias("at"))
    cells = F.transform(F.sequence(F.lit(1), F.col("width")), lambda p: F.coalesce(F.try_element_at("at", p), F.lit("·")))
    return rows.join(width, TAB).select(*TAB, "subject", "is_total", cells.alias("cells"))


def entry_grid(cells: DataFrame, columns: DataFrame, master: DataFrame, total: str, tables: DataFrame | None = None) -> DataFrame:
    """All master entities and the total row times a table's columns, with the text or number there is.

    ``columns``: TAB, position. Of ``tables`` (TAB, row_kind) those by category have the labels that are
    there instead of the master list. The grid is as large as its tables can get, so nothing is broadcast
    but what adaptive execution finds small.
    """
    names = master.select(F.col("entity").alias("subject"), F.lit(False).alias("is_total")).unionByName(master.sparkSession.range(1).select(F.lit(total).alias("subject"), F.lit(True).alias("is_total")))
    wide = columns.select(*TAB, "position")
    if tables is None:
        grid = wide.join(names)
    else:
        kinds = tables.select(*TAB, (F.col("row_kind") == "kategori").alias("by_category"))
        wide = wide.join(kinds, TAB)
        labels = cells.groupBy(*TAB, "subject").agg(F.bool_or("is_total").alias("is_total"))
        grid = wide.where("not by_category").drop("by_category").join(names).unionByName(wide.where("by_category").drop("by_category").join(labels, TAB))
    have = cells.select(*TAB, "subject", "position", F.coalesce(F.nullif("value_text", F.lit("")), s.format_id(F.col("value_num"))).alias("text"))
    return grid.join(have, [*TAB, "subject", "position"], "left").select(*TAB, "subject", "is_total", "position", F.coalesce("text", F.lit("")).alias("text"))


def dashboard(star: dict[str, DataFrame]) -> DataFrame:
    """Counts of publications, tables, facts, and facts to check."""
    one = lambda df, *a: df.agg(*a)
    p, t = one(star["publication"], F.count("*").alias("publications")), one(star["stat_table"], F.count("*").alias("tables"))
    f = one(facts_per_table(star), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("facts", "to_check")])
    return p.join(F.broadcast(t)).join(F.broadcast(f))


def newest_anomalies(facts: DataFrame, tables: DataFrame, n: int = 10) -> DataFrame:
    """The newest facts to check, with their table. ``facts`` has created and fact_id."""
    top = facts.where(F.col("flag") == s.TO_CHECK).orderBy(F.desc("created"), F.desc("fact_id")).limit(n)
    return top.join(tables.select(*TAB, "title"), TAB, "left")


def recent_activity(tables: DataFrame, n: int = 5) -> DataFrame:
    """The tables changed last, but for drafts."""
    return tables.where("status <> 'draft'").orderBy(F.desc("modified"), *TAB).limit(n)


def facts_by_chapter(star: dict[str, DataFrame], n: int = 10) -> DataFrame:
    """The chapter names with the most facts; names are one over publications, blank ones are others."""
    t = star["stat_table"].select(*TAB, "chapter_no")
    j = facts_per_table(star).select(*TAB, F.col("facts").alias("k")).join(t, TAB).join(star["chapter"], [*PUB, "chapter_no"], "left")
    name = F.coalesce(F.nullif(F.trim("chapter"), F.lit("")), F.lit("Lainnya"))
    return j.groupBy(name.alias("chapter")).agg(F.sum("k").alias("facts")).orderBy(F.desc("facts"), "chapter").limit(n)


def search_text(rows: DataFrame, column: str, query: str, order: list[Column], n: int = 100) -> DataFrame:
    """The first rows that contain the query in any case; a blank query finds none."""
    q = query.strip().lower()
    return (rows.where(F.lower(column).contains(q)) if q else rows.where(F.lit(False))).orderBy(*order).limit(n)


def search_fields(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that contain each word of the query in some of the columns."""
    hit = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.lower(c).contains(w), F.lit(False)) for c in columns])
    return rows.where(reduce(lambda a, b: a & b, [hit(w) for w in query.lower().split()], F.lit(True)))


def filter_facets(rows: DataFrame, **values) -> DataFrame:
    """Rows with the given values; a list means any of them, null a missing value."""
    for column, v in values.items():
        rows = rows.where(F.col(column).isin(*v) if isinstance(v, (list, tuple)) else F.col(column).eqNullSafe(F.lit(v)))
    return rows


def export_rows(star: dict[str, DataFrame], scope: DataFrame | None = None) -> DataFrame:
    """Facts with names in place of keys, in the exchange columns and order; ``scope`` (TAB) limits the tables."""
    f = star["fact"] if scope is None else star["fact"].join(scope.select(*TAB).distinct(), TAB, "left_semi")
    t = star["stat_table"].join(star["chapter"], [*PUB, "chapter_no"]).select(*TAB, "chapter", "title", "source")
    j = f.join(t, TAB)
    c = star["table_column"].select(*COL, "unit").withColumnRenamed("unit", "column_unit")
    j = j.join(c, on_column(j, c), "left").select(*[j[k] for k in j.columns], "column_unit")
    i = star["indicator"].select("indicator_key", "indicator", "unit")
    j = j.join(i, "indicator_key", "left")
    blank = lambda x: F.coalesce(x, F.lit(""))
    out = j.select(
        "chapter", "table_no", "title", blank(F.col("region")).alias("region"), blank(F.col("category")).alias("category"), blank(F.col("indicator")).alias("indicator"), blank(F.coalesce(F.nullif("column_unit", F.lit("")), F.col("unit"))).alias("unit"),
        blank(F.col("year").cast("string")).alias("year"), blank(F.col("value_num").cast("string")).alias("value_num"), blank(F.col("value_text")).alias("value_text"), "flag", blank(F.col("source")).alias("source"),
    )
    return out.orderBy("table_no", "category", "region", "year")


def publication_picker(publications: DataFrame) -> DataFrame:
    """Publications as small JSON texts with whether they have a file, newest first."""
    return publications.select(F.to_json(F.struct("publication", "pub_year", (F.coalesce("file", F.lit("")) != "").alias("has_file"))).alias("entry"), "pub_year", "publication").orderBy(F.desc("pub_year"), "publication").select("entry")


def indicator_names(star: dict[str, DataFrame]) -> DataFrame:
    return star["indicator"].select("indicator").orderBy("indicator")


def ranked(rows: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """Rows with their place in the default order within a key."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
