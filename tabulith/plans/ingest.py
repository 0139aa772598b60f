"""Loading exchange rows into the star schema: idempotent, set based, with natural keys.

Tables of the schema (``EMPTY`` has them without rows): publication, chapter, stat_table, indicator,
table_column, region, category, fact. A load returns the whole new schema and its counters. Columns
are known by (table_no, indicator key, year), facts by (table_no, indicator key, year, region,
region kind, category, category group), null equal to null.

First-wins and last-wins rules go by ``_seq``, the order of rows. Rows are reduced by one hash aggregate on
their texts first, so a hot table or region combines before the shuffle; all but the values of facts comes from what it leaves (``cells``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as s
from ..functions.stages import stage

PUB = ["publication", "pub_year"]
TAB = [*PUB, "table_no"]
COL = [*TAB, "indicator_key", "year"]
FACT = [*COL, "region", "region_kind", "category", "category_group"]

SCHEMAS = {
    "publication": "publication string, pub_year int, coverage string, kind string, file string, note string",
    "chapter": "publication string, pub_year int, chapter_no int, chapter string",
    "stat_table": "publication string, pub_year int, chapter_no int, table_no string, title string, title_en string, source string, row_kind string, status string",
    "indicator": "indicator_key string, indicator string, unit string, value_type string",
    "table_column": "publication string, pub_year int, table_no string, indicator_key string, year int, position int, unit string, value_type string",
    "region": "region string, region_kind string",
    "category": "category string, category_group string",
    "fact": "publication string, pub_year int, table_no string, indicator_key string, year int, region string, region_kind string, category string, category_group string, value_num decimal(24,4), value_text string, flag string",
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    """The schema without rows."""
    return {k: spark.createDataFrame([], v) for k, v in SCHEMAS.items()}


def same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def with_publication(publications: DataFrame, title: str, pub_year: int, by_title: bool = False) -> DataFrame:
    """``publications`` with the one that is meant, added where it is missing.

    It is known by title and year; ``by_title`` by its title alone, so the year is only for a new one.
    """
    meant = described(publications.sparkSession.createDataFrame([(title, pub_year)], "publication string, pub_year int")).select(*publications.columns)
    return publications.unionByName(not_in(meant, publications, PUB[:1] if by_title else PUB))


def described(publications: DataFrame, coverage: str = "", kind: str = "digital") -> DataFrame:
    """New publications (PUB) with all their columns: no file and no note yet."""
    return publications.select(*PUB, F.lit(coverage).alias("coverage"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file"), F.lit("").alias("note"))


def not_in(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks."""
    return new.join(old, same(new, old, key), "left_anti")


def prepare(rows: DataFrame, publication: str, pub_year: int, text_limit: int = 500) -> DataFrame:
    """Exchange rows stripped, typed and keyed. Rows without a table number are left out.

    The chapter's number is the leading part of the table's; ``chapter_no`` is null where it is none.
    """
    return _typed(rows, publication, pub_year, ["_seq"], text_limit)


def _typed(rows: DataFrame, publication: str, pub_year: int, own: list[str], text_limit: int = 500) -> DataFrame:
    """``prepare`` for those of the exchange columns that ``rows`` have; ``own`` columns stay as they are."""
    texts = [c for c in rows.columns if c not in own]
    bare = _stripped(rows, texts)
    if "table_no" in texts:
        bare = bare.where(F.col("table_no") != "")
    t = lambda c: F.col(c) if c in texts else F.lit("")
    lead = F.substring_index(t("table_no"), ".", 1)
    name = s.cut(t("category"), 500)
    made = {
        "table_no": {"table_no": t("table_no"), "chapter_no": F.coalesce(s.to_year(lead), s.strip(lead).try_cast("int"))},
        "chapter": {"chapter": F.nullif(t("chapter"), F.lit(""))},
        "title": {"title": s.cut(t("title"), 400), "title_en": s.cut(t("title_en"), 400)},
        "source": {"source": s.cut(t("source"), 300)},
        "indicator": {"indicator": t("indicator"), "indicator_key": s.bare_indicator(t("indicator"))},
        "unit": {"unit": t("unit")},
        "year": {"year": s.to_year(t("year"))},
        "region": {"region": F.nullif(t("region"), F.lit("")), "region_kind": F.when(t("region") != "", s.region_kind(t("region")))},
        "category": {"category": F.nullif(name, F.lit("")), "category_group": F.when(name != "", s.cut(t("category_group"), 80))},
    } | {c: {c: x} for c, x in _values(text_limit).items()}
    pub = [F.lit(publication).alias("publication"), F.lit(pub_year).cast("int").alias("pub_year")]
    return bare.select(*own, *pub, *[x.alias(k) for c, out in made.items() if c in texts for k, x in out.items()])


# a function over an array isn't compiled into one method with the rest, which would be too large for the JVM to
# compile: with it, Spark deals the columns to small methods. Each column is named once, so steps before join in
def _apart(f: Callable[[Column], Column], x: Column) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _stripped(rows: DataFrame, texts: list[str]) -> DataFrame:
    """``rows`` with some columns as stripped text, blank for null."""
    bare = {c: F.col(c).cast("string") for c in texts}
    return rows.select(*[c for c in rows.columns if c not in bare], *[(_apart(s.strip0, x) if c == "value_num" else s.strip0(x)).alias(c) for c, x in bare.items()])


def _values(text_limit: int = 500) -> dict[str, Column]:
    """The columns of a fact's value, from stripped texts."""
    return {"value_num": _apart(s.as_decimal, F.col("value_num")), "value_text": s.cut(F.col("value_text"), text_limit), "flag": F.coalesce(F.nullif(F.col("flag"), F.lit("")), F.lit(s.PRESENT))}


def quarantined(prepared: DataFrame) -> DataFrame:
    """Rows whose table number has no chapter number: they don't enter the load and don't stop it."""
    return prepared.where("chapter_no is null")


def _first(rows: DataFrame, key: list[str], most: dict[str, Column] | None = None, /, **payload: Column) -> DataFrame:
    """(key, at, f): the payload of the first row of a key as a struct, and its ``_seq``; ``most`` are maxima over the key.

    Rows are reduced by key and payload to the least ``_seq`` first, for that is a hash aggregate, while taking
    a struct along by its ``_seq`` would sort all rows.
    """
    p, m = [f"f_{k}" for k in payload], list(most or {})
    each = rows.select(*key, "_seq", *[c.alias(f"f_{k}") for k, c in payload.items()], *[c.alias(k) for k, c in (most or {}).items()])
    least = each.groupBy(*key, *p).agg(F.min("_seq").alias("at"), *[F.max(k).alias(k) for k in m])
    f = F.struct(*[F.col(f"f_{k}").alias(k) for k in payload])
    return least.groupBy(*key).agg(F.min("at").alias("at"), F.min_by(f, "at").alias("f"), *[F.max(k).alias(k) for k in m])


#: Exchange columns that say what a table and its columns are, and those that say which fact a row is.
HEAD = ["chapter", "table_no", "title", "title_en", "source", "indicator", "unit", "year"]
CELL = ["table_no", "indicator", "year", "region", "category", "category_group"]


def load(star: dict[str, DataFrame], rows: DataFrame, publication: str, pub_year: int, given: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The schema after a load of ``rows``, and one row of counters.

    Rows are reduced by their texts as they stand before anything is stripped, typed or keyed, for few texts
    differ. Tables, columns, regions, categories and facts are found in passes of their own over ``rows``, which are read several
    times. Who reads all tables of a load stages the rows' ``cells`` first (``given``), and ``rows`` are read but once more, for
    values. Stage rows that are costly to compute.
    """
    each = rows if given is None else given
    numeric = s.as_decimal(s.strip0(F.col("value_num").cast("string"))).isNotNull()
    heads = rows.groupBy(*_texts(rows, HEAD), (s.strip0(F.col("category").cast("string")) != "").alias("by_category"), numeric.alias("numeric")) if given is None else _heads(given)
    r = _typed(heads.agg(F.min("_seq").alias("_seq")), publication, pub_year, ["_seq", "by_category", "numeric"])
    r = stage(r.where("chapter_no is not null"))
    pubs = not_in(described(r.select(*PUB).distinct()), star["publication"], PUB)
    chapters = _first(r, [*PUB, "chapter_no"], chapter=F.col("chapter")).select(*PUB, "chapter_no", F.coalesce("f.chapter", F.concat(F.lit("Bab "), F.col("chapter_no").cast("string"))).alias("chapter"))
    chapters = not_in(chapters, star["chapter"], [*PUB, "chapter_no"])

    row_kind = F.when(F.col("by_category"), "kategori").otherwise("kecamatan")
    tables = _first(r, TAB, **{c: F.col(c) for c in ("chapter_no", "title", "title_en", "source")}, row_kind=row_kind).select(*PUB, "f.chapter_no", "table_no", "f.title", "f.title_en", "f.source", "f.row_kind", F.lit("ekstrak").alias("status"))
    tables = not_in(tables, star["stat_table"], TAB)

    by_key = _first(r, ["indicator_key"], {"numeric": F.col("numeric")}, indicator=F.col("indicator"), unit=F.col("unit"))
    indicators = not_in(by_key.select("indicator_key", "f.indicator", "f.unit", F.when(F.col("numeric"), "numerik").otherwise("teks").alias("value_type")), star["indicator"], ["indicator_key"])
    old = star["indicator"].join(by_key.select("indicator_key", "numeric"), "indicator_key", "left")
    promoted = old.select("indicator_key", "indicator", "unit", F.when(F.coalesce("numeric", F.lit(False)), "numerik").otherwise(F.col("value_type")).alias("value_type"))

    columns = not_in(_first(r, COL, unit=F.col("unit"), value_type=F.when(F.col("numeric"), "numerik").otherwise("teks")), star["table_column"], COL)
    top = star["table_column"].groupBy(*TAB).agg(F.max("position").alias("top"))
    ranked = columns.withColumn("k", F.row_number().over(Window.partitionBy(*TAB).orderBy("at"))).join(top, TAB, "left")
    columns = ranked.select(*COL, (F.coalesce("top", F.lit(0)) + F.col("k")).cast("int").alias("position"), "f.unit", "f.value_type")

    def named(texts: list[str], key: list[str]) -> DataFrame:
        some = each.select(*_texts(each, ["table_no", *texts])).distinct()
        return _typed(some, publication, pub_year, []).where(F.col("chapter_no").isNotNull() & F.col(key[0]).isNotNull()).select(*key).distinct()

    regions = not_in(named(["region"], ["region", "region_kind"]), star["region"], ["region", "region_kind"])
    categories = not_in(named(["category", "category_group"], ["category", "category_group"]), star["category"], ["category", "category_group"])
    facts, counts = upsert(star["fact"], rows, publication, pub_year) if given is None else _upsert(star["fact"], _maybe_last(rows, given), given, publication, pub_year)

    new = {"publication": pubs, "chapter": chapters, "stat_table": tables, "indicator": indicators, "table_column": columns, "region": regions, "category": categories}
    after = {k: (promoted if k == "indicator" else star[k]).unionByName(v) for k, v in new.items()} | {"fact": facts}
    for k, name in (("stat_table", "new_tables"), ("indicator", "new_indicators"), ("region", "new_regions"), ("category", "new_categories")):
        counts = counts.join(F.broadcast(new[k].agg(F.count("*").alias(name))))
    return after, counts


def _texts(rows: DataFrame, names: list[str]) -> list[Column]:
    """Those of the exchange columns that ``rows`` have, as text."""
    return [F.col(c).cast("string").alias(c) for c in names if c in rows.columns]


#: Slots by which rows that no fact takes its values from are told, a power of two. It bounds a broadcast; what passes by chance loses by ``_seq``.
SLOTS = 1 << 21


def cells(rows: DataFrame) -> DataFrame:
    """Exchange rows by their texts without values: how many have a number and how many have none, the first of each, and the last."""
    numeric = s.as_decimal(s.strip0(F.col("value_num").cast("string"))).isNotNull()
    each = rows.select("_seq", *_texts(rows, [*dict.fromkeys([*HEAD, *CELL])]), numeric.alias("numeric"))
    ends = [x for k, name in ((F.col("numeric"), "numeric"), (~F.col("numeric"), "other")) for x in (F.count_if(k).alias(f"{name}_n"), F.min(F.when(k, F.col("_seq"))).alias(f"{name}_at"))]
    return each.groupBy(*[c for c in each.columns if c not in ("_seq", "numeric")]).agg(*ends, F.max("_seq").alias("last"))


def _heads(cells: DataFrame) -> GroupedData:
    """``cells`` grouped as a load groups its rows, by what says which tables and columns there are."""
    parts = F.array(*[F.struct(F.lit(k).alias("numeric"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_at").alias("_seq")) for k, name in ((True, "numeric"), (False, "other"))])
    split = cells.select(*_texts(cells, HEAD), (s.strip0(F.col("category")) != "").alias("by_category"), F.inline(parts)).where("n > 0")
    return split.groupBy(*_texts(cells, HEAD), "by_category", "numeric")


def _maybe_last(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows that may be the last of their key's spelling, by a broadcast of SLOTS numbers at most."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).alias("slot")
    last = cells.groupBy(*[c for c in CELL if c in rows.columns]).agg(F.max("last").alias("last"))
    return rows.join(F.broadcast(last.select(slot("last")).distinct()), slot(rows["_seq"]) == F.col("slot"), "left_semi")


def upsert(facts: DataFrame, rows: DataFrame, publication: str, pub_year: int) -> tuple[DataFrame, DataFrame]:
    """Facts with exchange rows merged in, the last row of a key winning; and (new_facts, updated_facts).

    Repeats within a load count as updates. Two aggregates take the last values along: of each spelling of a key, and of
    each key among these and the old facts. Where only keys are asked for, as by the counts, the values drop out of
    the plan and both are hash aggregates. Keys begin alike in many rows, so a hash leads them: sorting rarely looks further.
    """
    values = ["value_num", "value_text", "flag"]
    spelt = [c for c in CELL if c in rows.columns]
    each = rows.select("_seq", *_texts(rows, [*CELL, *values]))
    last = each.groupBy(F.xxhash64(*spelt).alias("lead"), *spelt).agg(F.max(F.struct("_seq", *values)).alias("f"), F.count("*").alias("n"))
    last = _typed(last.select(*spelt, "n", "f.*"), publication, pub_year, ["_seq", "n"]).where("chapter_no is not null")
    seq = rows.schema["_seq"].dataType
    old = facts.select(*FACT, F.lit(0).alias("is_new"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(seq).alias("_seq"), *values)
    both = old.unionByName(last.select(*FACT, F.lit(1).alias("is_new"), "n", "_seq", *values))
    won = both.groupBy(F.xxhash64(*FACT).alias("lead"), *FACT).agg(F.max(F.struct("is_new", "_seq", *values)).alias("f"))
    by_key = both.groupBy(*FACT).agg(F.min("is_new").alias("is_new"), F.sum("n").alias("n"))
    counts = by_key.agg(F.count_if(F.col("is_new") == 1).alias("new_facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return won.select(*FACT, *[f"f.{c}" for c in values]), counts.select("new_facts", (F.col("n") - F.col("new_facts")).alias("updated_facts"))


def _upsert(facts: DataFrame, rows: DataFrame, each: DataFrame, publication: str, pub_year: int) -> tuple[DataFrame, DataFrame]:
    """``upsert`` with the rows' ``cells``; of ``rows`` the last of each spelling of a key are enough.

    Two aggregates take the last values along: of each spelling of a key, and of each key among these and the old facts.
    Counts need cells alone, so theirs are hash aggregates. Keys begin alike in many rows, so a hash leads them: sorting
    rarely looks further.
    """
    values = ["value_num", "value_text", "flag"]
    spelt = [c for c in CELL if c in rows.columns]
    texts = rows.select("_seq", *_texts(rows, [*CELL, *values]))
    last = texts.groupBy(F.xxhash64(*spelt).alias("lead"), *spelt).agg(F.max(F.struct("_seq", *values)).alias("f"))
    last = _typed(last.select(*spelt, "f.*"), publication, pub_year, ["_seq"]).where("chapter_no is not null")
    seq = rows.schema["_seq"].dataType
    old = facts.select(*FACT, F.lit(0).alias("is_new"), F.lit(None).cast(seq).alias("_seq"), *values)
    both = old.unionByName(last.select(*FACT, F.lit(1).alias("is_new"), "_seq", *values))
    won = both.groupBy(F.xxhash64(*FACT).alias("lead"), *FACT).agg(F.max(F.struct("is_new", "_seq", *values)).alias("f"))
    came = each.groupBy(*spelt).agg(F.sum(F.col("numeric_n") + F.col("other_n")).alias("n"))
    came = _typed(came, publication, pub_year, ["n"]).where("chapter_no is not null")
    keys = facts.select(*FACT, F.lit(0).alias("is_new"), F.lit(0).cast("long").alias("n")).unionByName(came.select(*FACT, F.lit(1).alias("is_new"), "n"))
    by_key = keys.groupBy(*FACT).agg(F.min("is_new").alias("is_new"), F.sum("n").alias("n"))
    counts = by_key.agg(F.count_if(F.col("is_new") == 1).alias("new_facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return won.select(*FACT, *[f"f.{c}" for c in values]), counts.select("new_facts", (F.col("n") - F.col("new_facts")).alias("updated_facts"))


def wide_to_long(rows: DataFrame, columns: DataFrame, area: str, phrase: str | None = None) -> DataFrame:
    """Exchange cells of wide rows: every row times its table's columns, missing cells blank.

    ``rows``: table_no, row, label, is_total, by_category, cells (array); ``columns``: table_no, position,
    name, unit, year, value_type, mode, base. A category row has its label as category and the area as
    region; a total row has the area's name. In year mode the indicator is the base and the column the
    year, in category mode the indicator is "base - name".
    """
    c = columns.select(*[F.col(k).alias(f"c_{k}") for k in ("table_no", "position", "name", "unit", "year", "value_type", "mode", "base")])
    each = rows.join(c, rows["table_no"] == c["c_table_no"])
    raw = F.coalesce(F.get(F.col("cells"), (F.col("c_position") - 1).cast("int")), F.lit(""))
    num = s.clean_num(raw)
    text_cell = F.col("c_value_type") == "teks"
    text = s.clean_text(raw)
    on_area = F.col("is_total") | F.col("by_category")
    return each.select(
        "table_no", "row", F.col("c_position").alias("position"),
        F.when(on_area, area).otherwise(F.col("label")).alias("region"),
        F.when(F.col("by_category") & ~F.col("is_total"), F.col("label")).otherwise("").alias("category"),
        F.when(F.col("c_mode") == "year", F.col("c_base")).when(F.col("c_mode") == "kategori", F.concat_ws(" - ", "c_base", "c_name")).otherwise(F.col("c_name")).alias("indicator"),
        F.col("c_unit").alias("unit"),
        F.when(F.col("c_mode") == "year", s.to_year(F.col("c_name"))).otherwise(F.col("c_year")).alias("year"),
        F.when(~text_cell, num["num"]).alias("value_num"),
        F.when(text_cell, text).otherwise(num["text"]).alias("value_text"),
        F.when(text_cell, F.when(text == "", "kosong").otherwise(s.PRESENT)).otherwise(num["flag"]).alias("flag"),
    )


def apply_edits(facts: DataFrame, edits: DataFrame, key: str = "fact_id") -> DataFrame:
    """``facts`` with edited texts, and ``changed``. ``edits``: key, new_text; ``facts`` has value_type."""
    met = facts.join(edits.select(key, F.trim("new_text").alias("new_text")), key, "left")
    number = s.parse_entry(F.col("new_text"))
    text_cell = F.col("value_type") == "teks"
    asked = F.col("new_text").isNotNull()
    changed = asked & F.when(text_cell, ~F.col("new_text").eqNullSafe(F.col("value_text"))).otherwise(~number.eqNullSafe(F.col("value_num")))
    filled = F.when(text_cell, F.col("new_text") != "").otherwise(number.isNotNull())
    keep = [c for c in facts.columns if c not in ("value_num", "value_text", "flag")]
    return met.select(
        *keep, F.when(changed & ~text_cell, number).otherwise(F.col("value_num")).alias("value_num"), F.when(changed, F.col("new_text")).otherwise(F.col("value_text")).alias("value_text"), F.when(changed & filled, s.PRESENT).otherwise(F.col("flag")).alias("flag"), changed.alias("changed")
    )


def mark_safe(facts: DataFrame, keys: DataFrame, key: str = "fact_id") -> DataFrame:
    """``facts`` with the flag of those in ``keys`` set to present."""
    met = facts.join(keys.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    return met.select(*[F.when(F.col("hit"), s.PRESENT).otherwise(F.col("flag")).alias("flag") if c == "flag" else F.col(c) for c in facts.columns])


def verify_tables(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """``tables`` with the status of those in ``keys`` (TAB) set to verified."""
    met = tables.join(keys.select(*TAB).distinct().withColumn("hit", F.lit(True)), TAB, "left")
    return met.select(*[F.when(F.col("hit"), "verifikasi").otherwise(F.col("status")).alias("status") if c == "status" else F.col(c) for c in tables.columns])


def define_columns(definitions: DataFrame, indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, new indicators) of a table entered by hand.

    ``definitions``: table_no, at, name, unit, year, value_type. Blank names go, positions start at 1
    without gaps, indicators are found by exact name.
    """
    named = definitions.withColumn("name", s.strip0(F.col("name"))).where("name <> ''")
    columns = named.withColumn("position", F.row_number().over(Window.partitionBy("table_no").orderBy("at")))
    first = named.groupBy(F.col("name").alias("indicator")).agg(F.min_by(F.struct("unit", "value_type"), F.struct("table_no", "at")).alias("f")).select("indicator", "f.*")
    return columns.select("table_no", "position", F.col("name").alias("indicator"), "unit", "year", "value_type"), not_in(first, indicators, ["indicator"])


def edit_columns(columns: DataFrame, edits: DataFrame) -> DataFrame:
    """Columns with edited unit, year and type, and the indicator where a name is given. Keys: table_no, position."""
    e = edits.select("table_no", "position", s.strip0(F.col("name")).alias("e_name"), F.col("unit").alias("e_unit"), F.col("year").alias("e_year"), F.col("value_type").alias("e_type"), F.lit(True).alias("hit"))
    met = columns.join(e, ["table_no", "position"], "left")
    hit = F.coalesce("hit", F.lit(False))
    pick = lambda new, old: F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old)
    return met.select("table_no", "position", F.when(hit & (F.col("e_name") != ""), F.col("e_name")).otherwise(F.col("indicator")).alias("indicator"), pick("e_unit", "unit"), pick("e_year", "year"), pick("e_type", "value_type"))


def delete_tables(star: dict[str, DataFrame], tables: DataFrame) -> dict[str, DataFrame]:
    """The schema without some tables (publication, pub_year, table_no), their columns and their facts."""
    return star | {k: not_in(star[k], tables, TAB) for k in ("stat_table", "table_column", "fact")}


def delete_publications(star: dict[str, DataFrame], publications: DataFrame) -> dict[str, DataFrame]:
    """The schema without some publications and all that is theirs."""
    return star | {k: not_in(star[k], publications, PUB) for k in ("publication", "chapter", "stat_table", "table_column", "fact")}


def protected(star: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Regions, categories and indicators that are in use, which may not be deleted."""
    f, c = star["fact"], star["table_column"]
    used = lambda dim, by, key: dim.join(by.select(*key).distinct(), key, "left_semi")
    return {"region": used(star["region"], f, ["region", "region_kind"]), "category": used(star["category"], f, ["category", "category_group"]), "indicator": used(star["indicator"], c, ["indicator_key"])}
