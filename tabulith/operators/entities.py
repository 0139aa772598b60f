"""Matching of labels to a master list of entities, and what it says about a table.

The master list is a parameter. Its normalised names are joined to distinct labels, so a label is matched
once however often it occurs. The list is small by nature; adaptive execution broadcasts it when it is.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scalars as s


def _master(master: DataFrame) -> DataFrame:
    """(entity, key); of entities with one key the greatest name counts."""
    return master.select("entity", s.entity_key(F.col("entity")).alias("key")).where("key <> ''").groupBy("key").agg(F.max("entity").alias("entity"))


def resolve_exact(labels: DataFrame, master: DataFrame, label: str) -> DataFrame:
    """(label, entity) of labels whose letters are those of an entity."""
    keyed = labels.select(label, s.entity_key(F.col(label)).alias("key")).where("key <> ''")
    return keyed.join(_master(master), "key").select(label, "entity")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The sequence similarity of two keys, the master's first: the measure is not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def resolve(labels: DataFrame, master: DataFrame, label: str, cutoff: float = 0.82) -> DataFrame:
    """(label, entity, ratio): exact matches, and for other labels the most similar entity from ``cutoff`` on.

    Ties go to the greater key. Distinct unmatched keys and master keys meet in an index of the master's parts
    (``similar_candidates``); of these only those with letters enough in common are compared in sequence.
    """
    m = _master(master)
    exact = resolve_exact(labels, master, label).withColumn("ratio", F.lit(1.0))
    keyed = labels.select(label, s.entity_key(F.col(label)).alias("key")).where("key <> ''")
    rest = keyed.join(m.select("key"), "key", "left_anti")
    pairs = similar_candidates(rest.select("key").distinct(), m.select(F.col("key").alias("mkey")), cutoff)
    common = F.aggregate(F.zip_with(_letters(F.col("key")), _letters(F.col("mkey")), lambda a, b: F.least(a, b)), F.lit(0), lambda t, x: t + x)
    near = pairs.where(2 * common >= cutoff * (F.length("key") + F.length("mkey")))
    found = near.withColumn("ratio", _ratio("mkey", "key")).where(F.col("ratio") >= cutoff)
    best = found.join(m.withColumnRenamed("key", "mkey"), "mkey").groupBy("key").agg(F.max_by(F.struct("entity", "ratio"), F.struct("ratio", "mkey")).alias("m"))
    fuzzy = rest.join(best, "key").select(label, "m.entity", "m.ratio")
    return exact.select(label, "entity", "ratio").unionByName(fuzzy)


#: Keys with more letters meet by length alone: their parts would be too many rows.
LONG_KEY = 48


def _cut_in_parts(keys: DataFrame, key: str, size: str, other: str, cutoff: float) -> DataFrame:
    """A row for each part of the master's keys, and each length of the other key: how they are cut depends on both.

    The ratio is 2 M / S with M letters matched, in order, of S. So of a pair that reaches the cutoff
    at most u = S - 2 M letters are unmatched. Each spoils one of u + 1 parts of the master's key at most: one part
    is in the label as it is, moved by no more than the unmatched letters before it.
    """
    n = F.length(key)
    low, high = F.ceil(n * (cutoff / (2 - cutoff)) - 1e-9).cast("int"), F.floor(n * ((2 - cutoff) / cutoff) + 1e-9).cast("int")
    met = keys.select(key, n.alias("own"), F.explode(F.sequence(low, high)).alias("far")).select(key, F.col("own").alias(size), F.col("far").alias(other))
    total = F.col("la") + F.col("lb")
    met = met.withColumn("m", F.ceil(total * (cutoff / 2) - 1e-9).cast("int")).where(F.col("m") <= F.least("la", "lb"))
    parts = (total - 2 * F.col("m") + 1).alias("parts")
    met = met.select("*", parts).where("parts <= lb").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    longer = F.col("i") - (F.col("parts") - F.col("lb") % F.col("parts"))
    base = F.floor(F.col("lb") / F.col("parts")).cast("int")
    return met.select("*", (F.col("i") * base + F.greatest(longer, F.lit(0))).alias("at"), (base + (longer >= 0).cast("int")).alias("chars"))


def similar_candidates(labels: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """(key, mkey) of all keys whose sequence ratio can reach ``cutoff``, and some others.

    An index of parts of the master's keys, by part, its number and both lengths. A label looks its pieces up
    only where a part can have moved to: some part is intact with fewer unmatched letters before it than its
    number, and fewer after it than there are parts after it, or another part is.
    """
    parts = _cut_in_parts(names.where(F.length("mkey") <= LONG_KEY), "mkey", "lb", "la", cutoff)
    index = parts.select("mkey", "la", "lb", "i", F.substring("mkey", F.col("at") + 1, F.col("chars")).alias("part"))
    asked = _cut_in_parts(labels.where(F.length("key") <= LONG_KEY * 2), "key", "la", "lb", cutoff).where(F.col("lb") <= LONG_KEY)
    after, moved = F.col("parts") - 1 - F.col("i"), F.col("at") + F.col("la") - F.col("lb")
    low = F.greatest(F.lit(0), F.col("at") - F.col("i"), moved - after, F.col("at") - (F.col("lb") - F.col("m")))
    high = F.least(F.col("la") - F.col("chars"), F.col("at") + F.col("i"), moved + after, F.col("at") + (F.col("la") - F.col("m")))
    places = asked.select("*", low.alias("low"), high.alias("high")).where("low <= high").withColumn("place", F.explode(F.sequence("low", "high")))
    pieces = places.select("key", "la", "lb", "i", F.substring("key", F.col("place") + 1, F.col("chars")).alias("part"))
    found = pieces.join(index, ["part", "i", "la", "lb"]).select("key", "mkey")

    # where a part would be empty (very short keys, low cutoffs) and for long keys: all of near lengths
    total = F.length("key") + F.col("lb")
    rest = names.select("mkey", F.length("mkey").alias("lb"))
    sizes = rest.withColumn("la", F.explode(F.sequence(F.ceil(F.col("lb") * (cutoff / (2 - cutoff)) - 1e-9).cast("int"), F.floor(F.col("lb") * ((2 - cutoff) / cutoff) + 1e-9).cast("int"))))
    loose = (F.col("lb") > LONG_KEY) | (total - 2 * F.ceil(total * (cutoff / 2) - 1e-9) + 1 > F.col("lb"))
    near = labels.join(sizes, F.length("key") == F.col("la")).where(loose).select("key", "mkey")
    return found.unionByName(near).distinct()


def _letters(key: Column) -> Column:
    """How often each letter from a to z is in a key, which has no others."""
    return F.array(*[F.length(key) - F.length(F.replace(key, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz"])


def resolve_by_edits(labels: DataFrame, master: DataFrame, label: str, edits: int = 2) -> DataFrame:
    """(label, entity, edits): the entity of fewest single-letter edits, at most ``edits``; ties to the greater name."""
    names = _master(master).select(F.col("key").alias("mkey"), "entity", F.explode(F.sequence(F.greatest(F.length("key") - edits, F.lit(1)), F.length("key") + edits)).alias("size"))
    keyed = labels.select(label, s.entity_key(F.col(label)).alias("key")).where("key <> ''")
    pairs = keyed.select("key", F.length("key").alias("size")).distinct().join(names, "size").withColumn("edits", F.levenshtein("key", "mkey")).where(F.col("edits") <= edits)
    best = pairs.groupBy("key").agg(F.max_by("entity", F.struct(-F.col("edits"), "mkey")).alias("entity"), F.min("edits").alias("edits"))
    return keyed.join(best.select("key", "entity", "edits"), "key").select(label, "entity", "edits")


def completeness(rows: DataFrame, master: DataFrame, table: list[str]) -> DataFrame:
    """Per table: entities found, expected, and whether a total row is there. ``rows``: table, entity, is_total."""
    expected = master.select(F.count_distinct("entity").alias("expected"))
    found = rows.groupBy(*table).agg(F.count_distinct("entity").alias("found"), F.coalesce(F.bool_or("is_total"), F.lit(False)).alias("has_total"))
    return found.join(F.broadcast(expected)).withColumn("complete", F.col("found") == F.col("expected"))


def missing_entities(rows: DataFrame, master: DataFrame, table: list[str]) -> DataFrame:
    """(table, entity) of master entities that a table lacks."""
    wanted = rows.select(*table).distinct().join(master.select("entity").distinct())
    return wanted.join(rows.select(*table, "entity").distinct(), [*table, "entity"], "left_anti")


def row_kind(rows: DataFrame, table: list[str], least: int = 5) -> DataFrame:
    """Per table "kecamatan" when at least ``least`` distinct entities label its rows, else "kategori"."""
    return rows.groupBy(*table).agg(F.when(F.count_distinct("entity") >= least, "kecamatan").otherwise("kategori").alias("row_kind"))


def row_kind_by_count(rows: DataFrame, table: list[str], least: int = 5) -> DataFrame:
    """The same for model pages: rows that match count, not distinct entities."""
    return rows.groupBy(*table).agg(F.when(F.count("entity") >= least, "kecamatan").otherwise("kategori").alias("row_kind"))
