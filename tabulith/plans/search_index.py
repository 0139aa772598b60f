"""Substring search by trigram postings: a query reads the files that can hold a hit, then checks each row.

Rows are dealt to ``slots`` by ranges of the columns that they are mostly read by, and every slot is a folder of
its own. Postings hold, for each indexed column and each three characters of its lowered texts, the slots where
they occur. A text that contains a query of three characters or more contains all its trigrams, so the slots
that are in all their postings hold every hit. What is left is read and checked with ``contains``, so results are
those of the scan. Queries of one or two characters have no trigram and are scans.

Postings grow with the trigrams and the slots, not with the rows. A trigram that is in every row has one
posting of ``slots`` numbers, since its rows are counted once a slot before they meet. A search collects at most ``slots`` numbers.
Rows that share all values of the range columns lie in one slot; its files hold at most ``file_rows`` rows each.

Defined cases: null texts match nothing; a blank query finds no row in ``search``, and all of them in
``search_words``, as the scans do; repeated rows stay; an empty table has no slots; a column named as the
slot is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .reads import search_fields

SLOT = "search_slot"
#: Postings lie in this many folders by the hash of the trigram: a query reads as many as it has trigrams.
PARTS = 32


def _trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in time linear in its length: a look-ahead at every character."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _part(trigram: Column) -> Column:
    return F.pmod(F.hash(trigram), F.lit(PARTS))


def build(rows: DataFrame, path: str, columns: list[str], by: list[str], slots: int = 256, file_rows: int = 1_000_000) -> None:
    """Write ``rows`` under ``path`` in slots by ranges of ``by``, and the postings of ``columns``.

    Postings are made from the rows as they were written, so a task that runs again can't part them.
    """
    if SLOT in {c.lower() for c in rows.columns}:
        raise ValueError(f"{SLOT} is a column of the index")
    dealt = rows.repartitionByRange(slots, *by).withColumn(SLOT, F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy(SLOT).option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    dealt.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # an empty table leaves no file to tell it
    stored = read_rows(rows.sparkSession, path)
    texts = stored.select(SLOT, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])))
    seen = texts.select(SLOT, "field", F.explode(_trigrams(F.col("text"))).alias("trigram")).distinct()
    # at most a number a slot
    postings = seen.groupBy("field", "trigram").agg(F.array_sort(F.collect_list(SLOT)).alias("slots")).withColumn("part", _part(F.col("trigram")))
    postings.repartition(PARTS, "part").sortWithinPartitions("part", "field", "trigram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an index, whole, with their slot."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def candidate_slots(spark: SparkSession, path: str, columns: list[str], words: list[str]) -> list[int] | None:
    """The slots where each word can occur in one of the columns; None if no word has a trigram."""
    long = [w for w in words if len(w) > 2]
    if not long:
        return None
    asked = [(w, w[i : i + 3]) for w in dict.fromkeys(long) for i in range(len(w) - 2)]
    asked = spark.createDataFrame(list(dict.fromkeys(asked)), "word string, trigram string")
    parts = [x.part for x in asked.select(_part(F.col("trigram")).alias("part")).distinct().collect()]  # as many as the query is long
    postings = spark.read.schema("field string, trigram string, slots array<int>, part int").parquet(f"{path}/postings")
    found = postings.where(F.col("part").isin(parts) & F.col("field").isin(columns)).join(F.broadcast(asked), "trigram")
    need = asked.groupBy("word").agg(F.count("*").alias("need"))
    held = found.select("word", "field", F.explode("slots").alias(SLOT)).groupBy("word", "field", SLOT).agg(F.count("*").alias("n"))
    # a word is in a slot if one of the fields has all its trigrams there; a slot counts if it has all words
    word_in = held.join(F.broadcast(need), "word").where("n = need").select("word", SLOT).distinct()
    return [r[SLOT] for r in word_in.groupBy(SLOT).agg(F.count("*").alias("n")).where(F.col("n") == len(set(long))).select(SLOT).collect()]


def _pruned(spark: SparkSession, path: str, columns: list[str], words: list[str]) -> DataFrame:
    rows = read_rows(spark, path)
    slots = candidate_slots(spark, path, columns, words)
    return rows if slots is None else rows.where(F.col(SLOT).isin(slots) if slots else F.lit(False))


def search(spark: SparkSession, path: str, column: str, query: str) -> DataFrame:
    """The rows whose ``column`` contains the query in any case; a blank query finds none."""
    q = query.strip().lower()
    if not q:
        return read_rows(spark, path).where(F.lit(False)).drop(SLOT)
    return _pruned(spark, path, [column], [q]).where(F.lower(column).contains(q)).drop(SLOT)


def search_words(spark: SparkSession, path: str, columns: list[str], query: str) -> DataFrame:
    """The rows that contain each word of the query in some of the columns."""
    return search_fields(_pruned(spark, path, columns, query.lower().split()), columns, query).drop(SLOT)
