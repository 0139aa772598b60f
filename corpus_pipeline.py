"""From raw documents to a source mix, in five stages, each a corpus operator of ``tabulith.llm``.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but
the last return the columns of ``documents``. Cut texts get their ``n_chars`` anew.

The line stage counts distinct texts per line, not documents: whole copies of a document are the
business of the stage after it, which keeps one of each group, and must not empty them before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from tabulith.llm.common import table

#: The mix is random and the quality stage is trained, so SQL can't express the rows.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    return quality.keep_good(docs, quality.train_chain(docs, table(spark, sf_dir, "labels")))


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in 10 or more different texts go."""
    cut = line_dedup.dedup_lines(docs, min_docs=10, distinct_texts=True)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, pct=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), size=10, mode="documents")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources come to their targets."""
    return mixing.mix_sources(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", common_lines),
    ("jaccard_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES:
        docs = f(spark, docs, sf_dir)
    return docs
