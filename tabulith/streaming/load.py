"""Exchange files that arrive in a folder, loaded into a stored star schema batch by batch.

Tables are stored in buckets by a hash of their key columns. A micro batch is one idempotent load: it reads
the buckets that its rows can touch, merges, and writes these anew beside the old ones; a small list of
each version says which folder holds each bucket, and a version counts once its list is written. A batch
that is run again after a failure writes its own folders again, so every file counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.stages import stage
from ..plans import ingest
from ..sources.long_csv import parse_long_csv


#: Buckets of each table that is keyed by tables or facts; the others are small and have one.
BUCKETS = 64
_BUCKETED = ("stat_table", "table_column", "fact")


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*ingest.TAB), F.lit(BUCKETS)).cast("int")


def _folders(spark: SparkSession, path: str, version: int) -> dict[tuple[str, int], str]:
    """The folder of each table's buckets in a version: at most BUCKETS rows a table."""
    if version < 0:
        return {}
    return {(r["table"], r["bucket"]): r["folder"] for r in spark.read.parquet(f"{path}/v{version}/list").collect()}


def read_star(spark: SparkSession, path: str, version: int, buckets: set[int] | None = None) -> dict[str, DataFrame]:
    """The tables of a version, or some buckets of the large ones; version -1 is the empty schema."""
    at: dict[str, list[str]] = {}
    for (table, bucket), folder in _folders(spark, path, version).items():
        if buckets is None or table not in _BUCKETED or bucket in buckets:
            at.setdefault(table, []).append(f"{path}/{folder}")
    blank = ingest.empty(spark)
    return {k: spark.read.schema(v).parquet(*at[k]) if k in at else blank[k] for k, v in ingest.SCHEMAS.items()}


def write_star(star: dict[str, DataFrame], path: str, version: int, buckets: set[int]) -> None:
    """A version in which the given buckets, and the tables of one bucket, are those of ``star``."""
    spark = star["fact"].sparkSession
    folders = dict(_folders(spark, path, version - 1))
    for k, df in star.items():
        top = f"v{version}/{k}"
        if k in _BUCKETED:
            df.withColumn("bucket", _bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{top}")
            written = {r["bucket"] for r in spark.read.parquet(f"{path}/{top}").select("bucket").distinct().collect()} if buckets else set()
            folders |= {(k, b): f"{top}/bucket={b}" for b in written}
        else:
            df.write.mode("overwrite").parquet(f"{path}/{top}")
            folders[k, 0] = top
    rows = [(table, bucket, folder) for (table, bucket), folder in sorted(folders.items())]
    spark.createDataFrame(rows, "table string, bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{version}/list")


def stream_long_rows(spark: SparkSession, source: str, target: str, publication: str, pub_year: int) -> DataStreamWriter:
    """A writer that keeps the star schema under ``target`` up to date with CSV files under ``source``.

    Start it with a trigger and a checkpoint location; the caller owns both.
    """
    lines = spark.readStream.text(source, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def load(batch: DataFrame, version: int) -> None:
        batch = stage(parse_long_csv(batch))
        prepared = ingest.prepare(batch, publication, pub_year).where("chapter_no is not null")
        buckets = {r["b"] for r in prepared.select(_bucket().alias("b")).distinct().collect()}  # BUCKETS at most
        star, _ = ingest.load(read_star(batch.sparkSession, target, version - 1, buckets), batch, publication, pub_year)
        write_star(star, target, version, buckets)

    return lines.writeStream.foreachBatch(load)
