"""Helpers shared by the corpus operators: table access, stage boundaries, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import shared_dir, stage

__all__ = ["BLANK", "CRC32_SQL", "LOWER", "TEXT_ROWS", "UPPER", "crc32_sql", "lower_ascii", "replaced", "shared_dir", "stage", "table", "text_batches"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters that count as blank: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
#: Rows of an Arrow batch that holds texts.
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of ``sf_dir``, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold TEXT_ROWS rows, unless the session has a number of its own.

    Spark's default is meant for narrow rows: so many texts are tens of megabytes, several times over
    in a worker and beside the executor's heap.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def lower_ascii(s: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` works byte by byte on pure ASCII; only other strings need the slower ``translate``.
    """
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns put in place of those of the same name in any case, else appended."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


#: Opens a WITH of DuckDB SQL: the table that ``crc32_sql`` looks up.
CRC32_SQL = """crc32_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned CRC-32 of an ASCII text, FROM ``crc32_table`` beside the text's table."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, crc32_table.t[xor(c, b) % 256 + 1])), 4294967295)"
