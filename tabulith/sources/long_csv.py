"""Exchange rows in CSV files: reading by the names in the header, writing in the three layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stages import stage
from .csv_records import csv_records, file_ranges, text_lines

# The columns of the exchange format, and their names in this library.
COLUMNS = {
    "bab": "chapter", "nomor_tabel": "table_no", "judul_tabel": "title", "wilayah": "region", "rincian": "category", "indikator": "indicator",
    "satuan": "unit", "tahun": "year", "nilai_num": "value_num", "nilai_teks": "value_text", "flag": "flag", "sumber": "source",
}
LEGACY = [c for c in COLUMNS if c not in ("rincian", "tahun")]


#: The order of an export: facts by table, category, region and year, as text.
ORDER = ("table_no", "category", "region", "year")
_CSV = {"quote": '"', "escape": '"'}


def read_long_csv(spark: SparkSession, path: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """Exchange rows as text, with ``_seq`` in the order of file names and of rows in a file. A missing path is an error.

    Files are read in ranges, also where values hold line breaks.
    """
    return parse_long_csv(text_lines(spark, path), columns)


def parse_long_csv(lines: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """The rows that ``text_lines`` hold. Columns go by the names in a file's first line; one that isn't there is null.

    A byte order mark, blanks and quotes around names don't count. A file whose first line has none of the names
    has no header: it is a part of an export, under the header of the first file that has one (in default
    order if there is none).
    """
    ranges = stage(file_ranges(lines))
    names = F.transform(F.split(F.regexp_replace("first", "^\ufeff", ""), ","), lambda x: F.btrim(x, F.lit('" \t\r')))
    heads = ranges.where("block = 0").select("file", names.alias("names"))
    places = F.array(*[F.array_position("names", c) - 1 for c in columns])
    heads = heads.select("file", F.size("names").alias("width"), places.alias("places"), F.arrays_overlap("names", F.lit(list(columns))).alias("has"))
    seen = heads.where("has").agg(F.max("width").alias("width"), F.min_by("places", "file").alias("places")).first()
    width, shared = seen["width"] or len(columns), seen["places"] or list(range(len(columns)))

    records = csv_records(lines, ranges).join(F.broadcast(heads), "file")  # a row a file
    fields = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), _CSV | {"multiLine": "true"})
    at = F.when(F.col("has"), F.col("places")).otherwise(F.lit(shared).cast("array<bigint>"))
    rows = records.where("NOT (has AND block = 0 AND at = 0)").select(F.struct("file", "block", "at").alias("_seq"), fields.alias("f"), at.alias("places"))
    values = rows.select("_seq", F.array(*[f"f.c{i}" for i in range(width)]).alias("v"), "places")
    return values.select("_seq", *[F.get("v", F.get("places", F.lit(i)).cast("int")).alias(n) for i, n in enumerate(columns.values())])


def write_long_csv(rows: DataFrame, path: str, columns: list[str] | None = None, bom: bool = False, order: tuple[str, ...] = ORDER) -> None:
    """Exchange rows to CSV files that, put together in the order of their names, are one file sorted by ``order``.

    Rows are dealt to sampled ranges of ``order``; the header is a row before all others, so it and its byte
    order mark (``bom``) are in the first part alone. Nulls are blank.
    """
    columns = columns or list(COLUMNS)
    keys = [F.col(c).cast("string").alias(f"key{i}") for i, c in enumerate(order)]
    body = rows.select(F.lit(1).alias("is_row"), *keys, *[F.coalesce(F.col(COLUMNS[c]).cast("string"), F.lit("")).alias(c) for c in columns])
    names = [F.lit(("\ufeff" if bom and i == 0 else "") + c).alias(c) for i, c in enumerate(columns)]
    top = rows.sparkSession.range(1).select(F.lit(0).alias("is_row"), *[F.lit(None).cast("string").alias(f"key{i}") for i in range(len(order))], *names)
    by = ["is_row", *[F.col(f"key{i}").asc_nulls_first() for i in range(len(order))], *columns]
    ordered = top.unionByName(body).orderBy(*by).select(*columns)
    ordered.write.mode("overwrite").csv(path, header=False, emptyValue="", encoding="UTF-8", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **_CSV)


def write_legacy_csv(rows: DataFrame, path: str) -> None:
    """The older layout without category and year."""
    write_long_csv(rows, path, LEGACY, order=("table_no", "region"))
