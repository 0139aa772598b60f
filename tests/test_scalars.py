"""Hand-derived values of the scalar functions."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulith.functions import scalars as s


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


NUMBERS = [
    ("1.946.197", "1946197", "ada"), ("2.706,82", "2706.82", "ada"), ("(1.234,5)", "-1234.5", "ada"), ("5,", "5", "ada"), (",5", "0.5", "ada"), ("-", None, "nihil"), ("–", None, "nihil"), ("(-)", None, "nihil"), ("Kota-kota", None, "nihil"),
    ("", None, "tidak_tersedia"), (None, None, "tidak_tersedia"), ("...", None, "tidak_tersedia"), ("12 ...", None, "tidak_tersedia"), ("..", None, "tidak_tersedia"), ("…", None, "tidak_tersedia"), ("Cipatujah", None, "tidak_tersedia"),
    ("1,2,3", None, "perlu_cek"), ("-5", "5", "ada"), ("2021-2025", "20212025", "ada"), (" 7 ", "7", "ada"),
]


def test_printed_numbers(spark):
    got = values(spark, [t for t, *_ in NUMBERS], s.clean_num(F.col("t"))["num"], s.clean_num(F.col("t"))["flag"])
    assert got == [(None if n is None else Decimal(n).quantize(Decimal("0.0001")), f) for _, n, f in NUMBERS]


def test_typed_numbers(spark):
    got = values(spark, ["2.706,82", "", "-5", "1e5", None], s.parse_entry(F.col("t")))
    assert got == [(Decimal("2706.8200"),), (None,), (Decimal("-5.0000"),), (None,), (None,)]
    assert values(spark, ["2024/2025", "25", "", None], s.to_year(F.col("t"))) == [(2024,), (None,), (None,), (None,)]
    assert values(spark, ["1946197", "2706.8200", None, "-0.5"], s.format_id(F.col("t").cast(s.DECIMAL))) == [("1.946.197",), ("2.706,82",), ("",), ("-0,5",)]


def test_keys(spark):
    same = ["Laki-laki", "Laki-Laki", "laki–laki"], ["Jumlah Desa / Kelurahan", "Jumlah Desa/Kelurahan"]
    for group in same:
        assert len(set(values(spark, group, s.norm_indicator(F.col("t"))))) == 1
    assert values(spark, ["  Luas   Daerah "], s.norm_indicator(F.col("t"))) == [("luas daerah",)]
    assert values(spark, ["12. Ci-patujah", "3) X", "99"], s.entity_key(F.col("t"))) == [("cipatujah",), ("x",), ("",)]


@pytest.mark.parametrize(("header", "unit", "name"), [("Luas (km2/sq.km)", "km2", "Luas"), ("Tinggi (m a.s.l) (1)", "m", "Tinggi"), ("Guru/Teachers", "", "Guru"), ("Tegal/Kebun", "", "Tegal/Kebun"), ("X ( ) (2)", "", "X")])
def test_headers(spark, header, unit, name):
    assert values(spark, [header], s.unit_of(F.col("t")), s.column_name(F.col("t"))) == [(unit, name)]


def test_years(spark):
    got = values(spark, ["Negeri 2024/2025 2025/2026", "2024/2025", "Negeri"], s.without_years(F.col("t")), s.only_years(F.col("t")), s.first_year(F.col("t")))
    assert got == [("Negeri", False, "2024"), ("2024/2025", True, "2024"), ("Negeri", False, "")]
    assert values(spark, ["Luas Panen, Menurut Kecamatan", None], s.title_indicator(F.col("t"))) == [("Luas Panen",), ("",)]
