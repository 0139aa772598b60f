"""Searches through trigram postings against the scans they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from tabulith.plans import reads as r
from tabulith.plans import search_index as x

SCHEMA = "id int, title string, note string"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeÄß𝒳 .%_\n") for _ in range(rng.randint(0, 9)))
    rows = [(i, f"Row {i // 100} {word()} {word()}", word() if i % 7 else None) for i in range(2000)]
    rows += [(5, "row twice", "x"), (5, "row twice", "x"), (None, None, None), (2001, "", ""), (2002, "long " * 20_000 + "NEEDLE", "y")]
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, SCHEMA)
    x.build(df, path, ["title", "note"], ["id"], slots=16)
    return df, path


def same(a, b):
    key = lambda t: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in t)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("query", ["needle", "row 13", "twice", "äß", "%", "𝒳ab", "e.a", "zzz", "  ", "row 19 "])
def test_search_is_the_scan(spark, index, query):
    df, path = index
    same(x.search(spark, path, "title", query), r.search_text(df, "title", query, [F.col("id")], 10_000))


@pytest.mark.parametrize("query", ["abc row", "needle y", "needle needle", "zzz row", "", "twice x"])
def test_words_in_some_of_the_columns(spark, index, query):
    df, path = index
    same(x.search_words(spark, path, ["title", "note"], query), r.search_fields(df, ["title", "note"], query))


def test_few_files_are_read(spark, index):
    _, path = index
    slots = x.candidate_slots(spark, path, ["title"], ["row 13"])
    assert slots and len(slots) < 5
    assert x.candidate_slots(spark, path, ["title"], ["needle"]) == [15]
    assert x.candidate_slots(spark, path, ["title"], ["zzz"]) == []
    assert x.candidate_slots(spark, path, ["title"], ["ab"]) is None
    scan = x.search(spark, path, "title", "needle")._jdf.queryExecution().executedPlan().toString()
    assert f"({x.SLOT}" in scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]


def test_empty_table_and_clashing_column(spark, tmp_path):
    x.build(spark.createDataFrame([], SCHEMA), str(tmp_path), ["title"], ["id"], slots=4)
    assert x.search(spark, str(tmp_path), "title", "abc").count() == 0
    with pytest.raises(ValueError, match=x.SLOT):
        x.build(spark.createDataFrame([], f"id int, title string, {x.SLOT} int"), str(tmp_path), ["title"], ["id"])
