"""Checks, loads and round trips over the star schema."""

from decimal import Decimal

import pytest

from tabulith.operators import entities as e
from tabulith.operators import validate as k
from tabulith.plans import ingest as g
from tabulith.plans import reads as r
from tabulith.sources import long_csv


def cells(spark, columns, totals):
    rows = [("t", i, p + 1, False, *c) for p, col in enumerate(columns) for i, c in enumerate(col)] + [("t", 99, p + 1, True, str(t), Decimal(t), "ada") for p, t in enumerate(totals)]
    return spark.createDataFrame(rows, "t string, row int, position int, is_total boolean, text string, num decimal(24,4), flag string")


def num(x):
    return (str(x), Decimal(x), "ada")


@pytest.mark.parametrize(("column", "total", "ok", "diff"), [([10, 20], 30, True, 0), ([10, 20], 99, False, -69), ([983509, 962688], 1946197, True, 0)])
def test_totals(spark, column, total, ok, diff):
    c = cells(spark, [[num(x) for x in column]], [total])
    row = k.check_columns(c, ["t"]).first()
    assert row.matches == ok and row["diff"] == diff and k.check_tables(c, ["t"]).first().all_match == ok


def test_repair(spark):
    one = k.repair_gaps(cells(spark, [[num(10), ("-", None, "nihil")]], [99]), ["t"])
    assert {(r.row, r.text, r.num, r.flag) for r in one.collect()} == {(0, "10", 10, "ada"), (1, "89", 89, "auto_corrected"), (99, "99", 99, "ada")}
    two = cells(spark, [[num(10), ("-", None, "nihil"), ("...", None, "tidak_tersedia")]], [99])
    assert k.repair_gaps(two, ["t"]).exceptAll(two.select("t", "row", "position", "is_total", "text", "num", "flag")).count() == 0
    assert k.check_tables(one, ["t"]).first().all_match


SCHEMA = "_seq long, chapter string, table_no string, title string, region string, category string, indicator string, unit string, year string, value_num string, value_text string, flag string, source string"


def long(*rows):
    return [(i, "Bab", t, "T", region, "", ind, "ha", year, v, v, "ada", "BPS") for i, (t, region, ind, year, v) in enumerate(rows)]


def test_load_is_idempotent(spark):
    rows = spark.createDataFrame(long(("98.1.1", "Cipatujah", "Zzq Indikator Unik", "2025", "1"), ("98.1.1", "Salopa", "Zzq Indikator  Unik", "2025", "2"), ("98.1.1", "Salopa", "zzq indikator unik", "2025", "3"), ("x.1", "A", "B", "", "4"), (" ", "A", "B", "", "5")), SCHEMA)
    star, n = g.load(g.empty(spark), rows, "P", 2024)
    assert n.first().asDict() == {"new_facts": 2, "updated_facts": 1, "new_tables": 1, "new_indicators": 1, "new_regions": 2, "new_categories": 0}
    assert {(f.region, f.value_num) for f in star["fact"].collect()} == {("Cipatujah", 1), ("Salopa", 3)}
    again, n = g.load(star, rows, "P", 2024)
    assert n.first().asDict() == {"new_facts": 0, "updated_facts": 3, "new_tables": 0, "new_indicators": 0, "new_regions": 0, "new_categories": 0}
    for name in g.SCHEMAS:
        assert star[name].exceptAll(again[name]).count() == 0 and again[name].exceptAll(star[name]).count() == 0, name
    assert [x.table_no for x in g.quarantined(g.prepare(rows, "P", 2024)).collect()] == ["x.1"]


def test_null_keys_merge(spark):
    star, _ = g.load(g.empty(spark), spark.createDataFrame(long(("1.1", "a", "i", "2025", "1")), SCHEMA), "P", 2024)
    _, n = g.load(star, spark.createDataFrame(long(("1.1", "a", "i", "2025", "2"), ("1.1", "", "i", "", "3"), ("1.1", "", "i", "", "4")), SCHEMA), "P", 2024)
    assert (n.first().new_facts, n.first().updated_facts) == (1, 2)


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(long(("98.1.1", 'Ci"pa, tujah', "Luas\nDaerah", "2025", "241")), SCHEMA)
    star, _ = g.load(g.empty(spark), rows, "P", 2024)
    long_csv.write_long_csv(r.export_rows(star), str(tmp_path / "x"), bom=True)
    head = next(p for p in (tmp_path / "x").iterdir() if p.name.startswith("part-00000")).read_text()
    assert head.startswith("﻿bab,nomor_tabel,") and "241" in head
    again, _ = g.load(g.empty(spark), long_csv.read_long_csv(spark, str(tmp_path / "x")), "P", 2024)
    assert again["fact"].exceptAll(star["fact"]).count() == 0 and star["fact"].count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        long_csv.read_long_csv(spark, str(tmp_path / "none"))


def test_similar_entities(spark):
    master = spark.createDataFrame([("Cipatujah",), ("Karangnunggal",), ("Salopa",)], "entity string")
    labels = spark.createDataFrame([("1. cipatujah",), ("Cipatuja",), ("Karangnungal",), ("Salop",), ("Elsewhere",), ("12",)], "label string")
    got = {x.label: x.entity for x in e.resolve(labels, master, "label").collect()}
    assert got == {"1. cipatujah": "Cipatujah", "Cipatuja": "Cipatujah", "Karangnungal": "Karangnunggal", "Salop": "Salopa"}


def test_view_has_all_columns(spark):
    rows = spark.createDataFrame(long(*[("1.1", "a", f"i{k}", "2025", str(k)) for k in range(12)], ("1.2", "a", "x", "2025", "1")), SCHEMA)
    star, _ = g.load(g.empty(spark), rows, "P", 2024)
    assert r.table_positions(star, ("P", 2024, "1.1")) == list(range(1, 13)) and r.table_positions(star, ("P", 2024, "none")) == []
    # another publication has a table of the same number: the pages stay apart
    star, _ = g.load(star, spark.createDataFrame(long(("1.1", "a", "other", "2025", "99")), SCHEMA), "P", 2025)
    row = r.table_view(star, ("P", 2024, "1.1"), r.table_positions(star, ("P", 2024, "1.1")), "kabupaten").first()
    pages = {(x.pub_year, x.table_no): x.cells for x in r.table_rows(star, "kabupaten").collect()}
    assert pages == {(2024, "1.1"): [str(k) for k in range(12)], (2024, "1.2"): ["1"], (2025, "1.1"): ["99"]}
    assert {(x.pub_year, x.table_no): x.status for x in g.verify_tables(star["stat_table"], star["stat_table"].where("pub_year = 2024 AND table_no = '1.1'")).collect()} == {(2024, "1.1"): "verifikasi", (2024, "1.2"): "ekstrak", (2025, "1.1"): "ekstrak"}
    assert [row[f"c{p}"] for p in range(1, 13)] == [str(k) for k in range(12)]


def test_publication_by_title(spark):
    have = spark.createDataFrame([("P", 2020)], "publication string, pub_year int")
    both = lambda df: sorted(tuple(r) for r in df.collect())
    assert both(g.with_publication(have, "P", 2021)) == [("P", 2020), ("P", 2021)]
    assert both(g.with_publication(have, "P", 2021, by_title=True)) == [("P", 2020)]
    assert both(g.with_publication(have, "Q", 2021, by_title=True)) == [("P", 2020), ("Q", 2021)]


def test_grid_of_category_tables(spark):
    tab = "publication string, pub_year int, table_no string"
    cells = spark.createDataFrame([("P", 1, "1.1", "X", 1, None, "x", "ada", False), ("P", 1, "1.2", "A", 2, None, "a", "ada", False)], f"{tab}, subject string, position int, value_num decimal(24,4), value_text string, flag string, is_total boolean")
    columns = spark.createDataFrame([("P", 1, t, k) for t in ("1.1", "1.2") for k in (1, 2)], f"{tab}, position int")
    tables = spark.createDataFrame([("P", 1, "1.1", "kategori"), ("P", 1, "1.2", "kecamatan")], f"{tab}, row_kind string")
    got = r.entry_grid(cells, columns, spark.createDataFrame([("A",), ("B",)], "entity string"), "All", tables).collect()
    assert sorted((x.table_no, x.subject, x.position, x.is_total, x.text) for x in got) == [
        ("1.1", "X", 1, False, "x"), ("1.1", "X", 2, False, ""),
        ("1.2", "A", 1, False, ""), ("1.2", "A", 2, False, "a"), ("1.2", "All", 1, True, ""), ("1.2", "All", 2, True, ""), ("1.2", "B", 1, False, ""), ("1.2", "B", 2, False, ""),
    ]


def test_audit_finds_faults_of_every_key(spark):
    star, _ = g.load(g.empty(spark), spark.createDataFrame(long(("1.1", "a", "i", "2025", "1"), ("1.1", "a", "j", "2025", "1")), SCHEMA), "P", 2024)
    assert {r["keys"] for r in k.audit_keys(star).collect()} == {0} and {x.rows for x in k.audit_values(star).collect()} == {0}
    twice = star | {t: star[t].unionByName(star[t]) for t in ("publication", "chapter", "stat_table", "indicator")}
    moved = star["table_column"].selectExpr("publication", "pub_year", "table_no", "indicator_key", "year", "1 AS position", "unit", "value_type")
    found = {(r.table, r.key.rsplit(", ", 1)[-1]): r["keys"] for r in k.audit_keys(twice | {"table_column": moved}).collect()}
    assert found == {("publication", "pub_year"): 1, ("chapter", "chapter_no"): 1, ("stat_table", "table_no"): 1, ("indicator", "indicator_key"): 2, ("table_column", "position"): 1, ("table_column", "year"): 0, ("region", "region_kind"): 0, ("category", "category_group"): 0}
    paper = star["publication"].selectExpr("publication", "pub_year", "coverage", "'paper' AS kind", "file", "note")
    assert [(r.table, r.rule) for r in k.audit_values(star | {"publication": paper}).collect() if r.rows] == [("publication", "kind")]


def test_a_load_sorts_no_rows_for_dimensions_and_joins_no_facts(spark):
    """Dimensions take hash aggregates of the rows; old facts and rows meet in one window, not in a full join."""
    rows = spark.createDataFrame(long(("1.1", "a", "i", "2025", "1"), ("1.1", "a", "i", "2025", "2"), ("1.1", "", "j", "", "3")), SCHEMA)
    star, _ = g.load(g.empty(spark), rows, "P", 2024)
    again, n = g.load(star, rows.selectExpr("* except (value_num)", "'7' AS value_num"), "P", 2024)
    assert {(f.indicator_key, f.value_num) for f in again["fact"].collect()} == {("i", 7), ("j", 7)} and (n.first().new_facts, n.first().updated_facts) == (0, 3)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan(again["fact"])
    for table in ("chapter", "stat_table", "indicator", "table_column"):
        assert "HashAggregate" in plan(star[table]) and "partial_min_by" in plan(star[table]), table
        least = [line for line in plan(star[table]).splitlines() if "partial_min(_seq" in line]
        assert least and all("HashAggregate" in line for line in least), table


def test_preparing_strips_each_text_once_outside_of_one_large_method(spark):
    """Each text is stripped as a column of its own: no array of all texts is walked for each row."""
    odd = long(("\u00a01.1 ", " a\t", "\u3000Luas  –  Panen / b ", " 2025 ", " 1.5\n"), (" x ", "", None, "", "n.a."))
    p = g.prepare(spark.createDataFrame(odd, SCHEMA), "P", 2024)
    found = {r.table_no: (r.region, r.indicator_key, r.year, r.value_num, r.chapter_no) for r in p.collect()}
    assert found["1.1"] == ("a", "luas - panen/b", 2025, 1.5, 1) and found["x"] == (None, "", None, None, None)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(array(") == 2 and "AS bare" not in plan


def test_a_load_reduces_rows_before_it_prepares_them(spark, monkeypatch):
    """What is written down has a row for each head, not for each row; values come from the last row of a key alone."""
    staged = []
    monkeypatch.setattr(g, "stage", lambda df: staged.append(df) or df)
    rows = spark.createDataFrame(long(*[("1.1", (" a", "b")[k % 2], "i", "2025", str(k)) for k in range(40)]), SCHEMA)
    # the last row twice under one number, and another key under that number
    again = rows.where("_seq = 39").unionByName(rows.where("_seq = 39").selectExpr("* except (region, value_num)", "'c' AS region", "'n.a.' AS value_num"))
    star, n = g.load(g.empty(spark), rows.unionByName(again), "P", 2024)
    assert [df.count() for df in staged] == [2]
    assert sorted((f.region, f.value_num, f.value_text) for f in star["fact"].collect()) == [("a", 38, "38"), ("b", 39, "39"), ("c", None, "39")]
    assert (n.first().new_facts, n.first().updated_facts) == (3, 39) and star["table_column"].first().value_type == "numerik"


def test_counts_of_a_load_carry_no_values(spark):
    """Keys come from hash aggregates alone, also those of facts that an earlier load made: no sort, window or join for values."""
    rows = spark.createDataFrame(long(("1.1", "a", "i", "2025", "1"), ("1.1", " a", "i", "2025", "2"), ("1.1", "", "j", "", "3")), SCHEMA)
    first, _ = g.upsert(g.empty(spark)["fact"], rows, "P", 2024)
    again, n = g.upsert(first, rows.selectExpr("* except (_seq, region)", "_seq + 10 AS _seq", "concat(region, 'b') AS region"), "P", 2024)
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Window", "Join", "SortAggregate", "max(struct") if x in plan]
    assert (n.first().new_facts, n.first().updated_facts) == (2, 1)
    assert {(f.region, f.value_num) for f in again.collect()} == {("a", 2), (None, 3), ("ab", 2), ("b", 3)}
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
