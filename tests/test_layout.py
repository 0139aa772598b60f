"""Hand-derived results of the layout, header and segmentation operators."""

import random

import pytest
from pyspark.sql import functions as F

from tabulith.operators import assembly as a
from tabulith.operators import headers as h
from tabulith.operators import layout as y


def frame(spark, rows, schema):
    return spark.createDataFrame([("d", 1, *r) for r in rows], f"doc_id string, page_no int, {schema}")


def test_lines_go_by_their_first_top(spark):
    items = frame(spark, [(i, t, 0.0, "x") for i, t in enumerate([10.0, 11.0, 13.5, 14.2, 20.0, 23.9, 24.1])], "seq int, top double, x0 double, text string")
    got = {r.line_top for r in y.cluster_lines(items, 4.0).collect()}
    assert got == {10.0, 14.2, 20.0, 24.1}


@pytest.mark.parametrize(("boxes", "edges"), [([(10.0, 50.0), (100.0, 140.0), (200.0, 250.0)], [10.0, 75.5, 170.5, 250.0]), ([(10.0, 50.0), (52.0, 90.0)], None)])
def test_gutters(spark, boxes, edges):
    assert y.gutter_edges(frame(spark, boxes, "x0 double, x1 double"), 7.0).first().edges == edges


def test_recognised_words_to_cells(spark):
    w = frame(spark, [(0, "Cipatujah", 50.0, 110.0, 200.0, 209.0), (1, "241", 210.0, 240.0, 200.0, 209.0), (2, "Salopa", 50.0, 100.0, 220.0, 229.0), (3, "99", 215.0, 240.0, 220.0, 229.0)], "seq int, text string, x0 double, x1 double, top double, bottom double")
    g = y.word_glyphs(w)
    assert g.count() == 20 and "Cipatujah" in y.page_texts(g).first().text
    edges = y.gutter_edges(g)
    assert edges.first().edges == [50.0, 160.5, 240.0]
    cells = y.to_columns(y.cluster_lines(g, 4.0), edges).orderBy("line_top").collect()
    assert [r.cols for r in cells] == [["Cipatujah", "241"], ["Salopa", "99"]]


def test_fake_bold(spark):
    g = frame(spark, [(0, "a", 0.0, 5.0), (1, "a", 1.5, 5.0), (2, "a", 3.0, 5.0), (3, "b", 3.1, 5.0), (4, "a", 3.2, 5.0)], "seq int, text string, x0 double, top double")
    assert sorted(r.seq for r in y.dedup_bold(g).collect()) == [0, 2, 3, 4]


def test_pending_labels(spark):
    rows = [("Eselon", False), ("Eselon II", False), ("", True), ("Staf", True), ("", True), ("X", False), ("Y", True), ("", True)]
    lines = frame(spark, [(float(i), [label, "7" if v else ""]) for i, (label, v) in enumerate(rows)], "line_top double, cols array<string>")
    assert [r.label for r in y.split_rows(lines, "kabupaten x").orderBy("line_top").collect()] == ["Eselon II", "Staf", "Y"]


def test_model_segments(spark):
    pages = [("", False), ("1.1", False), ("9.9", True), ("1.1", False), ("", False), ("1.2", False), ("1.1", True), ("1.2", False)]
    df = spark.createDataFrame([("d", i, n, c) for i, (n, c) in enumerate(pages)], "doc_id string, page_no int, table_no string, continued boolean")
    assert [r.table_idx for r in a.segment_model_pages(df).orderBy("page_no").collect()] == [1, 2, 2, 2, 2, 3, 3, 3]


def test_header_names(spark):
    blocks = [("Sekolah/Schools", 1.0, 0), ("Negeri 2024/2025", 2.0, 0), ("2023/2024", 1.0, 1), ("Luas (km2)", 1.0, 2), ("Jumlah 2020", 1.0, 3)]
    df = frame(spark, [(t, top, 0, c) for t, top, c in blocks], "text string, line_top double, block int, col int")
    got = {r.col: (r.name, r.unit, r.year) for r in h.parse_headers(df).collect()}
    assert got == {0: ("[Sekolah] Negeri", "", "2024"), 1: ("", "", "2023"), 2: ("Luas", "km2", ""), 3: ("Jumlah", "", "2020")}


def test_identity(spark):
    df = spark.createDataFrame([("Lanjutan Tabel 4.1.2\nx",), (" 3.2.1 \nSumber/Source : BPS X",), ("nothing",)], "t string")
    got = [tuple(r) for r in df.select(a.continued(F.col("t")), a.table_number(F.col("t")), a.source_line(F.col("t"))).collect()]
    assert got == [(True, "4.1.2", ""), (False, "3.2.1", "BPS X"), (False, None, "")]


def test_model_json(spark):
    """Answers under the model's keys are read; cut and broken ones are null, so their pages are set aside."""
    good = '{"nomor_tabel":"1.1","lanjutan":true,"headers":[{"nama":"Luas","satuan":"ha","tahun":"2024"}],"label_kolom":"Kecamatan","rows":[{"label":"a","values":["1"]}],"total_row":null}'
    texts = [f"```json\n{good}\n```", f"```\n{good} ```", '{"table_no": , "rows": [}', '{"nomor_tabel":"1","rows":[{"label":"a"}', good[:-1], good + "}", f"Here: {good}", "[1]", "{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(a.parse_page_json(F.col("t"))).collect()]
    for x in got[:2]:
        assert (x.table_no, x.continued, x.label_column, x.total_row) == ("1.1", True, "Kecamatan", None)
        assert x.headers[0].asDict() == {"name": "Luas", "unit": "ha", "year": "2024"} and x.rows[0]["values"] == ["1"]
    assert got[2:] == [None] * 9 and {r.i for r in a.unreadable_pages(df, "t").collect()} == set(range(2, 11))


def test_many_items_of_one_page(spark):
    """Runs much longer than a block of the fold, against the plain loop."""
    rng = random.Random(3)
    tops = [i * 2.5 + rng.random() for i in range(3000)] + [9000.0 + rng.random() for _ in range(3000)] + [None]
    items = frame(spark, [(i, t, float(i % 7), "ab"[i % 3 // 2]) for i, t in enumerate(tops)], "seq int, top double, x0 double, text string")
    firsts, want = [], {None: None}
    for t in sorted(tops[:-1]):
        if not firsts or t - firsts[-1] > 4.0:
            firsts.append(t)
        want[t] = firsts[-1]
    got = y.cluster_lines(items, 4.0).collect()
    assert len(got) == len(tops) and len(firsts) > y.BLOCK
    assert all(r.line_top == want[r.top] for r in got)

    near = frame(spark, [(i, i * 1.5, 0.0, "a") for i in range(2 * y.BLOCK + 2)], "seq int, top double, x0 double, text string")
    assert sorted(r.seq for r in y.dedup_bold(near).collect()) == list(range(0, 2 * y.BLOCK + 2, 2))


def test_long_recognised_words_stay_apart(spark):
    w = frame(spark, [(i, c * 1500, 0.0, 10.0, 0.0, 9.0) for i, c in enumerate("ab")], "seq int, text string, x0 double, x1 double, top double, bottom double")
    assert y.page_texts(y.word_glyphs(w)).first().text == "a" * 1500 + "b" * 1500


def test_equal_glyphs_that_lie_apart_are_not_folded(spark, monkeypatch):
    """Doubled letters side by side form no run, in either order: a fold that loses all it is given loses none of them."""
    g = spark.createDataFrame([(1, 1, 1, "l", 10.0, 5.0), (1, 1, 2, "l", 14.5, 7.0), (1, 1, 3, "l", 19.0, 9.0)], "doc_id long, page_no long, seq long, text string, x0 double, top double").withColumn("line_top", F.lit(5.0))
    near = g.unionByName(g.where("seq = 2").selectExpr("doc_id", "page_no", "4L AS seq", "text", "x0 + 0.5 AS x0", "top", "line_top"))
    seqs = lambda df: sorted(r.seq for r in df.collect())
    assert seqs(y.dedup_bold(near, line=["line_top"])) == seqs(y.dedup_bold(near)) == [1, 2, 3]
    monkeypatch.setattr(y, "_keep_first", lambda items, near: F.slice(items, 1, 0))
    assert seqs(y.dedup_bold(g, line=["line_top"])) == seqs(y.dedup_bold(g)) == [1, 2, 3]


def test_pages_are_dealt_out_before_they_are_taken_apart(spark, tmp_path):
    """Glyphs stay where their page is: what is dealt out by page is texts, and no glyph is moved for sizes, tops or lines."""
    from tabulith.plans import views as v

    spark.createDataFrame([(k, t, "user", "ab cd  e " * 9) for k in range(3) for t in range(2)], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    glyphs = v.glyphs(spark, str(tmp_path))
    lines = y.line_texts(glyphs.withColumn("line_top", F.col("top")))
    assert lines.groupBy("doc_id", "page_no").agg(F.sum("n").alias("n")).where("n <> 55").count() == 0
    for df in (lines, y.tolerances(glyphs)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1


def test_median_size_is_taken_of_counts(spark):
    """Also without sizes, with an even number of them, and with nulls among them."""
    sizes = [(1, 8.0), (1, 9.0), (1, 9.0), (1, 20.0), (2, None), (3, 8.0), (3, 9.0), (3, None)]
    glyphs = spark.createDataFrame([(d, 1, x) for d, x in sizes], "doc_id long, page_no int, size double")
    assert {r.doc_id: round(r.tol, 6) for r in y.tolerances(glyphs).collect()} == {1: 3.6, 2: 4.0, 3: 3.4}
