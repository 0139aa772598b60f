"""From printed pages to exchange rows: tables over two pages, totals, and a gap that the total fills."""

from decimal import Decimal

from pyspark.sql import functions as F

from tabulith.plans import extract
from tabulith.plans import views as v

SF = "/root/testdata/sf0.01"


def test_pages_to_rows(spark):
    """One value of a page is printed as a dash: its column has one gap, which the printed total gives back."""
    glyphs, words, cells, edges = v.printed_pages(spark, SF)
    hit = words.where("x0 = 210 AND top >= 130").orderBy("doc_id", "page_no", "top").first()
    here = (F.col("doc_id") == hit.doc_id) & (F.col("page_no") == hit.page_no) & (F.col("top") == hit.top) & (F.col("x0") >= 205) & (F.col("x0") < 360)
    dashed = glyphs.withColumn("text", F.when(here, F.when(F.col("x0") == 210, "-")).otherwise(F.col("text"))).where("text IS NOT NULL")
    # a leaning watermark over all pages is no text
    mark = glyphs.where("text = 'S'").withColumns({"text": F.lit("W"), "x0": F.col("x0") + 3, "matrix": F.array(*[F.lit(x) for x in (0.7, 0.7, -0.7, 0.7)])})
    master = spark.createDataFrame([("Nowhere",)], "entity string")
    rows = extract.exchange_rows(dashed.unionByName(mark), words, cells, edges, master, "Wilayah", "kabupaten").collect()

    suppliers = {r.s_name: r for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    found = {(r.category, r.indicator): r for r in rows if r.category}
    assert set(found) == {(n, i) for n in suppliers for i in ("Saldo", "Kode")}
    for (name, indicator), r in found.items():
        want = Decimal(str(abs(suppliers[name].s_acctbal))) if indicator == "Saldo" else suppliers[name].s_suppkey + 1
        assert Decimal(r.value_num) == want and (r.unit, r.source) == ("juta" if indicator == "Saldo" else "", "BPS"), r
    assert [r.flag for r in found.values()].count("auto_corrected") == 1 and {r.flag for r in rows} == {"ada", "auto_corrected"}
    totals = [r for r in rows if not r.category]
    assert len(totals) == 2 * len({r.table_no for r in rows}) and {r.region for r in rows} == {"Wilayah"}
