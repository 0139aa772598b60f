"""The query over padded headers."""

from tabulith.plans import assembly_queries as q


def test_padded_headers_keep_all_names(spark, monkeypatch):
    names = spark.createDataFrame([(i, f"n{i}", 1) for i in range(3600)], "name_id long, original string, size int")
    monkeypatch.setattr(q.v, "names", lambda spark, d: names)
    got = [(r.t, r.position, r.name) for r in q.c11_padded_headers(spark, "").collect()]
    assert {n for _, _, n in got if n.startswith("n")} == {f"n{i}" for i in range(3600)}
    assert sum(n.startswith("Kolom ") for _, _, n in got) == 300 and len(got) == len({(t, p) for t, p, _ in got})
