"""The registered queries: names, SQL, and that plans stay on the JVM without cross products by nested loop."""

import __spark_entry__ as entry
from tabulith.plans import registry


def test_names_match():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["publication", "pub_year", "table_no", "subject", "is_total", "cells"]


def test_plans(spark):
    for name in ("b20_bands", "d08_merged_cells", "g09_facts", "h14_export"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan, name
