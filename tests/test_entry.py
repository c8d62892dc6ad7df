"""The driver's contract, on the smallest tables."""

import __spark_entry__ as entry
from blipstream import registry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(registry.queries()) > 90


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_plans_of_sql_operators_have_no_python(spark):
    for name in ("flagship_report", "seq4b_window", "joi5_coverage", "fil5_percentiles", "his2_5_histogram"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
