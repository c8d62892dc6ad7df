"""Named queries of the signal engine and the SQL that states the same result."""

from pyspark.sql import DataFrame, SparkSession

from blipstream.plans import method_queries, more_queries, report_queries, rolling_queries, signal_queries, table_queries

MODULES = [signal_queries, table_queries, more_queries, report_queries, rolling_queries, method_queries]


def queries():
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_queries.flagship_report(spark, sf_dir)
