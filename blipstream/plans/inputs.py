"""The star-schema tables as signal tables: points(sample_id, channel, idx, time_s, intensity)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blipstream.operators.scan import numbered

from .stored import stored

#: Points that this application has numbered already, by application, kind, folder and state of the files read.
_made: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of(spark: SparkSession, path: str) -> tuple:
    """(path, bytes, time of change) of every file below path, by whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(files))


def once(spark: SparkSession, kind: str, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Numbering sorts all rows, so each application does it once per state of the table's files and reads the written points afterwards; a file that changed is read anew."""
    key = (spark.sparkContext.applicationId, kind, sf_dir, files_of(spark, f"{sf_dir}/{name}.parquet"))
    if key not in _made:
        for old in [k for k in _made if k[:3] == key[:3]]:
            del _made[old]
        _made[key] = stored(make(), kind)
    return _made[key]


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-valued traces: one channel per event type, ordered by time and id; seconds from the first event."""

    def make() -> DataFrame:
        events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("channel"), F.col("value").alias("intensity"))
        first = events.agg(F.min("us")).first()[0]
        return numbered(events, [F.col("us"), F.col("event_id")], "idx", ["channel"]).select(
            F.lit("s1").alias("sample_id"), "channel", F.col("idx").cast("int").alias("idx"), ((F.col("us") - F.lit(first)) / 1e6).alias("time_s"), "intensity"
        )

    return once(spark, "event-points", sf_dir, "events", make)


def count_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer traces: one channel per return flag and line status, 100 microseconds a point."""

    def make() -> DataFrame:
        names = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
        rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("channel"), *names)
        return numbered(rows, [F.col(c) for c in names], "idx", ["channel"]).select(
            F.lit("s1").alias("sample_id"), "channel", F.col("idx").cast("int").alias("idx"), F.col("l_quantity").alias("intensity"), ((F.col("idx") + 1) * F.lit(1e-4)).alias("time_s")
        )

    return once(spark, "count-points", sf_dir, "lineitem", make)


#: The same in DuckDB.
EVENT_POINTS = """pts AS (SELECT 's1' AS sample_id, event_type AS channel, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS idx,
  (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS time_s, value AS intensity FROM events)"""
COUNT_POINTS = """pts AS (SELECT 's1' AS sample_id, l_returnflag || l_linestatus AS channel,
  CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS INTEGER) AS idx, l_quantity AS intensity FROM lineitem)"""
