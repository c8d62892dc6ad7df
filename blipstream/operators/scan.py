"""Numbers and running sums that don't put a whole trace into one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored

TRACE = ["sample_id", "channel"]
BLOCK = 1 << 16


def tasks_of(df: DataFrame) -> int:
    """The session's number of shuffle partitions. Given as a number, Spark keeps it; else it puts partitions together until they hold a share of all rows each, and what a task sorts grows with the input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session has shuffle partitions, for windows and groups over these keys."""
    return df.repartition(tasks_of(df), *by)


def running_sum(df: DataFrame, value: Column, name: str, keys: list[str] | None = None, order: str = "idx", block: int = BLOCK) -> DataFrame:
    """df with the inclusive running sum of value along order, per trace.

    Two levels: each block of the order column sums on its own, and a window over one total per block
    gives the offset of each, so a trace of 1e8 points is thousands of tasks, not one.
    """
    keys = keys or TRACE
    rows = df.withColumn("__value", value).withColumn("__block", F.floor(F.col(order) / block))
    local = dealt(rows, *keys, "__block").withColumn("__local", F.sum("__value").over(Window.partitionBy(*keys, "__block").orderBy(order)))
    ahead = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__total")).withColumn("__ahead", F.coalesce(F.sum("__total").over(ahead), F.lit(0)))
    return local.join(offsets.drop("__total"), [*keys, "__block"]).withColumn(name, F.col("__ahead") + F.col("__local")).drop("__value", "__block", "__local", "__ahead")


def neighbours(df: DataFrame, column: str, name: str, by: int = -1, keys: list[str] | None = None) -> DataFrame:
    """df with the value that ``column`` has ``by`` points away (null beyond the ends), by an equi-join on the index."""
    keys = keys or TRACE
    other = df.select(*keys, (F.col("idx") - by).cast("int").alias("idx"), F.col(column).alias(name))
    return df.join(other, [*keys, "idx"], "left")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "idx", keys: Sequence[str] = ()) -> DataFrame:
    """df with each row's number (from 0) in ``order`` within keys, without a window over a whole key.

    Rows are dealt by ranges of (keys, order), one a shuffle partition, sorted and written once with their place. A row's number is its
    place in its range, less the first place of its key there, plus the key's rows in earlier ranges: a table of
    one row per key and range, which without keys is one row a shuffle partition and broadcast. Rows that tie in all of order keep any order among themselves, the same one in
    every later read.
    """
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    placed = stored(df.repartitionByRange(tasks_of(df), *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn("__place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    ahead = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "__range")
        .agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
        .select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__range").alias("__of"), (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__ahead"))
    )
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return placed.join(offsets if keys else F.broadcast(offsets), same).select(*df.columns, (F.col("__place") + F.col("__ahead")).alias(name))


def middles(df: DataFrame, value: Column, name: str, by: Sequence[str]) -> DataFrame:
    """(by, name): the median of value per group, null ones left out; for even numbers the mean of the middle two.

    Values are numbered by ranges and the one or two in the middle picked by an equi-join, so a group's values are never in
    one task, however many of them differ. Null groups are one group.
    """
    ranked = numbered(df.select(*by, value.cast("double").alias("__v")).where("__v is not null"), [F.col("__v")], "__r", by)
    n = ranked.groupBy(*by).agg(F.count("*").alias("__n"))
    picks = n.select(*(F.col(c).alias(f"__of_{c}") for c in by), F.explode(F.array_distinct(F.array(F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)))).alias("__at"))
    same = F.col("__r") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return ranked.join(picks, same).groupBy(*by).agg(F.avg("__v").alias(name))


def haloed(points: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """points with __block: each block of the index also gets the ``before`` points ahead of it and the ``after`` behind, so frames of that reach stay within a block."""
    return points.withColumn("__block", F.explode(F.sequence(F.floor((F.col("idx") - after) / block), F.floor((F.col("idx") + before) / block))))


def in_block(keys: Sequence[str] | None = None):
    return Window.partitionBy(*(keys or TRACE), "__block").orderBy("idx")


def own(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """haloed rows without the halo."""
    return df.where(F.floor(F.col("idx") / block) == F.col("__block")).drop("__block")
