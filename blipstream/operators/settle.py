"""Clipping until nothing moves, in rounds over all values of all groups."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .scan import TRACE


def settled(values: DataFrame, first: DataFrame, stats: list[Column], bounds: Callable[[], tuple[Column, Column]], name: str, rounds: int, least: int = 1, keys: list[str] = TRACE) -> DataFrame:
    """(keys, n, stats, rounds) of the values __x within an interval [__lo, __hi] per group that ``bounds`` derives from the stats of __in, again and again until no value changes sides.

    A round is one aggregation of all values, however many a group has, and writes one row a group; it also counts the
    values that changed sides, so the last round is seen in the one after, and groups that have settled keep their
    interval. ``bounds`` may use __was_lo and __was_hi, the interval of the stats. Groups of fewer than ``least`` values
    don't call for more rounds. ``rounds`` in the result counts those in which values left or came back.
    """
    bounded = first.withColumns({"__was_lo": F.lit(float("-inf")), "__was_hi": F.lit(float("-inf")), "__turns": F.lit(-1)})
    for _ in range(rounds):
        x = F.col("__x")
        now, was = x.between(F.col("__lo"), F.col("__hi")), x.between(F.col("__was_lo"), F.col("__was_hi"))
        met = values.join(bounded.select(*keys, "__lo", "__hi", "__was_lo", "__was_hi", "__turns"), keys).withColumn("__in", F.when(now, x)).withColumn("__moved", (now != was).cast("long"))
        turns = F.first("__turns") + (F.sum("__moved") > 0).cast("int")
        of = met.groupBy(*keys).agg(F.count("__in").alias("n"), *stats, F.sum("__moved").alias("__moved"), turns.alias("__turns"), F.first("__lo").alias("__was_lo"), F.first("__hi").alias("__was_hi"))
        state = stored(of, name)
        lo, hi = bounds()
        if state.where((F.col("__moved") > 0) & (F.col("n") >= least)).isEmpty():
            break
        still = F.col("__moved") == 0
        bounded = state.select(*keys, F.when(still, F.col("__was_lo")).otherwise(lo).alias("__lo"), F.when(still, F.col("__was_hi")).otherwise(hi).alias("__hi"), "__was_lo", "__was_hi", "__turns")
    return state.withColumnRenamed("__turns", "rounds").drop("__moved", "__was_lo", "__was_hi")
