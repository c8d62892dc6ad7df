"""Searches and gates by accumulated p-values: local p of each point, combined over channels or over the points of an event."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blipstream.functions.distributions import gamma_tails

from ..plans.stored import stored
from .align import broadcast_to_channels
from .baseline import fisher_tail
from .kernels import poisson_p
from .scan import TRACE, running_sum
from .search import hysteresis_search, rounded, spread_over

#: No p is smaller.
LEAST_P = 1e-300
COMBINATIONS = ("CHI_SQUARE", "GAMMA")


def local_p(points: DataFrame, mean: str = "location") -> DataFrame:
    """points with p, by the Poisson model of their background."""
    return poisson_p(points, mean).withColumn("p", F.greatest("p", F.lit(LEAST_P)))


def prescreened(points: DataFrame, per_minute: float) -> DataFrame:
    """The points of channels with more events a minute, by a hysteresis search with their start_thr, stop_thr and height_thr."""
    span = points.groupBy(*TRACE).agg((F.max("time_s") - F.min("time_s")).alias("__seconds"))
    rates = hysteresis_search(rounded(points)).groupBy(*TRACE).agg(F.count("*").alias("__events")).join(span, TRACE)
    return points.join(F.broadcast(rates.where(F.col("__events") / F.col("__seconds") > per_minute / 60).select(*TRACE)), TRACE, "left_semi")


def combined_p(points: DataFrame, how: str = "CHI_SQUARE") -> DataFrame:
    """SNK6: (sample_id, idx, k, lowest_p, h, p): Fisher's H = sum of -2 ln p over the channels at an index, and its p.

    CHI_SQUARE takes 2k degrees of freedom; GAMMA fits mean and SD of those H of a sample that lie below
    2k + 10 sqrt(k), as point by point the channels aren't independent. A single channel keeps its p.
    """
    if how not in COMBINATIONS:
        raise ValueError(f"no combination {how!r}")
    joint = points.groupBy("sample_id", "idx").agg(F.count("*").alias("k"), F.min("p").alias("lowest_p"), F.sum(-2 * F.log("p")).alias("h"))
    if how == "CHI_SQUARE":
        p = fisher_tail(F.col("h") / 2, F.col("k"))
    else:
        joint = stored(joint, "joint-p")
        inside = joint.where(F.col("h") < 2 * F.col("k") + 10 * F.sqrt("k"))
        fit = inside.groupBy("sample_id").agg(F.avg("h").alias("__m"), F.stddev_samp("h").alias("__s"))
        joint = joint.join(fit, "sample_id")
        scale = F.col("__s") * F.col("__s") / F.col("__m")

        @F.pandas_udf("double")
        def tail(h: pd.Series, shape: pd.Series, theta: pd.Series) -> pd.Series:
            return pd.Series(gamma_tails(shape.to_numpy(float), h.to_numpy(float) / theta.to_numpy(float)))

        p = tail(F.col("h"), F.col("__m") / scale, scale)
    return joint.withColumn("p", F.when(F.col("k") == 1, F.col("lowest_p")).otherwise(F.greatest(p, F.lit(LEAST_P)))).select("sample_id", "idx", "k", "lowest_p", "h", "p")


def accumulated_search(points: DataFrame, start_p: float, height_p: float, single_p: float | None = None, how: str = "CHI_SQUARE", onto: DataFrame | None = None) -> DataFrame:
    """SEQ5: regions of indices whose combined p is at most start_p, or where one channel alone has at most single_p; they stay if their least combined p is at most height_p, or by the exception. Every channel of ``onto`` (or points) gets them.

    points carry p and are those of prescreened channels.
    """
    alone = F.col("lowest_p") <= single_p if single_p is not None else F.lit(False)
    joint = combined_p(points, how).withColumn("channel", F.lit("*")).withColumn("__in", (F.col("p") <= start_p) | alone).withColumn("__alone", alone)
    keyed = running_sum(stored(joint, "combined-p"), (~F.col("__in")).cast("long"), "island")
    regions = keyed.where("__in").groupBy("sample_id", "island").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("p").alias("least_p"), F.bool_or("__alone").alias("__alone")
    )
    kept = regions.where((F.col("least_p") <= height_p) | F.col("__alone")).select("sample_id", "start_idx", "end_idx", "least_p")
    return broadcast_to_channels(kept, points if onto is None else onto).join(kept, ["sample_id", "start_idx", "end_idx"])


def p_gate(events: DataFrame, points: DataFrame, target: float) -> DataFrame:
    """FIL14: events whose points' p combine by Fisher to less than target; an event of one point by its own p."""
    inside = spread_over(events.select(*TRACE, "start_idx", "end_idx")).join(points.select(*TRACE, "idx", "p"), [*TRACE, "idx"])
    s = inside.groupBy(*TRACE, "start_idx").agg(F.sum(-F.log("p")).alias("__half"), F.count("*").alias("__k"), F.min("p").alias("__p"))
    p: Column = F.when(F.col("__k") == 1, F.col("__p")).otherwise(fisher_tail(F.col("__half"), F.col("__k")))
    return events.join(s.withColumn("event_p", p).where(F.col("event_p") < target).select(*TRACE, "start_idx", "event_p"), [*TRACE, "start_idx"])
