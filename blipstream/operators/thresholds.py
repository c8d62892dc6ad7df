"""Limits of background models per slice, by any criterion, brought to the points and to the peaks of events."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blipstream.functions.distributions import compound_poisson_tail, poisson_mid_ps

from .accumulate import LEAST_P, p_gate
from .baseline import PROTECTED, interpolated, limits, normal_tail, poisson_limit, z_of
from .kernels import compound_limits
from .scan import TRACE

CRITERIA = ("MEAN", "ALPHA", "FACTOR", "CUSTOM_VALUE")
POISSON_MODELS = ("POISSON", "POISSON_APPROXIMATION", "POISSON_CURRIE", "POISSON_COMPOUND")


def critical_limit(slices: DataFrame, alpha: float, poisson: str = "POISSON", shape: float = 0.47, eps: float = 0.5, name: str = "critical") -> DataFrame:
    """slices (location, spread, distr) with the value that the background exceeds with probability alpha: by the normal distribution, or for Poisson slices by the model named."""
    if poisson not in POISSON_MODELS:
        raise ValueError(f"no Poisson model {poisson!r}")
    z = z_of(alpha)
    known = limits(F.col("location"), F.col("spread"), z)
    if poisson == "POISSON_COMPOUND":
        made = compound_limits(slices, shape, alpha).withColumnRenamed("critical", "__count")
    else:
        count: Column = poisson_limit(F.col("location"), alpha, eps) if poisson == "POISSON" else known["currie" if poisson == "POISSON_CURRIE" else "poisson_normal"][0]
        made = slices.withColumn("__count", count)
    return made.withColumn(name, F.when(F.col("distr") == "POISSON", F.col("__count")).otherwise(known["gaussian"][0])).drop("__count")


def with_limit(slices: DataFrame, name: str, criterion: str, value: float, offset: float = 0.0, protected: bool = True, **model) -> DataFrame:
    """slices with a column ``name``: the location (MEAN), the critical limit at alpha (ALPHA), value spreads above the location (FACTOR), or the value itself; plus offset."""
    if criterion not in CRITERIA:
        raise ValueError(f"no criterion {criterion!r}")
    if criterion == "ALPHA":
        made = critical_limit(slices, value, name="__limit", **model)
    else:
        made = slices.withColumn("__limit", {"MEAN": F.col("location"), "FACTOR": F.col("location") + value * F.col("spread"), "CUSTOM_VALUE": F.lit(float(value))}[criterion])
    level = F.greatest(F.lit(PROTECTED), F.col("__limit")) if protected else F.col("__limit")
    return made.withColumn(name, level + offset).drop("__limit")


def onto_points(points: DataFrame, slices: DataFrame, columns: list[str]) -> DataFrame:
    """points (with slice_idx) with the columns of their slices, linear between the centres of slices; of a trace with one slice its values as they are."""
    out = points
    for c in columns:
        out = interpolated(out, slices, c)
    return out


def at_peaks(events: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """events with the columns of the points at their peaks."""
    return events.join(points.select(*TRACE, F.col("idx").alias("peak_idx"), *columns), [*TRACE, "peak_idx"], "left")


def gate_at_peak(events: DataFrame, kind: str, target: str = "target") -> DataFrame:
    """FIL11 to FIL13: events whose height, area, net area or mean signal exceeds a column of theirs, whose net height is below so many percent of the net area, or that have more or fewer points."""
    t = F.col(target)
    tests = {
        "HEIGHT": F.col("height") > t,
        "AREA": F.col("area") > t,
        "NET_AREA": F.col("net_area") > t,
        "MEAN_SIGNAL": F.col("area") / F.col("n_points") > t,
        "PEAK_DOMINANCE": F.col("net_height") < F.col("net_area") * t / 100,
        "MORE_POINTS_THAN": F.col("n_points") > t,
        "FEWER_POINTS_THAN": F.col("n_points") < t,
    }
    if kind not in tests:
        raise ValueError(f"no gate {kind!r}")
    return events.where(tests[kind])


def model_p(points: DataFrame, poisson: str = "POISSON", shape: float = 0.47) -> DataFrame:
    """DIS1 to DIS5: points (with location, spread, distr) with p, the probability of at least their intensity under their own model.

    Normal tails for Gaussian points and the approximated Poisson; mid-p of counts for POISSON and, as its limit is one of
    counts too, POISSON_CURRIE; the tail of the compound sum for POISSON_COMPOUND. Tails that need a special function are
    evaluated once for each pair of intensity (to three digits) and location (to two) and joined back. No p is below 1e-300.
    """
    if poisson not in POISSON_MODELS:
        raise ValueError(f"no Poisson model {poisson!r}")
    spread = F.when(F.col("distr") == "POISSON", F.sqrt("location")).otherwise(F.col("spread"))
    normal = normal_tail(F.coalesce(F.try_divide(F.col("intensity") - F.col("location"), spread), F.lit(0.0)))
    if poisson == "POISSON_APPROXIMATION":
        return points.withColumn("p", F.greatest(F.lit(LEAST_P), normal))

    @F.pandas_udf("double")
    def tail(y: pd.Series, m: pd.Series) -> pd.Series:
        if poisson != "POISSON_COMPOUND":
            return pd.Series(poisson_mid_ps(y.to_numpy(float), m.to_numpy(float)))
        tails = {k: compound_poisson_tail(k, shape) for k in m.unique()}
        return pd.Series([tails[k](v) if v > 0 else 1.0 for v, k in zip(y, m, strict=True)], dtype="float64")

    keyed = points.withColumn("__y", F.round("intensity", 3)).withColumn("__m", F.greatest(F.lit(0.01), F.round("location", 2)))
    known = keyed.where("distr = 'POISSON'").select("__y", "__m").distinct().withColumn("__p", tail("__y", "__m"))
    p = F.when(F.col("distr") == "POISSON", F.col("__p")).otherwise(normal)
    return keyed.join(known, ["__y", "__m"], "left").withColumn("p", F.greatest(F.lit(LEAST_P), p)).select(*points.columns, "p")


def accumulated_gate(events: DataFrame, points: DataFrame, alpha: float, **model) -> DataFrame:
    """FIL14 on points that have their model but no p yet."""
    return p_gate(events, model_p(points, **model), alpha)
