"""Background models: clipped location and spread per slice, limits per distribution, thresholds between slice centres."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .scan import TRACE
from .settle import settled

SLICE = [*TRACE, "slice_idx"]
#: Thresholds are never below this in protected look-ups.
PROTECTED = 0.1


def z_of(alpha: float) -> float:
    """SC7: upper-tail alpha to z; 0 from one half on, 37 below 1e-94."""
    return 0.0 if alpha >= 0.5 else 37.0 if alpha < 1e-94 else -NormalDist().inv_cdf(alpha)


def clipped(points: DataFrame, rounds: int = 5, z: float = 3.0, poisson: bool = False, offset: float = 0.0) -> DataFrame:
    """SEQ2a with a fixed number of rounds: location and spread per slice after removing what lies outside location -+ z * spread, offset wider.

    Each round aggregates what the rounds before kept; only one row per slice goes back to the points. It is written first,
    so that Spark knows how small it is and sends a few rows to all points, instead of all points of a slice to one task.
    """
    spread = F.sqrt(F.avg("intensity")) if poisson else F.coalesce(F.stddev_samp("intensity"), F.lit(0.0))
    stats = [F.avg("intensity").alias("location"), spread.alias("spread"), F.count("*").alias("n_kept")]
    wide = z * F.col("spread") + offset
    model = points.groupBy(*SLICE).agg(*stats).withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
    for _ in range(rounds):
        # What all rounds so far kept is an interval, so each round needs one row per slice from the one before.
        bounds = model.select(*SLICE, F.greatest("__lo", F.col("location") - wide).alias("__lo"), F.least("__hi", F.col("location") + wide).alias("__hi"))
        inside = points.join(stored(bounds, "clip-bounds"), SLICE).where("intensity between __lo and __hi")
        model = inside.groupBy(*SLICE).agg(*stats, F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    return model.drop("__lo", "__hi")


def converged(points: DataFrame, z: float = 3.0, offset: float = 0.0, most: int = 1000) -> DataFrame:
    """SEQ2a until nothing more is removed; slices shrink at their own pace, so each is a small Arrow group."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y, rounds = part["intensity"].to_numpy(), 0
        while rounds < most:
            loc, sd = (y.mean(), y.std(ddof=1) if len(y) > 1 else 0.0) if len(y) else (0.0, 0.0)
            keep = np.abs(y - loc) <= z * sd + offset
            if keep.all():
                break
            y, rounds = y[keep], rounds + 1
        return pd.DataFrame([[*key, loc, sd, len(y), rounds]], columns=[*SLICE, "location", "spread", "n_kept", "rounds"])

    return points.select(*SLICE, "intensity").groupBy(*SLICE).applyInPandas(run, "sample_id string, channel string, slice_idx int, location double, spread double, n_kept long, rounds int")


def converged_rounds(points: DataFrame, z: float = 3.0, offset: float = 0.0, poisson: bool = False, most: int = 1000) -> DataFrame:
    """SEQ2a until nothing more is removed, for slices of any length: location, spread, n_kept and rounds; what was removed once stays out.

    Each round is one aggregation of all points (see settle.settled), so a whole trace as one slice is as many tasks as it has
    blocks; slices that fit into a task are quicker with ``converged``.
    """
    values = points.select(*SLICE, F.col("intensity").alias("__x"))
    first = values.select(*SLICE).distinct().withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
    mean, spread = F.coalesce(F.avg("__in"), F.lit(0.0)), F.sqrt(F.avg("__in")) if poisson else F.stddev_samp("__in")
    wide = z * F.col("spread") + offset
    done = settled(
        values,
        first,
        [mean.alias("location"), F.coalesce(spread, F.lit(0.0)).alias("spread")],
        lambda: (F.greatest("__was_lo", F.col("location") - wide), F.least("__was_hi", F.col("location") + wide)),
        "converged",
        most + 1,
        keys=SLICE,
    )
    return done.select(*SLICE, "location", "spread", F.col("n").alias("n_kept"), "rounds")


def smart_clipped(points: DataFrame, start: float = 1.0, most: float = 10.0, fine: float = 0.1, near_zero: float = 0.1, worst_rsd: float = 1.5) -> DataFrame:
    """SEQ2b: the clipping factor grows by one until the clipped spread reaches 0.05, once more, then backs off finely while the relative spread is too large."""

    def limits(y: np.ndarray, z: float) -> tuple[float, float]:
        loc, sd = y.mean(), y.std(ddof=1) if len(y) > 1 else 0.0
        for _ in range(1000):
            inside = y[np.abs(y - loc) <= z * sd]
            if not len(inside) or len(inside) == len(y):
                break
            y = inside
            loc, sd = y.mean(), y.std(ddof=1) if len(y) > 1 else 0.0
        return float(loc), float(sd)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = part["intensity"].to_numpy()
        z, (loc, sd) = start, limits(y, start)
        if y.mean() >= near_zero:
            while sd < 0.05 and z < most:
                z += 1
                loc, sd = limits(y, z)
            z = min(most, z + 1)
            loc, sd = limits(y, z)
            while loc > 0 and sd / loc > worst_rsd and z > fine:
                z -= fine
                loc, sd = limits(y, z)
            if sd == 0:
                loc = float(np.median(y))
                sd = 1.4826 * float(np.median(np.abs(y - loc))) or math.sqrt(max(0.0, float(y.mean())))
        return pd.DataFrame([[*key, loc, sd, z]], columns=[*SLICE, "location", "spread", "z"])

    return points.select(*SLICE, "intensity").groupBy(*SLICE).applyInPandas(run, "sample_id string, channel string, slice_idx int, location double, spread double, z double")


def limits(location: Column, spread: Column, z: float) -> dict[str, tuple[Column, Column]]:
    """DIS2 to DIS4: (critical limit, detection limit) of each distribution that needs no table."""
    root = F.sqrt(location)
    return {
        "gaussian": (location + z * spread, location + 2 * z * spread),
        "poisson_normal": (location + z * root, location + 2 * z * root),
        "currie": (location + z * root, (2 * z) * (2 * z) + location + 2 * z * root),
    }


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series ten above, brought down by the product of the ten factors; good to 1e-13."""
    z = x + 10
    inverse = 1 / (z * z)
    series = (F.lit(1 / 12) - inverse * (F.lit(1 / 360) - inverse * (F.lit(1 / 1260) - inverse * F.lit(1 / 1680)))) / z
    product = F.lit(1.0)
    for k in range(10):
        product = product * (x + k)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def poisson_limit(location: Column, alpha: float, eps: float = 0.5) -> Column:
    """DIS1: smallest k with P(X > k) <= alpha for mean location + eps, whatever the mean.

    The upper tail is summed downwards in one fold, from where a Chernoff bound puts less than alpha * 1e-17 above to
    twelve spreads below the mean, with logarithms of the masses, so nothing underflows and small terms come first.
    """
    mean = location + F.lit(eps)
    rare = math.log(1 / alpha) + 40
    top = F.ceil(mean + rare / 3 + F.sqrt(F.lit(rare * rare / 9) + 2 * rare * mean))
    low = F.greatest(F.lit(0), F.floor(mean - 12 * F.sqrt(mean) - 12))
    start = F.struct((top * F.log(mean) - mean - log_gamma(top + 1.0)).alias("mass"), F.lit(0.0).alias("above"), F.lit(-1.0).alias("found"))

    def step(acc: Column, k: Column) -> Column:
        above = acc["above"] + F.exp(acc["mass"])
        return F.struct(
            (acc["mass"] + F.log(F.greatest(k, F.lit(1)) / mean)).alias("mass"),
            above.alias("above"),
            F.when((acc["found"] < 0) & (above > alpha), k.cast("double")).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(F.sequence(top, low, F.lit(-1).cast("long")), start, step, lambda acc: F.greatest(acc["found"], F.lit(0.0)))


def normal_tail(z: Column) -> Column:
    """P(N > z): erfc by Chebyshev fit, good to 1.2e-7 of its value."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Fixed values of the fit, lowest power first.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    total = F.lit(0.0)
    for c in reversed(fit):
        total = total * t + c
    tail = 0.5 * t * F.exp(-x * x + total)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def upper_p(location: Column, spread: Column, y: Column) -> dict[str, Column]:
    """DIS2 and DIS3: p-value of y under each distribution that needs no table; DIS4 takes DIS1's."""
    return {"gaussian": normal_tail((y - location) / spread), "poisson_normal": normal_tail((y - location) / F.sqrt(location))}


def fisher_tail(half: Column, terms: Column) -> Column:
    """Upper chi-squared tail at 2 * half with 2 * terms degrees of freedom: the sum of exp(-half) * half**j / j! for j < terms.

    The sum runs in one fold over logarithms of the terms, from twelve spreads below the largest to twelve above it, so
    neither exp(-half) nor a power leaves the range of doubles, and the fold grows with the root of half only.
    """
    half, last = half.cast("double"), F.greatest(terms, F.lit(1)).cast("long") - 1
    reach = F.ceil(12 * F.sqrt(half) + 40)
    top = F.least(last, F.floor(half))
    low = F.greatest(F.lit(0).cast("long"), top - reach)
    start = F.struct((low * F.log(half) - half - log_gamma(low + 1.0)).alias("mass"), F.lit(0.0).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        return F.struct((acc["mass"] + F.log(half / (j + 1))).alias("mass"), (acc["total"] + F.exp(acc["mass"])).alias("total"))

    total = F.aggregate(F.sequence(low, F.least(last, top + reach)), start, step, lambda acc: acc["total"])
    return F.when(half <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


MODELS = ("PESSIMISTIC", "THRESHOLD", "GAUSSIAN", "POISSON")


def model_choice(points: DataFrame, model: str = "PESSIMISTIC", cutoff: float = 10.0, z: float = 3.0, rounds: int = 5, poisson_offset: float = 2.71) -> DataFrame:
    """SEQ1: location, spread, n_kept and distr per slice. PESSIMISTIC fits both and takes the Gaussian where its critical limit at z is the larger; THRESHOLD takes Poisson below a median cutoff of the raw slice; else the one named."""
    if model not in MODELS:
        raise ValueError(f"no baseline model {model!r}")
    fits = {
        "GAUSSIAN": lambda: clipped(points, rounds).withColumn("distr", F.lit("GAUSSIAN")),
        "POISSON": lambda: clipped(points, rounds, poisson=True, offset=poisson_offset).withColumn("distr", F.lit("POISSON")),
    }
    if model in fits:
        return fits[model]()
    both = fits["GAUSSIAN"]().unionByName(fits["POISSON"]())
    row = F.struct("distr", "location", "spread", "n_kept")
    if model == "THRESHOLD":
        wanted = points.groupBy(*SLICE).agg(F.when(F.expr("percentile(intensity, 0.5)") < cutoff, "POISSON").otherwise("GAUSSIAN").alias("distr"))
        return both.join(wanted, [*SLICE, "distr"]).select(*SLICE, "location", "spread", "n_kept", "distr")
    limit = F.when(F.col("distr") == "GAUSSIAN", limits(F.col("location"), F.col("spread"), z)["gaussian"][0]).otherwise(limits(F.col("location"), F.col("spread"), z)["poisson_normal"][0])
    best = both.withColumn("__limit", limit).groupBy(*SLICE).agg(F.max_by(row, F.struct("__limit", "distr")).alias("__m"))
    return best.select(*SLICE, "__m.location", "__m.spread", "__m.n_kept", "__m.distr")


def interpolated(points: DataFrame, slices: DataFrame, value: str = "threshold") -> DataFrame:
    """JOI3: linear between the centres of slices, flat outside the first and last.

    points carry slice_idx; slices have (trace, slice_idx, value). Centres come from the points of a slice;
    each slice row carries its neighbours, so one equi-join on the slice index is enough.
    """
    centres = points.groupBy(*SLICE).agg(((F.min("idx") + F.max("idx")) / 2).alias("__c")).join(slices.select(*SLICE, F.col(value).alias("__v")), SLICE)
    w = Window.partitionBy(*TRACE).orderBy("slice_idx")
    near = centres.select(*SLICE, "__c", "__v", *[f(c).over(w).alias(f"{c}{n}") for c in ("__c", "__v") for n, f in (("p", F.lag), ("n", F.lead))])
    i = F.col("idx")
    line = F.when((i < F.col("__c")) & F.col("__cp").isNotNull(), F.col("__vp") + (F.col("__v") - F.col("__vp")) * (i - F.col("__cp")) / (F.col("__c") - F.col("__cp"))).when(
        (i > F.col("__c")) & F.col("__cn").isNotNull(), F.col("__v") + (F.col("__vn") - F.col("__v")) * (i - F.col("__c")) / (F.col("__cn") - F.col("__c"))
    )
    joined = points.join(near, SLICE)
    return joined.withColumn(value, F.coalesce(line, F.col("__v"))).select(*points.columns, value)
