"""Operators that need sequential or special-function code: small Arrow groups, one per slice, trace or event."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from blipstream.functions import distributions as dist

from ..plans.stored import stored
from .baseline import SLICE
from .scan import TRACE


def by_slice(points: DataFrame) -> GroupedData:
    """Slices dealt to as many tasks as a shuffle has: their few bytes would otherwise be put together into one, though each is work in Python."""
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.select(*SLICE, "intensity").repartition(tasks, *SLICE).groupBy(*SLICE)


def rosner(points: DataFrame, alpha: float = 0.05, fraction: float = 0.02) -> DataFrame:
    """SEQ2c: generalised ESD per slice; nothing is removed where nothing is significant."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = np.sort(part["intensity"].to_numpy())
        n, most, gone, lo, hi = len(y), math.ceil(fraction * len(y)), 0, 0, len(y)
        total, squares = y.sum(), (y * y).sum()
        for i in range(1, min(most, n - 3) + 1):
            m = hi - lo
            mean = total / m
            sd = math.sqrt(max(0.0, (squares - m * mean * mean) / (m - 1)))
            high = y[hi - 1] - mean >= mean - y[lo]
            x = y[hi - 1] if high else y[lo]
            t = dist.t_quantile(1 - alpha / (2 * (n - i + 1)), n - i - 1)
            limit = (n - i) * t / math.sqrt((n - i - 1 + t * t) * (n - i + 1))
            if sd > 0 and abs(x - mean) / sd > limit:
                gone = i
            lo, hi = (lo, hi - 1) if high else (lo + 1, hi)
            total, squares = total - x, squares - x * x
        kept = y
        for _ in range(gone):
            kept = kept[:-1] if kept[-1] - kept.mean() >= kept.mean() - kept[0] else kept[1:]
        return pd.DataFrame([[*key, gone, kept.mean() if n else 0.0, kept.std(ddof=1) if len(kept) > 1 else 0.0]], columns=[*SLICE, "n_outliers", "location", "spread"])

    return by_slice(points).applyInPandas(run, "sample_id string, channel string, slice_idx int, n_outliers int, location double, spread double")


def truncated_poisson(points: DataFrame) -> DataFrame:
    """AGG4: mean estimate per slice: from the share of zeros if over a quarter are zero, else from mean and mode of the rest."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = part["intensity"].to_numpy()
        rest = y[y > 0]
        zeros = 1 - len(rest) / len(y)
        if zeros > 0.25 and len(rest) and rest.min() >= 1:
            cut, lam = int(rest.min()), 0.0
            for step in (1.0, 0.05):
                while 1 - dist.gamma_p(cut, lam + step) > zeros:
                    lam += step
        elif len(rest):
            values, counts = np.unique(rest, return_counts=True)
            lam = max(0.5, (2 * rest.mean() + values[counts.argmax()]) / 3)
        else:
            lam = 0.5
        return pd.DataFrame([[*key, lam]], columns=[*SLICE, "mean"])

    return by_slice(points).applyInPandas(run, "sample_id string, channel string, slice_idx int, mean double")


def compound_limits(baselines: DataFrame, shape: float, alpha: float) -> DataFrame:
    """DIS5, DIS6: compound-Poisson limit of each slice (few rows), vectorised over Arrow batches."""

    @F.pandas_udf("double")
    def limit(location: pd.Series) -> pd.Series:
        return location.map(lambda m: dist.compound_poisson_limit(m, shape, alpha))

    return baselines.withColumn("critical", limit("location"))


def poisson_p(points: DataFrame, mean: str = "location") -> DataFrame:
    """DIS1: mid-p of each point. Distinct (rounded intensity, rounded mean) pairs are evaluated once and joined back."""

    @F.pandas_udf("double")
    def p(y: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(dist.poisson_mid_ps(y.to_numpy(), m.to_numpy()))

    keyed = points.withColumn("__y", F.round("intensity", 3)).withColumn("__m", F.greatest(F.lit(0.01), F.round(mean, 2)))
    known = stored(keyed.select("__y", "__m").distinct().withColumn("p", p("__y", "__m")), "poisson-p")
    return keyed.join(known, ["__y", "__m"]).drop("__y", "__m")


def savitzky_golay(points: DataFrame, width: int, order: int = 3, block: int = 1 << 16) -> DataFrame:
    """SEQ12: least-squares polynomial smoothing with mirrored edges, as a weighted sum of neighbours (no Python on the rows)."""
    from .traces import kernel_smooth

    half = width // 2
    x = np.arange(-half, half + 1, dtype=float)
    weights = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]
    return kernel_smooth(points, weights.tolist())


def multi_particles(event_points: DataFrame, z: float = 1.0, z_segment: float = 3.0, period: int = 3, raw: bool = False) -> DataFrame:
    """SEQ10: n_particles of each event: rising segments whose height exceeds z_segment * sqrt(length * background + 1/2).

    event_points carry island, idx, intensity and background (per point). Differences within z * sqrt(y + 1/2) are left
    out; the rest, or with ``raw`` the intensities before, are smoothed by a trailing mean over ``period``. A segment
    ends where the sign changes; a fall too small for its length ends it too, even if the next difference falls as well.
    The last segment doesn't count unless a fall ends it. Events of three points or fewer are one particle. An event is
    an array, folded by built-in functions: the longest one must fit into a task.
    """
    root = "sqrt({0} + 0.5D)"

    def smoothed(column: str) -> Column:
        return F.expr(f"transform({column}, (x, i) -> aggregate(slice({column}, greatest(i - {period - 2}, 1), least(i + 1, {period})), 0D, (a, v) -> a + v) / least(i + 1, {period}))")

    events = event_points.groupBy(*TRACE, "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "intensity"))), lambda p: p["intensity"].cast("double")).alias("__y"), F.first("background").cast("double").alias("__bg"))
    values = events.withColumn("__v", smoothed("__y") if raw and period > 1 else F.col("__y"))
    kept = values.withColumn("__d", F.expr(f"filter(transform(slice(__v, 2, size(__v)), (x, i) -> struct(x - __v[i] as d, {z}D * {root.format('x')} as limit)), p -> abs(p.d) > p.limit).d"))
    steps = kept.withColumn("__s", smoothed("__d") if not raw and period > 1 else F.col("__d"))
    limit = lambda acc: z_segment * F.sqrt(acc["length"] * F.col("__bg") + 0.5)
    start = F.struct(F.lit(False).alias("falls"), F.lit(0.0).alias("total"), F.lit(0.0).alias("length"), F.lit(0).alias("found"))

    def step(acc: Column, d: Column) -> Column:
        falls = d < 0
        steep = ~(falls & (acc["total"] < 0)) | (-acc["total"] > limit(acc))
        same = steep & (falls == acc["falls"])
        return F.struct(
            falls.alias("falls"),
            F.when(same, acc["total"] + d).otherwise(d).alias("total"),
            F.when(same, acc["length"] + 1.0).otherwise(F.lit(1.0)).alias("length"),
            (acc["found"] + F.when(~same & (acc["total"] > limit(acc)), 1).otherwise(0)).alias("found"),
        )

    count = F.when(F.size("__y") <= 3, 1).otherwise(F.aggregate("__s", start, step, lambda acc: acc["found"]))
    return steps.select(*TRACE, "island", count.alias("n_particles"))


def multi_populations(counted: DataFrame, pooled: bool = False) -> DataFrame:
    """FIL15: the population that each event goes to by its n_particles: 1 is the main branch; more go to one for each number, or pooled to one; events of none go nowhere."""
    n = F.col("n_particles")
    return counted.where(n > 0).withColumn("population", F.when(n == 1, "1").otherwise(F.lit(">1") if pooled else n.cast("string")))


def peak_asymmetry(event_points: DataFrame, at: float = 0.1) -> DataFrame:
    """SEQ17: back width over front width at a tenth of the height, interpolated; null if a side doesn't fall that low. An event is an array: the longest one must fit into a task."""
    events = event_points.groupBy(*TRACE, "island").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "intensity"))), lambda p: p["intensity"].cast("double")).alias("__y"))
    y = F.col("__y")
    top = F.array_position(y, F.array_max(y)).cast("int")
    sides = events.select(*TRACE, "island", (at * F.array_max(y)).alias("__level"), F.reverse(F.slice(y, 1, top)).alias("__front"), F.slice(y, top, F.size(y)).alias("__back"))

    def width(side: str) -> Column:
        low = F.array_position(F.transform(side, lambda x: x < F.col("__level")), True).cast("int")
        here, before = F.get(side, low - 1), F.get(side, low - 2)
        return F.when(low > 1, low - 1 - (F.col("__level") - here) / (before - here))

    return sides.select(*TRACE, "island", (width("__back") / width("__front")).alias("asymmetry_10"))


def empirical_shape(points: DataFrame) -> DataFrame:
    """AGG25: log-sd of single-ion pulses from traces with over 50 zeros: mean pulses by -ln(P0), variance by moments; NaN otherwise."""
    s = points.groupBy(*TRACE).agg(F.count("*").alias("n"), F.sum((F.col("intensity") == 0).cast("int")).alias("zeros"), F.avg("intensity").alias("m"), F.var_samp("intensity").alias("v"))
    lam = -F.log(F.col("zeros") / F.col("n"))
    second = F.col("v") / lam / F.pow(F.col("m") / lam, F.lit(2))
    return s.select(*TRACE, F.when((F.col("zeros") > 50) & (lam > 0) & (second > 1), F.sqrt(F.log(second))).otherwise(F.lit(float("nan"))).alias("shape"))
