"""Operators on points: time cuts, re-binning, unit decisions, averages and summaries of traces."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .scan import BLOCK, TRACE, haloed, in_block, middles, neighbours, numbered, own


def in_order():
    return Window.partitionBy(*TRACE).orderBy("idx")


def time_roi(points: DataFrame, start: float, stop: float) -> DataFrame:
    """FIL1: closed time interval of an explicit series; indices start again at 0."""
    cut = points.where(F.col("time_s").between(start, stop))
    first = cut.groupBy(*TRACE).agg(F.min("idx").alias("__first"))
    return cut.join(first, TRACE).withColumn("idx", (F.col("idx") - F.col("__first")).cast("int")).drop("__first")


def constant_roi(points: DataFrame, dt: float, start: float, stop: float) -> DataFrame:
    """FIL1 for a constant dwell time: index range [round(start/dt)-1, round(stop/dt)-1], clamped; Java rounding."""
    lo, hi = max(0, int(start / dt + 0.5) - 1), int(stop / dt + 0.5) - 1
    return points.where(F.col("idx").between(lo, hi)).withColumn("idx", (F.col("idx") - lo).cast("int"))


def segment(points: DataFrame, length: int, merge_below: int = 100) -> DataFrame:
    """SEQ0: slice_idx of each point; a tail of fewer than merge_below points joins the slice before."""
    n = points.groupBy(*TRACE).agg(F.count("*").alias("__n"))
    slices = F.greatest(F.lit(1), F.floor(F.col("__n") / length) + F.when(F.col("__n") % length >= merge_below, 1).otherwise(0))
    return points.join(F.broadcast(n), TRACE).withColumn("slice_idx", F.least(F.floor(F.col("idx") / length), slices - 1).cast("int")).drop("__n")


def rebin(points: DataFrame, k: int) -> DataFrame:
    """SEQ9: sums of k consecutive points at the time of the last; a partial tail is dropped."""
    bins = points.groupBy(*TRACE, F.floor(F.col("idx") / k).cast("int").alias("bin"))
    done = bins.agg(F.sum("intensity").alias("intensity"), F.max("time_s").alias("time_s"), F.count("*").alias("__n")).where(F.col("__n") == k)
    return done.select(*TRACE, F.col("bin").alias("idx"), "time_s", "intensity")


def cps_to_counts(points: DataFrame) -> DataFrame:
    """PRJ4: rate times the time since the point before; the first two points use the third difference."""
    early = points.groupBy(*TRACE).agg((F.max(F.when(F.col("idx") == 2, F.col("time_s"))) - F.max(F.when(F.col("idx") == 1, F.col("time_s")))).alias("__dt"))
    steps = own(haloed(points, 1, 0).withColumn("__step", F.col("time_s") - F.lag("time_s").over(in_block())))
    dt = F.when(F.col("idx") < 2, F.col("__dt")).otherwise(F.col("__step"))
    return steps.join(early, TRACE).withColumn("counts", F.col("intensity") * dt).drop("__dt", "__step")


def dwell_times(points: DataFrame) -> DataFrame:
    """Dwell time (mean of differences, the first two replaced by the third's) and duration of explicit series."""
    t = {i: F.max(F.when(F.col("idx") == i, F.col("time_s"))) for i in (0, 1, 2)}
    n, first, last = F.count("*"), F.min("time_s"), F.max("time_s")
    dt = F.when(n >= 3, (last - t[1] - (t[2] - t[1]) + 2 * (t[2] - t[1])) / n)
    return points.groupBy(*TRACE).agg(n.alias("n_points"), dt.alias("dt_s"), (last - first + dt).alias("duration_s"))


def is_integer(points: DataFrame, first: int = 10_000, limit: float = 0.15, block: int = BLOCK) -> DataFrame:
    """Whether the mean distance of the first non-zero values from whole numbers is below limit. That only the first count is the rule itself.

    Blocks of the index are counted first; only those that hold some of the first values are looked at again.
    """
    rows = points.where("intensity <> 0").select(*TRACE, "idx", "intensity", F.floor(F.col("idx") / block).alias("__block"))
    ahead = Window.partitionBy(*TRACE).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*TRACE, "__block").agg(F.count("*").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).where(F.col("__ahead") < first)
    near = rows.join(F.broadcast(blocks.drop("__n")), [*TRACE, "__block"])  # at most ``first`` blocks a trace
    used = near.withColumn("__nth", F.row_number().over(Window.partitionBy(*TRACE, "__block").orderBy("idx"))).where(F.col("__ahead") + F.col("__nth") <= first)
    return used.groupBy(*TRACE).agg((F.avg(F.abs(F.floor(F.col("intensity") + 0.5) - F.col("intensity"))) < limit).alias("is_integer"))


def looks_like_counts(points: DataFrame) -> DataFrame:
    """PRJ5: distinct rounded non-zero values; the three smallest gaps add up to 12 at most, or all gaps to less than 10.

    Values are numbered by ranges and meet the next one by an equi-join; of the gaps only the three smallest are ranked.
    """
    values = numbered(points.where("intensity <> 0").select(*TRACE, F.floor(F.col("intensity") + 0.5).alias("v")).distinct(), [F.col("v")], "idx", TRACE)
    gaps = neighbours(values, "v", "before").where("before is not null").select(*TRACE, (F.col("v") - F.col("before")).alias("gap")).distinct()
    least = gaps.withColumn("nth", F.row_number().over(Window.partitionBy(*TRACE).orderBy("gap"))).where("nth <= 3").groupBy(*TRACE).agg(F.sum("gap").alias("__three"))
    return gaps.groupBy(*TRACE).agg(F.sum("gap").alias("__all")).join(least, TRACE).select(*TRACE, ((F.col("__three") <= 12) | (F.col("__all") < 10)).alias("is_counts"))


def trace_stats(points: DataFrame) -> DataFrame:
    """AGG1: mean, median, sample SD and 1.4826 * MAD; 0 where a statistic has too few values. Medians by ranges."""
    median = stored(middles(points, F.col("intensity"), "median", TRACE), "medians")
    first = points.groupBy(*TRACE).agg(F.avg("intensity").alias("mean"), F.coalesce(F.stddev_samp("intensity"), F.lit(0.0)).alias("sd"))
    mad = middles(points.join(median, TRACE), F.abs(F.col("intensity") - F.col("median")), "mad_sd", TRACE)
    return first.join(median, TRACE).join(mad, TRACE).select(*TRACE, "mean", "median", "sd", (F.col("mad_sd") * 1.4826).alias("mad_sd"))


def avoid_zero_stats(points: DataFrame) -> DataFrame:
    """AGG2, AGG3: median that falls back to positive values when 0, median of positive values, square root of the mean, MAD of positive values. Medians by ranges."""
    positive = points.where("intensity > 0")
    every = middles(points, F.col("intensity"), "median", TRACE).join(middles(positive, F.col("intensity"), "median_non_zero", TRACE), TRACE, "left").withColumn("median_non_zero", F.coalesce("median_non_zero", F.lit(0.0)))
    every = stored(every, "medians")
    root = points.groupBy(*TRACE).agg(F.sqrt(F.avg("intensity")).alias("sqrt_mean"))
    mad = middles(positive.join(every, TRACE), F.abs(F.col("intensity") - F.col("median_non_zero")), "mad_non_zero", TRACE)
    out = every.join(root, TRACE).join(mad, TRACE, "left").withColumn("mad_non_zero", F.coalesce(F.col("mad_non_zero") * 1.4826, F.lit(0.0)))
    return out.withColumn("median_avoid_zero", F.when(F.col("median") == 0, F.col("median_non_zero")).otherwise(F.col("median"))).select(*TRACE, "median", "median_non_zero", "sqrt_mean", "median_avoid_zero", "mad_non_zero")


def mode(points: DataFrame) -> DataFrame:
    """AGG5: most frequent value; of equally frequent ones the one that occurs first."""
    found = points.groupBy(*TRACE, "intensity").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    best = found.groupBy(*TRACE).agg(F.max_by(F.struct("intensity", "n"), F.struct("n", -F.col("first"))).alias("__m"))
    return best.select(*TRACE, F.col("__m.intensity").alias("mode"), F.col("__m.n").alias("n"))


def rmsd(points: DataFrame) -> DataFrame:
    """AGG17: root mean square of successive differences."""
    step = own(haloed(points, 1, 0).withColumn("d", F.col("intensity") - F.lag("intensity").over(in_block())))
    return step.groupBy(*TRACE).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmsd"))


def moving_average(points: DataFrame, width: int) -> DataFrame:
    """SEQ12: trailing moving average with a partial head."""
    return own(haloed(points, width - 1, 0).withColumn("smooth", F.avg("intensity").over(in_block().rowsBetween(-(width - 1), 0))))


def kernel_smooth(points: DataFrame, weights: list[float]) -> DataFrame:
    """SEQ12: symmetric kernel with mirrored edges, for traces longer than half of it: a weighted sum of a frame within a block, whose halo and mirrored ends are the only copies."""
    half = len(weights) // 2
    ends = points.groupBy(*TRACE).agg(F.count("*").alias("__n"))
    n, i = F.col("__n"), F.col("idx")
    places = F.array_distinct(F.filter(F.array(i, F.when(i.between(1, half), -i), F.when(i.between(n - 1 - half, n - 2), 2 * (n - 1) - i)), lambda x: x.isNotNull()))
    mirrored = points.join(ends, TRACE).select(*TRACE, "intensity", "__n", F.explode(places).alias("idx"))
    blocks = haloed(mirrored, half, half)
    around = [(w, F.coalesce(F.lag("intensity", half - k).over(in_block()) if k < half else F.lead("intensity", k - half).over(in_block()), F.lit(0.0))) for k, w in enumerate(weights)]
    total = sum((w * v for w, v in around[1:]), around[0][0] * around[0][1]) / sum(weights)
    smooth = own(blocks.withColumn("smooth", total)).where(i.between(0, n - 1))
    return smooth.select(*TRACE, i.cast("int").alias("idx"), "smooth")


def gaussian_weights(sigma: float) -> list[float]:
    """SEQ12: a Gaussian kernel out to three sigma."""
    half = math.ceil(3 * sigma)
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]


def sinc_weights(degree: int, half: int) -> list[float]:
    """SEQ12: sinc times a Gaussian, by the distance from the centre in units of half + 1."""

    def at(x: float) -> float:
        turn = math.pi * 0.5 * (degree + 4) * x
        return (math.sin(turn) / turn if turn else 1.0) * math.exp(-4 * x * x)

    return [at(abs(k) / (half + 1)) for k in range(-half, half + 1)]


def time_average(points: DataFrame, width: float, filtered: bool = False, least: int = 10) -> DataFrame:
    """SEQ11: windows of ``width`` seconds from the first time stamp: bin, n, mean, per_second and the centre's time.

    Windows are the least number that reaches the last stamp; a stamp on the last edge is outside, and so are negative
    ones, as the first window begins at 0. Of over two windows, a last one of fewer than ``least`` points joins the one
    before. filtered: the mean is that of values strictly within one MAD of the window's median. Empty windows have mean 0.
    """
    span = points.groupBy(*TRACE).agg(F.min("time_s").alias("__t0"), F.ceil((F.max("time_s") - F.min("time_s")) / width).alias("__bins"))
    binned = points.join(span, TRACE).withColumn("bin", F.floor((F.col("time_s") - F.col("__t0")) / width)).where((F.col("bin") < F.col("__bins")) & (F.col("time_s") >= 0))
    last = binned.where(F.col("bin") == F.col("__bins") - 1).groupBy(*TRACE).agg(F.count("*").alias("__tail"))
    edges = span.join(last, TRACE, "left").withColumn("__merged", (F.col("__bins") > 2) & (F.coalesce("__tail", F.lit(0)) < least)).withColumn("__left", F.col("__bins") - F.col("__merged").cast("int"))
    final = binned.join(edges.select(*TRACE, "__left"), TRACE).withColumn("bin", F.least("bin", F.col("__left") - 1)).select(*TRACE, "bin", "intensity")
    kept = final
    if filtered:
        middle = final.groupBy(*TRACE, "bin").agg(F.expr("percentile(intensity, 0.5)").alias("__m"))
        away = final.join(middle, [*TRACE, "bin"]).withColumn("__d", F.abs(F.col("intensity") - F.col("__m")))
        mad = away.groupBy(*TRACE, "bin").agg(F.expr("percentile(__d, 0.5)").alias("__mad"))
        kept = away.join(mad, [*TRACE, "bin"]).where("__d < __mad")
    means = kept.groupBy(*TRACE, "bin").agg(F.count("*").alias("n"), F.avg("intensity").alias("mean"))
    every = edges.where("__left > 0").select(*TRACE, "__t0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__left") - 1)).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return every.join(means, [*TRACE, "bin"], "left").select(
        *TRACE, "bin", n.alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), (n / F.lit(width)).alias("per_second"), (F.col("__t0") + (F.col("bin") + 0.5) * width).alias("centre_s")
    )


def prefilter(points: DataFrame) -> DataFrame:
    """FIL23: strictly inside median +- MAD of the trace. Medians by ranges."""
    m = stored(middles(points, F.col("intensity"), "__m", TRACE), "medians")
    mad = m.join(middles(points.join(m, TRACE), F.abs(F.col("intensity") - F.col("__m")), "__d", TRACE), TRACE)
    return points.join(mad, TRACE).where("intensity > __m - __d and intensity < __m + __d").drop("__m", "__d")


def channel_ratio(points: DataFrame, over: str, under: str) -> DataFrame:
    """SEQ13, JOI1: points of over / under where under is positive, joined by index."""
    a = points.where(F.col("channel") == over).select("sample_id", "idx", F.col("intensity").alias("a"))
    b = points.where((F.col("channel") == under) & (F.col("intensity") > 0)).select("sample_id", "idx", F.col("intensity").alias("b"))
    return a.join(b, ["sample_id", "idx"]).select("sample_id", "idx", (F.col("a") / F.col("b")).alias("ratio"))


def channel_sum(points: DataFrame, groups: Column) -> DataFrame:
    """SEQ14: sum of the channels of each group by index."""
    return points.groupBy("sample_id", groups.alias("channel"), "idx").agg(F.sum("intensity").alias("intensity"))


def element_sum(points: DataFrame, channels: DataFrame, exclude_isobars: bool = False, selected: list[str] | None = None) -> DataFrame:
    """SEQ14: (sample_id, channel, idx, time_s, intensity, n_isotopes) with one channel per element, the sum of its isotopes by index, named by a sum sign before the element.

    channels has (channel, element, mass_number); of an element and mass only the first channel by name counts. Masses that
    two elements of the table claim can be left out, and so can channels that aren't ``selected``.
    """
    first = channels.groupBy("element", "mass_number").agg(F.min("channel").alias("channel"))
    if exclude_isobars:
        claimed = channels.groupBy("mass_number").agg(F.count_distinct("element").alias("__k")).where("__k < 2").select("mass_number")
        first = first.join(claimed, "mass_number")
    if selected is not None:
        first = first.where(F.col("channel").isin(selected))
    named = points.join(first.select("channel", "element"), "channel")
    summed = named.groupBy("sample_id", F.concat(F.lit("Σ"), "element").alias("channel"), "idx")
    return summed.agg(F.min("time_s").alias("time_s"), F.sum("intensity").alias("intensity"), F.count("*").alias("n_isotopes"))


def renumbered(points: DataFrame) -> DataFrame:
    """idx without gaps."""
    return numbered(points.withColumnRenamed("idx", "__was"), [F.col("__was")], "idx", TRACE).drop("__was")


def sampled_average(points: DataFrame, width: int, every: int) -> DataFrame:
    """The trailing mean over width of all but the first and last point, at every ``every``-th of them; nothing for traces of three points or fewer."""
    ends = points.groupBy(*TRACE).agg(F.count("*").alias("__n"))
    inner = points.join(ends, TRACE).where((F.col("__n") > 3) & F.col("idx").between(1, F.col("__n") - 2)).withColumn("idx", F.col("idx") - 1).drop("__n")
    return moving_average(inner, width).where((F.col("idx") + 1) % every == 0).withColumn("idx", F.floor(F.col("idx") / every))


def drift_factor(averages: DataFrame, width: int = 9, every: int = 3) -> DataFrame:
    """AGG15: how far the background of a trace drifts, from its short averages (points): a range, a spread and a trend term, multiplied.

    Range: 1 + (max - min) / (mean + 1) of what lies from one root below to a quarter root above the mean, with the root
    of mean + 1. Spread: 100 SD / (mean + 1) of the trailing means of what is left of that and not zero. Trend: 1 plus
    the share of strictly rising or falling runs of four among every third trailing mean, less 0.25, at least 1. A term
    without enough values is 1.
    """
    s = averages.groupBy(*TRACE).agg(F.count("*").alias("__count"), F.avg("intensity").alias("__mean"))
    root = F.sqrt(F.col("__mean") + 1)
    near = averages.join(s, TRACE).where((F.col("__count") <= 3) | F.col("intensity").between(F.col("__mean") - root, F.col("__mean") + 0.25 * root))
    reach = near.where("__count > 3").groupBy(*TRACE).agg((1 + (F.max("intensity") - F.min("intensity")) / (F.first("__mean") + 1)).alias("range_term"))
    rest = renumbered(near.where("intensity <> 0").select(*TRACE, "idx", "intensity"))
    spread = sampled_average(rest, width, 1).groupBy(*TRACE).agg(F.when(F.count("*") > 1, 100 * F.stddev_samp("smooth") / (F.avg("smooth") + 1)).alias("rsd_term"))
    steps = sampled_average(averages.select(*TRACE, "idx", "intensity"), width, every)
    before = [F.lag("smooth", k).over(in_block()) for k in (3, 2, 1)]
    runs = own(haloed(steps, 3, 0).withColumns({"__a": before[0], "__b": before[1], "__c": before[2]}))
    rising = (F.col("__a") < F.col("__b")) & (F.col("__b") < F.col("__c")) & (F.col("__c") < F.col("smooth"))
    falling = (F.col("__a") > F.col("__b")) & (F.col("__b") > F.col("__c")) & (F.col("__c") > F.col("smooth"))
    trend = runs.groupBy(*TRACE).agg(F.when(F.count("*") > 1, F.greatest(F.lit(1.0), 0.75 + F.sum((rising | falling).cast("int")) / F.count("*"))).alias("trend_term"))
    terms = s.select(*TRACE).join(reach, TRACE, "left").join(spread, TRACE, "left").join(trend, TRACE, "left")
    filled = terms.select(*TRACE, *[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("range_term", "rsd_term", "trend_term")])
    return filled.withColumn("drift", F.col("range_term") * F.col("rsd_term") * F.col("trend_term"))
