"""Event search: which runs of points rise above the background."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored
from .kernels import savitzky_golay
from .scan import TRACE, dealt, numbered as in_order, running_sum
from .traces import is_integer, moving_average

EVENT = [*TRACE, "event_ord"]


def rounded(points: DataFrame) -> DataFrame:
    """Searches see integer traces rounded, half up; measures stay those of the recorded values, which are kept as gross."""
    kinds = is_integer(points).where("is_integer")
    joined = points.withColumn("gross", F.col("intensity")).join(F.broadcast(kinds), TRACE, "left")
    return joined.withColumn("intensity", F.when(F.col("is_integer"), F.floor(F.col("intensity") + 0.5).cast("double")).otherwise(F.col("intensity"))).drop("is_integer")


def gross(points: DataFrame) -> Column:
    return F.col("gross" if "gross" in points.columns else "intensity")


def simple_search(points: DataFrame) -> DataFrame:
    """SEQ3: every positive point above its threshold is an event of one point."""
    return points.where("intensity > height_thr and intensity > 0").select(*TRACE, F.col("idx").alias("start_idx"), F.col("idx").alias("end_idx"), F.col("idx").alias("peak_idx"))


def keyed_runs(points: DataFrame) -> DataFrame:
    """points with island (the key of a run and of the point that closes it), __break and __open (the run's first index at or above start).

    A point below both start and stop (or not positive) breaks the trace; the running count of breaks names
    the island, and a break belongs to the island it closes. Only that count crosses islands, and it is a
    blocked sum; all else is partitioned by island.
    """
    brk = (F.col("intensity") < F.col("start_thr")) & ((F.col("intensity") < F.col("stop_thr")) | (F.col("intensity") <= 0))
    marked = running_sum(points, brk.cast("long"), "__count").withColumn("__break", brk)
    keyed = dealt(marked.withColumn("island", F.col("__count") - F.col("__break").cast("long")).drop("__count"), *TRACE, "island")
    first = F.min(F.when(~F.col("__break") & (F.col("intensity") >= F.col("start_thr")), F.col("idx")))
    return keyed.withColumn("__open", first.over(Window.partitionBy(*TRACE, "island")))


def hysteresis_points(points: DataFrame) -> DataFrame:
    """SEQ4a up to the height test: the points of every opened run, with island. points carry start_thr, stop_thr and height_thr."""
    return keyed_runs(points).where("not __break and idx >= __open").drop("__open", "__break")


def hysteresis_search(points: DataFrame) -> DataFrame:
    """SEQ4a: events (start_idx, end_idx, peak_idx, n_points, area, height) whose height exceeds the threshold at the closing index, or at the last one of the trace."""
    inside, measured = ~F.col("__break"), gross(points)

    def of_run(column: str) -> Column:
        return F.when(inside, F.col(column))

    runs = keyed_runs(points).where("__break or idx >= __open").groupBy(*TRACE, "island").agg(
        F.min(of_run("idx")).alias("start_idx"),
        F.max(of_run("idx")).alias("end_idx"),
        F.count(of_run("idx")).alias("n_points"),
        F.sum(F.when(inside, measured)).alias("area"),
        F.max(F.when(inside, measured)).alias("height"),
        F.max(of_run("intensity")).alias("__seen"),
        F.min_by("idx", F.when(inside, F.struct(-measured, "idx"))).alias("peak_idx"),
        F.max_by("height_thr", "idx").alias("__closing"),
    )
    return runs.where(F.col("__seen") > F.col("__closing")).drop("__closing", "__seen", "island")


def numbered(events: DataFrame) -> DataFrame:
    """event_ord: 0, 1, ... along each trace."""
    return in_order(events, [F.col("start_idx"), F.col("end_idx")], "event_ord", TRACE).withColumn("event_ord", F.col("event_ord").cast("int"))


def merge_intervals(intervals: DataFrame, touch: int = 0) -> DataFrame:
    """Maximal unions of (start_idx, end_idx) per trace; next.start <= end + touch belongs to the same one.

    A union begins where all intervals that began before have ended. Each distinct index holds the numbers that begin
    and end there (an end counts touch + 1 later), so the open ones are a blocked running sum and no trace is in one task.
    """
    begins = F.struct(F.col("start_idx").alias("at"), F.lit(1).alias("begins"), F.lit(0).alias("ends"), F.col("end_idx").alias("last"))
    ends = F.struct((F.col("end_idx") + touch + 1).alias("at"), F.lit(0).alias("begins"), F.lit(1).alias("ends"), F.lit(None).cast("int").alias("last"))
    steps = intervals.select(*TRACE, F.explode(F.array(begins, ends)).alias("__s"))
    spots = steps.groupBy(*TRACE, F.col("__s.at").alias("idx")).agg(F.sum("__s.begins").alias("__begins"), F.sum("__s.ends").alias("__ends"), F.max("__s.last").alias("__last"))
    open_ = running_sum(stored(spots, "interval-spots"), F.col("__begins") - F.col("__ends"), "__open").where("__begins > 0")
    new = (F.col("__open") == F.col("__begins")).cast("long")
    named = running_sum(stored(open_, "interval-begins"), new, "__grp")
    return named.groupBy(*TRACE, "__grp").agg(F.min("idx").cast("int").alias("start_idx"), F.max("__last").cast("int").alias("end_idx")).drop("__grp")


def window_search(points: DataFrame, widen: int, bonus: float) -> DataFrame:
    """SEQ4b: each point at or above start is widened on both sides, more if it is low; overlapping results fuse; the height is tested at the merged peak."""
    n = points.groupBy(*TRACE).agg(F.max("idx").alias("__last"))
    extra = F.ceil(F.least(F.lit(1.0), F.greatest(F.lit(1.0), F.col("start_thr")) / F.greatest(F.lit(1.0), F.col("intensity"))) * bonus)
    wide = points.where("intensity >= start_thr").join(F.broadcast(n), TRACE).select(
        *TRACE, F.greatest(F.lit(0), F.col("idx") - widen - extra).cast("int").alias("start_idx"), F.least("__last", F.col("idx") + widen + extra).cast("int").alias("end_idx")
    )
    merged = merge_intervals(wide)
    return peaks(merged, points).where("height > peak_thr").drop("peak_thr")


def spread_over(intervals: DataFrame) -> DataFrame:
    """One row per interval and index; linear in the points that events cover."""
    return intervals.withColumn("idx", F.explode(F.sequence("start_idx", "end_idx")))


def peaks(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """Area, height, points and first maximum of disjoint intervals, by an equi-join on the index."""
    found = spread_over(intervals).join(points.select(*TRACE, "idx", "intensity", "height_thr"), [*TRACE, "idx"])
    first_max = F.struct(-F.col("intensity"), "idx")
    return found.groupBy(*TRACE, "start_idx", "end_idx").agg(
        F.count("*").alias("n_points"), F.sum("intensity").alias("area"), F.max("intensity").alias("height"), F.min_by("idx", first_max).alias("peak_idx"), F.min_by("height_thr", first_max).alias("peak_thr")
    )


def smooth_search(points: DataFrame, width: int) -> DataFrame:
    """SEQ4c with the trailing average: searches max(ceil(smooth), intensity)."""
    smooth = moving_average(points, width)
    return hysteresis_search(smooth.withColumn("intensity", F.greatest(F.ceil(F.round("smooth", 9)).cast("double"), F.col("intensity"))).drop("smooth"))


SMOOTHERS = ("MOAV", "SAVITZKY_GOLAY")


def smooth_merge_search(points: DataFrame, width: int, smoother: str = "MOAV") -> DataFrame:
    """SEQ4c: runs of max(ceil(smooth), intensity) between start and stop become events of the recorded intensities; those stay whose first maximum exceeds the height threshold there.

    The smoother is the trailing mean or the least-squares cubic over ``width`` points (at least two). Runs that touch in an
    index are merged before heights are tested.
    """
    if smoother not in SMOOTHERS:
        raise ValueError(f"no smoother {smoother!r}")
    width = max(2, width)
    seen = rounded(points)
    if smoother == "MOAV":
        smooth = moving_average(points, width).select(*TRACE, "idx", "smooth")
    else:
        smooth = savitzky_golay(points, width).select(*TRACE, "idx", "smooth")
    high = seen.drop("gross").join(smooth, [*TRACE, "idx"]).withColumn("intensity", F.greatest(F.ceil(F.round("smooth", 9)).cast("double"), F.col("intensity"))).drop("smooth")
    runs = hysteresis_points(high).groupBy(*TRACE, "island").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx")).drop("island")
    return peaks(merge_intervals(runs), points).where("height > peak_thr").drop("peak_thr")
