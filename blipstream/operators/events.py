"""Event metrics, background correction, gates and filters."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quant import revert
from ..plans.stored import stored
from .scan import TRACE, middles, numbered, running_sum
from .search import spread_over


def metrics(events: DataFrame, points: DataFrame, dt: float | None = None) -> DataFrame:
    """SEQ6: duration in microseconds, centre time and asymmetry from index look-ups; events bring start, end, peak, points, area, height."""
    t = points.select(*TRACE, "idx", "time_s")

    def at(df: DataFrame, index: Column, name: str) -> DataFrame:
        return df.withColumn("__i", index.cast("int")).join(t.withColumnsRenamed({"idx": "__i", "time_s": name}), [*TRACE, "__i"], "left").drop("__i")

    out = at(at(at(at(events, F.col("start_idx") - 1, "__before"), F.col("end_idx"), "__end"), F.col("end_idx") + 1, "__after"), F.floor((F.col("start_idx") + F.col("end_idx")) / 2), "center_time_s")
    a, b = F.col("peak_idx") - F.col("start_idx"), F.col("end_idx") - F.col("peak_idx")
    first = F.coalesce(F.col("__after") - F.col("__start"), F.lit(dt))
    out = at(out, F.col("start_idx"), "__start")
    return out.withColumn("duration_us", F.when(F.col("start_idx") > 0, F.col("__end") - F.col("__before")).otherwise(first) * 1e6).withColumn(
        "asymmetry", F.when(F.col("n_points") <= 2, 1.0).otherwise(2.0 * b / F.greatest(F.lit(1), a + b))
    ).drop("__before", "__end", "__after", "__start")


#: PRJ1: what an event is described by; n_events is that of its trace.
PARAMETERS = ["area", "net_area", "height", "net_height", "duration_us", "n_points", "bg_per_event", "n_events", "asymmetry", "start_idx", "end_idx", "center_time_s"]


def all_parameters(events: DataFrame, points: DataFrame) -> DataFrame:
    """PRJ1: (trace, event_ord, PARAMETERS) of events that have their net values."""
    n = events.groupBy(*TRACE).agg(F.count("*").alias("n_events"))
    return metrics(events, points).join(n, TRACE).select(*TRACE, "event_ord", *PARAMETERS)


def net_of_baseline(events: DataFrame, location: DataFrame, clamp: bool = False) -> DataFrame:
    """SEQ7a: background = max(0.1, location) times points; net area and net height."""
    bg = F.greatest(F.lit(0.1), F.col("location")) * F.col("n_points")
    net = events.join(F.broadcast(location), TRACE).withColumn("bg_per_event", F.least(bg, F.col("area")) if clamp else bg)
    return net.withColumn("net_area", F.col("area") - F.col("bg_per_event")).withColumn("net_height", F.greatest(F.lit(0.0), F.col("height")) - F.col("bg_per_event") / F.col("n_points"))


def background(points: DataFrame, events: DataFrame) -> DataFrame:
    """SEQ8, SET3: the points in no event."""
    return points.join(spread_over(events).select(*TRACE, "idx"), [*TRACE, "idx"], "left_anti")


def net_of_window(events: DataFrame, points: DataFrame, half: int, block: int = 4096) -> DataFrame:
    """SEQ7b: mean of the background points with index in (peak - half, peak + half]; 0 if there are none.

    Prefix sums of the background by index turn the window into two look-ups; they are decimals, so that
    differences of large sums lose no digits.
    """
    inside = spread_over(events).select(*TRACE, "idx").distinct().withColumn("__in", F.lit(1))
    marked = points.join(inside, [*TRACE, "idx"], "left").withColumn("__free", F.col("__in").isNull().cast("long"))
    total = running_sum(marked, F.when(F.col("__free") == 1, F.col("intensity")).otherwise(0.0).cast("decimal(28,6)"), "__sum")
    total = running_sum(total, F.col("__free"), "__count").select(*TRACE, "idx", "__sum", "__count")
    last = points.groupBy(*TRACE).agg(F.max("idx").alias("__last"))
    keyed = events.join(last, TRACE).withColumn("__hi", F.least(F.col("peak_idx") + half, F.col("__last")).cast("int")).withColumn("__lo", F.greatest(F.col("peak_idx") - half, F.lit(-1)).cast("int"))
    hi = total.withColumnsRenamed({"idx": "__hi", "__sum": "__s1", "__count": "__c1"})
    lo = total.withColumnsRenamed({"idx": "__lo", "__sum": "__s0", "__count": "__c0"})
    both = keyed.join(hi, [*TRACE, "__hi"]).join(lo, [*TRACE, "__lo"], "left")
    n = F.col("__c1") - F.coalesce("__c0", F.lit(0))
    return both.withColumn("bg_mean", F.when(n > 0, (F.col("__s1") - F.coalesce("__s0", F.lit(0))).cast("double") / n).otherwise(0.0)).drop("__hi", "__lo", "__s1", "__c1", "__s0", "__c0", "__last")


def sums_in_time(peaks: DataFrame, free: DataFrame, half: float, value: str) -> DataFrame:
    """SEQ7c: (trace, start_idx, n, total) of the free points with a time in (t - half, t + half] of each peak (start_idx, t); value is a decimal.

    Both ends of a window are marks among the points in order of time, each behind the points of its own time; what lies
    between is the difference of two running sums, so work grows with points and peaks, not with what windows hold.
    """
    ends = F.array(*(F.struct((F.col("t") + s * half).alias("at"), F.lit(s).alias("sign")) for s in (-1, 1)))
    marks = peaks.select(*TRACE, "start_idx", F.explode(ends).alias("__e")).select(*TRACE, "__e.at", F.lit(1).alias("kind"), "start_idx", "__e.sign", F.lit(None).cast(free.schema[value].dataType).alias("y"))
    none = F.lit(None).cast("int")
    points = free.select(*TRACE, F.col("time_s").alias("at"), F.lit(0).alias("kind"), none.alias("start_idx"), none.alias("sign"), F.col(value).alias("y"))
    placed = stored(numbered(points.unionByName(marks), [F.col("at"), F.col("kind")], "idx", TRACE), "in-time")
    both = running_sum(running_sum(placed, F.coalesce("y", F.lit(0).cast(free.schema[value].dataType)), "__sum"), (F.col("kind") == 0).cast("long"), "__count").where("kind = 1")
    return both.groupBy(*TRACE, "start_idx").agg(F.sum(F.col("sign") * F.col("__count")).alias("n"), F.sum(F.when(F.col("sign") > 0, F.col("__sum")).otherwise(-F.col("__sum"))).alias("total"))


def legacy_percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Percentiles at position p * (n + 1), clamped to the ends, one column per name; values are numbered by ranges, no group is sorted whole."""
    ranked = numbered(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), [F.col("__v")], "__r", by)
    n = ranked.groupBy(*by).agg(F.count("*").alias("__n"))
    wanted = n.select(*by, "__n", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("__n") + 1)).alias("pos")) for k, p in at.items()))).alias("__w")).select(*by, "__n", "__w.name", "__w.pos")
    low = F.least(F.greatest(F.floor("pos"), F.lit(1)), F.col("__n"))
    places = wanted.withColumn("__lo", low).withColumn("__hi", F.least(low + 1, F.col("__n"))).withColumn("__part", F.when(F.col("pos") < 1, 0.0).otherwise(F.col("pos") - F.floor("pos")))
    both = places.select(*by, "name", "__part", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__lo").alias("nth")), F.struct(F.lit(1).alias("side"), F.col("__hi").alias("nth")))).alias("__s"))
    met = both.select(*by, "name", "__part", "__s.side", (F.col("__s.nth") - 1).alias("__r")).join(ranked, [*by, "__r"])
    value_at = met.groupBy(*by, "name", "__part").agg(F.max(F.when(F.col("side") == 0, F.col("__v"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("__v"))).alias("hi"))
    line = F.col("lo") + F.col("__part") * (F.col("hi") - F.col("lo"))
    return value_at.groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, line)).alias(k) for k in at))


def percentile_roi(df: DataFrame, by: list[str], value: str, start: float, stop: float) -> DataFrame:
    """FIL5: rows between two legacy percentiles; groups whose bounds collapse keep all."""
    b = legacy_percentiles(df, by, value, {"__lo": start, "__hi": stop})
    return df.join(b, by).where((F.col("__lo") >= F.col("__hi")) | F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def iqr_fence(df: DataFrame, by: list[str], value: str, k: float = 1.5) -> DataFrame:
    """FIL6: Q1 - k * IQR .. Q3 + k * IQR where the IQR is positive."""
    q = legacy_percentiles(df, by, value, {"__q1": 0.25, "__q3": 0.75})
    iqr = F.col("__q3") - F.col("__q1")
    return df.join(q, by).where((iqr <= 0) | F.col(value).between(F.col("__q1") - k * iqr, F.col("__q3") + k * iqr)).drop("__q1", "__q3")


def mad_fence(df: DataFrame, by: list[str], value: str, k: float = 1.5) -> DataFrame:
    """FIL7: median -+ k / 2 * MAD, the MAD unscaled; medians by ranges."""
    m = stored(middles(df, F.col(value), "__m", by), "medians")
    d = m.join(middles(df.join(m, by), F.abs(F.col(value) - F.col("__m")), "__d", by), by)
    return df.join(d, by).where(F.abs(F.col(value) - F.col("__m")) <= k / 2 * F.col("__d")).drop("__m", "__d")


def with_overrides(events: DataFrame, overrides: DataFrame, low: float, high: float, value: str, only_exceptions: bool = False) -> DataFrame:
    """FIL4, FIL10: absolute bounds, replaced for the channels that overrides lists (channel, low, high); with only_exceptions the other channels keep all their events."""
    joined = events.join(overrides.withColumn("__own", F.lit(True)), "channel", "left")
    inside = F.col(value).between(F.coalesce("low", F.lit(low)), F.coalesce("high", F.lit(high)))
    return joined.where(inside | F.col("__own").isNull() if only_exceptions else inside).drop("low", "high", "__own")


def as_counts(bounds: DataFrame, calibration: DataFrame) -> DataFrame:
    """FIL4: bounds (channel, low, high) in fg as bounds in counts by each channel's calibration, so that events are filtered without being quantified."""
    given = bounds.join(calibration.select("channel", "strategy", "np_cts_per_fg", "ionic_cts_per_fg", "aerosol_te_pct"), "channel")
    low, high = (revert(F.col(c), F.col("strategy"), F.col("np_cts_per_fg"), F.col("ionic_cts_per_fg"), F.col("aerosol_te_pct")).alias(c) for c in ("low", "high"))
    return given.select("channel", low, high)


def merged_samples(events: DataFrame, traces: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG14: (merged_id, channel) of samples merged by groups (sample_id, merged_id): events of all its samples together (n, mean, SD and median of net area), rate by all seconds, raw mean as the plain mean of the samples' means.

    traces has (sample_id, channel, seconds, raw_mean). A sample without events of a channel still lends its seconds and mean.
    """
    of = traces.join(groups, "sample_id").groupBy("merged_id", "channel").agg(F.count("*").alias("n_samples"), F.sum("seconds").alias("seconds"), F.avg("raw_mean").alias("raw_mean"))
    together = events.join(groups, "sample_id").select("merged_id", "channel", "net_area")
    s = together.groupBy("merged_id", "channel").agg(F.count("*").alias("n"), F.avg("net_area").alias("mean_net_area"), F.stddev_samp("net_area").alias("sd_net_area"))
    s = s.join(middles(together, F.col("net_area"), "median_net_area", ["merged_id", "channel"]), ["merged_id", "channel"])
    n = F.coalesce("n", F.lit(0))
    return of.join(s, ["merged_id", "channel"], "left").withColumn("n", n).withColumn("per_second", F.try_divide(n, F.col("seconds")))


def gate(events: DataFrame, kind: str, target: float) -> DataFrame:
    """FIL11 to FIL13: height, area, net_area against a threshold; more or fewer points; peak dominance in percent."""
    tests = {
        "height": F.col("height") > target,
        "area": F.col("area") > target,
        "net_area": F.col("net_area") > target,
        "more_points": F.col("n_points") > target,
        "fewer_points": F.col("n_points") < target,
        "dominance": F.col("net_height") < target / 100 * F.col("net_area"),
    }
    return events.where(tests[kind])


def over_range(events: DataFrame, flagged: DataFrame) -> DataFrame:
    """FIL16: population OvRng for events that contain a flagged index, else InRng."""
    hit = spread_over(events.select(*TRACE, "start_idx", "end_idx")).join(flagged.select(*TRACE, "idx"), [*TRACE, "idx"], "left_semi").select(*TRACE, "start_idx").distinct().withColumn("__hit", F.lit(True))
    return events.join(hit, [*TRACE, "start_idx"], "left").withColumn("population", F.when(F.col("__hit"), "OvRng").otherwise("InRng")).drop("__hit")


def remove_channels(events: DataFrame, seconds: DataFrame, most_rate: float | None = None, least_count: int | None = None, least_net: float | None = None, by: str = "max") -> DataFrame:
    """FIL19: drops channels by event rate, count, or net area: that of their largest event (``by`` max) or of their smallest (min)."""
    s = events.groupBy(*TRACE).agg(F.count("*").alias("n"), {"max": F.max, "min": F.min}[by]("net_area").alias("top")).join(seconds, TRACE)
    keep = F.lit(True)
    if most_rate is not None:
        keep = keep & (F.col("n") / F.col("seconds") <= most_rate)
    if least_count is not None:
        keep = keep & (F.col("n") >= least_count)
    if least_net is not None:
        keep = keep & (F.col("top") >= least_net)
    return events.join(s.where(keep).select(*TRACE), TRACE, "left_semi")


def inside_polygon(df: DataFrame, x: str, y: str, corners: list[tuple[float, float]]) -> DataFrame:
    """FIL21: ray casting; one comparison per edge, all in generated code."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            crosses = ((F.col(y) < y1) != (F.col(y) < y2)) & (F.col(x) < (x2 - x1) * (F.col(y) - y1) / (y2 - y1) + x1)
            odd = odd != crosses
    return df.where(odd)


def aligned_filter(spectra: DataFrame, channels: list[str], low: float, high: float) -> DataFrame:
    """FIL17: event ordinals whose value lies in bounds in all listed channels; survivors keep every channel."""
    ok = spectra.where(F.col("channel").isin(channels)).groupBy("sample_id", "event_ord").agg(F.bool_and(F.col("intensity").between(low, high)).alias("__ok"), F.count("*").alias("__n"))
    return spectra.join(ok.where(F.col("__ok") & (F.col("__n") == len(channels))).select("sample_id", "event_ord"), ["sample_id", "event_ord"], "left_semi")


def manual_roi(events: DataFrame, parameter: str, start: float, stop: float, label: str) -> DataFrame:
    """FIL2: events with population: each keeps its own (main), and those whose parameter lies in [start, stop] are once more in MRoi(label)."""
    main = events.withColumn("population", F.lit("main"))
    return main.unionByName(events.where(F.col(parameter).between(start, stop)).withColumn("population", F.lit(f"MRoi({label})")))


def roi(df: DataFrame, parameter: str, start: float, stop: float, include: bool = True) -> DataFrame:
    """FIL3: the closed interval, or what lies strictly outside; nulls are in neither."""
    inside = F.col(parameter).between(start, stop)
    return df.where(inside if include else ~inside)


SELECTIONS = ("ALL_LOADED", "SELECTED", "POSITIVE_LIST", "NEGATIVE_LIST")


def select_channels(df: DataFrame, mode: str, channels: list[str] | None = None) -> DataFrame:
    """FIL20: rows of all channels, of the selected or listed ones, or of all but the listed ones."""
    if mode not in SELECTIONS:
        raise ValueError(f"no selection {mode!r}")
    if mode == "ALL_LOADED":
        return df
    listed = F.col("channel").isin(channels or [])
    return df.where(~listed if mode == "NEGATIVE_LIST" else listed)


def statistics(events: DataFrame) -> DataFrame:
    """AGG7: per trace, mean, SD and median of net area, mean and SD of height and of duration."""
    one = {f"{k}_{c}": f(c) for c in ("net_area", "height", "duration_us") for k, f in (("mean", F.avg), ("sd", F.stddev_samp))}
    return events.groupBy(*TRACE).agg(F.count("*").alias("n"), *(e.alias(k) for k, e in one.items())).join(middles(events, F.col("net_area"), "median_net_area", TRACE), TRACE, "left")


def profiles(events: DataFrame, points: DataFrame) -> DataFrame:
    """AGG24: for each number of points, the profile of the trace's last event of that length, as shares of its area."""
    last = events.groupBy(*TRACE, "n_points").agg(F.max(F.struct("start_idx", "end_idx", "area")).alias("__e"))
    spread = spread_over(last.select(*TRACE, "n_points", "__e.start_idx", "__e.end_idx", "__e.area")).join(points.select(*TRACE, "idx", "intensity"), [*TRACE, "idx"])
    return spread.select(*TRACE, "n_points", (F.col("idx") - F.col("start_idx")).alias("offset"), (F.col("intensity") / F.col("area")).alias("share"))


def summed_order(spectra: DataFrame) -> DataFrame:
    """SRT2: event ordinals of a sample with nth, by their sum over channels, largest first; ties by ordinal."""
    total = spectra.groupBy("sample_id", "event_ord").agg(F.sum("intensity").alias("total"))
    return numbered(total, [F.col("total").desc(), F.col("event_ord")], "nth", ["sample_id"])


def trimmed(points: DataFrame) -> DataFrame:
    """SRT7: the traces of a sample cut to the length of its shortest."""
    ends = points.groupBy(*TRACE).agg(F.max("idx").alias("__end")).groupBy("sample_id").agg(F.min("__end").alias("__end"))
    return points.join(ends, "sample_id").where(F.col("idx") <= F.col("__end")).drop("__end")


def mapped_channels(left: DataFrame, right: DataFrame, isotope: str = "isotope") -> DataFrame:
    """JOI8: the channels of two samples that measure the same isotope; channels without one meet each other."""
    a, b = left.select(isotope, F.col("channel").alias("left_channel")), right.select(F.col(isotope).alias("__other"), F.col("channel").alias("right_channel"))
    return a.join(b, F.col(isotope).eqNullSafe(F.col("__other"))).drop("__other")


def reconciled(loaded: DataFrame, imported: DataFrame) -> DataFrame:
    """SET5: after importing a sample anew: its traces that are still there keep their loaded points, those that went go, new ones come in."""
    there, now = loaded.select(*TRACE).distinct(), imported.select(*TRACE).distinct()
    return loaded.join(now, TRACE, "left_semi").unionByName(imported.join(there, TRACE, "left_anti"))
