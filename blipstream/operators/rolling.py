"""Exact order statistics of sliding frames: medians and MADs around every point, and around events, in blocks with a halo."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .align import broadcast_to_channels
from .scan import TRACE, haloed
from .search import spread_over

#: The MAD of normal values times this is their SD.
MAD_TO_SD = 1.4826
#: Values of sorted frames that are in memory at once.
FRAME_VALUES = 1 << 21
KEYS = "sample_id string, channel string"


def medians(ordered: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The median of the n values from column ``first`` of each sorted row; NaN where n is 0."""
    at = np.arange(len(ordered))
    low = ordered[at, np.minimum(first + np.maximum(n - 1, 0) // 2, ordered.shape[1] - 1)]
    high = ordered[at, np.minimum(first + n // 2, ordered.shape[1] - 1)]
    return np.where(n > 0, low + (high - low) * 0.5, np.nan)


def deviations(ordered: np.ndarray, first: np.ndarray, n: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The median distance from ``middle`` of the same values."""
    column = np.arange(ordered.shape[1])
    outside = (column < first[:, None]) | (column >= (first + n)[:, None])
    away = np.where(outside, np.inf, np.abs(ordered - middle[:, None]))
    away.sort(axis=1)
    return medians(away, np.zeros(len(n), np.int64), n)


def frames(y: np.ndarray, before: int, after: int):
    """(first row, sorted frames, sizes) for the frame [i - before, i + after] of every i, some rows at a time; beyond the ends are NaNs, which come last."""
    padded = np.concatenate([np.full(before, np.nan), y, np.full(after, np.nan)])
    every = np.lib.stride_tricks.sliding_window_view(padded, before + after + 1)
    step = max(1, FRAME_VALUES // (before + after + 1))
    for at in range(0, len(y), step):
        ordered = np.sort(every[at : at + step], axis=1)
        yield at, ordered, (~np.isnan(ordered)).sum(1)


def by_block(points: DataFrame, before: int, after: int, run, columns: list[str], block: int) -> DataFrame:
    """Applies run(intensities, first own row, end of own rows) -> values of the columns to each block of the index and its halo; points of a trace are numbered without gaps."""
    block = max(block, before + after)

    def of_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        own = (part["idx"] // block == key[-1]).to_numpy()
        if not own.any():
            return part.loc[own, [*TRACE, "idx"]].assign(**{c: 0.0 for c in columns})
        lo = int(own.argmax())
        hi = lo + int(own.sum())
        made = run(part["intensity"].to_numpy(float), lo, hi)
        return pd.DataFrame({"sample_id": np.full(hi - lo, key[0], object), "channel": np.full(hi - lo, key[1], object), "idx": part["idx"].to_numpy()[lo:hi], **dict(zip(columns, made, strict=True))})

    near = haloed(points.select(*TRACE, "idx", "intensity"), before, after, block)
    return near.groupBy(*TRACE, "__block").applyInPandas(of_block, f"{KEYS}, idx int, " + ", ".join(f"{c} double" for c in columns))


def rolling_median(points: DataFrame, before: int, after: int, block: int = 1 << 14) -> DataFrame:
    """(trace, idx, median, mad): of the values from ``before`` points ahead to ``after`` behind, less at the ends of a trace; the MAD is unscaled.

    Exact: every frame is sorted, in tasks of one block and its halo, so a trace is many tasks. Work is points times the
    width of a frame. Null intensities aren't allowed.
    """

    def run(y: np.ndarray, lo: int, hi: int):
        middle, mad = np.empty(len(y)), np.empty(len(y))
        for at, ordered, n in frames(y, before, after):
            first = np.zeros(len(n), np.int64)
            middle[at : at + len(n)] = medians(ordered, first, n)
            mad[at : at + len(n)] = deviations(ordered, first, n, middle[at : at + len(n)])
        return middle[lo:hi], mad[lo:hi]

    return by_block(points, before, after, run, ["median", "mad"], block)


def local_peak_likelihood(points: DataFrame, short: int = 3, long: int = 100, k: float = 0.1, block: int = 1 << 14) -> DataFrame:
    """SEQ15: points with ``score``, the share of the points at most ``short`` away that exceed the point's own threshold, and ``likelihood``, by the largest score of the trace.

    The threshold is median + k MAD of those values of the frame of ``long`` points to both sides that lie within one MAD
    of the frame's median; MADs are scaled to an SD. Frames are cut at the ends. Where all scores are 0, likelihoods are 0.
    """

    def run(y: np.ndarray, lo: int, hi: int):
        limit = np.empty(len(y))
        for at, ordered, n in frames(y, long, long):
            start = np.zeros(len(n), np.int64)
            middle = medians(ordered, start, n)
            mad = MAD_TO_SD * deviations(ordered, start, n, middle)
            first, kept = (ordered < (middle - mad)[:, None]).sum(1), ((ordered >= (middle - mad)[:, None]) & (ordered <= (middle + mad)[:, None])).sum(1)
            clean = medians(ordered, first, kept)
            limit[at : at + len(n)] = clean + k * (MAD_TO_SD * deviations(ordered, first, kept, clean))
        padded = np.concatenate([np.full(short, np.nan), y, np.full(short, np.nan)])
        near = np.lib.stride_tricks.sliding_window_view(padded, 2 * short + 1)[lo:hi]
        above = (near > limit[lo:hi, None]).sum(1)  # none is above a threshold of no values
        return (above / (~np.isnan(near)).sum(1),)

    reach = max(short, long)
    scored = by_block(points, reach, reach, run, ["score"], block)
    top = scored.groupBy(*TRACE).agg(F.max("score").alias("__top"))
    return points.join(scored, [*TRACE, "idx"]).join(top, TRACE).withColumn("likelihood", F.coalesce(F.try_divide(F.col("score"), F.col("__top")), F.lit(0.0))).drop("__top")


def frames_of_events(events: DataFrame, background: DataFrame, half: float, width: float) -> DataFrame:
    """(trace, start_idx, n, bg_mean, bg_median) over the background values y with x in (at - half, at + half] for each event's ``at``; n is 0 where there are none.

    Both sides meet in blocks of x of at least 2 * half, the background with a halo, so a task holds a block and a frame or two.
    """
    width = max(float(width), 2.0 * half)
    near = background.select(*TRACE, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    near = near.withColumn("__block", F.explode(F.sequence(F.floor((F.col("x") - half) / width), F.floor((F.col("x") + half) / width))))
    own = events.select(*TRACE, "start_idx", F.col("at").cast("double").alias("at")).withColumn("__block", F.floor(F.col("at") / width))

    def run(key: tuple, of: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        around = around.sort_values(["x", "y"])
        x, y, at = around["x"].to_numpy(), around["y"].to_numpy(), of["at"].to_numpy()
        spans = list(zip(np.searchsorted(x, at - half, "right").tolist(), np.searchsorted(x, at + half, "right").tolist(), strict=True))
        return pd.DataFrame(
            {
                "sample_id": of["sample_id"],
                "channel": of["channel"],
                "start_idx": of["start_idx"],
                "n": [b - a for a, b in spans],
                "bg_mean": [y[a:b].mean() if b > a else 0.0 for a, b in spans],
                "bg_median": [float(np.median(y[a:b])) if b > a else 0.0 for a, b in spans],
            }
        )

    groups = own.groupBy(*TRACE, "__block").cogroup(near.groupBy(*TRACE, "__block"))
    return groups.applyInPandas(run, f"{KEYS}, start_idx int, n long, bg_mean double, bg_median double")


def free_points(points: DataFrame, events: DataFrame) -> DataFrame:
    return points.join(spread_over(events.select(*TRACE, "start_idx", "end_idx")).select(*TRACE, "idx"), [*TRACE, "idx"], "left_anti")


def background_of_events(events: DataFrame, points: DataFrame, half: float, by: str = "INDEX", location: str = "MEDIAN", clamp: bool = False, block: int = 1 << 14) -> DataFrame:
    """SEQ7b and SEQ7c: events with n_bg, bg_mean, bg_median, bg_per_event, net_area and net_height from the points near the peak that are in no event.

    INDEX takes indices in (peak - half, peak + half], TIME times in the same interval around the peak's time, so a peak
    without a time stamp has no background. bg_per_event is the mean or, for MEDIAN, the exact median of these points
    times n_points; clamp keeps it from exceeding the area. Events without such points get 0.
    """
    if by not in ("INDEX", "TIME") or location not in ("MEAN", "MEDIAN"):
        raise ValueError(f"no background by {by!r} and {location!r}")
    free = free_points(points, events)
    if by == "INDEX":
        at, x, width = events.withColumn("at", F.col("peak_idx")), F.col("idx"), float(block)
    else:
        stamp = points.select(*TRACE, F.col("idx").alias("peak_idx"), F.col("time_s").alias("at"))
        at, x = events.join(stamp, [*TRACE, "peak_idx"]), F.col("time_s")
        s = points.groupBy(*TRACE).agg(F.try_divide(F.max("time_s") - F.min("time_s"), F.count("*")).alias("dt")).agg(F.min("dt")).first()[0]
        width = block * float(s or 0.0)
    found = frames_of_events(at, free.select(*TRACE, x.alias("x"), F.col("intensity").alias("y")), half, width or 1.0)
    joined = events.join(found, [*TRACE, "start_idx"], "left")
    level: Column = F.coalesce("bg_mean" if location == "MEAN" else "bg_median", F.lit(0.0))
    bg = level * F.col("n_points")
    out = joined.withColumn("__bg", F.least(bg, F.col("area")) if clamp else bg)
    return out.select(
        *events.columns,
        F.coalesce("n", F.lit(0)).cast("long").alias("n_bg"),
        F.coalesce("bg_mean", F.lit(0.0)).alias("bg_mean"),
        F.coalesce("bg_median", F.lit(0.0)).alias("bg_median"),
        F.col("__bg").alias("bg_per_event"),
        (F.col("area") - F.col("__bg")).alias("net_area"),
        (F.greatest(F.lit(0.0), F.col("height")) - F.col("__bg") / F.col("n_points")).alias("net_height"),
    )


def realigned(intervals: DataFrame, points: DataFrame, half: float, by: str = "INDEX", location: str = "MEDIAN", clamp: bool = False) -> DataFrame:
    """JOI7: each aligned interval (sample_id, start_idx, end_idx) as an event of every channel of its sample, with peak, area, height and background of that channel's own points anew; no aligned interval is background on any channel."""
    return background_of_events(stored(broadcast_to_channels(intervals, points), "aligned"), points, half, by, location, clamp)
