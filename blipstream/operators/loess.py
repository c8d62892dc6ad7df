"""SEQ12: LOESS, locally weighted straight lines with robust rounds, in blocks of a trace."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .scan import TRACE, numbered

#: Below this a residual's median and a frame's spread count as 0.
ACCURACY = 1e-12
#: Frames up to this width are summed directly, wider ones by Fourier transforms.
DIRECT = 256
#: Rows times width of frames that are evaluated one by one at once.
CELLS = 1 << 20


def tricube(u: np.ndarray) -> np.ndarray:
    return np.where(u < 1, (1 - np.minimum(u, 1) ** 3) ** 3, 0.0)


def sliding_sums(kernel: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of kernel[k] * values[i + k] for every i at which the kernel fits."""
    if len(kernel) <= DIRECT:
        return np.correlate(values, kernel, "valid")
    size = 1 << (len(values) + len(kernel)).bit_length()
    return np.fft.irfft(np.fft.rfft(values, size) * np.conj(np.fft.rfft(kernel, size)), size)[: len(values) - len(kernel) + 1]


def line_at(s0, s1, s2, y0, y1):
    """The value at distance 0 of the weighted line through distances d and values y, from the sums of w, wd, wdd, wy and wdy."""
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_d, mean_y = s1 / s0, y0 / s0
        spread = s2 / s0 - mean_d * mean_d
        slope = np.where(np.sqrt(np.abs(spread)) < ACCURACY, 0.0, (y1 / s0 - mean_d * mean_y) / np.where(spread == 0, 1, spread))
        return mean_y - slope * mean_d


def local_lines(y: np.ndarray, r: np.ndarray, first: int, at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Lines at the places ``at`` of a trace of n points, from the values y and weights r of the places from ``first`` on.

    A frame is the ``width`` points nearest to its place, the earlier ones where that leaves a choice; at the ends of the
    trace it can't be centred. Weights are tricube in the distance by the frame's furthest point.
    """
    out = np.empty(len(at))
    left = np.clip(-((width - 2 * at) // 2), 0, n - width)  # the least start whose frame reaches as far behind as ahead
    centred = left == -((width - 2 * at) // 2)
    if centred.any():
        some = at[centred]
        lo, hi = int(some[0]), int(some[-1])
        d = np.arange(-(width // 2), (width - 1) // 2 + 1)
        kernel = tricube(np.abs(d) / (width // 2))
        a, b = lo + d[0] - first, hi + d[-1] - first + 1
        v, w = y[a:b] * r[a:b], r[a:b]
        out[centred] = line_at(sliding_sums(kernel, w), sliding_sums(kernel * d, w), sliding_sums(kernel * d * d, w), sliding_sums(kernel, v), sliding_sums(kernel * d, v))
    rest = np.flatnonzero(~centred)
    for k in range(0, len(rest), max(1, CELLS // width)):
        rows = rest[k : k + max(1, CELLS // width)]
        cols = left[rows][:, None] + np.arange(width)
        d = cols - at[rows][:, None]
        w = tricube(np.abs(d) / np.maximum(np.abs(d).max(1), 1)[:, None]) * r[cols - first]
        v = w * y[cols - first]
        out[rows] = line_at(w.sum(1), (w * d).sum(1), (w * d * d).sum(1), v.sum(1), (v * d).sum(1))
    return out


def frame_sizes(points: DataFrame, bandwidth: float) -> DataFrame:
    """(trace, __n, __pad, __total, __width): points, mirrored points at each end, their total, and points of a frame; width 0 where a trace is too short to smooth."""
    n = F.col("__n")
    share = F.greatest(F.lit(1e-4), F.greatest(3.0 / n, F.least(F.lit(float(np.nextafter(1.0, 0.0))), F.lit(float(bandwidth)))))
    sizes = points.groupBy(*TRACE).agg(F.count("*").alias("__n")).withColumn("__share", share)
    sizes = sizes.withColumn("__pad", F.greatest(F.lit(0).cast("long"), F.least(n - 2, F.floor(F.col("__share") * n + 0.5)))).withColumn("__total", n + 2 * F.col("__pad"))
    width = F.when(F.col("__share") > 1, 0).otherwise(F.floor(F.col("__share") * F.col("__total")))
    return sizes.select(*TRACE, "__n", "__pad", "__total", width.cast("long").alias("__width"))


def loess(points: DataFrame, bandwidth: float = 0.05, robust: int = 2, block: int = 1 << 16) -> DataFrame:
    """SEQ12: (trace, idx, smooth): at each point the line through the nearest ``bandwidth`` of all points, weighted by tricube distance, at that point.

    Both ends are first lengthened by their mirror image, bandwidth times as many points. After each of ``robust``
    rounds points weigh (1 - (residual / 6 medians)**2)**2 of the residuals, 0 beyond; a trace whose median residual is
    0 is done. Traces of two points or fewer keep their values, and so does a point whose whole frame weighs nothing. A
    frame has at least three points. Points of a trace are numbered without gaps.

    Blocks of the index and half a frame to each side are one task each; sums over frames are correlations, so the work
    doesn't grow with the width but at the very ends of a trace (a frame each for half a frame of places). The median
    residual is found by ranges. Each round is written once.
    """
    sizes = stored(frame_sizes(points, bandwidth), "loess-sizes")
    rows = points.select(*TRACE, "idx", F.col("intensity").cast("double").alias("__y")).join(sizes, TRACE)
    i, n, pad = F.col("idx"), F.col("__n"), F.col("__pad")
    places = F.array(i + pad, F.when(i.between(1, pad), pad - i), F.when(i.between(n - 1 - pad, n - 2), pad + 2 * (n - 1) - i))
    lengthened = rows.where("__width > 0").select(*TRACE, "__total", "__width", "__y", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("__at"))
    state = lengthened.withColumn("__r", F.lit(1.0))
    schema = "sample_id string, channel string, __at long, __total long, __width long, __y double, __r double, __smooth double"

    def of_block(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__at")
        at, y, r = part["__at"].to_numpy(), part["__y"].to_numpy(), part["__r"].to_numpy()
        total, width = int(part["__total"].iloc[0]), int(part["__width"].iloc[0])
        own = part["__own"].to_numpy() == key[-1]
        line = local_lines(y, r, int(at[0]), at[own], total, width)
        line = np.where(np.isfinite(line), line, y[own])
        n = len(line)
        return pd.DataFrame({"sample_id": np.full(n, key[0], object), "channel": np.full(n, key[1], object), "__at": at[own], "__total": total, "__width": width, "__y": y[own], "__r": r[own], "__smooth": line})

    for round_ in range(robust + 1):
        # A frame at an end reaches a whole width from its place.
        size, reach = F.greatest(F.lit(block), F.col("__width")), F.col("__width")
        near = state.withColumn("__own", F.floor(F.col("__at") / size)).withColumn("__block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("__at") - reach) / size)), F.least(F.floor((F.col("__total") - 1) / size), F.floor((F.col("__at") + reach) / size)))))
        made = stored(near.groupBy(*TRACE, "__block").applyInPandas(of_block, schema), "loess-round")
        if round_ == robust:
            break
        away = made.select(*TRACE, "__total", F.abs(F.col("__y") - F.col("__smooth")).alias("__e"))
        middle = numbered(away, [F.col("__e")], "__rank", TRACE).where(F.col("__rank") == F.floor(F.col("__total") / 2)).select(*TRACE, F.col("__e").alias("__m"))
        u = F.try_divide(F.abs(F.col("__y") - F.col("__smooth")), 6 * F.col("__m"))
        weight = F.when(F.col("__m") < ACCURACY, F.col("__r")).when(u >= 1, 0.0).otherwise((1 - u * u) * (1 - u * u))
        state = stored(made.join(middle, TRACE).select(*TRACE, "__at", "__total", "__width", "__y", weight.alias("__r")), "loess-weights")
    done = made.select(*TRACE, "__at", "__smooth").join(sizes, TRACE).where(F.col("__at").between(pad, pad + n - 1)).select(*TRACE, (F.col("__at") - pad).cast("int").alias("idx"), F.col("__smooth").alias("smooth"))
    return done.unionByName(rows.where("__width = 0").select(*TRACE, F.col("idx").cast("int").alias("idx"), F.col("__y").alias("smooth")))
