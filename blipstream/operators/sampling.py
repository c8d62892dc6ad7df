"""SC14: samples of order statistics, evenly spaced and jittered the same way every time."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import numbered

#: The fraction whose multiples spread the jitter evenly.
GOLDEN = 0.6180339887
JITTERS = ("GOLDEN", "HASHED", "MURMUR")


def murmur(k: np.ndarray) -> np.ndarray:
    """MurmurHash3 (x86, 32 bits, seed 0) of whole numbers as four bytes, the highest first; signed."""
    # Fixed values of the hash.
    c1, c2, add, f1, f2 = (np.uint32(x) for x in (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint32(by)) | (x >> np.uint32(32 - by))

    h = turned(turned(k.astype(">u4").view("<u4").astype(np.uint32) * c1, 15) * c2, 13) * np.uint32(5) + add
    h = h ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * f1
    h = (h ^ (h >> np.uint32(13))) * f2
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def offset(i: Column, centre: Column, n: Column, window: int, jitter: str) -> Column:
    """How far the i-th pick lies from its centre among n places."""
    if jitter == "GOLDEN":
        reach = max(1, window)
        return F.floor((i * F.lit(GOLDEN)) % 1 * (2 * reach + 1)) - reach
    if jitter == "HASHED":
        return i % (2 * window + 1) - window

    @F.pandas_udf("long")
    def hashed(k: pd.Series) -> pd.Series:
        return pd.Series(murmur(k.to_numpy(np.uint32)).astype(np.int64))

    low, high = F.least(F.lit(window), centre), F.least(F.lit(window), n - 1 - centre)
    return F.pmod(hashed(i), low + high + 1) - low


def quantile_sample(df: DataFrame, by: list[str], value: str, rows: int, window: int = 2, jitter: str = "GOLDEN") -> DataFrame:
    """(by, nth, value): ``rows`` values of each group, the i-th near place i / (rows - 1) of its sorted values.

    Places are moved by at most ``window``: by multiples of the golden ratio, by i itself (HASHED), or by a hash of it that
    keeps within the ends (MURMUR); the others are cut off at the ends. A group of at most ``rows`` values is kept whole,
    one value is the upper median. Null values don't count. Values are numbered by ranges and picked by an equi-join.
    """
    if jitter not in JITTERS:
        raise ValueError(f"no jitter {jitter!r}")
    ranked = numbered(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v")), [F.col("__v")], "__r", by)
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("__n"))
    n, i = F.col("__n"), F.col("nth")
    picks = sizes.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.least(n, F.lit(rows)) - 1)))
    if rows == 1:
        place = F.floor(n / 2)
    else:
        centre = F.floor(i / F.lit(float(max(1, rows - 1))) * (n - 1) + 0.5)
        place = F.greatest(F.lit(0), F.least(n - 1, centre + offset(i, centre, n, window, jitter)))
    picked = picks.select(*by, "nth", F.when(n <= rows, i).otherwise(place).cast("long").alias("__r"))
    return picked.join(ranked, [*by, "__r"]).select(*by, F.col("nth").cast("int").alias("nth"), F.col("__v").alias(value))
