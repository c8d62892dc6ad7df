"""MOD11: the earth mover's distance of two samples against that of random samples of their pool."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blipstream.functions.distributions import normal_tail

from ..plans.stored import stored
from .models import p_column
from .scan import numbered, running_sum

#: Blocks of the sorted pool are as large as keeps their number below this.
MOST_BLOCKS = 1 << 16
HOW = ("BOOTSTRAP", "PERMUTATION")


def draw(rng: np.random.Generator, sizes: np.ndarray, n: int, how: str) -> np.ndarray:
    """How many of n draws from a pool fall on each of its parts: with replacement, or without."""
    if how == "BOOTSTRAP":
        return rng.multinomial(n, sizes / sizes.sum())
    left, pool, out = n, int(sizes.sum()), np.zeros(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):  # one part after the other, each given what the ones before took
        out[k] = rng.hypergeometric(size, pool - size, left) if 0 < left < pool else left and size
        left, pool = left - int(out[k]), pool - size
    return out


def dealt(replicates: int, seed: int, total: int, block: int, na: int, nb: int, how: str, spark) -> DataFrame:
    """(rep, block, xa, xb, ahead_a, ahead_b): of each replicate, how many values of both samples come from a block of the pool, and from all before it."""
    sizes = np.full(-(-total // block), block, np.int64)
    sizes[-1] = total - block * (len(sizes) - 1)

    def run(batches):
        for batch in batches:
            for rep in batch["id"]:
                rng = np.random.default_rng([seed, int(rep)])
                a = draw(rng, sizes, na, how)
                b = draw(rng, sizes, nb, how) if how == "BOOTSTRAP" else sizes - a
                yield pd.DataFrame({"rep": int(rep), "block": np.arange(len(sizes)), "xa": a, "xb": b, "ahead_a": np.cumsum(a) - a, "ahead_b": np.cumsum(b) - b})

    return spark.range(1, replicates + 1).mapInPandas(run, "rep long, block long, xa long, xb long, ahead_a long, ahead_b long")


def emd_permutation(df: DataFrame, group: str, a: str, b: str, value: str, replicates: int = 1000, how: str = "BOOTSTRAP", seed: int = 1, block: int = 1 << 14) -> DataFrame:
    """One row: emd, mean and SD of the replicates' log10 emd, z, p (normal, two-sided) and p_rank (share of replicates, the samples themselves among them, at least as far apart).

    emd is the area between the two distribution functions by the furthest reach of one sample from the other's nearest
    end. A replicate draws samples of the same sizes from the pool: with replacement (BOOTSTRAP) or by splitting it
    (PERMUTATION). p is null where the replicates don't vary or the samples are equal; p_rank holds always. Null values
    don't count; an empty sample gives no row.

    The pool is numbered by ranges and cut into blocks. How many values of a replicate come from each block is drawn
    first, a replicate in one draw; then each block draws its own and sums the area within it. Only one row for each
    replicate and block is shuffled, never a row for each replicate and value; the numbers depend on ``seed`` alone.
    PERMUTATION takes pools of less than 1e9 values.
    """
    if how not in HOW:
        raise ValueError(f"no way to draw {how!r}")
    spark = df.sparkSession
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select((F.col(group) == a).cast("int").alias("is_a"), F.col(value).cast("double").alias("v"))
    pool = stored(numbered(rows, [F.col("v"), F.col("is_a")], "idx").withColumn("all", F.lit(1)), "pool")
    n = pool.agg(F.count("*").alias("n"), F.coalesce(F.sum("is_a"), F.lit(0)).alias("a")).first()
    total, na, nb = n["n"], n["a"], n["n"] - n["a"]
    schema = "rep long, area double, lo_a double, hi_a double, lo_b double, hi_b double"
    if not na or not nb:
        return spark.createDataFrame([], "emd double, mean_log double, sd_log double, z double, p double, p_rank double")
    if how == "PERMUTATION" and total >= 10**9:
        raise ValueError("too large a pool to split: take BOOTSTRAP")
    block = max(block, -(-total // MOST_BLOCKS))
    observed = pool.groupBy(F.floor(F.col("idx") / block).alias("block")).agg(F.sum("is_a").alias("xa"), F.sum(1 - F.col("is_a")).alias("xb"))
    ahead = running_sum(running_sum(observed.withColumn("all", F.lit(1)), F.col("xa"), "sa", ["all"], "block"), F.col("xb"), "sb", ["all"], "block")
    # Replicate 0 is the samples themselves.
    own = ahead.select(F.lit(0).cast("long").alias("rep"), "block", "xa", "xb", (F.col("sa") - F.col("xa")).alias("ahead_a"), (F.col("sb") - F.col("xb")).alias("ahead_b"))

    def of_block(key: tuple, values: pd.DataFrame, reps: pd.DataFrame) -> pd.DataFrame:
        values = values.sort_values("idx")
        mine = (values["idx"] // block == key[0]).to_numpy()
        v, truth = values["v"].to_numpy(), values["is_a"].to_numpy()[mine]
        size = int(mine.sum())
        gaps = np.diff(v) if len(v) > size else np.append(np.diff(v), 0.0)
        out = []
        for rep, xa, xb, ahead_a, ahead_b in reps.sort_values("rep")[["rep", "xa", "xb", "ahead_a", "ahead_b"]].itertuples(index=False):
            rng = np.random.default_rng([seed, int(rep), int(key[0]) + 1])
            if rep == 0:
                ca, cb = truth, 1 - truth
            elif how == "BOOTSTRAP":
                ca, cb = (np.bincount(rng.integers(0, size, x), minlength=size) for x in (xa, xb))
            else:
                ca = np.zeros(size, np.int64)
                ca[rng.permutation(size)[:xa]] = 1
                cb = 1 - ca
            apart = np.abs((ahead_a + np.cumsum(ca)) / na - (ahead_b + np.cumsum(cb)) / nb)
            ends = [(np.nan, np.nan) if not len(at) else (v[at[0]], v[at[-1]]) for at in (np.flatnonzero(ca), np.flatnonzero(cb))]
            out.append((rep, float(apart @ gaps), *ends[0], *ends[1]))
        return pd.DataFrame(out, columns=["rep", "area", "lo_a", "hi_a", "lo_b", "hi_b"])

    # A block also gets the value after its last one: the area between them is its own.
    near = pool.withColumn("__block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("idx") - 1) / block)), F.floor(F.col("idx") / block))))
    every = dealt(replicates, seed, total, block, na, nb, how, spark).unionByName(own)
    parts = near.groupBy("__block").cogroup(every.groupBy("block")).applyInPandas(of_block, schema)

    def known(c: str):
        return F.nanvl(c, F.lit(None).cast("double"))

    whole = parts.groupBy("rep").agg(F.sum("area").alias("area"), *(f(known(c)).alias(c) for f, c in ((F.min, "lo_a"), (F.max, "hi_a"), (F.min, "lo_b"), (F.max, "hi_b"))))
    reach = F.greatest(F.abs(F.col("hi_a") - F.col("lo_b")), F.abs(F.col("hi_b") - F.col("lo_a")))
    emds = stored(whole.select("rep", F.coalesce(F.try_divide(F.col("area"), reach), F.lit(0.0)).alias("emd")), "emd-replicates")
    first = emds.where("rep = 0").select(F.col("emd").alias("emd"))
    seen = first.first()["emd"]
    log = F.log10(F.when((F.col("rep") > 0) & (F.col("emd") > 0), F.col("emd")))
    s = emds.agg(F.avg(log).alias("mean_log"), F.stddev_samp(log).alias("sd_log"), (F.sum((F.col("emd") >= seen - 1e-12 * abs(seen)).cast("long")) / (replicates + 1)).alias("p_rank"))
    z = F.abs(F.try_divide(F.lit(math.log10(seen)) - F.col("mean_log"), F.col("sd_log"))) if seen > 0 else F.lit(None).cast("double")
    return s.select(F.lit(seen).alias("emd"), "mean_log", "sd_log", z.alias("z"), "p_rank").select("emd", "mean_log", "sd_log", "z", p_column(lambda x: 2 * normal_tail(x), F.col("z")).alias("p"), "p_rank")
