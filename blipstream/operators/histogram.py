"""Histograms, their widths and what is read off them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import legacy_percentiles

MOST_BINS = 10_000


def widths(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """HIS1: bin widths by rule, from one aggregation and the legacy quartiles."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("skew"))
    s = s.join(legacy_percentiles(df, by, value, {"q1": 0.25, "q3": 0.75}), by)
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    doane = 1 + F.log2(n) + F.log2(1 + F.abs(F.col("skew")) / F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3))))
    rules = {
        "terrell_scott": span / F.ceil(F.cbrt(2 * n)),
        "doane": span / F.ceil(doane),
        "rice": span / F.ceil(2 * F.cbrt(n)),
        "root": span / F.ceil(F.sqrt(n)),
        "sturges": span / (F.ceil(F.log2(n)) + 1),
        "freedman_diaconis": 2 * (F.col("q3") - F.col("q1")) / F.cbrt(n),
        "scott": 3.49 * F.col("sd") / F.cbrt(n),
    }
    return s.select(*by, "n", "lo", "hi", *[w.alias(k) for k, w in rules.items()])


def shimazaki(df: DataFrame, by: list[str], value: str, bins: list[int]) -> DataFrame:
    """HIS1, Shimazaki-Shinomoto: of the given bin counts the one with the least (2 * mean - variance) / width**2; its width."""
    limits_ = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    tries = df.join(limits_, by).where("__hi > __lo").withColumn("k", F.explode(F.array(*map(F.lit, bins)))).withColumn("w", (F.col("__hi") - F.col("__lo")) / F.col("k"))
    counts = tries.groupBy(*by, "k", "w", F.least(F.col("k") - 1, F.floor((F.col(value) - F.col("__lo")) / F.col("w"))).alias("b")).agg(F.count("*").alias("c"))
    total, squares = F.sum("c"), F.sum(F.col("c") * F.col("c"))
    cost = counts.groupBy(*by, "k", "w").agg(total.alias("__t"), squares.alias("__s")).withColumn("__mean", F.col("__t") / F.col("k"))
    cost = cost.withColumn("cost", (2 * F.col("__mean") - (F.col("__s") / F.col("k") - F.col("__mean") * F.col("__mean"))) / (F.col("w") * F.col("w")))
    best = Window.partitionBy(*by).orderBy("cost", "k")
    return cost.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*by, "k", "w", "cost")


def histogram(df: DataFrame, by: list[str], value: str, width: float, most_bins: int = MOST_BINS) -> DataFrame:
    """HIS2 to HIS4: counts on bins that all groups share, with relative frequency, density and the running share.

    There are at most ``most_bins`` bins, of the width given: where the values reach further, the last bin holds the rest.
    """
    b = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")).withColumn("__n", F.greatest(F.lit(1), F.least(F.lit(most_bins), F.ceil((F.col("__hi") - F.col("__lo")) / width))))
    binned = df.crossJoin(F.broadcast(b)).withColumn("bin", F.least(F.col("__n") - 1, F.floor((F.col(value) - F.col("__lo")) / width)).cast("int"))  # one row
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), (F.first("__lo") + (F.col("bin") + 0.5) * width).alias("centre"))
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    return counts.withColumn("relative", F.col("n") / F.sum("n").over(whole)).withColumn("density", F.col("relative") / width).withColumn("cdf", F.sum("n").over(upto) / F.sum("n").over(whole))


def otsu(hist: DataFrame, by: list[str]) -> DataFrame:
    """FIL8: the bin centre that maximises wB * wF * (mB - mF)**2; the first maximum wins. The window holds bins, not rows."""
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin")
    x = F.col("n") * F.col("centre")
    s = hist.withColumn("__w", F.sum("n").over(upto)).withColumn("__t", F.sum("n").over(whole)).withColumn("__x", F.sum(x).over(upto)).withColumn("__xt", F.sum(x).over(whole))
    wf = F.col("__t") - F.col("__w")
    between = F.col("__w") * wf * F.pow(F.col("__x") / F.col("__w") - (F.col("__xt") - F.col("__x")) / F.when(wf > 0, wf), F.lit(2))
    return s.withColumn("between", between).where("between is not null").groupBy(*by).agg(F.max_by("centre", F.struct(F.round("between", 3), -F.col("bin"))).alias("otsu"))


def change_point(hist: DataFrame, by: list[str], width: int = 3) -> DataFrame:
    """FIL9: centre of the first bin whose mean over the next ``width`` bins exceeds that of the ``width`` before."""
    w = Window.partitionBy(*by).orderBy("bin")
    s = hist.withColumn("__b", F.avg("n").over(w.rowsBetween(-width, -1))).withColumn("__f", F.avg("n").over(w.rowsBetween(0, width - 1)))
    return s.where("__f > __b").groupBy(*by).agg(F.min_by("centre", "bin").alias("change_point"))


def log_change(hist: DataFrame, by: list[str]) -> DataFrame:
    """MOD14: the centre with the steepest rise of log10 counts from one bin to the next."""
    w = Window.partitionBy(*by).orderBy("bin")
    s = hist.withColumn("__d", F.log10("n") - F.lag(F.log10("n")).over(w)).where("__d is not null")
    return s.groupBy(*by).agg(F.max_by("centre", F.struct(F.round("__d", 9), -F.col("bin"))).alias("log_change"), F.max(F.round("__d", 9)).alias("rise"))


def box_plot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AGG22: mean, legacy quartiles and whiskers at the furthest values within 1.5 IQR."""
    q = legacy_percentiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = df.join(q, by)
    lo = F.min(F.when(F.col(value) >= F.col("q1") - 1.5 * iqr, F.col(value)))
    hi = F.max(F.when(F.col(value) <= F.col("q3") + 1.5 * iqr, F.col(value)))
    return inside.groupBy(*by).agg(F.avg(value).alias("mean"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"), lo.alias("whisker_lo"), hi.alias("whisker_hi"))


def kernel_density(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """AGG29: Gaussian kernel with Silverman's width on a fixed grid; each row adds to every grid point, summed map-side. Null where the values have no spread, as there is no width then."""
    n = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).withColumn("h", 1.06 * F.col("sd") * F.pow("n", F.lit(-0.2)))
    rows = df.crossJoin(F.broadcast(n)).withColumn("x", F.explode(F.array(*map(F.lit, grid))))  # one row
    u = F.try_divide(F.col("x") - F.col(value), F.col("h"))
    return rows.groupBy("x").agg(F.try_divide(F.sum(F.exp(-u * u / 2)), F.first("n") * F.first("h") * F.lit((2 * 3.141592653589793) ** 0.5)).alias("density"))


def math_transform(x: Column, kind: str) -> Column:
    """PRJ2: identity, cube root, or log10 with the logarithm of the least double for what isn't positive."""
    if kind == "cbrt":
        return F.cbrt(x)
    return F.when(x > 0, F.log10(x)).otherwise(-323.3062153431158) if kind == "log10" else x
