"""Regressions, test statistics, clustering and similarity."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blipstream.functions.distributions import chi2_tail, f_tail, ks_p, normal_tail, t_tail

from ..plans.stored import stored
from .align import rank_average
from .scan import neighbours, numbered, running_sum


def ols(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """MOD1: slope, intercept and R squared; a single point is joined by the origin (null slope if it stands at x = 0)."""
    s = df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.first(x).alias("__x"), F.first(y).alias("__y"))
    one = F.col("n") == 1
    return s.select(*by, "n", F.when(one, F.try_divide(F.col("__y"), F.col("__x"))).otherwise(F.col("slope")).alias("slope"), F.when(one, 0.0).otherwise(F.col("intercept")).alias("intercept"), "r2")


def wls(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """MOD2: weights 1 / y, or y where any y of the group is 0; closed form from weighted sums. Null where all x are equal or the weights add up to 0."""
    zero = df.groupBy(*by).agg(F.max((F.col(y) == 0).cast("int")).alias("__zero"))
    w = F.when(F.col("__zero") == 1, F.col(y)).otherwise(F.try_divide(F.lit(1.0), F.col(y)))
    s = df.join(zero, by).withColumn("__w", w).groupBy(*by).agg(*[F.sum(e).alias(k) for k, e in (("sw", F.col("__w")), ("sx", F.col("__w") * F.col(x)), ("sy", F.col("__w") * F.col(y)), ("sxx", F.col("__w") * F.col(x) * F.col(x)), ("sxy", F.col("__w") * F.col(x) * F.col(y)))])
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"))
    return s.withColumn("slope", slope).withColumn("intercept", F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("sw"))).select(*by, "slope", "intercept")


def slope_only(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """MOD3: least squares through the origin; null where all x are 0."""
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))).alias("slope"))


def collapse_x(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """MOD4: one row per x (to eight digits) with the mean of y."""
    return df.groupBy(*by, F.round(x, 8).alias(x)).agg(F.avg(y).alias(y), F.count("*").alias("n"))


def p_column(function: Callable[..., float], *columns: Column) -> Column:
    """A special function of one row of results (a test has one), as an Arrow batch function; null without all arguments."""

    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else function(*row) for row in zip(*values, strict=True)], dtype="float64")

    return run(*columns)


def value_counts(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """One row per distinct value: how many of each sample have it (ca, cb) and how many at most it (sa, sb); numbered by ranges and summed by blocks."""
    counts = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum((F.col(group) == a).cast("long")).alias("ca"), F.sum((F.col(group) == b).cast("long")).alias("cb"))
    at = numbered(counts, [F.col("v")], "idx").withColumn("all", F.lit(1))
    return stored(running_sum(running_sum(at, F.col("ca"), "sa", ["all"]), F.col("cb"), "sb", ["all"]), "value-counts")


def two_samples(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """MOD11, MOD12: Kolmogorov-Smirnov distance, Mann-Whitney U, Welch t, Brunner-Munzel W and the earth mover's distance of two groups, each test with its p.

    p of U is the normal one without corrections; a test without spread has null p.
    """
    c = value_counts(df, group, a, b, value)
    moments = [f(F.when(F.col(group) == g, F.col(value))).alias(k) for k, f, g in (("ma", F.avg, a), ("mb", F.avg, b), ("va", F.var_samp, a), ("vb", F.var_samp, b))]
    base = c.agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    n = base.first()
    na, nb = float(n["na"] or 0), float(n["nb"] or 0)
    if not na or not nb:
        raise ValueError(f"no values of {a!r} or {b!r}")
    less_a, less_b = max(na - 1, 1.0), max(nb - 1, 1.0)
    m = df.where(F.col(group).isin(a, b)).agg(*moments).first()
    ahead = neighbours(c, "v", "next", 1, ["all"])
    d = F.abs(F.col("sa") / na - F.col("sb") / nb)
    rank = F.col("sa") + F.col("sb") - (F.col("ca") + F.col("cb") - 1) / 2
    below_a, below_b = (F.col("sb") - F.col("cb") / 2) / nb, (F.col("sa") - F.col("ca") / 2) / na
    s = ahead.agg(
        F.max(d).alias("ks"),
        F.sum(d * F.coalesce(F.col("next") - F.col("v"), F.lit(0.0))).alias("emd"),
        (F.sum(F.col("ca") * rank) - na * (na + 1) / 2).alias("u"),
        *[F.sum(F.col(w) * f).alias(k) for k, w, f in (("p1", "ca", below_a), ("p2", "ca", below_a * below_a), ("q1", "cb", below_b), ("q2", "cb", below_b * below_b))],
    )
    va, vb = (F.lit(m[k]).cast("double") / x for k, x in (("va", na), ("vb", nb)))
    t, t_dof = F.try_divide(F.lit(m["ma"]).cast("double") - F.lit(m["mb"]).cast("double"), F.sqrt(va + vb)), F.try_divide((va + vb) * (va + vb), va * va / less_a + vb * vb / less_b)
    sx, sy = ((F.col(f"{k}2") - F.col(f"{k}1") * F.col(f"{k}1") / x) / less / x for k, x, less in (("p", na, less_a), ("q", nb, less_b)))
    w, w_dof = F.try_divide(F.col("p1") / na - 0.5, F.sqrt(sx + sy)), F.try_divide((sx + sy) * (sx + sy), sx * sx / less_a + sy * sy / less_b)
    u_z = (F.least(F.col("u"), na * nb - F.col("u")) - na * nb / 2) / F.sqrt(F.lit(na * nb * (na + nb + 1) / 12))
    return s.select("ks", "emd", "u", t.alias("t"), t_dof.alias("t_dof"), F.when(sx + sy > 0, w).alias("w"), F.when(sx + sy > 0, w_dof).alias("w_dof"), u_z.alias("u_z")).select(
        "ks",
        p_column(lambda x: ks_p(x, int(na), int(nb)), F.col("ks")).alias("ks_p"),
        "emd",
        "u",
        p_column(lambda z: 2 * normal_tail(-z), F.col("u_z")).alias("u_p"),
        "t",
        p_column(t_tail, F.col("t"), F.col("t_dof")).alias("t_p"),
        "w",
        p_column(t_tail, F.col("w"), F.col("w_dof")).alias("w_p"),
    )


def wilcoxon(df: DataFrame, group: str, a: str, b: str, value: str, order: str, thin: Column | None = None) -> DataFrame:
    """MOD11: signed ranks of the differences of two samples paired in ``order``: n, w (the larger rank sum) and the normal p with continuity.

    Unequal samples are thinned to the smaller one's size without replacement, by the smallest MD5 of order unless
    ``thin`` says otherwise, so reruns agree.
    """
    thin = F.md5(F.col(order).cast("string")) if thin is None else thin
    both = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(value).alias("x"), thin.alias("m"))
    sizes = {r["g"]: r["count"] for r in both.groupBy("g").count().collect()}  # two rows
    least = min(sizes.get(a, 0), sizes.get(b, 0))
    kept = numbered(both, [F.col("m"), F.col("o")], "nth", ["g"]).where(F.col("nth") < least)
    placed = numbered(kept, [F.col("o"), F.col("m")], "pair", ["g"])
    one, two = (placed.where(F.col("g") == g).select("pair", F.col("x").alias(k)) for g, k in ((a, "xa"), (b, "xb")))
    gaps = stored(one.join(two, "pair").select(F.abs(F.col("xb") - F.col("xa")).alias("gap"), (F.col("xb") > F.col("xa")).alias("up")), "pairs")
    s = rank_average(gaps, "gap").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("up"), F.col("rank"))), F.lit(0.0)).alias("plus"))
    total = F.col("n") * (F.col("n") + 1) / 2
    w = F.greatest(F.col("plus"), total - F.col("plus"))
    z = (total - w - total / 2 - 0.5) / F.sqrt(total / 2 * (2 * F.col("n") + 1) / 6)
    return s.select("n", w.alias("w"), z.alias("z")).select("n", "w", p_column(lambda x: 2 * normal_tail(-x), F.col("z")).alias("p"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """MOD11: H with tie correction, in doubles, and its p; both null where all values are equal."""
    ranked = stored(rank_average(df.select(group, value), value), "ranks")
    n = ranked.count() * 1.0
    per = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    ties = df.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t"))).first()[0] or 0.0
    untied = F.lit(float(1 - ties / (n * n * n - n) if n > 1 else 0))
    h = per.agg(F.try_divide(F.lit(12 / (n * (n + 1)) if n else 0.0) * F.sum(F.col("r") * F.col("r") / F.col("k")) - 3 * (n + 1), untied).alias("h"), F.count("*").alias("groups"))
    return h.select("h", p_column(lambda x, k: chi2_tail(x, k - 1), F.col("h"), F.col("groups")).alias("p"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """MOD11: one-way F from group counts, means and variances, and its p; both null for one group or without spread within groups."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    between = F.try_divide(F.col("q") - F.try_divide(F.col("t") * F.col("t"), F.col("N")), F.col("k") - 1)
    f = F.try_divide(between, F.try_divide(F.col("w"), F.col("N") - F.col("k")))
    return s.select(f.alias("f"), "k", "N").select("f", p_column(lambda x, k, n: f_tail(x, k - 1, n - k), F.col("f"), F.col("k"), F.col("N")).alias("p"))


def stars(p: Column) -> Column:
    """SC22."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def cosine(a: Column, b: Column) -> Column:
    """SC18; null where a vector is all zeros."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def z_scores(matrix: DataFrame, by: list[str], value: str) -> DataFrame:
    """MOD6: shared shift to positive values, log2, z-score within by; 0 where all values are equal, null for a single value."""
    low = matrix.agg(F.min(value).alias("__low"))
    logs = matrix.crossJoin(F.broadcast(low)).withColumn("__x", F.log2(F.col(value) - F.col("__low") + 1))  # one row
    s = logs.groupBy(*by).agg(F.avg("__x").alias("__m"), F.stddev_samp("__x").alias("__s"))
    return logs.join(s, by).withColumn("z", F.when(F.col("__s") == 0, 0.0).otherwise(F.try_divide(F.col("__x") - F.col("__m"), F.col("__s")))).drop("__low", "__x", "__m", "__s")


def composition(spectra: DataFrame) -> DataFrame:
    """AGG21: mean per cluster and element, negatives to 0, in percent of the cluster."""
    m = spectra.groupBy("cluster", "element").agg(F.greatest(F.lit(0.0), F.avg("intensity")).alias("m"))
    total = F.sum("m").over(Window.partitionBy("cluster"))
    return m.select("cluster", "element", F.when(total > 0, 100 * F.col("m") / total).otherwise(0.0).alias("percent"))


def ward_distances(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray) -> np.ndarray:
    """Ward's distance between clusters, from centroids and sizes; the same from either side."""
    square = (one * one).sum(1)[:, None] + (two * two).sum(1)[None] - 2 * one @ two.T
    return np.sqrt(np.maximum(0, square) * (2 * (n_one[:, None] * n_two[None]) / (n_one[:, None] + n_two[None])))


def ward_nearest(x: np.ndarray, n: np.ndarray, ids: np.ndarray, mine: np.ndarray, asks: np.ndarray, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(distance, id) of the nearest of each cluster among the pairs in which one asks, infinite where there is none.

    Where clusters are of two blocks, pairs are those across. Ties go to the smaller id. Each pair is evaluated once, tile by
    tile, so both sides see one distance and memory doesn't grow with the square of the clusters.
    """
    best, other = np.full(len(ids), np.inf), np.full(len(ids), np.iinfo(np.int64).max)

    def better(at: np.ndarray, d: np.ndarray, to: np.ndarray) -> None:
        won = (d < best[at]) | ((d == best[at]) & (to < other[at]) & np.isfinite(d))
        best[at[won]], other[at[won]] = d[won], to[won]

    def meet(one: np.ndarray, two: np.ndarray) -> None:
        if len(one) and len(two):
            d = ward_distances(x[one], n[one], x[two], n[two])
            if one is two:
                d = np.minimum(d, d.T)
                np.fill_diagonal(d, np.inf)
            else:
                at = d.argmin(0)
                better(two, d[at, np.arange(len(two))], ids[one][at])
            at = d.argmin(1)
            better(one, d[np.arange(len(one)), at], ids[two][at])

    order = np.argsort(ids)  # the first least of a row is that of the smallest id
    groups = [order[mine[order] == m] for m in np.unique(mine)]
    asking, known = ([[g[k : k + tile] for k in range(0, len(g), tile)] for g in (g[asks[g] == wanted] for g in groups)] for wanted in (True, False))
    for i in range(len(groups)):
        j = i if len(groups) == 1 else 1 - i
        for k, one in enumerate(asking[i]):
            for two in [*(asking[j][k:] if i == j else asking[j] if i < j else []), *known[j]]:
                meet(one, two)
    return best, other


def ward_blocks(groups: int, cells: int) -> int:
    """The fewest blocks a group that give so many cells (pairs of blocks, each with itself too) over all groups."""
    return next(b for b in range(1, cells + 1) if groups * b * (b + 1) >= 2 * cells)


def ward(rows: DataFrame, by: list[str], vector: str, most_rows: int = 1000, block_rows: int = 50_000, least_cells: int = 48) -> DataFrame:
    """MOD7: merge heights of Ward linkage per group: (by, merge, height), lowest first.

    While a group has over ``most_rows`` clusters, a round on Spark finds the nearest neighbour of each, in cells of two
    blocks, and merges all pairs that are each other's nearest, which Ward's distance allows in any order. A merged cluster
    is never nearer to others than the nearer of its parts was, so only merged clusters, and those whose nearest was merged,
    ask anew. What is left of a group is finished in one task by nearest-neighbour chains. Ties go to the smaller numbers of
    a pair. Groups must not be null.

    Comparisons grow with the square of a group. A cluster is sent once per block of its group and round. Blocks are as many
    as give ``least_cells`` cells over all large groups, so what is shuffled grows with the rows; only where they would hold
    over ``block_rows`` clusters there are more of them, which keeps the memory of a task. Rounds follow from how many pairs are each other's
    nearest: of points in general a third or so merge at once, but points that grow apart one by one (1.06**i) merge a pair
    or two a round.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    unknown = {"other": F.lit(None).cast("long"), "d": F.lit(None).cast("double")}
    nodes = stored(rows.select(*by, F.monotonically_increasing_id().alias("id"), F.lit(1.0).alias("n"), F.col(vector).cast("array<double>").alias("c")).withColumns(unknown), "ward")
    heights = None

    def nearest(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        was, mine = part["d"].to_numpy(float, na_value=np.inf), part["mine"].to_numpy()
        asks = part["other"].isna().to_numpy() & (key[-2] == key[-1] or mine.min() < mine.max())
        d, other = ward_nearest(np.stack(part["c"].to_numpy()), part["n"].to_numpy(), part["id"].to_numpy(), mine, asks)
        found = pd.DataFrame({**dict(zip(by, key, strict=False)), "id": part["id"], "other": other, "d": d})
        return found[np.isfinite(d) & (d <= was)]

    while True:
        large = stored(nodes.groupBy(*by).count().where(F.col("count") > most_rows), "ward-large")
        groups = large.count()
        if groups == 0:
            break
        large = large.select(*by, F.greatest(F.lit(ward_blocks(groups, least_cells)), F.ceil(F.col("count") / block_rows)).alias("blocks"))
        dealt = nodes.join(large, by).withColumn("mine", F.pmod(F.xxhash64("id"), "blocks")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = dealt.withColumn("i", F.least("mine", "met")).withColumn("j", F.greatest("mine", "met")).select(*by, "i", "j", "id", "n", "c", "mine", "other", "d")
        found = cells.groupBy(*by, "i", "j").applyInPandas(nearest, f"{keys}, id long, other long, d double")
        every = found.unionByName(nodes.where("other is not null").join(large, by, "left_semi").select(*by, "id", "other", "d"))
        best = stored(every.groupBy(*by, "id").agg(F.min(F.struct("d", "other")).alias("b")).select(*by, "id", "b.other", "b.d"), "ward-nearest")
        back = best.select(*by, F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = stored(best.where("id < other").join(back, [*by, "id", "other"]), "ward-pairs")
        if pairs.isEmpty():
            # Rounding may differ between rounds and leave like distances in a ring; when all ask at once it can't.
            nodes = nodes.withColumns(unknown)
            continue
        into = pairs.select(*by, F.explode(F.array("id", "other")).alias("__id"), F.col("id").alias("into")).withColumnRenamed("__id", "id")
        gone = into.select(*by, F.col("id").alias("other"), F.lit(True).alias("lost"))
        now = best.join(into, [*by, "id"], "left").join(gone, [*by, "other"], "left")
        kept = now.where("into is null").select(*by, "id", *(F.when(F.col("lost").isNull(), F.col(c)).alias(c) for c in unknown))
        stay = nodes.drop("other", "d").join(kept, [*by, "id"])
        small = nodes.join(large, by, "left_anti")
        one, two = F.col("two")[0], F.col("two")[1]
        total = one["n"] + two["n"]
        centre = F.transform(F.arrays_zip(one["c"].alias("x"), two["c"].alias("y")), lambda z: (z["x"] * one["n"] + z["y"] * two["n"]) / total)
        both = nodes.join(into, [*by, "id"]).groupBy(*by, "into").agg(F.sort_array(F.collect_list(F.struct("id", "n", "c"))).alias("two"))
        merged = both.select(*by, F.col("into").alias("id"), total.alias("n"), centre.alias("c")).withColumns(unknown)
        nodes = stored(stay.unionByName(merged).unionByName(small), "ward")
        level = pairs.select(*by, F.col("d").alias("height"))
        heights = level if heights is None else heights.unionByName(level)

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, sizes = np.stack(part["c"].to_numpy()), part["n"].to_numpy().copy()
        alive, d = np.ones(len(x), bool), ward_distances(x, sizes, x, sizes)
        np.fill_diagonal(d, np.inf)
        found, chain = [], []
        while alive.sum() > 1:
            if not chain:
                chain = [int(np.flatnonzero(alive)[0])]
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b, chain = chain[-2], chain[:-2]
                found.append(d[a, b])
                n = sizes[a] + sizes[b] + sizes
                new = np.sqrt(np.maximum(0, ((sizes[a] + sizes) * d[a] ** 2 + (sizes[b] + sizes) * d[b] ** 2 - sizes * d[a, b] ** 2) / n))
                alive[a], sizes[b] = False, sizes[a] + sizes[b]
                new[~alive], new[b] = np.inf, np.inf
                d[a], d[:, a] = np.inf, np.inf
                d[b], d[:, b] = new, new
            else:
                chain.append(b)
        return pd.DataFrame([[*key, h] for h in found], columns=[*by, "height"])

    last = nodes.select(*by, "n", "c").groupBy(*by).applyInPandas(finish, f"{keys}, height double")
    every = last if heights is None else heights.unionByName(last)
    return numbered(every, [F.col("height")], "merge", by).select(*by, F.col("merge").cast("int").alias("merge"), "height")


def cut_heights(heights: DataFrame, by: list[str], top: int = 100) -> DataFrame:
    """MOD8: suggested cuts of a group's merges (numbered from 0, lowest first): half, largest_step and elbow.

    half is half the greatest height. largest_step lies in the middle of the largest step between neighbouring heights, of
    equal steps the lowest; it is 0.9 heights where there is one merge only. elbow is the height furthest below the chord
    of the ``top`` highest, drawn from the highest at (0, 1) to the lowest of them at (1, share of the highest); of equally
    far ones the highest, the lowest of them where there are two or fewer, 0.9 heights of a single merge, and the least
    height where all are 0. Only the ``top`` highest merges of a group meet; steps come by an equi-join on the number.
    """
    s = heights.groupBy(*by).agg(F.count("*").alias("__n"), F.max("height").alias("__max"), F.min("height").alias("__min"))
    after = heights.select(*by, (F.col("merge") - 1).alias("merge"), F.col("height").alias("__next"))
    gap = F.round(F.col("__next") - F.col("height"), 9)
    steps = heights.join(after, [*by, "merge"]).groupBy(*by).agg(F.max_by((F.col("height") + F.col("__next")) / 2, F.struct(gap, -F.col("merge"))).alias("__step"))
    k = F.least(F.col("__n"), F.lit(top))
    last = heights.join(s, by).where(F.col("merge") >= F.col("__n") - k).withColumn("__i", F.col("__n") - 1 - F.col("merge"))
    low = last.where(F.col("merge") == F.col("__n") - k).select(*by, F.col("height").alias("__low"))
    x, drop = F.try_divide(F.col("__i"), k - 1), F.try_divide(F.col("__low"), F.col("__max")) - 1
    far = (x * drop - (F.try_divide(F.col("height"), F.col("__max")) - 1)) / F.sqrt(1 + drop * drop)
    inner = last.join(low, by).where((F.col("__i") > 0) & (F.col("__i") < k - 1)).withColumn("__far", far)
    elbows = inner.groupBy(*by).agg(F.max_by("height", F.struct(F.round("__far", 12), -F.col("__i"))).alias("__elbow"))
    one = F.col("__n") == 1
    return s.join(steps, by, "left").join(low, by).join(elbows, by, "left").select(
        *by,
        (F.col("__max") / 2).alias("half"),
        F.when(one, 0.9 * F.col("__max")).otherwise(F.col("__step")).alias("largest_step"),
        F.when(one, 0.9 * F.col("__max")).when(F.col("__max") == 0, F.col("__min")).otherwise(F.coalesce("__elbow", "__low")).alias("elbow"),
    )
