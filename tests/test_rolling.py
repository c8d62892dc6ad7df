"""Sliding medians, LOESS, random samples of a pool and pulse shapes against loops, several blocks a trace."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.operators import ion_shape, loess, permutation, rolling
from blipstream.operators.loess import local_lines, sliding_sums

POINTS = "sample_id string, channel string, idx int, time_s double, intensity double"


def trace(spark, y, channel="c"):
    return spark.createDataFrame([("s", channel, i, 0.5 * i, float(v)) for i, v in enumerate(y)], POINTS)


def values(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.round(rng.gamma(2.0, 5.0, n), 1)


def mad(x):
    return float(np.median(np.abs(x - np.median(x))))


@pytest.mark.parametrize("n,before,after", [(400, 7, 30), (1, 3, 3), (5, 20, 0), (130, 60, 60)])
def test_rolling_medians(spark, n, before, after):
    y = values(n)
    got = rolling.rolling_median(trace(spark, y).repartition(3), before, after, block=50).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(n))
    for i, r in enumerate(got):
        w = y[max(0, i - before) : i + after + 1]
        assert abs(r.median - np.median(w)) < 1e-12 and abs(r.mad - mad(w)) < 1e-12, i


def test_local_likelihood(spark):
    y = values(300, 4)
    y[120:126] += 90
    got = rolling.local_peak_likelihood(trace(spark, y), 2, 25, 0.5, block=60).orderBy("idx").collect()
    scores = []
    for i in range(300):
        w = y[max(0, i - 25) : i + 26]
        m, d = np.median(w), 1.4826 * mad(w)
        clean = w[(w >= m - d) & (w <= m + d)]
        near = y[max(0, i - 2) : i + 3]
        scores.append((near > np.median(clean) + 0.5 * 1.4826 * mad(clean)).mean())
    assert max(abs(a - r.score) for a, r in zip(scores, got, strict=True)) < 1e-12
    assert max(abs(a / max(scores) - r.likelihood) for a, r in zip(scores, got, strict=True)) < 1e-12
    assert {r.likelihood for r in rolling.local_peak_likelihood(trace(spark, [3.0] * 40)).collect()} == {0.0}


EVENTS = "sample_id string, channel string, start_idx int, end_idx int, peak_idx int, n_points int, area double, height double"


@pytest.mark.parametrize("by", ["INDEX", "TIME"])
def test_background_of_events(spark, by):
    y = values(500, 6)
    spans = [(0, 3, 1), (50, 50, 50), (51, 60, 55), (200, 290, 240), (497, 499, 498)]
    rows = [("s", "c", a, b, p, b - a + 1, float(y[a : b + 1].sum()), float(y[p])) for a, b, p in spans]
    events, points = spark.createDataFrame(rows, EVENTS), trace(spark, y)
    half = 20 if by == "INDEX" else 10.0
    free = np.array([not any(a <= i <= b for a, b, _ in spans) for i in range(500)])
    for location, f in (("MEAN", np.mean), ("MEDIAN", np.median)):
        got = {r.start_idx: r for r in rolling.background_of_events(events, points, half, by, location, clamp=True, block=64).collect()}
        for (_, _, a, b, p, n, area, height), (lo, hi) in zip(rows, [(s[2] - 20, s[2] + 20) for s in spans], strict=True):
            w = np.array([y[i] for i in range(500) if lo < i <= hi and free[i]])
            bg = min(area, (float(f(w)) if len(w) else 0.0) * n)
            r = got[a]
            assert r.n_bg == len(w) and abs(r.bg_per_event - bg) < 1e-9 and abs(r.net_area - (area - bg)) < 1e-9 and abs(r.net_height - (height - bg / n)) < 1e-9
    assert got[200].n_bg == 0 and got[200].bg_per_event == 0.0
    with pytest.raises(ValueError):
        rolling.background_of_events(events, points, half, "AREA")


def loess_plainly(y, bandwidth, robust=2):
    n = len(y)
    b = max(1e-4, 3 / n, min(np.nextafter(1.0, 0.0), bandwidth))
    if n <= 1 or b > 1:
        return list(y)
    pad = max(0, min(n - 2, math.floor(b * n + 0.5)))
    full = [y[pad - i] for i in range(pad)] + list(y) + [y[n - 2 - i] for i in range(pad)]
    total = len(full)
    q = math.floor(b * total)
    r = [1.0] * total
    for round_ in range(robust + 1):
        line = []
        for i in range(total):
            lo = min(range(total - q + 1), key=lambda a: (max(i - a, a + q - 1 - i), a))
            reach = max(i - lo, lo + q - 1 - i)
            w = [r[k] * (1 - min(1.0, abs(k - i) / reach) ** 3) ** 3 for k in range(lo, lo + q)]
            x, v = np.arange(lo, lo + q) - i, full[lo : lo + q]
            s = sum(w)
            if s == 0:
                line.append(full[i])
                continue
            mx, my = np.dot(w, x) / s, np.dot(w, v) / s
            spread = np.dot(w, x * x) / s - mx * mx
            slope = 0.0 if math.sqrt(abs(spread)) < 1e-12 else (np.dot(w, x * v) / s - mx * my) / spread
            line.append(my - slope * mx)
        away = [abs(a - c) for a, c in zip(full, line, strict=True)]
        m = sorted(away)[total // 2]
        if round_ == robust or m < 1e-12:
            break
        r = [0.0 if e >= 6 * m else (1 - (e / (6 * m)) ** 2) ** 2 for e in away]
    return line[pad : pad + n]


@pytest.mark.parametrize("n,bandwidth", [(150, 0.1), (151, 0.33), (40, 0.9), (3, 0.5), (2, 0.5), (1, 0.5), (90, 0.0)])
def test_loess(spark, n, bandwidth):
    y = values(n, 3) + 5 * np.sin(np.arange(n) / 9)
    if n > 100:
        y[60] += 400  # a spike that the robust rounds take out
    got = loess.loess(trace(spark, y), bandwidth, block=48).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(n))
    assert max(abs(a - r.smooth) for a, r in zip(loess_plainly(y, bandwidth), got, strict=True)) < 1e-8


def test_loess_of_wide_frames():
    rng = np.random.default_rng(2)
    kernel, x = rng.uniform(size=601), rng.normal(size=3000)
    assert np.abs(sliding_sums(kernel, x) - np.correlate(x, kernel, "valid")).max() < 1e-10  # the one with Fourier transforms
    y, r = rng.normal(size=2000), rng.uniform(0.1, 1, 2000)
    whole = local_lines(y, r, 0, np.arange(2000), 2000, 801)
    part = local_lines(y[100:1900], r[100:1900], 100, np.arange(900, 1100), 2000, 801)
    assert np.abs(whole[900:1100] - part).max() < 1e-9
    assert np.isfinite(whole).all()


def emd(a, b):
    every = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), every, "right") / len(x) for x in (a, b))
    reach = max(abs(a.max() - b.min()), abs(b.max() - a.min()))
    return float((np.abs(fa - fb)[:-1] * np.diff(every)).sum() / reach) if reach else 0.0


def test_permutations_against_all_splits(spark):
    a, b = np.array([1.0, 2.0, 2.5, 4.0, 7.0]), np.array([3.0, 4.0, 5.5, 6.0, 8.0, 9.0])
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None), ("c", 3.0)], "g string, x double")
    pool = np.concatenate([a, b])
    seen = emd(a, b)
    splits = [emd(pool[list(c)], np.delete(pool, list(c))) for c in combinations(range(11), 5)]
    share = np.mean([e >= seen - 1e-12 for e in splits])
    got = permutation.emd_permutation(df, "g", "a", "b", "x", replicates=1500, how="PERMUTATION", block=4).first()
    assert abs(got.emd - seen) < 1e-12
    assert abs(got.p_rank - share) < 2 * math.sqrt(share * (1 - share) / 1500) + 1 / 1500
    logs = np.log10([e for e in splits if e > 0])
    assert abs(got.mean_log - logs.mean()) < 2.5 * logs.std() / math.sqrt(1500) and abs(got.sd_log / logs.std() - 1) < 0.1
    again = permutation.emd_permutation(df.repartition(5), "g", "a", "b", "x", replicates=1500, how="PERMUTATION", block=4).first()
    assert tuple(again) == tuple(got)


def test_bootstrap_of_the_pool(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0, 1, 150), rng.normal(0, 1, 220)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
    got = permutation.emd_permutation(df, "g", "a", "b", "x", replicates=400, block=64).first()
    pool, logs = np.concatenate([a, b]), []
    for _ in range(2000):
        logs.append(math.log10(emd(rng.choice(pool, 150), rng.choice(pool, 220))))
    assert abs(got.emd - emd(a, b)) < 1e-12
    assert abs(got.mean_log - np.mean(logs)) < 4 * np.std(logs) / math.sqrt(400) and abs(got.sd_log / np.std(logs) - 1) < 0.15
    assert abs(got.p - math.erfc(got.z / math.sqrt(2))) < 1e-9 and got.p > 0.01
    far = df.withColumn("x", F.col("x") + F.when(F.col("g") == "a", 5.0).otherwise(0.0))
    assert permutation.emd_permutation(far, "g", "a", "b", "x", replicates=200).first().p < 1e-4
    same = df.withColumn("x", F.lit(1.0))
    assert tuple(permutation.emd_permutation(same, "g", "a", "b", "x", replicates=20).first()) == (0.0, None, None, None, None, 1.0)
    assert permutation.emd_permutation(df.where("g = 'a'"), "g", "a", "b", "x").count() == 0
    with pytest.raises(ValueError):
        permutation.emd_permutation(df, "g", "a", "b", "x", how="ALL")


def pulses(rate, sigma, n, seed):
    rng = np.random.default_rng(seed)
    k = rng.poisson(rate, n)
    return np.array([rng.lognormal(0.3, sigma, j).sum() for j in k])


def shape_plainly(y, clip=5.0, trim=5.0):
    zeros = (y == 0).sum()
    if zeros <= 50:
        return None, None
    p0 = zeros / len(y)
    rate = -math.log(p0)
    pos = np.sort(y[y > 0])
    edge = pos[min(len(pos) - 1, math.ceil(rate * p0 / (1 - p0) * len(pos)))]
    logs = np.log(pos[pos <= edge])
    keep = np.ones(len(logs), bool)
    for _ in range(20):
        mu, sd = logs[keep].mean(), logs[keep].std()
        new = np.abs(logs - mu) <= clip * sd
        if (new == keep).all():
            break
        keep = new
    rest = y
    while True:
        p = rest[rest > 0]
        left = rest[rest <= p.mean() + trim * p.std()]
        if len(left) == len(rest):
            break
        rest = left
    return sd, math.sqrt(math.log(rest.var() * rate / rest.mean() ** 2))


def test_pulse_shapes(spark):
    rows = {"mid": pulses(0.8, 0.45, 6000, 1), "rare": pulses(0.05, 0.45, 6000, 2), "dense": pulses(3.2, 0.45, 6000, 3), "full": pulses(9.0, 0.45, 500, 4) + 1}
    rows["mid"][::1500] = 500.0  # spikes of particles
    df = None
    for c, y in rows.items():
        df = trace(spark, y, c) if df is None else df.unionByName(trace(spark, y, c))
    got = {r.channel: r for r in ion_shape.ion_shape(df).collect()}
    assert set(got) == set(rows) and got["full"].shape is None and got["full"].rate is None
    for c in ("mid", "rare", "dense"):
        window, moments = shape_plainly(rows[c])
        assert abs(got[c].window - window) < 1e-9 and abs(got[c].moments - moments) < 1e-9, c
        if c != "mid":
            assert got[c].shape == got[c].moments and abs(got[c].shape - 0.45) < 0.06
    t = abs(got["mid"].rate - 1.55) / 1.45
    w = 1 - t * t * (3 - 2 * t)
    assert abs(got["mid"].shape - (w * got["mid"].window + (1 - w) * got["mid"].moments)) < 1e-12 and abs(got["mid"].shape - 0.45) < 0.06
    mean = ion_shape.mean_ion_shape(ion_shape.ion_shape(df)).first()
    assert mean.channels == 3 and abs(mean["shape"] - np.mean([got[c].shape for c in ("mid", "rare", "dense")])) < 1e-12


def test_blanked_ranges(spark):
    y = np.concatenate([pulses(2.5, 0.6, 2000, 5), pulses(0.3, 0.6, 1500, 6)])
    df = trace(spark, y)
    off = spark.createDataFrame([("s", "c", 2000, 2999), ("s", "c", 2500, 3499)], "sample_id string, channel string, start_idx int, end_idx int")
    alone = ion_shape.ion_shape(trace(spark, y[2000:])).first()
    assert ion_shape.ion_shape(df, off).first().shape == pytest.approx(alone["shape"], abs=1e-12)
    few = spark.createDataFrame([("s", "c", 2000, 2030)], "sample_id string, channel string, start_idx int, end_idx int")
    rest = ion_shape.ion_shape(trace(spark, np.delete(y, range(2000, 2031)))).first()
    assert ion_shape.ion_shape(df, few).first().shape == pytest.approx(rest["shape"], abs=1e-12)
