"""Sequential models, sinks and summaries against restatements and published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.operators import baseline, events, kernels, rolling, search, traces
from blipstream.operators.scan import middles
from blipstream.sources import sinks

POINTS = "sample_id string, channel string, slice_idx int, idx int, time_s double, intensity double"


def sliced(spark, **series):
    return spark.createDataFrame([("s", c, 0, i, 0.1 * (i + 1), float(v)) for c, y in series.items() for i, v in enumerate(y)], POINTS)


def clip_until_still(y, z):
    while True:
        m, s = y.mean(), y.std(ddof=1) if len(y) > 1 else 0.0
        inside = y[np.abs(y - m) <= z * s]
        if len(inside) in (0, len(y)):
            return m, s
        y = inside


def smart_plainly(y):
    z = 1.0
    m, s = clip_until_still(y, z)
    if y.mean() < 0.1:
        return m, s, z
    while s < 0.05 and z < 10:
        z += 1
        m, s = clip_until_still(y, z)
    z = min(10.0, z + 1)
    m, s = clip_until_still(y, z)
    while m > 0 and s / m > 1.5 and z > 0.1:
        z -= 0.1
        m, s = clip_until_still(y, z)
    if s == 0:
        m = np.median(y)
        s = 1.4826 * np.median(np.abs(y - m)) or math.sqrt(max(0, y.mean()))
    return m, s, z


def test_growing_factors(spark):
    rng = np.random.default_rng(4)
    series = {
        "normal": rng.normal(20, 2, 800),
        "spiky": np.concatenate([rng.normal(5, 1, 600), rng.uniform(50, 400, 60)]),
        "small": rng.uniform(0, 0.1, 200),
        "heavy": rng.exponential(1.0, 500) ** 3,
        "steps": np.repeat([4.0, 4.0, 4.0, 9.0], 50),
        "flat": np.full(60, 3.0),
    }
    got = {r.channel: r for r in baseline.smart_clipped(sliced(spark, **series)).collect()}
    for c, y in series.items():
        m, s, z = smart_plainly(np.asarray(y))
        assert (got[c].location, got[c].spread) == (pytest.approx(m), pytest.approx(s)) and got[c].z == pytest.approx(z), c


#: A published example of the generalised test with three outliers at 0.05 (Rosner, 1983).
ROSNER = "-0.25 0.68 0.94 1.15 1.20 1.26 1.26 1.34 1.38 1.43 1.49 1.49 1.55 1.56 1.58 1.65 1.69 1.70 1.76 1.77 1.81 1.91 1.94 1.96 1.99 2.06 2.09 2.10 2.14 2.15 2.23 2.24 2.26 2.35 2.37 2.40 2.47 2.54 2.62 2.64 2.90 2.92 2.92 2.93 3.21 3.26 3.30 3.59 3.68 4.30 4.64 5.34 5.42 6.01"


def test_published_outliers(spark):
    y = [float(x) for x in ROSNER.split()]
    r = kernels.rosner(sliced(spark, c=y), 0.05, 10 / 54).first()
    rest = np.array(sorted(y)[:-3])
    assert r.n_outliers == 3 and r.location == pytest.approx(rest.mean()) and r.spread == pytest.approx(rest.std(ddof=1))


def test_truncated_poisson(spark):
    rng = np.random.default_rng(7)
    series = {"rare": rng.poisson(0.7, 4000), "often": rng.poisson(9, 4000), "none": np.zeros(50), "cut": np.where((k := rng.poisson(2.0, 4000)) < 2, 0, k)}
    got = {r.channel: r["mean"] for r in kernels.truncated_poisson(sliced(spark, **series)).collect()}
    assert got["none"] == 0.5
    assert got["rare"] == pytest.approx(-math.log((series["rare"] == 0).mean()), abs=0.051)
    values, counts = np.unique(series["often"][series["often"] > 0], return_counts=True)
    assert got["often"] == pytest.approx((2 * series["often"][series["often"] > 0].mean() + values[counts.argmax()]) / 3)
    share = (series["cut"] == 0).mean()  # P(X < 2) = exp(-m) (1 + m)
    assert abs(math.exp(-got["cut"]) * (1 + got["cut"]) - share) < 0.02 and abs(got["cut"] - 2.0) < 0.15


def test_medians_by_ranges(spark):
    rng = np.random.default_rng(9)
    groups = {"a": rng.normal(size=301).tolist(), "b": rng.integers(0, 5, 400).tolist(), None: [1.0, 4.0], "e": [7.0]}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("n", None)], "g string, v double").repartition(7)
    got = {r.g: r.m for r in middles(df, F.col("v"), "m", ["g"]).collect()}
    assert got == {g: pytest.approx(np.median(x)) for g, x in groups.items()}


def test_first_values_and_gaps(spark):
    y = [0.0] * 30 + [1.1, 2.0, 3.0] + [0.0] * 50 + [4.0, 5.4, 6.4] * 20
    p = sliced(spark, c=y, z=[0.0] * 9)
    for first, block in ((3, 16), (4, 16), (40, 16), (10_000, 1 << 16)):
        used = np.array([v for v in y if v][:first])
        want = bool(np.abs(np.floor(used + 0.5) - used).mean() < 0.15)
        assert {r.channel: r.is_integer for r in traces.is_integer(p, first, block=block).collect()} == {"c": want}, first
    q = sliced(spark, near=[1, 2, 3, 4, 9, 0], far=[1, 50, 120, 300], one=[5, 5, 5], wide=[10, 13, 17, 22, 900])
    assert {r.channel: r.is_counts for r in traces.looks_like_counts(q).collect()} == {"near": True, "far": False, "wide": True}
    modes = {r.channel: (r.mode, r.n) for r in traces.mode(sliced(spark, a=[3, 1, 1, 3, 2], b=[7])).collect()}
    assert modes == {"a": (3.0, 2), "b": (7.0, 1)}


def test_custom_and_error_tables(spark):
    e = spark.createDataFrame([("s", "a", 0, 5.0, 2), ("s", "a", 1, 7.0, 3), ("s", "b", 0, 1.0, 1)], "sample_id string, channel string, event_ord int, area double, n_points int")
    made = sinks.custom_population(e, {"area_k": F.col("area") / 1000, "points": F.col("n_points")})
    assert made.columns == ["sample_id", "channel", "event_ord", "area_k", "points"] and made.where("channel = 'a'").agg(F.sum("area_k")).first()[0] == pytest.approx(0.012)
    with_bg = sinks.custom_population(e, {"area": F.col("area")}, spark.createDataFrame([("s", "a", 0.5)], "sample_id string, channel string, background double"))
    assert {(r.channel, r.background) for r in with_bg.collect()} == {("a", 0.5), ("b", None)}
    rates = spark.createDataFrame([("s", "a", 1.0, 0.5, 2 / 3), ("s", "b", 0.5, 0.5, 0.5), ("t", "a", 1.0, 1.0, None)], "sample_id string, channel string, precision double, recall double, f_score double")
    got = {(r.sample_id, r.channel): (r.precision, r.recall) for r in sinks.error_table(rates).collect()}
    assert got["s", "mean"] == (0.75, 0.5) and got["s", "sd"] == (pytest.approx(math.sqrt(0.125)), 0.0) and got["t", "sd"] == (None, None) and len(got) == 7


def test_all_parameters_and_realigned_events(spark):
    y = np.ones(60)
    y[[0, 1]] = 30, 20
    y[30:34] = 5, 50, 20, 5
    p = sliced(spark, a=y, b=2 * y).drop("slice_idx")
    runs = spark.createDataFrame([("s", 0, 1), ("s", 30, 33)], "sample_id string, start_idx int, end_idx int")
    got = {(r.channel, r.start_idx): r for r in rolling.realigned(runs, p, 10, "INDEX", "MEDIAN").collect()}
    assert got["a", 30].n_bg == 16 and got["a", 30].bg_per_event == 4.0 and got["b", 30].net_area == pytest.approx(2 * 80 - 8) and got["b", 0].peak_idx == 0 and got["a", 0].n_bg == 9
    named = search.numbered(spark.createDataFrame([tuple(r) for r in got.values()], rolling.realigned(runs, p, 10).schema).where("channel = 'a'"))
    full = {r.start_idx: r for r in events.all_parameters(named, p).collect()}
    assert list(full[30].asDict())[3:] == events.PARAMETERS and full[30].n_events == 2 and full[30].center_time_s == pytest.approx(3.2) and full[0].duration_us == pytest.approx(2e5) and full[30].asymmetry == pytest.approx(2 * 2 / 3)
