"""Operators on data without spread, and tails and quantiles far out: results instead of failures."""

import math

import pytest
from pyspark.sql import functions as F

from blipstream.functions.distributions import compound_poisson_limit, compound_poisson_tail, gamma_tails
from blipstream.operators import accumulate, baseline, histogram, models, spectra
from blipstream.plans import inputs


def test_tail_of_many_or_small_p(spark):
    import numpy as np

    cases = [(800.0, 800), (2000.0, 500), (2000.0, 2000), (0.0, 3), (1e-9, 5), (745.5, 2), (1e5, 100_000), (1e5, 99_000), (99_000.0, 100_000), (3.0, 1), (50.0, 400)]
    got = [r.p for r in spark.createDataFrame([(i, h, k) for i, (h, k) in enumerate(cases)], "i int, h double, k int").withColumn("p", baseline.fisher_tail(F.col("h"), F.col("k"))).orderBy("i").collect()]
    want = gamma_tails(np.array([float(k) for _, k in cases]), np.array([h for h, _ in cases]))
    assert all(abs(a - b) <= 1e-8 * max(b, 1e-280) + 1e-300 for a, b in zip(got, want, strict=True)), list(zip(got, want, strict=True))
    assert abs(got[0] - 0.495) < 1e-3 and all(0 <= p <= 1 for p in got)


def test_gate_keeps_long_events(spark):
    """An event of 10,000 points with p = 0.01 each is as unlikely as can be; one of p = 0.9 is not."""
    points = spark.range(20_000).select(F.lit("s").alias("sample_id"), F.lit("c").alias("channel"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") < 10_000, 0.01).otherwise(0.9).alias("p"))
    events = spark.createDataFrame([("s", "c", 0, 9_999), ("s", "c", 10_000, 19_999)], "sample_id string, channel string, start_idx int, end_idx int")
    assert [r.start_idx for r in accumulate.p_gate(events, points, 1e-5).collect()] == [0]


def test_compound_quantiles_have_no_upper_bound():
    for mean, shape, alpha in ((0.5, 2.0, 1e-6), (0.5, 3.0, 1e-4), (3.0, 0.47, 1e-5), (1e-3, 1.0, 1e-4), (30_000.0, 0.5, 1e-6), (12.0, 0.0, 1e-3)):
        found = compound_poisson_limit(mean, shape, alpha)
        above = compound_poisson_tail(mean, shape)
        assert above(found) <= alpha and (shape == 0.0 or abs(above(found) / alpha - 1) < 1e-6), (mean, shape, alpha)
    assert compound_poisson_limit(0.5, 2.0, 1e-6) > 150 and compound_poisson_limit(0.0, 1.0, 0.1) == 0.0 == compound_poisson_limit(0.01, 1.0, 0.5)
    with pytest.raises(ValueError):
        compound_poisson_limit(1.0, 1.0, 0.0)
    # Against plain summation, pulse number by pulse number.
    x, total = 9.0, 0.0
    for k in range(1, 60):
        s = math.log1p(math.expm1(0.47**2) / k)
        total += math.exp(k * math.log(3.0) - 3.0 - math.lgamma(k + 1)) * 0.5 * math.erfc((math.log(x) - math.log(k) + s / 2) / math.sqrt(2 * s))
    assert abs(compound_poisson_tail(3.0, 0.47)(x) - total) < 1e-14


def test_models_without_spread(spark):
    flat = spark.createDataFrame([("g", 0.0, 2.0)], "g string, x double, y double")
    assert models.ols(flat, ["g"], "x", "y").first().slope is None
    assert models.wls(flat, ["g"], "x", "y").first().slope is None
    assert models.slope_only(flat, ["g"], "x", "y").first().slope is None
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    assert {r.z for r in models.z_scores(same, ["g"], "x").collect()} == {0.0}
    assert models.z_scores(same.limit(1), ["g"], "x").first().z is None
    assert tuple(models.kruskal_wallis(same, "g", "x").first()) == (None, None)
    assert models.anova(same, "g", "x").first().f is None and models.anova(same.where("g = 'a'"), "g", "x").first().f is None
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert zero.select(models.cosine(F.col("a"), F.col("b"))).first()[0] is None
    assert [(r.distance, r.similarity) for r in spectra.emd_pairs(same, "g", "x").collect()] == [(0.0, 1.0)]
    assert {r.share for r in spectra.normalised(spark.createDataFrame([(None, 1.0), (None, -1.0)], "g string, x double"), ["g"], "x", "sum").collect()} == {None}
    assert [r.density for r in histogram.kernel_density(same, "x", [1.0]).collect()] == [None]


def test_changed_input_is_read_anew(spark, tmp_path):
    def write(n):
        rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).alias("user_id"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"))
        rows.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        return inputs.event_points(spark, str(tmp_path)).count()

    assert [write(50), write(80), inputs.event_points(spark, str(tmp_path)).count()] == [50, 80, 80]
