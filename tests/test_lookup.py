"""Quantile tables, jittered samples, merged samples and further small variants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.functions import chemistry
from blipstream.functions.distributions import compound_poisson_limit
from blipstream.operators import align, events, lookup, quant, sampling, spectra


def test_nodes_and_cells_of_a_table(spark):
    means, shapes, alphas = [0.5, 2.0, 8.0], [0.2, 0.5], [1e-6, 1e-3]
    grid = lookup.compound_grid(spark, means, shapes, alphas).cache()
    nodes = {(r["mean"], r["shape"], r.alpha): r.value for r in grid.collect()}
    assert len(nodes) == 12 and all(v == compound_poisson_limit(*k) for k, v in nodes.items())
    rows = spark.createDataFrame([*nodes, (1.25, 0.35, 5e-4), (99.0, 0.5, 1e-3), (0.1, 0.1, 1e-9), (None, 0.2, 1e-3)], "mean double, shape double, alpha double")
    got = {(r["mean"], r["shape"], r.alpha): r.q for r in lookup.looked_up(rows, grid, "q").collect()}
    assert all(got[k] == pytest.approx(v, rel=1e-12) for k, v in nodes.items())
    w = [((2.0 - 1.25) / 1.5, 0.5), ((1.25 - 0.5) / 1.5, 2.0)]
    a = (5e-4 - 1e-6) / (1e-3 - 1e-6)
    want = sum(x * (0.5 * ((1 - a) * nodes[m, 0.2, 1e-6] + a * nodes[m, 0.2, 1e-3]) + 0.5 * ((1 - a) * nodes[m, 0.5, 1e-6] + a * nodes[m, 0.5, 1e-3])) for x, m in w)
    assert got[1.25, 0.35, 5e-4] == pytest.approx(want, rel=1e-12)
    assert got[99.0, 0.5, 1e-3] == nodes[8.0, 0.5, 1e-3] and got[0.1, 0.1, 1e-9] == nodes[0.5, 0.2, 1e-6] and got[None, 0.2, 1e-3] is None
    holes = lookup.looked_up(rows, grid.where("not (mean = 2 and shape = 0.5)"), "q").where("mean = 1.25").first()
    assert holes.q is None


def sampled_plainly(x, m, window, jitter):
    x, n = sorted(x), len(x)
    if n <= m:
        return x
    if m == 1:
        return [x[n // 2]]
    out = []
    for i in range(m):
        c = math.floor(i / (m - 1) * (n - 1) + 0.5)
        if jitter == "GOLDEN":
            w = max(1, window)
            k = c + math.floor((i * 0.6180339887 % 1) * (2 * w + 1)) - w
        elif jitter == "HASHED":
            k = c + i % (2 * window + 1) - window
        else:
            lo, hi = min(window, c), min(window, n - 1 - c)
            k = c - lo + int(sampling.murmur(np.array([i], np.uint32))[0]) % (lo + hi + 1)
        out.append(x[max(0, min(n - 1, k))])
    return out


@pytest.mark.parametrize("jitter", sampling.JITTERS)
def test_jittered_samples(spark, jitter):
    rng = np.random.default_rng(2)
    groups = {"big": rng.normal(size=500).round(2), "few": rng.normal(size=7), "one": [3.0]}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("few", None)], "g string, x double").repartition(4)
    for m, window in ((20, 3), (1, 2), (7, 0)):
        got = sampling.quantile_sample(df, ["g"], "x", m, window, jitter).orderBy("g", "nth").collect()
        for g, x in groups.items():
            assert [r.x for r in got if r.g == g] == [float(v) for v in sampled_plainly(x, m, window, jitter)], (g, m)
    with pytest.raises(ValueError):
        sampling.quantile_sample(df, ["g"], "x", 3, 1, "DICE")


def test_the_hash_is_murmur(spark):
    # Known values of the hash: of four zero bytes, and of the bytes 21 43 65 87.
    assert [int(x) & 0xFFFFFFFF for x in sampling.murmur(np.array([0, 0x21436587], np.uint32))] == [0x2362F9DE, 0xF55B516B]


def test_merged_samples(spark):
    e = spark.createDataFrame([("s1", "c", 1.0), ("s1", "c", 5.0), ("s2", "c", 3.0), ("s3", "c", 9.0)], "sample_id string, channel string, net_area double")
    t = spark.createDataFrame([("s1", "c", 10.0, 2.0), ("s2", "c", 30.0, 4.0), ("s3", "c", 5.0, 1.0), ("s4", "c", 5.0, 3.0)], "sample_id string, channel string, seconds double, raw_mean double")
    g = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b"), ("s4", "b"), ("s4", "z")], "sample_id string, merged_id string")
    got = {r.merged_id: r for r in events.merged_samples(e, t, g).collect()}
    assert (got["a"].n, got["a"].mean_net_area, got["a"].median_net_area, got["a"].per_second, got["a"].raw_mean) == (3, 3.0, 3.0, 0.075, 3.0)
    assert (got["b"].n, got["b"].per_second, got["b"].raw_mean) == (1, 0.1, 2.0) and (got["z"].n, got["z"].per_second, got["z"].mean_net_area) == (0, 0.0, None)


def test_small_variants(spark):
    e = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 100.0)], "channel string, v double")
    own = spark.createDataFrame([("a", 0.0, 5.0)], "channel string, low double, high double")
    assert sorted(r.v for r in events.with_overrides(e, own, 0.0, 50.0, "v").collect()) == [1.0]
    assert sorted(r.v for r in events.with_overrides(e, own, 0.0, 50.0, "v", only_exceptions=True).collect()) == [1.0, 100.0]
    iso = chemistry.isotopes(spark)
    split = chemistry.split_signal(spark.createDataFrame([("Ag", 1000.0), ("Xx", 5.0)], "element string, counts double"), iso).collect()
    assert sum(r.isotope_counts for r in split) == pytest.approx(1000.0) and {r.mass_number for r in split} == {107, 109}
    one = sorted((r.element, r.kind, r["at"]) for r in align.interferences(iso, 56.0).collect())
    many = align.interferences_of(spark.createDataFrame([(1, 56.0), (2, 500.0), (3, None)], "k int, mass double"), iso).collect()
    assert sorted((r.element, r.kind, r["at"]) for r in many) == one and {r.k for r in many} == {1}
    lo = spark.range(1).select(quant.lognormal_sum_lo(F.lit(2.0), F.lit(1.0), F.lit(4)).alias("s")).first().s
    assert lo.sigma == pytest.approx(math.sqrt(math.log(1.25) / 4)) and lo.mu == pytest.approx(math.log(8) - math.log(1.25) / 8)
    kept, members = spectra.cluster_spectra(spark.createDataFrame([(1, k, el, v) for k, el, v in ((10, "Au", 5.0), (11, "Au", 6.0), (10, "Ag", 9.0), (11, "Ag", 0.0))] + [(2, 12, "Au", 0.0)], "cluster int, event int, element string, intensity double"), 1.0)
    assert [(r.cluster, r.element, r["mean"]) for r in kept.collect()] == [(1, "Au", 5.5)] and {r.event: r.population for r in members.collect()} == {10: "Au", 11: "Au", 12: ""}
    long = spark.range(30).select(F.lit("s").alias("sample_id"), F.lit("c").alias("channel"), F.col("id").cast("int").alias("idx"), F.col("id").cast("double").alias("intensity"))
    none = spark.createDataFrame([], "sample_id string, start_idx int, end_idx int")
    assert spectra.sampled_background(long, none).first().background == 12.5 and spectra.sampled_background(long, none, long=20).first().background == 10.0
