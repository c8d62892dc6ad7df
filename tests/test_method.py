"""Method files: sets of the shape that the program writes, compiled and run on traces with known events."""

import numpy as np
import pytest

from blipstream.operators import baseline, events, thresholds, traces
from blipstream.plans.method import compile_method, read_method
from blipstream.plans.method_queries import METHOD, parameter_set

POINTS = "sample_id string, channel string, idx int, time_s double, intensity double"
DT = 1e-4


def points(spark, n=4000, seed=1, at=(200, 900, 901, 2500, 3990)):
    rng = np.random.default_rng(seed)
    rows = []
    for c, level in (("low", 1.0), ("high", 60.0)):
        y = rng.poisson(level, n).astype(float)
        for k in at:
            y[k : k + 4] += [10 * level + 20, 20 * level + 40, 12 * level + 20, 3 * level + 8][: n - k]
        rows += [("s", c, i, DT * (i + 1), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, POINTS)


def method(baseline_set=None, search_set=None, *more):
    base = dict(baselineDynamics="CONSTANT", baselineWidthPerSegment=100.0, generalDistributionApproach="THRESHOLD", poissonNormalCutoff=10.0, poissonChoice="POISSON_COMPOUND", outlierTestTypePoisson="ITERATE_TO_CONVERGENCE", outlierFactorPoissonStart=3.0, outlierPoissonOffsetBoolean="true", outlierPoissonOffsetValue=2.71, siaShape=0.3, applyPoissonContinuityCorrection="true", poissonContinuityCorrection=0.5, outlierTestTypeGauss="SMART_INCREMENT_ITERATION", outlierFactorGaussStart=1.0)
    find = dict(enableBoolean="true", searchAlgorithm="SPLIT_CORRECTION", heightFilter="ALPHA", heightFilterAlphaValue=5e-7, startCriterium="MEAN", stopCriterium="MEAN", startStopOffset=0.5, netCorrectionOption="BLN_MEAN", windowWidth=300.0, windowBonusWidth=200.0, smoothGaussianWidth=300.0, netTimeWindow=0.01, netTimeWindowLocation="MEDIAN", pValueStartStopAlphaValue=1e-3, pValueThresholdAlphaValue=1e-6)
    other = parameter_set("MCSimGeneralParams", duration=49.8) + parameter_set("NuInterpreterParams", preScreenAlpha=1e-6)
    return f"<tool version='1'><method labelOfSet='x'>{other}{parameter_set('BaselineParams', **(base | (baseline_set or {})))}{parameter_set('SearchParams', **(find | (search_set or {})))}{''.join(more)}</method></tool>"


def spans(df):
    return sorted((r.channel, r.start_idx, r.end_idx) for r in df.collect())


def covers(found, at=(200, 900, 2500, 3990)):
    return all(any(c == ch and a <= k + 1 and z >= k for c, a, z in found) for ch in ("low", "high") for k in at)


def test_sets_of_a_file():
    xml = "<t><method><BaselineParams><parameter value='2' xmlID='n'><parameterBundle><parameter value='A' xmlID='e'/></parameterBundle><parameterBundleDefaults><parameter value='B' xmlID='e'/></parameterBundleDefaults></parameter></BaselineParams></method></t>"
    assert read_method(xml) == [{"name": "BaselineParams", "parameters": {"n": "2", "e": "A"}}]
    assert [s.kind for s in compile_method(METHOD).steps] == ["model", "model_search", "model_gate", "model_gate"]


def test_the_shape_of_the_example_runs(spark):
    p = points(spark).cache()
    found = compile_method(method()).run(p)
    assert found.columns[:2] == ["sample_id", "channel"] and {"net_area", "net_height", "event_ord", "bg_per_event"} <= set(found.columns)
    assert covers(spans(found)) and found.count() < 16
    # By hand: the Poisson channel by convergence and a compound limit, the Gaussian one by growing factors.
    sliced = traces.segment(p, 10**6)
    low = baseline.converged_rounds(sliced.where("channel = 'low'"), 3.0, 2.71, poisson=True).first()
    assert abs(low.location - 1.0) < 0.1 and low.rounds >= 1
    limit = thresholds.critical_limit(spark.createDataFrame([("s", "low", 0, low.location, low.spread, "POISSON")], "sample_id string, channel string, slice_idx int, location double, spread double, distr string"), 5e-7, "POISSON_COMPOUND", 0.3).first().critical
    smallest = min(r.height for r in found.where("channel = 'low'").collect())
    assert smallest > limit > low.location + 4


@pytest.mark.parametrize("how", ["SIMPLE", "SPLIT_CORRECTION_WINDOW", "SPLIT_CORRECTION_SMOOTH", "P_VALUE_ACCUMULATION"])
def test_other_searches(spark, how):
    found = spans(compile_method(method({"poissonChoice": "POISSON"}, {"searchAlgorithm": how})).run(points(spark)))
    assert covers(found) and len(found) < 60


@pytest.mark.parametrize("net", ["INDEX_APPROXIMATION", "TIME_EXACT"])
def test_segments_and_windows_of_background(spark, net):
    xml = method({"baselineDynamics": "SEGMENTED", "outlierTestTypeGauss": "ROSNER", "outlierRosnerMaxPercent": 0.05, "poissonChoice": "POISSON_CURRIE"}, {"netCorrectionOption": net, "suppressNegativeValues": "true"})
    found = compile_method(xml).run(points(spark))
    assert covers(spans(found))
    for r in found.collect():
        assert abs(r.bg_per_event / r.n_points - (1.0 if r.channel == "low" else 60.0)) < (1.1 if r.channel == "low" else 6.0)


def test_gates_and_removal(spark):
    p = points(spark)
    every = compile_method(method()).run(p)
    high = method(None, None, parameter_set("GatingParams", gatingOption="HEIGHT", measureOfSignificance="Z_VALUE", zValue=40.0, factorBoolean="true", factor=2.0))
    gated = compile_method(high).run(p)
    assert 0 < gated.count() < every.count() and all(r.height > 80 for r in gated.collect())
    for kind, more in (("AREA", dict(measureOfSignificance="ALPHA", alphaValue=1e-9)), ("NET_AREA", dict(measureOfSignificance="CUSTOM_VALUE", absoluteCutoff=100.0)), ("PEAK_DOMINANCE", dict(spikeBalancePercent=60.0)), ("MORE_POINTS_THAN", dict(absoluteCutoff=2.0)), ("ACCUMULATED_P", dict(pValueAccumulationAlpha=1e-12))):
        assert compile_method(method(None, None, parameter_set("GatingParams", gatingOption=kind, **more))).run(p).count() <= every.count(), kind
    none = method(None, None, parameter_set("IsotopeRemoverParams", removeFewerIsotopesThan="true", fewerIsotopesNumber=100, removeMoreIsotopesThan="false", moreIsotopesRate=1.0))
    assert compile_method(none).run(p).count() == 0
    with pytest.raises(ValueError):
        compile_method("<m>" + parameter_set("GatingParams", gatingOption="HEIGHT", absoluteCutoff=1) + "</m>").run(p)
    with pytest.raises(ValueError):
        compile_method(method({"outlierTestTypeGauss": "MAGIC", "generalDistributionApproach": "GAUSSIAN_MODEL"})).run(p)


def test_rounds_equal_groups(spark):
    sliced = traces.segment(points(spark), 1000)
    for z, offset in ((3.0, 0.0), (2.0, 1.0)):
        one = sorted(baseline.converged(sliced, z, offset).collect())
        two = sorted(baseline.converged_rounds(sliced, z, offset).select("sample_id", "channel", "slice_idx", "location", "spread", "n_kept", "rounds").collect())
        assert [r[:3] + r[5:] for r in map(tuple, one)] == [r[:3] + r[5:] for r in map(tuple, two)]
        assert all(abs(a.location - b.location) < 1e-9 and abs(a.spread - b.spread) < 1e-9 for a, b in zip(one, two, strict=True))
    assert events.statistics(compile_method(METHOD).run(points(spark)).withColumn("duration_us", events.F.lit(1.0))).count() >= 1
