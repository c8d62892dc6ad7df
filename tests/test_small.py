"""Names of files, sums of isotopes, p by model, efficiencies and further tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.functions import chemistry, parsing
from blipstream.functions.distributions import compound_poisson_tail, poisson_mid_p
from blipstream.operators import quant, thresholds, traces
from blipstream.sources import sinks


def test_file_names(spark):
    names = {
        "a_d60nm_c1p5ppb": [("d", 60.0, "nm"), ("c", 1.5, "ppb")],
        "n2E-3ugl_q250µlmin__x": [("n", 2e-3, "ugl"), ("q", 250.0, "µlmin")],
        "D5_7nm_d5em_e5E+2um_d1pnm": [("", 7.0, "nm"), ("e", 500.0, "um"), ("d", 1.0, "pnm")],
        "": [],
    }
    df = spark.createDataFrame([(n,) for n in [*names, None]], "n string").withColumn("b", parsing.name_blocks(F.col("n")))
    got = {r.n: r.b for r in df.collect()}
    assert all([tuple(b) for b in got[n]] == v for n, v in names.items()) and got[None] is None
    said = {r.n: r.c for r in df.select("n", parsing.name_conditions(F.col("b")).alias("c")).collect()}
    assert tuple(said["a_d60nm_c1p5ppb"]) == ("CALIBRATOR", "IONIC", 60.0, 1.5, None)
    assert tuple(said["n2E-3ugl_q250µlmin__x"]) == ("CALIBRATOR", "PARTICLE", None, 2e-3, 0.25)
    assert tuple(said[""]) == (None,) * 5


def test_sums_of_elements(spark):
    rows = [("s", c, i, 0.1 * i, float(10 * k + i)) for k, c in enumerate(("Ti48", "Ti50", "Cr50", "Cr52", "Cr52b")) for i in range(2)]
    p = spark.createDataFrame(rows, "sample_id string, channel string, idx int, time_s double, intensity double")
    ch = spark.createDataFrame([("Ti48", "Ti", 48), ("Ti50", "Ti", 50), ("Cr50", "Cr", 50), ("Cr52", "Cr", 52), ("Cr52b", "Cr", 52)], "channel string, element string, mass_number int")

    def sums(**how):
        return {(r.channel, r.idx): (r.intensity, r.n_isotopes) for r in traces.element_sum(p, ch, **how).collect()}

    assert sums() == {("ΣTi", 0): (10.0, 2), ("ΣTi", 1): (12.0, 2), ("ΣCr", 0): (50.0, 2), ("ΣCr", 1): (52.0, 2)}
    assert sums(exclude_isobars=True) == {("ΣTi", 0): (0.0, 1), ("ΣTi", 1): (1.0, 1), ("ΣCr", 0): (30.0, 1), ("ΣCr", 1): (31.0, 1)}
    assert sums(selected=["Ti50"]) == {("ΣTi", 0): (10.0, 1), ("ΣTi", 1): (11.0, 1)}


def test_p_by_model(spark):
    rows = [("s", "g", i, float(y), 10.0, 2.0, "GAUSSIAN") for i, y in enumerate((4, 10, 16, 40))] + [("s", "p", i, float(y), 3.0, 9.9, "POISSON") for i, y in enumerate((0, 3, 9, 400))]
    p = spark.createDataFrame(rows, "sample_id string, channel string, idx int, intensity double, location double, spread double, distr string")
    for model in thresholds.POISSON_MODELS:
        got = {(r.channel, r.intensity): r.p for r in thresholds.model_p(p, model, 0.4).collect()}
        for y in (4.0, 10.0, 16.0, 40.0):
            assert got["g", y] == pytest.approx(0.5 * math.erfc((y - 10) / 2 / math.sqrt(2)), rel=1e-6)
        tail = compound_poisson_tail(3.0, 0.4)
        want = {"POISSON_APPROXIMATION": lambda y: 0.5 * math.erfc((y - 3) / math.sqrt(6)), "POISSON_COMPOUND": lambda y: tail(y) if y else 1.0}.get(model, lambda y: poisson_mid_p(y, 3.0))
        assert all(got["p", y] == pytest.approx(max(1e-300, want(y)), rel=1e-6, abs=1e-299) for y in (0.0, 3.0, 9.0, 400.0)), model
    with pytest.raises(ValueError):
        thresholds.model_p(p, "NONE")


def test_number_efficiency(spark):
    s = spark.createDataFrame([("c", 6e7, 1.0, 500, 10.0), ("c", 1.2e8, 1.0, 1000, 10.0), ("z", 0.0, 1.0, 3, 1.0)], "channel string, particles_per_l double, flow_ml_min double, n_events long, seconds double")
    assert {r.channel: r.number_te_pct for r in quant.number_calibrated(s).collect()} == {"c": pytest.approx(5.0), "z": None}


def test_lines_and_blocks(spark):
    t = spark.createDataFrame([("b", 2, 5.0, 1.0), ("b", 1, 6.0, 1.0), ("a", 7, 8.0, 1.0)], "sample_id string, id int, area double, frame double")
    got = sorted(tuple(r) for r in sinks.lpc_lines(t, "id").collect())
    assert got == [("a", 0, 1.0, 20.0, 20.0, 7.0, 8.0), ("b", 0, 1.0, 40.0, 20.0, 1.0, 6.0), ("b", 1, 2.0, 40.0, 40.0, 2.0, 5.0)]
    s = spark.createDataFrame([("s", 0, "a", 1.0), ("s", 0, "b", 2.0), ("s", 2, "a", 3.0)], "sample_id string, event_ord int, channel string, intensity double")
    assert sorted(tuple(r) for r in sinks.transposed(s, [0, 2]).collect()) == [("s", "a", 1.0, 3.0), ("s", "b", 2.0, None)]
    assert [tuple(r) for r in sinks.side_by_side(s, "channel", ["a", "b"], ["intensity"], "event_ord").orderBy("row").collect()] == [(1, 1.0, 2.0), (2, 3.0, None)]


def test_isotopes_of_a_file(spark, tmp_path):
    chemistry.isotopes(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "iso"))
    loaded = chemistry.load_isotopes(spark, str(tmp_path / "iso"))
    assert sorted(loaded.collect()) == sorted(chemistry.isotopes(spark).collect())
    m = {r.element: r for r in chemistry.molar_masses(loaded).collect()}
    assert m["Ag"].molar_mass == pytest.approx(107.868, abs=1e-3) and m["Ag"].most_abundant == 107 and np.isclose(m["Au"].molar_mass, 196.9665688)
