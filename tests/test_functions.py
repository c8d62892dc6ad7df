"""Special functions against published values, formulas, labels and units."""

import math

import pytest
from pyspark.sql import functions as F

from blipstream.functions import chemistry, distributions, parsing
from blipstream.operators import baseline


def test_tails():
    assert distributions.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert distributions.chi2_tail(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.f_tail(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert distributions.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert distributions.poisson_mid_p(3, 2.0) == pytest.approx(1 - sum(math.exp(-2) * 2**k / math.factorial(k) for k in range(4)) + 0.5 * math.exp(-2) * 8 / 6)


def test_compound_limit_grows_with_the_shape():
    a, b = (distributions.compound_poisson_limit(5.0, s, 1e-3) for s in (0.2, 0.6))
    assert 12 < a < b < 40


def test_fisher_and_poisson_columns(spark):
    r = spark.range(1).select(
        baseline.fisher_tail(F.lit(4.0), F.lit(3)).alias("p"), baseline.poisson_limit(F.lit(4.5), 0.01).alias("k")
    ).first()
    assert r.p == pytest.approx(distributions.chi2_tail(8.0, 6)) and r.k == 11.0
    assert baseline.z_of(0.6) == 0.0 and baseline.z_of(1e-99) == 37.0 and baseline.z_of(0.025) == pytest.approx(1.959964, abs=1e-6)


def test_formulas():
    assert chemistry.parse_formula("Ca(OH)2") == {"Ca": 1.0, "O": 2.0, "H": 2.0}
    assert chemistry.parse_formula("Fe2O3") == {"Fe": 2.0, "O": 3.0} and chemistry.parse_formula("NaYb0.2F4")["Yb"] == 0.2
    assert chemistry.mass_fraction("TiO2", "Ti", {"Ti": 47.867, "O": 15.999}) == pytest.approx(0.5993, abs=1e-3)
    for bad in ("", "ti", "Ti(O", "Ti)2"):
        with pytest.raises(ValueError):
            chemistry.parse_formula(bad)


def test_labels(spark):
    rows = [("24Mg | 24Mg", "Mg", 24), ("56Fe.16O", "Fe", 56), ("Ag107", "Ag", 107), ("??", None, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "l string")
    assert [(r.x.element, r.x.mass_number) for r in df.select(parsing.channel_label(F.col("l")).alias("x")).collect()] == [(b, c) for _, b, c in rows]
    name = spark.createDataFrame([("a_d60nm_c1p5ppb",)], "n string").select(parsing.name_hint(F.col("n"), "nm").alias("d"), parsing.name_hint(F.col("n"), "ppb").alias("c"), parsing.name_hint(F.col("n"), "ppm").alias("x")).first()
    assert (name.d, name.c, name.x) == (60.0, 1.5, None)
