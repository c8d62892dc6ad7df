"""Calibration: from counts to mass, moles and size."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import slope_only


def quantify(events: DataFrame, calibration: DataFrame, value: str = "net_area") -> DataFrame:
    """PRJ3, SC10: mass in fg, equivalent diameter in nm.

    MASS divides by the particle response; SIZE and FREQUENCY by the ionic response over the transport
    efficiency. Diameter of a sphere of the given density (g/cm3) and mass fraction. calibration has one row a channel.
    """
    joined = events.join(calibration, ["sample_id", "channel"])
    mass = F.when(F.col("strategy") == "MASS", F.col(value) / F.col("np_cts_per_fg")).otherwise(F.col(value) / F.col("ionic_cts_per_fg") * (F.col("aerosol_te_pct") / 100))
    # fg over g/cm3 gives 1e-15 cm3; a nanometre is 1e-7 cm.
    size = F.cbrt(6 * F.col("mass_fg") * 1e-15 / (F.col("mass_fraction") * F.col("density_g_cm3") * math.pi)) * 1e7
    return joined.withColumn("mass_fg", mass).withColumn("diameter_nm", F.when(F.col("mass_fg") > 0, size))


def revert(mass_fg: Column, strategy: Column, np_response: Column, ionic: Column, te: Column) -> Column:
    """FIL4: the counts that give a mass."""
    return F.when(strategy == "MASS", mass_fg * np_response).otherwise(mass_fg * ionic / (te / 100))


def number_concentration(n: Column, seconds: Column, te_pct: Column, flow_ml_min: Column) -> Column:
    """AGG6: particles per ml."""
    return 60 * n / seconds / (te_pct / 100) / flow_ml_min


def filled_te(calibration: DataFrame) -> DataFrame:
    """SC11: a missing aerosol efficiency comes from the first other channel of the sample that has one; the number efficiency falls back to it."""
    w = Window.partitionBy("sample_id").orderBy("channel").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    any_te = F.first(F.when(F.col("aerosol_te_pct") > 0, F.col("aerosol_te_pct")), ignorenulls=True).over(w)
    te = F.when(F.col("aerosol_te_pct") > 0, F.col("aerosol_te_pct")).otherwise(any_te)
    return calibration.withColumn("aerosol_te_pct", te).withColumn("number_te_pct", F.when(F.col("number_te_pct") > 0, F.col("number_te_pct")).otherwise(F.col("aerosol_te_pct")))


def background_equivalent(mean_counts: Column, dt_s: Column, sensitivity: Column, flow_ml_min: Column) -> Column:
    """AGG12: background as concentration: counts per second over sensitivity (counts per fg) and flow, in ug/l."""
    return mean_counts / dt_s / sensitivity / (flow_ml_min / 60) * 1e-6


def efficiency(np_response: Column, ionic: Column) -> Column:
    """MOD5."""
    return 100 * ionic / np_response


def lognormal_sum(mean: Column, sd: Column, n: Column) -> Column:
    """SC19: mu and sigma of the lognormal with the mean and variance of n independent ones."""
    total, var = mean * n, sd * sd * n
    sigma2 = F.log(1 + var / (total * total))
    return F.struct((F.log(total) - sigma2 / 2).alias("mu"), F.sqrt(sigma2).alias("sigma"))


def lognormal_sum_lo(mean: Column, sd: Column, n: Column) -> Column:
    """SC19: the same by Lo's rule, which fits few summands better: sigma is the single one's over the root of n."""
    sigma2 = F.log(1 + sd * sd / (mean * mean)) / n
    return F.struct((F.log(mean * n) - sigma2 / 2).alias("mu"), F.sqrt(sigma2).alias("sigma"))


def calibrated(standards: DataFrame, ionic: DataFrame) -> DataFrame:
    """MOD5: per channel, the response to particles (slope of net signal over mass) and to ions (slope of counts over mass flow), both through the origin, and the aerosol efficiency in percent that follows."""
    np_ = slope_only(standards, ["channel"], "mass_fg", "net_signal").withColumnRenamed("slope", "np_cts_per_fg")
    free = slope_only(ionic, ["channel"], "flow_fg_s", "cps").withColumnRenamed("slope", "ionic_cts_per_fg")
    return np_.join(free, "channel").withColumn("aerosol_te_pct", efficiency(F.col("np_cts_per_fg"), F.col("ionic_cts_per_fg")))


def across_channels(per_channel: DataFrame) -> DataFrame:
    """AGG16: over channels (n_events, drift): mean events, rounded up, and the drift halfway between mean and largest."""
    return per_channel.agg(F.ceil(F.avg("n_events")).alias("mean_events"), (0.5 * (F.max("drift") + F.avg("drift"))).alias("drift"))


def number_calibrated(standards: DataFrame) -> DataFrame:
    """MOD5: per channel, the number efficiency in percent: the slope through the origin of detected over delivered particles per second.

    standards has (channel, particles_per_l, flow_ml_min, n_events, seconds) of particle calibrators.
    """
    rates = standards.select("channel", (F.col("particles_per_l") * F.col("flow_ml_min") / 60_000).alias("delivered"), F.try_divide(F.col("n_events"), F.col("seconds")).alias("detected"))
    return slope_only(rates, ["channel"], "delivered", "detected").select("channel", (100 * F.col("slope")).alias("number_te_pct"))
