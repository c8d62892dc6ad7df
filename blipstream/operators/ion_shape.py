"""AGG25, AGG26: the log-sd of single-ion pulses, from the lowest non-zero values, from moments, or a blend of both."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stored import stored
from .scan import TRACE, numbered
from .search import spread_over
from .settle import settled

#: Traces need more zeros than this; more non-zero blanked points than this are used alone.
LEAST_ZEROS, LEAST_BLANKED = 50, 50
#: Fewer values than this give no estimate; rounds of clipping end here at the latest.
LEAST_VALUES, MOST_ROUNDS = 5, 20
#: Between these mean numbers of pulses a point the percentile window counts too.
BLEND = (0.1, 3.0)


def unblanked(points: DataFrame, blanked: DataFrame | None) -> DataFrame:
    """The points to use where ``blanked`` (trace, start_idx, end_idx) tells when the beam was off: those of the ranges alone if over 50 of them are not 0, else the others."""
    if blanked is None:
        return points
    inside = spread_over(blanked.select(*TRACE, "start_idx", "end_idx")).select(*TRACE, "idx").distinct().withColumn("__off", F.lit(True))
    marked = points.join(inside, [*TRACE, "idx"], "left").withColumn("__off", F.coalesce("__off", F.lit(False)))
    enough = marked.where("__off").groupBy(*TRACE).agg((F.sum((F.col("intensity") != 0).cast("long")) > LEAST_BLANKED).alias("__alone"))
    return marked.join(enough, TRACE, "left").where(F.col("__alone").isNull() | (F.col("__alone") == F.col("__off"))).drop("__off", "__alone")


def window_shape(points: DataFrame, rates: DataFrame, clip: float) -> DataFrame:
    """(trace, window): SD of the logarithms of the lowest non-zero values, as many as single pulses are expected among them, within clip SDs of their mean.

    Values are numbered by ranges; of n of them all up to the one at place ceil(n * rate * exp(-rate) / (1 - exp(-rate))) count, ties with it too.
    """
    ranked = numbered(points.where("intensity > 0").select(*TRACE, F.col("intensity").alias("v")), [F.col("v")], "__rank", TRACE)
    p0 = F.exp(-F.col("rate"))
    last = F.least(F.col("positive") - 1, F.ceil(F.col("rate") * p0 / (1 - p0) * F.col("positive")))
    edge = ranked.join(rates.select(*TRACE, last.alias("__rank")).where("__rank > 0"), [*TRACE, "__rank"]).select(*TRACE, F.col("v").alias("__edge"))
    window = stored(ranked.join(edge, TRACE).where("v <= __edge").select(*TRACE, F.log("v").alias("__x")), "ion-window")
    everything = window.select(*TRACE).distinct().withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
    stats = [F.avg("__in").alias("__mean"), F.coalesce(F.stddev_pop("__in"), F.lit(0.0)).alias("__sd")]
    done = settled(window, everything, stats, lambda: (F.col("__mean") - clip * F.col("__sd"), F.col("__mean") + clip * F.col("__sd")), "ion-window-round", MOST_ROUNDS, LEAST_VALUES)
    return done.select(*TRACE, F.when((F.col("n") >= LEAST_VALUES) & (F.col("__sd") > 0), F.col("__sd")).alias("window"))


def moment_shape(points: DataFrame, rates: DataFrame, trim: float) -> DataFrame:
    """(trace, moments): sqrt(ln(variance * rate / mean**2)) of all values but spikes, which lie over trim SDs above the mean of the non-zero rest."""
    values = points.select(*TRACE, F.col("intensity").alias("__x"))
    positive = F.when(F.col("__in") > 0, F.col("__in"))
    stats = [F.count(positive).alias("__k"), F.avg(positive).alias("__mean"), F.coalesce(F.stddev_pop(positive), F.lit(0.0)).alias("__sd"), F.avg("__in").alias("__m"), F.var_pop("__in").alias("__v")]
    everything = rates.select(*TRACE).withColumns({"__lo": F.lit(float("-inf")), "__hi": F.lit(float("inf"))})
    # What was cut once stays cut.
    done = settled(values, everything, stats, lambda: (F.lit(float("-inf")), F.least(F.col("__was_hi"), F.coalesce(F.col("__mean") + trim * F.col("__sd"), F.lit(float("inf"))))), "ion-moment-round", MOST_ROUNDS + 1, LEAST_VALUES)
    ratio = F.try_divide(F.col("__v") * F.col("rate"), F.col("__m") * F.col("__m"))
    found = done.join(rates.select(*TRACE, "rate"), TRACE)
    return found.select(*TRACE, F.when((F.col("__k") >= LEAST_VALUES) & (ratio > 1), F.sqrt(F.log(ratio))).alias("moments"))


def ion_shape(points: DataFrame, blanked: DataFrame | None = None, clip: float = 5.0, trim: float = 5.0) -> DataFrame:
    """AGG25: (trace, rate, window, moments, shape) of traces of counted ions: the log-sd of one pulse, null where nothing can be said.

    ``rate``, the mean number of pulses a point, follows from the share of zeros, of which there must be over 50. The
    estimate from a window of ranks and that from moments are blended by 1 - 3t**2 + 2t**3, t the distance of rate from
    the middle of BLEND by half its width; outside, and where the other fails, one counts alone. See unblanked for
    ``blanked``. Every round of clipping is one aggregation; of a trace only one row moves between rounds.
    """
    used = stored(unblanked(points.select(*TRACE, "idx", "intensity"), blanked), "ion-points")
    zeros = F.sum((F.col("intensity") == 0).cast("long"))
    s = used.groupBy(*TRACE).agg(F.count("*").alias("n"), zeros.alias("zeros"), F.sum((F.col("intensity") > 0).cast("long")).alias("positive"))
    counted = stored(s.withColumn("rate", F.when(F.col("zeros") > LEAST_ZEROS, -F.log(F.col("zeros") / F.col("n")))), "ion-rates")
    rates = counted.where("rate > 0")
    both = counted.join(window_shape(used, rates, clip), TRACE, "left").join(moment_shape(used, rates, trim), TRACE, "left")
    middle, half = (BLEND[0] + BLEND[1]) / 2, (BLEND[1] - BLEND[0]) / 2
    t = F.least(F.lit(1.0), F.abs(F.col("rate") - middle) / half)
    weight = F.when(F.col("rate").between(*BLEND), 1 - t * t * (3 - 2 * t)).otherwise(0.0)
    blend = weight * F.col("window") + (1 - weight) * F.col("moments")
    return both.select(*TRACE, "rate", "window", "moments", F.coalesce(blend, F.col("moments"), F.col("window")).alias("shape"))


def mean_ion_shape(shapes: DataFrame) -> DataFrame:
    """AGG26: (sample_id, channels, shape): the mean over the channels of a sample that have a shape."""
    return shapes.groupBy("sample_id").agg(F.count("shape").alias("channels"), F.avg("shape").alias("shape"))
