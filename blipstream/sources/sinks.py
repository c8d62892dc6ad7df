"""Tables that leave the engine."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blipstream.operators.scan import dealt, numbered


def raw_table(points: DataFrame, channels: list[str]) -> DataFrame:
    """SNK1: one column per channel; channels are given, so the pivot needs no pass of its own.

    A point is alone in its channel at its index, so each column takes what is there of its channel; points are dealt by index once.
    """
    return dealt(points, "sample_id", "idx").groupBy("sample_id", "idx").agg(*(F.first(F.when(F.col("channel") == c, F.col("intensity")), ignorenulls=True).alias(c) for c in channels))


def population_table(events: DataFrame) -> DataFrame:
    """SNK2."""
    return events.select("sample_id", "channel", "event_ord", "center_time_s", "area", "net_area", "height", "net_height", "duration_us", "n_points", "bg_per_event")


def matrix(spectra: DataFrame, channels: list[str]) -> DataFrame:
    """SNK7 by events: rows are particles, columns channels; write_transposed gives the other way."""
    return spectra.groupBy("sample_id", "event_ord").pivot("channel", channels).agg(F.sum("intensity"))


def transposed(spectra: DataFrame, events: list[int], value: str = "intensity") -> DataFrame:
    """SNK7 as features by particles: a row per channel, a column p0, p1, ... per listed event ordinal of a sample; empty where a channel has no value."""
    named = spectra.where(F.col("event_ord").isin(events)).withColumn("__p", F.concat(F.lit("p"), F.col("event_ord").cast("string")))
    return named.groupBy("sample_id", "channel").pivot("__p", [f"p{k}" for k in events]).agg(F.sum(value))


#: Columns of image-particle tables that lines don't carry (fixed values).
NOT_FEATURES = ("TARGET", "frame", "x", "y", "detection_time", "frame_id", "centroid_row", "centroid_col")


def lpc_lines(tables: DataFrame, order: str, step_um: float = 20.0, cycle_ms: float = 1.0) -> DataFrame:
    """SNK8: image particles as a laser line per sample: sample_id, row, cycle_ms, x_um, y_um and every feature, numbered in front as 0name, 1name and so on.

    Samples lie step_um apart along x, by name from one step on; particles along y in ``order``, and cycles follow each other
    evenly. Rows are numbered by ranges.
    """
    features = [c for c in tables.columns if c not in (*NOT_FEATURES, "sample_id")]
    at = numbered(tables, [F.col(order)], "row", ["sample_id"])
    lines = numbered(tables.select("sample_id").distinct(), [F.col("sample_id")], "__line")
    placed = at.join(lines, "sample_id").withColumns({"cycle_ms": (F.col("row") + 1) * cycle_ms, "x_um": (F.col("__line") + 1) * step_um, "y_um": (F.col("row") + 1) * step_um})
    return placed.select("sample_id", F.col("row").cast("int").alias("row"), "cycle_ms", "x_um", "y_um", *(F.col(f"`{c}`").cast("double").alias(f"{k}{c}") for k, c in enumerate(features)))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """SNK11: a directory of CSV parts with headers, written in parallel."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def side_by_side(df: DataFrame, by: str, groups: list[str], columns: list[str], order: str) -> DataFrame:
    """SNK11, horizontal blocks: rows of each group numbered in order (by ranges), one block of columns per group."""
    n = numbered(df, [F.col(order)], "row", [by]).withColumn("row", (F.col("row") + 1).cast("int"))
    return n.groupBy("row").pivot(by, groups).agg(*[F.first(c).alias(c) for c in columns])


def declared_rows(one_row: DataFrame, order: list[str]) -> DataFrame:
    """SRT8: a row of results as (metric, value) in declaration order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in order])
    return one_row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")


def custom_population(events: DataFrame, parameters: dict[str, Column], background: DataFrame | None = None) -> DataFrame:
    """SNK3: the chosen parameters, in the caller's units, of each event; with the trace's sampled background if given."""
    keyed = events if background is None else events.join(background, ["sample_id", "channel"], "left")
    extra = [] if background is None else ["background"]
    return keyed.select("sample_id", "channel", "event_ord", *[c.alias(k) for k, c in parameters.items()], *extra)


def error_table(raw: DataFrame) -> DataFrame:
    """SNK12: precision, recall and F of each trace, and their means and SDs over the traces of a sample as rows of channel mean and sd."""
    rates = ["precision", "recall", "f_score"]
    per = raw.select("sample_id", "channel", *rates)
    over = [per.groupBy("sample_id").agg(*[f(c).alias(c) for c in rates]).withColumn("channel", F.lit(k)) for k, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return per.unionByName(over[0]).unionByName(over[1])
