"""Joins between events: overlap matching, alignment across channels, nearest m/z, isobars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scan import TRACE, numbered, running_sum
from .search import merge_intervals, spread_over


def overlaps(a: DataFrame, b: DataFrame, bin_width: int = 256) -> DataFrame:
    """All overlapping pairs (start_idx, end_idx of a; other_start, other_end of b) per trace.

    Both sides are cut into bins of the index and joined on the bin; a pair counts only in the bin where
    its overlap begins, so nothing is repeated and no Cartesian product appears.
    """

    def binned(df: DataFrame) -> DataFrame:
        return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_idx") / bin_width), F.floor(F.col("end_idx") / bin_width))))

    other = binned(b.select(*TRACE, "start_idx", "end_idx")).withColumnsRenamed({"start_idx": "other_start", "end_idx": "other_end"})
    joined = binned(a.select(*TRACE, "start_idx", "end_idx")).join(other, [*TRACE, "__bin"]).where("start_idx <= other_end and end_idx >= other_start")
    return joined.where(F.floor(F.greatest("start_idx", "other_start") / bin_width) == F.col("__bin")).drop("__bin")


def first_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """JOI4: for each interval of a the first overlapping one of b, null if there is none; b may serve again."""
    first = overlaps(a, b).groupBy(*TRACE, "start_idx", "end_idx").agg(F.min(F.struct("other_start", "other_end")).alias("__m"))
    return a.select(*TRACE, "start_idx", "end_idx").join(first, [*TRACE, "start_idx", "end_idx"], "left").select(*TRACE, "start_idx", "end_idx", F.col("__m.other_start").alias("match_start"), F.col("__m.other_end").alias("match_end"))


def error_rates(truth: DataFrame, found: DataFrame) -> DataFrame:
    """AGG23, AGG27, FIL18: matched, missed and false events per trace; precision, recall and F (0/0 is 1)."""
    t = first_match(truth, found).groupBy(*TRACE).agg(F.count("*").alias("n_truth"), F.count("match_start").alias("matched"))
    f = first_match(found, truth).groupBy(*TRACE).agg(F.count("*").alias("n_found"), F.count("match_start").alias("tp"))
    both = t.join(f, TRACE, "full").fillna(0, ["n_truth", "matched", "n_found", "tp"])
    p = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("tp") / F.when(F.col("n_found") > 0, F.col("n_found")))
    r = F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("matched") / F.when(F.col("n_truth") > 0, F.col("n_truth")))
    return both.withColumn("fp", F.col("n_found") - F.col("tp")).withColumn("fn", F.col("n_truth") - F.col("matched")).withColumn("precision", p).withColumn("recall", r).withColumn(
        "f_score", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    )


def by_coverage(events: DataFrame) -> DataFrame:
    """JOI5: per sample the maximal runs of indices that any channel's event covers; adjacent intervals fuse."""
    return merge_intervals(events.select("sample_id", F.lit("*").alias("channel"), "start_idx", "end_idx"), touch=1)


def by_connection(events: DataFrame) -> DataFrame:
    """JOI6: hulls of events of a sample that are linked by one shared index (either has at most 3 points) or two (both have more).

    Links are found by the binned overlap join; what they connect, over any number of steps, are the components of
    the links between numbered events.
    """
    keyed = numbered(events.select("sample_id", F.lit("*").alias("channel"), "start_idx", "end_idx").distinct(), [F.col("sample_id"), F.col("start_idx"), F.col("end_idx")], "node")
    names = keyed.select(*TRACE, "start_idx", "end_idx", F.col("node").alias("a"))
    shared = F.least("end_idx", "other_end") - F.greatest("start_idx", "other_start") + 1
    short = (F.col("end_idx") - F.col("start_idx") < 3) | (F.col("other_end") - F.col("other_start") < 3)
    links = overlaps(keyed, keyed).where(F.when(short, shared >= 1).otherwise(shared >= 2))
    theirs = names.withColumnsRenamed({"start_idx": "other_start", "end_idx": "other_end", "a": "b"})
    pairs = links.join(names, [*TRACE, "start_idx", "end_idx"]).join(theirs, [*TRACE, "other_start", "other_end"]).where("a < b").select("a", "b")
    joined = keyed.join(components(pairs), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return joined.groupBy(*TRACE, "component").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("component")


def broadcast_to_channels(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """JOI7: each aligned interval on every channel of its sample; peak, area and height anew. Channels of a sample are few; points meet by index."""
    rows = spread_over(intervals.select("sample_id", "start_idx", "end_idx")).join(points.select("sample_id", "channel", "idx", "intensity"), ["sample_id", "idx"])
    return rows.groupBy(*TRACE, "start_idx", "end_idx").agg(
        F.count("*").alias("n_points"), F.sum("intensity").alias("area"), F.max("intensity").alias("height"), F.min_by("idx", F.struct(-F.col("intensity"), "idx")).alias("peak_idx")
    )


def nearest(wanted: DataFrame, recorded: DataFrame, tolerance: float) -> DataFrame:
    """JOI9, SRC10: for each wanted mz the closest recorded mz within tolerance (the smaller on a tie), by bins of the tolerance."""
    b = F.floor(F.col("mz") / tolerance)
    left = wanted.withColumn("__bin", F.explode(F.array(b - 1, b, b + 1)))
    right = recorded.select(F.floor(F.col("recorded_mz") / tolerance).alias("__bin"), "recorded_mz")
    near = left.join(right, "__bin").where(F.abs(F.col("mz") - F.col("recorded_mz")) <= tolerance)
    return near.groupBy(*wanted.columns).agg(F.min_by("recorded_mz", F.struct(F.round(F.abs(F.col("mz") - F.col("recorded_mz")), 9), "recorded_mz")).alias("recorded_mz"))


def isobars(isotopes: DataFrame) -> DataFrame:
    """JOI10: mass numbers that two or more elements claim."""
    return isotopes.groupBy("mass_number").agg(F.array_sort(F.collect_set("element")).alias("elements")).where(F.size("elements") > 1)


def interferences(isotopes: DataFrame, mass: float, width: float = 0.5, shift: float = 15.9949) -> DataFrame:
    """JOI11: isotopes whose own mass, oxide, doubly charged ion or dimer lies within width of mass."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("at")) for k, e in (("atom", F.col("exact_mass")), ("oxide", F.col("exact_mass") + shift), ("doubly charged", F.col("exact_mass") / 2), ("dimer", F.col("exact_mass") * 2))])
    return isotopes.select("element", "mass_number", F.explode(kinds).alias("__k")).select("element", "mass_number", "__k.kind", "__k.at").where(F.abs(F.col("at") - mass) <= width)


def interferences_of(wanted: DataFrame, isotopes: DataFrame, width: float = 0.5, shift: float = 15.9949) -> DataFrame:
    """JOI11 for a column of masses: wanted (mass, more) with the isotopes whose atom, oxide, doubly charged ion or dimer lies within width, by bins of width."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("at")) for k, e in (("atom", F.col("exact_mass")), ("oxide", F.col("exact_mass") + shift), ("doubly charged", F.col("exact_mass") / 2), ("dimer", F.col("exact_mass") * 2))])
    species = isotopes.select("element", "mass_number", F.explode(kinds).alias("__k")).select("element", "mass_number", "__k.kind", "__k.at", F.floor(F.col("__k.at") / width).alias("__bin"))
    b = F.floor(F.col("mass") / width)
    near = wanted.withColumn("__bin", F.explode(F.array(b - 1, b, b + 1))).join(species, "__bin")
    return near.where(F.abs(F.col("at") - F.col("mass")) <= width).drop("__bin")


def numbered_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET6: number of shared indices of each overlapping pair."""
    return overlaps(a, b).withColumn("shared", F.least("end_idx", "other_end") - F.greatest("start_idx", "other_start") + 1)


def rank_average(df: DataFrame, value: str) -> DataFrame:
    """SEQ19: ranks over the whole table, ties averaged; null has none.

    Distinct values are counted, numbered by ranges and summed by blocks, so no task holds them all.
    """
    values = numbered(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")), [F.col(value)], "__at").withColumn("__all", F.lit(1))
    summed = running_sum(values, F.col("__n"), "__upto", ["__all"], "__at")
    ranked = summed.select(value, (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2).alias("rank"))
    return df.join(ranked, value)
