"""What is one row per trace goes to the points; no join puts all points of a trace into one task."""

import pytest
from pyspark.sql import functions as F

from blipstream.operators import baseline, search, traces
from blipstream.plans.method import with_thresholds


@pytest.fixture
def points(spark):
    """Points too large, by Spark's estimate, for what is aggregated from them to be taken as small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    x = F.pmod(F.col("id") * 7919, F.lit(101)).cast("double")
    yield spark.range(40_000).select(F.lit("s").alias("sample_id"), F.concat(F.lit("c"), F.col("id") % 2).alias("channel"), F.floor(F.col("id") / 2).cast("int").alias("idx"), (F.col("id") * 0.1).alias("time_s"), x.alias("intensity"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins_by_trace(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_clipping_sends_bounds_to_the_points(points):
    made = baseline.clipped(points.withColumn("slice_idx", F.lit(0)), 3)
    assert joins_by_trace(made) == 0
    assert {r.channel: r.n_kept for r in made.collect()} == {"c0": 20_000, "c1": 20_000}


@pytest.mark.parametrize("made", [search.rounded, lambda p: traces.segment(p, 5000), lambda p: with_thresholds(p, p.groupBy("sample_id", "channel").agg(F.avg("intensity").alias("location"), F.stddev("intensity").alias("spread")), 0.5, 1.0)])
def test_rows_of_traces_go_to_the_points(points, made):
    assert joins_by_trace(made(points)) == 0


def test_sums_in_time_have_open_starts_and_closed_ends(spark):
    """Points at both ends of the window, equal times, a window without points; and no row per pair of peak and point."""
    from blipstream.operators import events

    times = [0.0, 1.0, 1.0, 2.0, 3.0, 3.0, 9.0]
    free = spark.createDataFrame([("s", "c", t, str(10**k)) for k, t in enumerate(times)], "sample_id string, channel string, time_s double, v string").select("sample_id", "channel", "time_s", F.col("v").cast("decimal(28,6)").alias("y"))
    peaks = spark.createDataFrame([("s", "c", i, t) for i, t in enumerate([2.0, 0.5, 6.0, 3.0])], "sample_id string, channel string, start_idx int, t double")
    got = {r.start_idx: (r.n, float(r.total)) for r in events.sums_in_time(peaks, free, 1.0, "y").collect()}
    assert got == {i: (len(k), float(sum(10**j for j in k))) for i, k in enumerate([[j for j, x in enumerate(times) if t - 1 < x <= t + 1] for t in (2.0, 0.5, 6.0, 3.0)])}


def test_slices_stay_dealt_over_tasks(spark):
    """Slices of few bytes aren't put together into one task."""
    from blipstream.operators import kernels

    p = spark.range(20_000).select(F.lit("s").alias("sample_id"), F.lit("c").alias("channel"), F.floor(F.col("id") / 500).cast("int").alias("slice_idx"), F.pmod(F.col("id") * 7919, F.lit(101)).cast("double").alias("intensity"))
    for made in (kernels.rosner(p), kernels.truncated_poisson(p)):
        assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1


@pytest.fixture
def many_tasks(spark):
    """More shuffle partitions than rows of so few bytes would be left in, if Spark put them together."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield 16
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranges_of_numbers_stay_apart(spark, many_tasks):
    from blipstream.operators import scan

    made = scan.numbered(spark.range(20_000).select("id", (F.col("id") % 3).alias("k")), [F.col("id").desc()], "n", ["k"])
    assert len(made.inputFiles()) == many_tasks
    assert {(r.k, r.n): r.id for r in made.collect()} == {(k, n): x for k in range(3) for n, x in enumerate(sorted(range(k, 20_000, 3), reverse=True))}


def test_raw_table_stays_dealt_over_tasks(points, many_tasks):
    """Also indices that a channel lacks, channels that aren't asked for, and values that are null."""
    from blipstream.sources import sinks

    p = points.where("idx < 3000 or channel = 'c1'").withColumns({"intensity": F.when(F.col("idx") != 7, F.col("intensity")), "sample_id": F.concat(F.lit("s"), F.col("idx") % 1)})
    made = sinks.raw_table(p, ["c1", "c0", "c9"])
    assert made.columns == ["sample_id", "idx", "c1", "c0", "c9"]
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() == many_tasks
    want = {i: ((float((2 * i + 1) * 7919 % 101), float(2 * i * 7919 % 101) if i < 3000 else None) if i != 7 else (None, None)) for i in range(20_000)}
    assert {r.idx: (r.c1, r.c0) for r in made.collect()} == want and made.where("c9 is not null").isEmpty()


def test_runs_and_sums_stay_dealt_over_tasks(points, many_tasks):
    """Runs of a trace, and blocks of a running sum, aren't put together into a task; results are those of any dealing."""
    from blipstream.operators import scan

    p = points.withColumn("sample_id", F.concat(F.lit("s"), F.col("idx") % 1)).withColumns({"start_thr": F.lit(60.0), "stop_thr": F.lit(40.0), "height_thr": F.lit(80.0)})
    keyed = search.keyed_runs(p)
    assert keyed.select(F.spark_partition_id().alias("task")).distinct().count() == many_tasks
    summed = scan.running_sum(p, F.col("idx").cast("long"), "total", block=100)
    assert "REPARTITION_BY_NUM" in summed._jdf.queryExecution().executedPlan().toString()
    assert summed.where("total <> idx * (idx + 1L) div 2").isEmpty() and summed.count() == 40_000
