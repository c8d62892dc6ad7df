"""Trace, baseline, search and event queries over the events and lineitem tables, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blipstream.operators import accumulate, baseline, events, kernels, scan, search, traces

from .inputs import COUNT_POINTS, EVENT_POINTS, count_points, event_points, table
from .method import find, with_thresholds
from .stored import stored

Q, SQL = {}, {}
Z, OFFSET = 1.0, 0.5


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def tail_sql(z: str, density: str, steps: int = 4000) -> str:
    """The integral of density (of y) from z to infinity: midpoints of s in y = z + s / (1 - s)."""
    y, s_ = f"({z} + ((i + 0.5) / {steps}) / (1 - (i + 0.5) / {steps}))", f"((i + 0.5) / {steps})"
    return f"list_sum(list_transform(range(0, {steps}), lambda i: {density.replace('y', y)} / ((1 - {s_}) * (1 - {s_})) / {steps}))"


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def clip_sql(rounds: int, spread: str = "coalesce(stddev_samp(intensity), 0)", z: float = 3.0, offset: float = 0.0, source: str = "pts", key: str = "channel") -> str:
    """CTEs b (key, location, spread, n_kept) after rounds of clipping."""
    out, last = [], source
    for i in range(rounds):
        out.append(f"m{i} AS (SELECT {key}, avg(intensity) AS loc, {spread} AS sd FROM {last} GROUP BY {key})")
        out.append(f"k{i} AS (SELECT x.* FROM {last} x JOIN m{i} USING ({key}) WHERE abs(x.intensity - loc) <= {z} * sd + {offset})")
        last = f"k{i}"
    out.append(f"b AS (SELECT {key}, avg(intensity) AS location, {spread} AS spread, count(*) AS n_kept FROM {last} GROUP BY {key})")
    return ", ".join(out)


THR = f"t AS (SELECT p.*, location, spread, greatest(0.1, location) + {OFFSET} AS s, greatest(0.1, location + {Z} * spread) AS h FROM pts p JOIN b USING (channel))"
RUNS = """g AS (SELECT *, intensity < s AND (intensity < s OR intensity <= 0) AS brk, lead(h) OVER (PARTITION BY channel ORDER BY idx) AS h_next,
  sum(CASE WHEN intensity < s AND (intensity < s OR intensity <= 0) THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM t),
o AS (SELECT *, min(CASE WHEN intensity >= s THEN idx END) OVER (PARTITION BY channel, island) AS opened FROM g WHERE NOT brk),
e AS (SELECT channel, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_points, sum(intensity) AS area, max(intensity) AS height,
  arg_min(idx, row(-intensity, idx)) AS peak_idx, coalesce(arg_max(h_next, idx), arg_max(h, idx)) AS h_end, any_value(location) AS location
  FROM o WHERE idx >= opened GROUP BY channel, island HAVING max(intensity) > coalesce(arg_max(h_next, idx), arg_max(h, idx)))"""
FOUND = f"WITH {EVENT_POINTS}, {clip_sql(5)}, {THR}, {RUNS}"


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = event_points(spark, sf_dir)
    return points, stored(baseline.clipped(points.withColumn("slice_idx", F.lit(0))).drop("slice_idx", "n_kept"), "baselines")


def found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    points, location = model(spark, sf_dir)
    return points, location, stored(find(points, location, OFFSET, Z), "events")


@query(FOUND + """ SELECT channel, count(*) AS n_events, round(sum(area - greatest(0.1, location) * n_points), 6) AS net_area, round(avg(height), 6) AS mean_height,
  round(avg(n_points), 6) AS mean_points, round(any_value(location), 6) AS location FROM e GROUP BY channel""")
def flagship_report(spark, sf_dir):
    """SEQ2a, SEQ4a, SEQ7a, AGG6, AGG7: background, search, net correction and the per-channel report."""
    _, _, e = found(spark, sf_dir)
    return e.groupBy("channel").agg(F.count("*").alias("n_events"), F.round(F.sum("net_area"), 6).alias("net_area"), F.round(F.avg("height"), 6).alias("mean_height"), F.round(F.avg("n_points"), 6).alias("mean_points"), F.round(F.first("location"), 6).alias("location"))


@query(f"WITH {EVENT_POINTS} SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS INTEGER) AS idx, round(time_s, 6) AS time_s, intensity FROM pts WHERE time_s BETWEEN 100000 AND 1500000")
def fil1_time_roi(spark, sf_dir):
    return traces.time_roi(event_points(spark, sf_dir), 100000, 1500000).select("channel", "idx", F.round("time_s", 6).alias("time_s"), "intensity")


@query(f"WITH {COUNT_POINTS} SELECT channel, CAST(idx - 99 AS INTEGER) AS idx, intensity FROM pts WHERE idx BETWEEN 99 AND 999")
def fil1_constant_roi(spark, sf_dir):
    return traces.constant_roi(count_points(spark, sf_dir), 1e-4, 0.01, 0.1).select("channel", "idx", "intensity")


@query(f"""WITH {EVENT_POINTS}, n AS (SELECT channel, count(*) AS n FROM pts GROUP BY channel)
SELECT channel, slice_idx, count(*) AS n_points, round(sum(intensity), 6) AS total FROM (SELECT channel, intensity,
  CAST(least(idx // 150, greatest(1, n // 150 + CASE WHEN n % 150 >= 100 THEN 1 ELSE 0 END) - 1) AS INTEGER) AS slice_idx FROM pts JOIN n USING (channel)) GROUP BY channel, slice_idx""")
def seq0_segments(spark, sf_dir):
    s = traces.segment(event_points(spark, sf_dir), 150)
    return s.groupBy("channel", "slice_idx").agg(F.count("*").alias("n_points"), F.round(F.sum("intensity"), 6).alias("total"))


@query(f"WITH {COUNT_POINTS} SELECT channel, CAST(idx // 7 AS INTEGER) AS idx, sum(intensity) AS intensity FROM pts GROUP BY channel, idx // 7 HAVING count(*) = 7")
def seq9_rebin(spark, sf_dir):
    return traces.rebin(count_points(spark, sf_dir), 7).select("channel", "idx", "intensity")


@query(f"""WITH {EVENT_POINTS}, d AS (SELECT *, lag(time_s) OVER (PARTITION BY channel ORDER BY idx) AS before,
  max(CASE WHEN idx = 2 THEN time_s END) OVER (PARTITION BY channel) - max(CASE WHEN idx = 1 THEN time_s END) OVER (PARTITION BY channel) AS third FROM pts)
SELECT channel, idx, round(intensity * CASE WHEN idx < 2 THEN third ELSE time_s - before END, 4) AS counts FROM d""")
def prj4_cps_to_counts(spark, sf_dir):
    return traces.cps_to_counts(event_points(spark, sf_dir)).select("channel", "idx", F.round("counts", 4).alias("counts"))


@query(f"""WITH {EVENT_POINTS}, s AS (SELECT channel, count(*) AS n, min(time_s) AS a, max(time_s) AS z, max(CASE WHEN idx = 1 THEN time_s END) AS t1, max(CASE WHEN idx = 2 THEN time_s END) AS t2 FROM pts GROUP BY channel)
SELECT channel, n AS n_points, round((z - t1 - (t2 - t1) + 2 * (t2 - t1)) / n, 4) AS dt_s, round(z - a + (z - t1 - (t2 - t1) + 2 * (t2 - t1)) / n, 4) AS duration_s FROM s""")
def d6_dwell_times(spark, sf_dir):
    return traces.dwell_times(event_points(spark, sf_dir)).select("channel", "n_points", F.round("dt_s", 4).alias("dt_s"), F.round("duration_s", 4).alias("duration_s"))


@query(f"""WITH {EVENT_POINTS}, u AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY idx) AS k FROM pts WHERE intensity <> 0)
SELECT channel, avg(abs(floor(intensity + 0.5) - intensity)) < 0.15 AS is_integer FROM u WHERE k <= 10000 GROUP BY channel""")
def d6_is_integer(spark, sf_dir):
    return traces.is_integer(event_points(spark, sf_dir)).select("channel", "is_integer")


@query(f"""WITH {COUNT_POINTS}, v AS (SELECT DISTINCT channel, floor(intensity + 0.5) AS v FROM pts WHERE intensity <> 0),
g AS (SELECT DISTINCT channel, v - before AS gap FROM (SELECT *, lag(v) OVER (PARTITION BY channel ORDER BY v) AS before FROM v) WHERE before IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY gap) AS nth FROM g)
SELECT channel, sum(CASE WHEN nth <= 3 THEN gap END) <= 12 OR sum(gap) < 10 AS is_counts FROM r GROUP BY channel""")
def prj5_count_data(spark, sf_dir):
    return traces.looks_like_counts(count_points(spark, sf_dir)).select("channel", "is_counts")


@query(f"""WITH {EVENT_POINTS}, s AS (SELECT channel, avg(intensity) AS mean, quantile_cont(intensity, 0.5) AS median, coalesce(stddev_samp(intensity), 0) AS sd FROM pts GROUP BY channel)
SELECT channel, round(any_value(mean), 6) AS mean, round(any_value(median), 6) AS median, round(any_value(sd), 6) AS sd, round(quantile_cont(abs(intensity - median), 0.5) * 1.4826, 6) AS mad_sd FROM pts JOIN s USING (channel) GROUP BY channel""")
def agg1_trace_stats(spark, sf_dir):
    return traces.trace_stats(event_points(spark, sf_dir)).select("channel", *r6("mean", "median", "sd", "mad_sd"))


@query("""WITH pts AS (SELECT c_mktsegment AS channel, c_acctbal AS intensity FROM customer),
s AS (SELECT channel, quantile_cont(intensity, 0.5) AS median, quantile_cont(intensity, 0.5) FILTER (WHERE intensity > 0) AS m FROM pts GROUP BY channel),
d AS (SELECT channel, quantile_cont(abs(intensity - m), 0.5) * 1.4826 AS d FROM pts JOIN s USING (channel) WHERE intensity > 0 GROUP BY channel)
SELECT channel, round(median, 6) AS median, round(m, 6) AS median_non_zero, round(CASE WHEN median = 0 THEN m ELSE median END, 6) AS median_avoid_zero, round(d, 6) AS mad_non_zero FROM s JOIN d USING (channel)""")
def agg2_avoid_zero(spark, sf_dir):
    pts = table(spark, sf_dir, "customer").select(F.lit("s1").alias("sample_id"), F.col("c_mktsegment").alias("channel"), F.col("c_acctbal").alias("intensity"))
    return traces.avoid_zero_stats(pts.withColumn("intensity", F.col("intensity"))).select("channel", *r6("median", "median_non_zero", "median_avoid_zero", "mad_non_zero"))


@query(f"""WITH {COUNT_POINTS}, f AS (SELECT channel, intensity, count(*) AS n, min(idx) AS first FROM pts GROUP BY channel, intensity)
SELECT channel, intensity AS mode, n FROM f QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, first) = 1""")
def agg5_mode(spark, sf_dir):
    return traces.mode(count_points(spark, sf_dir)).select("channel", "mode", "n")


@query(f"WITH {EVENT_POINTS}, d AS (SELECT channel, intensity - lag(intensity) OVER (PARTITION BY channel ORDER BY idx) AS d FROM pts) SELECT channel, round(sqrt(avg(d * d)), 6) AS rmsd FROM d GROUP BY channel")
def agg17_rmsd(spark, sf_dir):
    return traces.rmsd(event_points(spark, sf_dir)).select("channel", *r6("rmsd"))


@query(f"WITH {EVENT_POINTS} SELECT channel, idx, round(avg(intensity) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW), 5) AS smooth FROM pts")
def seq12_moving_average(spark, sf_dir):
    return traces.moving_average(event_points(spark, sf_dir), 9).select("channel", "idx", F.round("smooth", 5).alias("smooth"))


def kernel_sql(weights: list[float]) -> str:
    half, total = len(weights) // 2, sum(weights)
    return f"""WITH {EVENT_POINTS}, n AS (SELECT channel, count(*) AS n FROM pts GROUP BY channel), j AS (SELECT unnest(range({-half}, {half + 1})) AS j, unnest({weights}::DOUBLE[]) AS w),
q AS (SELECT p.channel, p.idx, w, CASE WHEN p.idx + j < 0 THEN -(p.idx + j) WHEN p.idx + j > n - 1 THEN 2 * (n - 1) - (p.idx + j) ELSE p.idx + j END AS at FROM pts p JOIN n USING (channel), j)
SELECT q.channel, q.idx, round(sum(q.w * v.intensity) / {total!r}, 5) AS smooth FROM q JOIN pts v ON v.channel = q.channel AND v.idx = q.at GROUP BY q.channel, q.idx"""


KERNEL = [0.1, 0.25, 0.3, 0.25, 0.1]


@query(kernel_sql(KERNEL))
def seq12_kernel(spark, sf_dir):
    return traces.kernel_smooth(event_points(spark, sf_dir), KERNEL).select("channel", "idx", F.round("smooth", 5).alias("smooth"))


@query(kernel_sql(traces.gaussian_weights(2.0)))
def seq12_gaussian(spark, sf_dir):
    return traces.kernel_smooth(event_points(spark, sf_dir), traces.gaussian_weights(2.0)).select("channel", "idx", F.round("smooth", 5).alias("smooth"))


@query(kernel_sql(traces.sinc_weights(4, 5)))
def seq12_sinc(spark, sf_dir):
    return traces.kernel_smooth(event_points(spark, sf_dir), traces.sinc_weights(4, 5)).select("channel", "idx", F.round("smooth", 5).alias("smooth"))


#: Weights of the middle of seven points under the cubic of least squares: fixed values over 21.
CUBIC_7 = [-2.0, 3.0, 6.0, 7.0, 6.0, 3.0, -2.0]


@query(kernel_sql(CUBIC_7))
def seq12_savitzky_golay(spark, sf_dir):
    return kernels.savitzky_golay(event_points(spark, sf_dir), 7).select("channel", "idx", F.round("smooth", 5).alias("smooth"))


def average_sql(filtered: bool) -> str:
    """The rules of SEQ11 for windows of 20,000 seconds that have at least 60 points at their end."""
    keep = "abs(intensity - m) < d" if filtered else "TRUE"
    return f"""WITH {EVENT_POINTS}, f AS (SELECT channel, min(time_s) AS t0, CAST(ceil((max(time_s) - min(time_s)) / 20000.0) AS BIGINT) AS bins FROM pts GROUP BY channel),
x AS (SELECT channel, t0, bins, CAST(floor((time_s - t0) / 20000.0) AS BIGINT) AS bin, intensity FROM pts JOIN f USING (channel) WHERE floor((time_s - t0) / 20000.0) < bins AND time_s >= 0),
l AS (SELECT f.channel, f.t0, CASE WHEN f.bins > 2 AND count(x.bin) < 60 THEN f.bins - 1 ELSE f.bins END AS bins FROM f LEFT JOIN x ON x.channel = f.channel AND x.bin = f.bins - 1 GROUP BY f.channel, f.t0, f.bins),
y AS (SELECT x.channel, least(x.bin, l.bins - 1) AS bin, intensity FROM x JOIN l USING (channel)), m AS (SELECT channel, bin, quantile_cont(intensity, 0.5) AS m FROM y GROUP BY 1, 2),
w AS (SELECT y.*, m, quantile_cont(abs(intensity - m), 0.5) OVER (PARTITION BY channel, bin) AS d FROM y JOIN m USING (channel, bin)), k AS (SELECT channel, bin, count(*) AS n, avg(intensity) AS mean FROM w WHERE {keep} GROUP BY 1, 2),
e AS (SELECT channel, t0, unnest(range(0, bins)) AS bin FROM l)
SELECT channel, bin, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean, round(coalesce(n, 0) / 20000.0, 8) AS per_second, round(t0 + (bin + 0.5) * 20000.0, 5) AS centre_s FROM e LEFT JOIN k USING (channel, bin)"""


def averaged(spark, sf_dir, filtered: bool):
    t = traces.time_average(event_points(spark, sf_dir), 20000.0, filtered, 60)
    return t.select("channel", "bin", "n", F.round("mean", 6).alias("mean"), F.round("per_second", 8).alias("per_second"), F.round("centre_s", 5).alias("centre_s"))


@query(average_sql(False))
def seq11_time_average(spark, sf_dir):
    return averaged(spark, sf_dir, False)


@query(average_sql(True))
def seq11_filtered_average(spark, sf_dir):
    return averaged(spark, sf_dir, True)


@query(f"""WITH {EVENT_POINTS}, s AS (SELECT channel, quantile_cont(intensity, 0.5) AS m FROM pts GROUP BY channel), d AS (SELECT channel, any_value(m) AS m, quantile_cont(abs(intensity - m), 0.5) AS d FROM pts JOIN s USING (channel) GROUP BY channel)
SELECT channel, idx, intensity FROM pts JOIN d USING (channel) WHERE intensity > m - d AND intensity < m + d""")
def fil23_prefilter(spark, sf_dir):
    return traces.prefilter(event_points(spark, sf_dir)).select("channel", "idx", "intensity")


@query(f"WITH {COUNT_POINTS} SELECT a.idx, round(a.intensity / b.intensity, 6) AS ratio FROM pts a JOIN pts b ON a.idx = b.idx WHERE a.channel = 'AF' AND b.channel = 'RF' AND b.intensity > 0")
def seq13_ratio(spark, sf_dir):
    return traces.channel_ratio(count_points(spark, sf_dir), "AF", "RF").select("idx", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {COUNT_POINTS} SELECT substr(channel, 1, 1) AS channel, idx, sum(intensity) AS intensity FROM pts GROUP BY 1, 2")
def seq14_channel_sum(spark, sf_dir):
    return traces.channel_sum(count_points(spark, sf_dir), F.substring("channel", 1, 1)).select("channel", "idx", "intensity")


def sampled_sql(name: str, source: str, every: int) -> str:
    """CTE name(channel, k, v): trailing means over nine of all but the first and last value of source(channel, pos, y), at every so many."""
    return f"""{name} AS (SELECT channel, (j + 1) // {every} AS k, v FROM (SELECT channel, j, avg(y) OVER (PARTITION BY channel ORDER BY j ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS v
  FROM (SELECT channel, y, row_number() OVER (PARTITION BY channel ORDER BY pos) - 2 AS j, count(*) OVER (PARTITION BY channel) AS n FROM {source}) WHERE n > 3 AND j BETWEEN 0 AND n - 3) WHERE (j + 1) % {every} = 0)"""


@query(f"""WITH {EVENT_POINTS}, a AS (SELECT channel, idx // 5 AS pos, avg(intensity) AS y FROM pts GROUP BY 1, 2), s AS (SELECT channel, count(*) AS n, avg(y) AS m FROM a GROUP BY channel),
near AS (SELECT a.* FROM a JOIN s USING (channel) WHERE n <= 3 OR y BETWEEN m - sqrt(m + 1) AND m + 0.25 * sqrt(m + 1)), rest AS (SELECT * FROM near WHERE y <> 0), {sampled_sql('u', 'rest', 1)}, {sampled_sql('t', 'a', 3)},
r AS (SELECT channel, 1 + (max(y) - min(y)) / (any_value(m) + 1) AS range_term FROM near JOIN s USING (channel) WHERE n > 3 GROUP BY channel), d AS (SELECT channel, CASE WHEN count(*) > 1 THEN 100 * stddev_samp(v) / (avg(v) + 1) END AS rsd_term FROM u GROUP BY channel),
q AS (SELECT channel, v, lag(v, 1) OVER o AS c, lag(v, 2) OVER o AS b, lag(v, 3) OVER o AS a FROM t WINDOW o AS (PARTITION BY channel ORDER BY k)),
e AS (SELECT channel, CASE WHEN count(*) > 1 THEN greatest(1, 0.75 + count(*) FILTER (WHERE (a < b AND b < c AND c < v) OR (a > b AND b > c AND c > v)) / count(*)) END AS trend_term FROM q GROUP BY channel)
SELECT channel, round(range_term, 6) AS range_term, round(rsd_term, 6) AS rsd_term, round(trend_term, 6) AS trend_term, round(range_term * rsd_term * trend_term, 5) AS drift FROM r JOIN d USING (channel) JOIN e USING (channel)""")
def agg15_drift_factor(spark, sf_dir):
    p = event_points(spark, sf_dir).groupBy("sample_id", "channel", F.floor(F.col("idx") / 5).alias("idx")).agg(F.avg("intensity").alias("intensity"))
    return traces.drift_factor(p).select("channel", *r6("range_term", "rsd_term", "trend_term"), F.round("drift", 5).alias("drift"))


@query(f"WITH {EVENT_POINTS}, {clip_sql(5)} SELECT channel, round(location, 6) AS location, round(spread, 6) AS spread, n_kept FROM b")
def seq2a_clipped(spark, sf_dir):
    b = baseline.clipped(event_points(spark, sf_dir).withColumn("slice_idx", F.lit(0)))
    return b.select("channel", *r6("location", "spread"), "n_kept")


@query(f"WITH {COUNT_POINTS}, {clip_sql(5, 'sqrt(avg(intensity))', 3.0, 2.71)} SELECT channel, round(location, 6) AS location, round(spread, 6) AS spread, n_kept FROM b")
def seq2a_clipped_poisson(spark, sf_dir):
    b = baseline.clipped(count_points(spark, sf_dir).withColumn("slice_idx", F.lit(0)), poisson=True, offset=2.71)
    return b.select("channel", *r6("location", "spread"), "n_kept")


@query(f"WITH {EVENT_POINTS}, {clip_sql(40)} SELECT channel, round(location, 6) AS location, round(spread, 6) AS spread, n_kept FROM b")
def seq2a_converged(spark, sf_dir):
    b = baseline.converged(event_points(spark, sf_dir).withColumn("slice_idx", F.lit(0)))
    return b.select("channel", *r6("location", "spread"), "n_kept")


@query()
def seq2b_smart(spark, sf_dir):
    return baseline.smart_clipped(traces.segment(event_points(spark, sf_dir), 500)).select("channel", "slice_idx", "location", "spread", "z")


@query()
def seq2c_rosner(spark, sf_dir):
    return kernels.rosner(traces.segment(event_points(spark, sf_dir), 500)).select("channel", "slice_idx", "n_outliers", "location", "spread")


@query()
def agg4_truncated_poisson(spark, sf_dir):
    return kernels.truncated_poisson(traces.segment(count_points(spark, sf_dir), 5000)).select("channel", "slice_idx", "mean")


SLICES_150 = """n AS (SELECT channel, count(*) AS n FROM pts GROUP BY channel), s AS (SELECT p.*, channel || ':' || CAST(least(idx // 150, greatest(1, n // 150 + CASE WHEN n % 150 >= 100 THEN 1 ELSE 0 END) - 1) AS INTEGER) AS slice FROM pts p JOIN n USING (channel))"""


def model_sql(pick: str) -> str:
    """Both fits of every slice (5 rounds each), then pick over g (Gaussian), p (Poisson) and m (median)."""
    gauss = clip_sql(5, source="s", key="slice").replace("b AS (", "g AS (")
    poisson = clip_sql(5, "sqrt(avg(intensity))", 3.0, 2.71, "s", "slice").replace("b AS (", "p AS (")
    for i in range(5):
        poisson = poisson.replace(f"m{i} ", f"pm{i} ").replace(f"k{i} ", f"pk{i} ")
    return f"""WITH {EVENT_POINTS}, {SLICES_150}, {gauss}, {poisson}, m AS (SELECT slice, quantile_cont(intensity, 0.5) AS median FROM s GROUP BY slice),
c AS (SELECT slice, {pick} AS gauss, g.location AS gl, g.spread AS gs, g.n_kept AS gn, p.location AS pl, p.spread AS ps, p.n_kept AS pn FROM g JOIN p USING (slice) JOIN m USING (slice))
SELECT split_part(slice, ':', 1) AS channel, CAST(split_part(slice, ':', 2) AS INTEGER) AS slice_idx, round(CASE WHEN gauss THEN gl ELSE pl END, 6) AS location, round(CASE WHEN gauss THEN gs ELSE ps END, 6) AS spread,
  CASE WHEN gauss THEN gn ELSE pn END AS n_kept, CASE WHEN gauss THEN 'GAUSSIAN' ELSE 'POISSON' END AS distr FROM c"""


def chosen(spark, sf_dir, model: str, cutoff: float = 10.0):
    found_ = baseline.model_choice(traces.segment(event_points(spark, sf_dir), 150), model, cutoff)
    return found_.select("channel", "slice_idx", *r6("location", "spread"), "n_kept", "distr")


@query(model_sql("g.location + 3 * g.spread >= p.location + 3 * sqrt(p.location) AND NOT (g.location + 3 * g.spread = p.location + 3 * sqrt(p.location))"))
def seq1_pessimistic(spark, sf_dir):
    return chosen(spark, sf_dir, "PESSIMISTIC")


@query(model_sql("median >= 40"))
def seq1_threshold(spark, sf_dir):
    return chosen(spark, sf_dir, "THRESHOLD", 40.0)


@query(model_sql("TRUE"))
def seq1_forced_gaussian(spark, sf_dir):
    return chosen(spark, sf_dir, "GAUSSIAN")


@query(model_sql("FALSE"))
def seq1_forced_poisson(spark, sf_dir):
    return chosen(spark, sf_dir, "POISSON")


@query(f"""WITH {COUNT_POINTS}, {clip_sql(2)} SELECT channel, round(location + 3 * spread, 6) AS gaussian_c, round(location + 6 * spread, 6) AS gaussian_d, round(location + 3 * sqrt(location), 6) AS poisson_normal_c,
  round(location + 6 * sqrt(location), 6) AS poisson_normal_d, round(location + 3 * sqrt(location), 6) AS currie_c, round(36 + location + 6 * sqrt(location), 6) AS currie_d FROM b""")
def dis2_4_limits(spark, sf_dir):
    b = baseline.clipped(count_points(spark, sf_dir).withColumn("slice_idx", F.lit(0)), 2)
    made = baseline.limits(F.col("location"), F.col("spread"), 3.0)
    return b.select("channel", *[F.round(e, 6).alias(f"{k}_{s}") for k, pair in made.items() for s, e in zip("cd", pair, strict=True)])


@query("""WITH m AS (SELECT n_nationkey, alpha, exp(n_nationkey * 0.55) + 0.5 AS m FROM nation, (VALUES (0.05), (0.001), (1e-10)) AS a(alpha)),
k AS (SELECT *, unnest(range(CAST(greatest(0, floor(m - 12 * sqrt(m) - 12)) AS BIGINT), CAST(ceil(m + 40 * sqrt(m) + 150) AS BIGINT))) AS k FROM m),
t AS (SELECT *, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY n_nationkey, alpha ORDER BY k DESC) AS above FROM k)
SELECT n_nationkey, CAST(alpha AS DOUBLE) AS alpha, CAST(max(k) AS DOUBLE) AS critical FROM t WHERE above > alpha GROUP BY n_nationkey, alpha""")
def dis1_poisson_limit(spark, sf_dir):
    """Means from 1 to 540,000."""
    m = table(spark, sf_dir, "nation").select("n_nationkey", F.exp(F.col("n_nationkey") * 0.55).alias("m"))
    limit = [F.struct(F.lit(a).alias("alpha"), baseline.poisson_limit(F.col("m"), a).alias("critical")) for a in (0.05, 0.001, 1e-10)]
    return m.select("n_nationkey", F.explode(F.array(*limit)).alias("x")).select("n_nationkey", "x.alpha", "x.critical")


@query()
def dis2_3_p_values(spark, sf_dir):
    """Upper tails of every point; held against erfc in the tests, as SQL has none."""
    p = event_points(spark, sf_dir)
    m = p.groupBy("sample_id", "channel").agg(F.avg("intensity").alias("location"), F.stddev_samp("intensity").alias("spread"))
    made = baseline.upper_p(F.col("location"), F.col("spread"), F.col("intensity"))
    return p.join(m, ["sample_id", "channel"]).select("channel", "idx", *[e.alias(k) for k, e in made.items()])


@query()
def dis5_compound_limit(spark, sf_dir):
    b = baseline.clipped(count_points(spark, sf_dir).withColumn("slice_idx", F.lit(0)), 2)
    return kernels.compound_limits(b, 0.49, 1e-4).select("channel", "location", "critical")


SLICED = f"""WITH {EVENT_POINTS}, n AS (SELECT channel, count(*) AS n FROM pts GROUP BY channel), s AS (SELECT p.*, CAST(least(idx // 150, greatest(1, n // 150 + CASE WHEN n % 150 >= 100 THEN 1 ELSE 0 END) - 1) AS INTEGER) AS slice_idx FROM pts p JOIN n USING (channel)),
c AS (SELECT channel, slice_idx, (min(idx) + max(idx)) / 2.0 AS c, avg(intensity) AS v FROM s GROUP BY 1, 2),
w AS (SELECT *, lag(c) OVER o AS cp, lag(v) OVER o AS vp, lead(c) OVER o AS cn, lead(v) OVER o AS vn FROM c WINDOW o AS (PARTITION BY channel ORDER BY slice_idx))"""


@query(SLICED + """ SELECT s.channel, s.idx, round(CASE WHEN idx < c AND cp IS NOT NULL THEN vp + (v - vp) * (idx - cp) / (c - cp) WHEN idx > c AND cn IS NOT NULL THEN v + (vn - v) * (idx - c) / (cn - c) ELSE v END, 5) AS threshold
FROM s JOIN w ON w.channel = s.channel AND w.slice_idx = s.slice_idx""")
def joi3_interpolated(spark, sf_dir):
    p = traces.segment(event_points(spark, sf_dir), 150)
    v = p.groupBy("sample_id", "channel", "slice_idx").agg(F.avg("intensity").alias("threshold"))
    return baseline.interpolated(p, v).select("channel", "idx", F.round("threshold", 5).alias("threshold"))


@query(f"WITH {EVENT_POINTS}, {clip_sql(5)}, {THR} SELECT channel, idx AS start_idx FROM t WHERE intensity > h AND intensity > 0")
def seq3_simple(spark, sf_dir):
    p, b = model(spark, sf_dir)
    return search.simple_search(with_thresholds(search.rounded(p), b, OFFSET, Z)).select("channel", "start_idx")


#: Counts that recording has blurred by up to 0.08: integer traces, which searches round.
BLURRED = f"{COUNT_POINTS}, raw AS (SELECT * REPLACE (intensity + (idx % 5 - 2) * 0.04 AS intensity) FROM pts), flat AS (SELECT channel, floor(intensity + 0.5) AS y, idx, intensity FROM raw)"


def blurred(spark, sf_dir):
    return count_points(spark, sf_dir).withColumn("intensity", F.col("intensity") + (F.col("idx") % 5 - 2) * 0.04)


@query(f"WITH {BLURRED} SELECT channel, idx AS start_idx FROM flat WHERE y > 48.96 AND y > 0")
def seq3_integer(spark, sf_dir):
    return search.simple_search(search.rounded(blurred(spark, sf_dir)).withColumn("height_thr", F.lit(48.96))).select("channel", "start_idx")


@query(f"""WITH {BLURRED}, g AS (SELECT *, y < 45.02 AS brk, sum(CASE WHEN y < 45.02 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM flat),
r AS (SELECT channel, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_points, round(sum(intensity), 6) AS area, round(max(intensity), 6) AS height, max(y) AS seen FROM g WHERE NOT brk GROUP BY channel, island)
SELECT channel, start_idx, end_idx, n_points, area, height FROM r WHERE seen > 48.96""")
def seq4a_integer(spark, sf_dir):
    flat = search.rounded(blurred(spark, sf_dir)).withColumns({k: F.lit(v) for k, v in (("start_thr", 45.02), ("stop_thr", 45.02), ("height_thr", 48.96))})
    return search.hysteresis_search(flat).select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), F.round("height", 6).alias("height"))


@query(FOUND + " SELECT channel, start_idx, end_idx, peak_idx, n_points, round(area, 6) AS area, height FROM e")
def seq4a_hysteresis(spark, sf_dir):
    _, _, e = found(spark, sf_dir)
    return e.select("channel", "start_idx", "end_idx", "peak_idx", "n_points", F.round("area", 6).alias("area"), "height")


MERGE = """o AS (SELECT *, max(z) OVER (PARTITION BY channel ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM w),
i AS (SELECT *, sum(CASE WHEN ahead IS NULL OR a > ahead + {touch} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM o),
m AS (SELECT channel, min(a) AS start_idx, max(z) AS end_idx FROM i GROUP BY channel, grp)"""


@query(f"""WITH {EVENT_POINTS}, {clip_sql(5)}, {THR}, l AS (SELECT channel, max(idx) AS last FROM pts GROUP BY channel),
x AS (SELECT channel, idx, last, 2 + CAST(ceil(least(1.0, greatest(1.0, s) / greatest(1.0, intensity)) * 3) AS INTEGER) AS half FROM t JOIN l USING (channel) WHERE intensity >= s),
w AS (SELECT channel, greatest(0, idx - half) AS a, least(last, idx + half) AS z FROM x), {MERGE.format(touch=0)}
SELECT m.channel, CAST(start_idx AS INTEGER) AS start_idx, CAST(end_idx AS INTEGER) AS end_idx, count(*) AS n_points, round(sum(intensity), 6) AS area, max(intensity) AS height FROM m JOIN t ON t.channel = m.channel AND t.idx BETWEEN start_idx AND end_idx
GROUP BY 1, 2, 3 HAVING max(intensity) > arg_min(h, row(-intensity, idx))""")
def seq4b_window(spark, sf_dir):
    p, b = model(spark, sf_dir)
    return search.window_search(with_thresholds(p, b, OFFSET, Z), 2, 3).select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), "height")


@query(f"""WITH {EVENT_POINTS}, {clip_sql(5)}, t0 AS (SELECT p.*, location, spread, greatest(0.1, location) + {OFFSET} AS s, greatest(0.1, location + {Z} * spread) AS h FROM pts p JOIN b USING (channel)),
t AS (SELECT channel, idx, location, s, h, greatest(ceil(round(avg(intensity) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9)), intensity) AS intensity FROM t0), {RUNS}
SELECT channel, start_idx, end_idx, n_points, round(area, 6) AS area, height FROM e""")
def seq4c_smooth(spark, sf_dir):
    p, b = model(spark, sf_dir)
    return search.smooth_search(with_thresholds(p, b, OFFSET, Z), 4).select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), "height")


#: Local p of counts by the Poisson model of their channel's mean, per distinct pair of rounded values.
LOCAL_P = f"""{COUNT_POINTS}, mm AS (SELECT channel, avg(intensity) AS location FROM pts GROUP BY channel), yk AS (SELECT p.*, greatest(0.01, round(location, 2)) AS m, round(intensity, 3) AS y FROM pts p JOIN mm USING (channel)),
dp AS (SELECT y, m, 0.5 * exp(floor(y) * ln(m) - m - lgamma(floor(y) + 1)) + list_sum(list_transform(range(1, 200), lambda j: exp((floor(y) + j) * ln(m) - m - lgamma(floor(y) + j + 1)))) AS p FROM (SELECT DISTINCT y, m FROM yk)),
lp AS (SELECT yk.channel, yk.idx, yk.intensity, greatest(1e-300, p) AS p FROM yk JOIN dp USING (y, m))"""
FISHER = "exp(-half) * list_sum(list_transform(range(0, k), lambda j: half ** j / factorial(CAST(j AS INTEGER))))"
COMBINED = f"""hh AS (SELECT idx, count(*) AS k, min(p) AS lowest_p, sum(-ln(p)) AS half FROM lp GROUP BY idx), cp AS (SELECT idx, k, lowest_p, half, CASE WHEN k = 1 THEN lowest_p ELSE greatest(1e-300, {FISHER}) END AS p FROM hh)"""


def counted_p(spark, sf_dir):
    p = count_points(spark, sf_dir)
    return accumulate.local_p(p.join(F.broadcast(p.groupBy("sample_id", "channel").agg(F.avg("intensity").alias("location"))), ["sample_id", "channel"]))


@query(f"WITH {LOCAL_P} SELECT channel, idx, round(p, 9) AS p FROM lp")
def dis1_poisson_p(spark, sf_dir):
    return counted_p(spark, sf_dir).select("channel", "idx", F.round("p", 9).alias("p"))


@query(f"WITH {LOCAL_P}, {COMBINED} SELECT idx, k, round(lowest_p, 9) AS lowest_p, round(2 * half, 6) AS h, round(p, 9) AS p FROM cp")
def snk6_p_values(spark, sf_dir):
    return accumulate.combined_p(counted_p(spark, sf_dir)).select("idx", "k", F.round("lowest_p", 9).alias("lowest_p"), F.round("h", 6).alias("h"), F.round("p", 9).alias("p"))


@query(f"""WITH {LOCAL_P}, {COMBINED}, f AS (SELECT avg(2 * half) AS m, stddev_samp(2 * half) AS s FROM cp WHERE 2 * half < 2 * k + 10 * sqrt(k)), z AS (SELECT idx, k, lowest_p, 2 * half / (s * s / m) AS x, m / (s * s / m) AS a FROM cp, f),
g AS (SELECT idx, CASE WHEN k = 1 THEN lowest_p ELSE {tail_sql('x', 'exp((a - 1) * ln(greatest(y, 1e-300)) - (y) - lgamma(a))', 1000)} END AS p FROM z) SELECT idx, round(p, 4) AS p FROM g""")
def seq5_gamma(spark, sf_dir):
    return accumulate.combined_p(counted_p(spark, sf_dir), "GAMMA").select("idx", F.round("p", 4).alias("p"))


#: Channels with over so many events a minute take part.
PER_MINUTE = 12_000.0


@query(f"""WITH {LOCAL_P}, sg AS (SELECT *, sum(CASE WHEN intensity < 45 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM pts),
sr AS (SELECT channel, count(*) AS n FROM (SELECT channel, island FROM sg WHERE intensity >= 45 GROUP BY channel, island HAVING max(intensity) > 49) GROUP BY channel),
sc AS (SELECT channel FROM sr JOIN (SELECT channel, (max(idx) - min(idx)) * 1e-4 AS seconds FROM pts GROUP BY channel) USING (channel) WHERE n / seconds > {PER_MINUTE} / 60), {COMBINED.replace('FROM lp', 'FROM lp JOIN sc USING (channel)')},
g AS (SELECT *, p <= 0.3 OR lowest_p <= 1e-6 AS inside, sum(CASE WHEN p <= 0.3 OR lowest_p <= 1e-6 THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM cp),
r AS (SELECT min(idx) AS start_idx, max(idx) AS end_idx, min(p) AS least_p FROM g WHERE inside GROUP BY island HAVING min(p) <= 0.0005 OR bool_or(lowest_p <= 1e-6))
SELECT channel, start_idx, end_idx, round(least_p, 9) AS least_p, count(*) AS n_points, sum(intensity) AS area, max(intensity) AS height FROM r JOIN pts ON idx BETWEEN start_idx AND end_idx GROUP BY 1, 2, 3, 4""")
def seq5_accumulated_p(spark, sf_dir):
    p = counted_p(spark, sf_dir)
    screened = accumulate.prescreened(p.withColumns({k: F.lit(v) for k, v in (("start_thr", 45.0), ("stop_thr", 45.0), ("height_thr", 49.0))}), PER_MINUTE)
    found_ = accumulate.accumulated_search(screened, 0.3, 0.0005, 1e-6, onto=count_points(spark, sf_dir))
    return found_.select("channel", "start_idx", "end_idx", F.round("least_p", 9).alias("least_p"), "n_points", "area", "height")


@query(f"""WITH {LOCAL_P}, sg AS (SELECT *, sum(CASE WHEN intensity < 42 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM lp),
e AS (SELECT channel, min(idx) AS start_idx, max(idx) AS end_idx, sum(-ln(p)) AS half, count(*) AS k, min(p) AS lowest FROM sg WHERE intensity >= 42 GROUP BY channel, island HAVING max(intensity) > 46),
q AS (SELECT channel, start_idx, end_idx, CASE WHEN k = 1 THEN lowest ELSE {FISHER} END AS p FROM e) SELECT channel, start_idx, end_idx, round(p, 12) AS event_p FROM q WHERE p < 1e-5""")
def fil14_accumulated_p_gate(spark, sf_dir):
    p = counted_p(spark, sf_dir)
    e = search.hysteresis_search(search.rounded(p).withColumns({k: F.lit(v) for k, v in (("start_thr", 42.0), ("stop_thr", 42.0), ("height_thr", 46.0))}))
    return accumulate.p_gate(e, p, 1e-5).select("channel", "start_idx", "end_idx", F.round("event_p", 12).alias("event_p"))


@query(FOUND + """ SELECT e.channel, e.start_idx, round(CASE WHEN e.start_idx > 0 THEN z.time_s - p.time_s ELSE n.time_s - s.time_s END * 1e6, 0) AS duration_us, round(c.time_s, 6) AS center_time_s,
  round(CASE WHEN n_points <= 2 THEN 1.0 ELSE 2.0 * (end_idx - peak_idx) / greatest(1, end_idx - start_idx) END, 6) AS asymmetry
FROM e JOIN pts z ON z.channel = e.channel AND z.idx = e.end_idx LEFT JOIN pts p ON p.channel = e.channel AND p.idx = e.start_idx - 1 LEFT JOIN pts n ON n.channel = e.channel AND n.idx = e.end_idx + 1
JOIN pts s ON s.channel = e.channel AND s.idx = e.start_idx JOIN pts c ON c.channel = e.channel AND c.idx = (e.start_idx + e.end_idx) // 2""")
def seq6_metrics(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return events.metrics(e, p).select("channel", "start_idx", F.round("duration_us", 0).alias("duration_us"), *r6("center_time_s", "asymmetry"))


@query(FOUND + """, q AS (SELECT p.channel, p.idx, p.intensity FROM pts p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.channel = p.channel AND p.idx BETWEEN e.start_idx AND e.end_idx))
SELECT channel, count(*) AS n, round(avg(intensity), 6) AS mean, round(stddev_samp(intensity), 6) AS sd FROM q GROUP BY channel""")
def agg9_background(spark, sf_dir):
    """SEQ8, SET3, AGG9."""
    p, _, e = found(spark, sf_dir)
    return events.background(p, e).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.avg("intensity"), 6).alias("mean"), F.round(F.stddev_samp("intensity"), 6).alias("sd"))


@query(FOUND + """, q AS (SELECT p.channel, p.idx, p.intensity FROM pts p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.channel = p.channel AND p.idx BETWEEN e.start_idx AND e.end_idx))
SELECT e.channel, e.peak_idx, round(coalesce(avg(q.intensity), 0), 7) AS bg_mean FROM e LEFT JOIN q ON q.channel = e.channel AND q.idx > e.peak_idx - 25 AND q.idx <= e.peak_idx + 25 GROUP BY e.channel, e.peak_idx""")
def seq7b_window_background(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return events.net_of_window(e, p, 25).select("channel", "peak_idx", F.round("bg_mean", 7).alias("bg_mean"))


GATES = {"height": ("height > 90", 90), "area": ("area > 150", 150), "more_points": ("n_points > 2", 2), "fewer_points": ("n_points < 3", 3), "dominance": ("height - greatest(0.1, location) < 0.6 * (area - greatest(0.1, location) * n_points)", 60)}
for _kind, (_where, _target) in GATES.items():

    def _gate(spark, sf_dir, kind=_kind, target=_target):
        _, _, e = found(spark, sf_dir)
        return events.gate(e, kind, target).select("channel", "start_idx", "end_idx")

    Q[f"fil11_13_gate_{_kind}"] = _gate
    SQL[f"fil11_13_gate_{_kind}"] = FOUND + f" SELECT channel, start_idx, end_idx FROM e WHERE {_where}"


@query(f"""WITH {EVENT_POINTS}, {clip_sql(5)}, {THR}, {RUNS}, v AS (SELECT e.*, area / n_points AS x FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY x) AS r, count(*) OVER (PARTITION BY channel) AS n FROM v),
q AS (SELECT channel, max(CASE WHEN r = least(greatest(floor(0.05 * (n + 1)), 1), n) THEN x END) AS l0, max(CASE WHEN r = least(greatest(floor(0.05 * (n + 1)) + 1, 1), n) THEN x END) AS l1, max(0.05 * (n + 1) - floor(0.05 * (n + 1))) AS lf,
  max(CASE WHEN r = least(greatest(floor(0.95 * (n + 1)), 1), n) THEN x END) AS h0, max(CASE WHEN r = least(greatest(floor(0.95 * (n + 1)) + 1, 1), n) THEN x END) AS h1, max(0.95 * (n + 1) - floor(0.95 * (n + 1))) AS hf FROM r GROUP BY channel)
SELECT channel, start_idx FROM r JOIN q USING (channel) WHERE x BETWEEN l0 + lf * (l1 - l0) AND h0 + hf * (h1 - h0)""")
def fil5_percentiles(spark, sf_dir):
    _, _, e = found(spark, sf_dir)
    e = e.withColumn("x", F.col("area") / F.col("n_points"))
    return events.percentile_roi(e, ["channel"], "x", 0.05, 0.95).select("channel", "start_idx")


QUARTILES = """r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x) AS r, count(*) OVER (PARTITION BY g) AS n FROM v),
q AS (SELECT g, any_value(n) AS n, max(CASE WHEN r = floor(0.25 * (n + 1)) THEN x END) AS a0, max(CASE WHEN r = floor(0.25 * (n + 1)) + 1 THEN x END) AS a1, max(0.25 * (n + 1) - floor(0.25 * (n + 1))) AS af,
  max(CASE WHEN r = floor(0.5 * (n + 1)) THEN x END) AS m0, max(CASE WHEN r = floor(0.5 * (n + 1)) + 1 THEN x END) AS m1, max(0.5 * (n + 1) - floor(0.5 * (n + 1))) AS mf,
  max(CASE WHEN r = floor(0.75 * (n + 1)) THEN x END) AS b0, max(CASE WHEN r = floor(0.75 * (n + 1)) + 1 THEN x END) AS b1, max(0.75 * (n + 1) - floor(0.75 * (n + 1))) AS bf FROM r GROUP BY g),
k AS (SELECT g, n, a0 + af * (a1 - a0) AS q1, m0 + mf * (m1 - m0) AS median, b0 + bf * (b1 - b0) AS q3 FROM q)"""


@query(f"WITH v AS (SELECT o_orderpriority AS g, o_orderkey AS o, o_totalprice AS x FROM orders), {QUARTILES} SELECT o AS o_orderkey FROM v JOIN k USING (g) WHERE x BETWEEN q1 - 0.3 * (q3 - q1) AND q3 + 0.3 * (q3 - q1)")
def fil6_iqr_fence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return events.iqr_fence(o, ["o_orderpriority"], "o_totalprice", 0.3).select("o_orderkey")


@query("""WITH m AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1), d AS (SELECT g, any_value(m) AS m, quantile_cont(abs(o_totalprice - m), 0.5) AS d FROM orders JOIN m ON g = o_orderpriority GROUP BY g)
SELECT o_orderkey FROM orders JOIN d ON g = o_orderpriority WHERE abs(o_totalprice - m) <= 0.75 * d""")
def fil7_mad_fence(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return events.mad_fence(o, ["o_orderpriority"], "o_totalprice").select("o_orderkey")


@query("SELECT event_id FROM events WHERE value BETWEEN CASE WHEN event_type = 'click' THEN 10 ELSE 20 END AND CASE WHEN event_type = 'click' THEN 30 ELSE 60 END")
def fil10_overrides(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), "value")
    own = spark.createDataFrame([("click", 10.0, 30.0)], "channel string, low double, high double")
    return events.with_overrides(e, own, 20.0, 60.0, "value").select("event_id")


@query(FOUND + """, f AS (SELECT channel, idx FROM pts WHERE intensity > 150) SELECT e.channel, e.start_idx, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.channel = e.channel AND f.idx BETWEEN e.start_idx AND e.end_idx) THEN 'OvRng' ELSE 'InRng' END AS population FROM e""")
def fil16_over_range(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return events.over_range(e, p.where("intensity > 150")).select("channel", "start_idx", "population")


def remover_sql(by: str) -> str:
    return FOUND + f""", s AS (SELECT channel, {by}(area - greatest(0.1, location) * n_points) AS top FROM e GROUP BY channel), k AS (SELECT channel FROM s WHERE top >= (SELECT quantile_cont(top, 0.5) FROM s))
SELECT e.channel, e.start_idx FROM e JOIN k USING (channel)"""


def removed(spark, sf_dir, by: str):
    """The channels whose smallest or largest net area is below the median of the channels go."""
    p, _, e = found(spark, sf_dir)
    seconds = p.groupBy("sample_id", "channel").agg((F.max("time_s") - F.min("time_s")).alias("seconds"))
    tops = e.groupBy("channel").agg({"max": F.max, "min": F.min}[by]("net_area").alias("top"))
    cut = tops.agg(F.expr("percentile(top, 0.5)")).first()[0]
    return events.remove_channels(e, seconds, least_net=cut, by=by).select("channel", "start_idx")


@query(remover_sql("max"))
def fil19_remover(spark, sf_dir):
    return removed(spark, sf_dir, "max")


@query(remover_sql("min"))
def fil19_remover_by_minimum(spark, sf_dir):
    return removed(spark, sf_dir, "min")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 9000 AND c_acctbal > 0 AND c_custkey < 1000 AND c_custkey >= 10 AND (c_acctbal - 0) / 9.0 + c_custkey < 1010")
def fil21_polygon(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return events.inside_polygon(c, "x", "y", [(10.0, 0.0), (1010.0, 0.0), (10.0, 9000.0)]).select("c_custkey")


@query(f"""WITH {COUNT_POINTS}, k AS (SELECT idx FROM pts WHERE channel IN ('AF', 'RF') GROUP BY idx HAVING count(*) = 2 AND bool_and(intensity BETWEEN 10 AND 40)) SELECT channel, idx, intensity FROM pts JOIN k USING (idx)""")
def fil17_aligned(spark, sf_dir):
    s = count_points(spark, sf_dir).withColumnRenamed("idx", "event_ord")
    return events.aligned_filter(s, ["AF", "RF"], 10, 40).select("channel", F.col("event_ord").alias("idx"), "intensity")


#: Runs above the start threshold as lists, with the background of their trace.
RUN_LISTS = f"""{EVENT_POINTS}, {clip_sql(5)}, {THR}, g AS (SELECT *, sum(CASE WHEN intensity < s THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM t),
ev AS (SELECT channel, island, min(idx) AS start_idx, list(intensity ORDER BY idx) AS y, any_value(location) AS bg FROM g WHERE intensity >= s GROUP BY channel, island)"""


def particles_sql(raw: bool) -> str:
    """The segments of SEQ10, one difference a step."""
    mean = "list_transform(range(1, len({0}) + 1), lambda i: list_avg({0}[greatest(1, i - 2):i]))"
    before, after = (mean.format("y"), "d") if raw else ("y", mean.format("d"))
    return f"""WITH RECURSIVE {RUN_LISTS}, v AS (SELECT *, {before} AS v FROM ev), k AS (SELECT *, list_transform(list_filter(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]) > sqrt(v[i] + 0.5)), lambda i: v[i] - v[i - 1]) AS d FROM v),
q AS (SELECT channel, island, start_idx, len(y) AS n, bg, {after} AS x FROM k),
w AS (SELECT channel, island, 0 AS pos, FALSE AS falls, 0.0::DOUBLE AS total, 0 AS length, 0 AS found FROM q UNION ALL
  SELECT channel, island, pos + 1, next < 0, CASE WHEN same THEN total + next ELSE next END, CASE WHEN same THEN length + 1 ELSE 1 END, found + CASE WHEN NOT same AND total > 3 * sqrt(length * bg + 0.5) THEN 1 ELSE 0 END
  FROM (SELECT w.*, q.x[pos + 1] AS next, bg, (NOT (q.x[pos + 1] < 0 AND total < 0) OR -total > 3 * sqrt(length * bg + 0.5)) AND ((q.x[pos + 1] < 0) = falls) AS same FROM w JOIN q USING (channel, island) WHERE pos < len(q.x))),
p AS (SELECT q.channel, q.start_idx, CASE WHEN any_value(q.n) <= 3 THEN 1 ELSE max(found) END AS n_particles FROM q JOIN w USING (channel, island) GROUP BY 1, 2)"""


def particles(spark, sf_dir, raw: bool):
    p, b = model(spark, sf_dir)
    runs = search.hysteresis_points(with_thresholds(p, b, OFFSET, Z)).withColumn("background", F.col("location"))
    starts = runs.groupBy("sample_id", "channel", "island").agg(F.min("idx").alias("start_idx"))
    return kernels.multi_particles(runs, raw=raw).join(starts, ["sample_id", "channel", "island"]).select("channel", "start_idx", "n_particles")


@query(particles_sql(False) + " SELECT * FROM p")
def seq10_multi_particles(spark, sf_dir):
    return particles(spark, sf_dir, False)


@query(particles_sql(True) + " SELECT * FROM p")
def seq10_multi_particles_raw(spark, sf_dir):
    return particles(spark, sf_dir, True)


@query(particles_sql(False) + " SELECT *, CASE WHEN n_particles = 1 THEN '1' ELSE '>1' END AS population FROM p WHERE n_particles > 0")
def fil15_multi_events(spark, sf_dir):
    return kernels.multi_populations(particles(spark, sf_dir, False), pooled=True)


def side_sql(side: str) -> str:
    low = f"list_position(list_transform({side}, lambda x: x < level), TRUE)"
    return f"CASE WHEN {low} > 1 THEN {low} - 1 - (level - {side}[{low}]) / ({side}[{low} - 1] - {side}[{low}]) END"


@query(f"""WITH {RUN_LISTS}, x AS (SELECT channel, start_idx, 0.1 * list_max(y) AS level, list_reverse(y[1:list_position(y, list_max(y))]) AS front, y[list_position(y, list_max(y)):] AS back FROM ev)
SELECT channel, start_idx, round(({side_sql('back')}) / ({side_sql('front')}), 6) AS asymmetry_10 FROM x""")
def seq17_asymmetry(spark, sf_dir):
    p, b = model(spark, sf_dir)
    runs = search.hysteresis_points(with_thresholds(p, b, OFFSET, Z))
    starts = runs.groupBy("sample_id", "channel", "island").agg(F.min("idx").alias("start_idx"))
    return kernels.peak_asymmetry(runs).join(starts, ["sample_id", "channel", "island"]).select("channel", "start_idx", F.round("asymmetry_10", 6).alias("asymmetry_10"))


@query(f"WITH {COUNT_POINTS} SELECT channel, idx, sum(intensity) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS total FROM pts")
def scan_running_sum(spark, sf_dir):
    return scan.running_sum(count_points(spark, sf_dir), F.col("intensity"), "total", block=1000).select("channel", "idx", "total")
