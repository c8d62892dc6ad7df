"""Reports and the remaining small operators, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blipstream.functions import chemistry
from blipstream.operators import baseline, events, quant, traces
from blipstream.operators.scan import TRACE, middles

from .inputs import EVENT_POINTS, event_points, table
from .signal_queries import FOUND, found, model_sql
from .stored import stored

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(FOUND + """, q AS (SELECT p.* FROM pts p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.channel = p.channel AND p.idx BETWEEN e.start_idx AND e.end_idx)),
c AS (SELECT e.channel, e.start_idx, p.time_s AS t FROM e JOIN pts p ON p.channel = e.channel AND p.idx = e.peak_idx)
SELECT c.channel, c.start_idx, count(q.idx) AS n, round(coalesce(avg(q.intensity), 0), 7) AS bg_mean FROM c LEFT JOIN q ON q.channel = c.channel AND q.time_s > c.t - 20000 AND q.time_s <= c.t + 20000 GROUP BY 1, 2""")
def seq7c_time_background(spark, sf_dir):
    """Background points by time around the peak, from running sums along time."""
    p, _, e = found(spark, sf_dir)
    half = 20000.0
    free = events.background(p, e).select(*TRACE, "time_s", F.col("intensity").cast("decimal(28,6)").alias("y"))
    peak = e.select(*TRACE, "start_idx", F.col("peak_idx").alias("idx")).join(p.select(*TRACE, "idx", F.col("time_s").alias("t")), [*TRACE, "idx"])
    out = events.sums_in_time(stored(peak, "peaks"), free, half, "y")
    return out.select("channel", "start_idx", F.col("n").cast("long").alias("n"), F.round(F.coalesce(F.try_divide(F.col("total").cast("double"), F.col("n")), F.lit(0.0)), 7).alias("bg_mean"))


@query(f"""WITH {EVENT_POINTS}, b AS (SELECT channel, idx // 200 AS blk, quantile_cont(intensity, 0.5) AS m FROM pts GROUP BY 1, 2), d AS (SELECT p.channel, p.idx // 200 AS blk, quantile_cont(abs(intensity - m), 0.5) AS d FROM pts p JOIN b ON b.channel = p.channel AND b.blk = p.idx // 200 GROUP BY 1, 2),
s AS (SELECT p.channel, CAST(p.idx // 20 AS INTEGER) AS part, avg(CASE WHEN intensity > m + 2 * d THEN 1.0 ELSE 0.0 END) AS share FROM pts p JOIN b ON b.channel = p.channel AND b.blk = p.idx // 200 JOIN d ON d.channel = p.channel AND d.blk = p.idx // 200 GROUP BY 1, 2)
SELECT channel, part, round(share / max(share) OVER (PARTITION BY channel), 6) AS likelihood FROM s""")
def seq15_local_likelihood(spark, sf_dir):
    """Share of points in a short stretch above median + 2 MAD of the long stretch around it, by the channel's largest."""
    p = stored(event_points(spark, sf_dir), "points").withColumn("blk", F.floor(F.col("idx") / 200))
    m = p.groupBy(*TRACE, "blk").agg(F.expr("percentile(intensity, 0.5)").alias("m"))
    d = p.join(m, [*TRACE, "blk"]).groupBy(*TRACE, "blk").agg(F.first("m").alias("m"), F.expr("percentile(abs(intensity - m), 0.5)").alias("d"))
    s = p.join(d, [*TRACE, "blk"]).groupBy(*TRACE, F.floor(F.col("idx") / 20).cast("int").alias("part")).agg(F.avg((F.col("intensity") > F.col("m") + 2 * F.col("d")).cast("double")).alias("share"))
    return s.select("channel", "part", F.round(F.col("share") / F.max("share").over(Window.partitionBy(*TRACE)), 6).alias("likelihood"))


@query("""WITH m AS (SELECT event_type AS channel, value / 5.0 * 0.4 AS fg FROM events), z AS (SELECT channel, fg, CASE WHEN fg > 0 THEN cbrt(6 * fg * 1e-15 / (19.3 * pi())) * 1e7 END AS nm FROM m)
SELECT channel, round(avg(fg), 6) AS mean_fg, round(quantile_cont(fg, 0.5), 6) AS median_fg, round(stddev_samp(fg), 6) AS sd_fg, round(avg(nm), 5) AS mean_nm, round(avg(fg) / 196.9665688 * 1e3, 6) AS mean_amol FROM z GROUP BY channel""")
def agg8_quantified(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("s1").alias("sample_id"), F.col("event_type").alias("channel"), F.col("value").alias("net_area"))
    cal = e.select("sample_id", "channel").distinct().select("*", F.lit("SIZE").alias("strategy"), F.lit(1.0).alias("np_cts_per_fg"), F.lit(5.0).alias("ionic_cts_per_fg"), F.lit(40.0).alias("aerosol_te_pct"), F.lit(1.0).alias("mass_fraction"), F.lit(19.3).alias("density_g_cm3"))
    q = quant.quantify(e, cal)
    amol = chemistry.convert(chemistry.convert(F.avg("mass_fg"), "mass", "fg", "g") / 196.9665688, "molar", "mol", "amol")
    means = q.groupBy("channel").agg(F.round(F.avg("mass_fg"), 6).alias("mean_fg"), F.round(F.stddev_samp("mass_fg"), 6).alias("sd_fg"), F.round(F.avg("diameter_nm"), 5).alias("mean_nm"), F.round(amol, 6).alias("mean_amol"))
    return means.join(middles(q, F.col("mass_fg"), "median_fg", ["channel"]).withColumn("median_fg", F.round("median_fg", 6)), "channel")


@query("WITH c AS (" + model_sql("g.location + 3 * g.spread > p.location + 3 * sqrt(p.location)").replace("round(CASE WHEN gauss THEN gl ELSE pl END, 6)", "CASE WHEN gauss THEN gl ELSE pl END").replace("round(CASE WHEN gauss THEN gs ELSE ps END, 6)", "CASE WHEN gauss THEN gs ELSE ps END") + """)
SELECT channel, count(*) AS slices, round(avg(location), 6) AS location, round(avg(spread), 6) AS spread, string_agg(DISTINCT distr, ',' ORDER BY distr) AS distr FROM c GROUP BY channel""")
def agg10_baseline_summary(spark, sf_dir):
    s = baseline.model_choice(traces.segment(event_points(spark, sf_dir), 150))
    return s.groupBy("channel").agg(F.count("*").alias("slices"), F.round(F.avg("location"), 6).alias("location"), F.round(F.avg("spread"), 6).alias("spread"), F.array_join(F.array_sort(F.collect_set("distr")), ",").alias("distr"))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT g AS o_orderpriority, round(max(CASE WHEN r = least(floor(0.99 * (n + 1)), n) THEN x END) + max(0.99 * (n + 1) - floor(0.99 * (n + 1))) * (max(CASE WHEN r = least(floor(0.99 * (n + 1)) + 1, n) THEN x END) - max(CASE WHEN r = least(floor(0.99 * (n + 1)), n) THEN x END)), 5) AS axis_limit FROM r GROUP BY g""")
def agg30_axis_limit(spark, sf_dir):
    p = events.legacy_percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"axis_limit": 0.99})
    return p.withColumn("axis_limit", F.round("axis_limit", 5))


@query("SELECT n_nationkey, printf('%.2f', n_nationkey / 3.0) AS shown, lower(hex(n_nationkey + 16)) AS hexed, CAST(list_aggregate(list_transform(range(0, 5), lambda i: n_nationkey + i * 0.25), 'sum') AS DOUBLE) AS spaced FROM nation")
def sc4_17_format(spark, sf_dir):
    k = F.col("n_nationkey")
    spaced = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: k + i * 0.25), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "nation").select(k, F.format_string("%.2f", k / 3.0).alias("shown"), F.lower(F.hex((k + 16).cast("long"))).alias("hexed"), spaced.alias("spaced"))


@query("SELECT p_partkey, CAST(CASE WHEN contains(lower(p_name || ' ' || p_type), 'steel') THEN 7.85 WHEN contains(lower(p_name || ' ' || p_type), 'copper') THEN 8.96 WHEN contains(lower(p_name || ' ' || p_type), 'tin') THEN 7.31 END AS DOUBLE) AS density FROM part")
def sc21_density(spark, sf_dir):
    """Density by substring; the table is the caller's."""
    found_ = chemistry.density(F.concat_ws(" ", "p_name", "p_type"), [("Steel", 7.85), ("Copper", 8.96), ("Tin", 7.31)])
    return table(spark, sf_dir, "part").select("p_partkey", found_.alias("density"))


@query("""WITH x AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT label, i FROM x WHERE v > 0.1 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT x.label AS cluster, CAST(x.i AS INTEGER) AS element, count(*) AS n, round(avg(v), 6) AS mean FROM x JOIN k ON k.label = x.label AND k.i = x.i GROUP BY 1, 2""")
def mod10_cluster_spectra(spark, sf_dir):
    """Cluster spectra of the channels that exceed a threshold in at least two members."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.posexplode("embedding").alias("element", "v")).withColumn("v", F.col("v").cast("double"))
    s = x.groupBy("cluster", "element").agg(F.sum((F.col("v") > 0.1).cast("int")).alias("strong"), F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))
    return s.where("strong >= 2").drop("strong")


@query(FOUND + """ SELECT p.channel, count(*) AS n_points, any_value(ev.n) AS n_events, round(avg(p.intensity), 6) AS raw_mean, round(any_value(ev.mean_net), 6) AS mean_net FROM pts p
JOIN (SELECT channel, count(*) AS n, avg(area - greatest(0.1, location) * n_points) AS mean_net FROM e GROUP BY channel) ev ON ev.channel = p.channel GROUP BY p.channel""")
def snk10_results_table(spark, sf_dir):
    """The results table: one row per trace, one column per report value."""
    p, _, e = found(spark, sf_dir)
    a = p.groupBy(*TRACE).agg(F.count("*").alias("n_points"), F.round(F.avg("intensity"), 6).alias("raw_mean"))
    b = e.groupBy(*TRACE).agg(F.count("*").alias("n_events"), F.round(F.avg("net_area"), 6).alias("mean_net"))
    return a.join(b, TRACE).select("channel", "n_points", "n_events", "raw_mean", "mean_net")
