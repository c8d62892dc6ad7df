"""A method file run from end to end, look-ups in quantile tables, jittered samples and further variants, with their SQL."""

from pyspark.sql import functions as F

from blipstream.functions.distributions import compound_poisson_limit
from blipstream.functions import parsing
from blipstream.operators import align, events, lookup, quant, rolling, sampling, search, spectra, thresholds, traces
from blipstream.sources import nu, sinks

from .inputs import COUNT_POINTS, EVENT_POINTS, count_points, event_points, table
from .method import compile_method, with_thresholds
from .signal_queries import FOUND, OFFSET, SQL as SIGNAL_SQL, Z, clip_sql, found, model
from .table_queries import COVER, high_runs, runs_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def parameter_set(tag: str, **values) -> str:
    return f"<{tag}>" + "".join(f'<parameter value="{v}" xmlID="{k}"/>' for k, v in values.items()) + f"</{tag}>"


#: A constant Gaussian background of five clipping rounds, a search between mean and one spread above it, the gate of a mean signal and one of points.
METHOD = "<root><method>" + "".join(
    [
        parameter_set("BaselineParams", baselineDynamics="CONSTANT", generalDistributionApproach="GAUSSIAN_MODEL", outlierTestTypeGauss="FIXED_NUMBER_ITERATION", outlierGaussMaxNonSmartIncrements=5, outlierFactorGaussStart=3.0),
        parameter_set("SearchParams", enableBoolean="true", searchAlgorithm="SPLIT_CORRECTION", startCriterium="MEAN", stopCriterium="MEAN", heightFilter="FACTOR", heightFilterFactorValue=1.0, startStopOffset=0.5, netCorrectionOption="BLN_MEAN"),
        parameter_set("GatingParams", enableBoolean="false", gatingOption="HEIGHT", measureOfSignificance="CUSTOM_VALUE", absoluteCutoff=1e9),
        parameter_set("GatingParams", enableBoolean="true", gatingOption="MEAN_SIGNAL", measureOfSignificance="Z_VALUE", zValue=0.8, factorBoolean="false", factor=1.0),
        parameter_set("GatingParams", enableBoolean="true", gatingOption="FEWER_POINTS_THAN", absoluteCutoff=4.0),
    ]
) + "</method></root>"


@query(FOUND + " SELECT e.channel, e.start_idx, e.end_idx, round(e.area - greatest(0.1, e.location) * n_points, 6) AS net_area FROM e JOIN b ON b.channel = e.channel WHERE area / n_points > b.location + 0.8 * b.spread AND n_points < 4")
def src11_method(spark, sf_dir):
    found = compile_method(METHOD).run(event_points(spark, sf_dir))
    return found.select("channel", "start_idx", "end_idx", F.round("net_area", 6).alias("net_area"))


#: A coarse grid of compound-Poisson quantiles.
MEANS, SHAPES, ALPHAS = (1.0, 5.0, 20.0, 40.0, 80.0, 200.0), (0.3, 0.6), (1e-6, 1e-3)
GRID = "grid(mean, shape, alpha, v) AS (VALUES " + ", ".join(f"({m}::DOUBLE, {s}::DOUBLE, {a}::DOUBLE, {compound_poisson_limit(m, s, a)!r}::DOUBLE)" for m in MEANS for s in SHAPES for a in ALPHAS) + ")"
CORNERS = " UNION ALL ".join(
    f"SELECT channel, part, location, shape, (SELECT v FROM grid g WHERE g.mean = m{i} AND g.shape = {SHAPES[j]} AND g.alpha = {ALPHAS[k]}) * ({'tm' if i else '(1 - tm)'}) * ({'ts' if j else '(1 - ts)'}) * ({'ta' if k else '(1 - ta)'}) AS v FROM c"
    for i in (0, 1)
    for j in (0, 1)
    for k in (0, 1)
)


@query(f"""WITH {EVENT_POINTS}, {GRID}, s AS (SELECT channel, CAST(idx // 150 AS INTEGER) AS part, avg(intensity) AS location, 0.3 + 0.3 * (idx // 150 % 5) / 4.0 AS shape FROM pts GROUP BY channel, idx // 150),
b AS (SELECT *, (SELECT max(mean) FROM grid WHERE mean <= location) AS m0, (SELECT min(mean) FROM grid WHERE mean > location) AS m1 FROM s), c AS (SELECT *, (location - m0) / (m1 - m0) AS tm, (shape - 0.3) / 0.3 AS ts, (1e-4 - 1e-6) / (1e-3 - 1e-6) AS ta FROM b)
SELECT channel, part, round(sum(v), 6) AS critical FROM ({CORNERS}) GROUP BY channel, part""")
def dis6_table_quantiles(spark, sf_dir):
    """Compound-Poisson limits of short stretches, by eight nodes of a table each."""
    part = F.floor(F.col("idx") / 150).cast("int")
    s = event_points(spark, sf_dir).groupBy("channel", part.alias("part")).agg(F.avg("intensity").alias("mean")).withColumn("shape", 0.3 + 0.3 * (F.col("part") % 5) / 4.0).withColumn("alpha", F.lit(1e-4))
    return lookup.looked_up(s, lookup.compound_grid(spark, MEANS, SHAPES, ALPHAS), "critical").select("channel", "part", F.round("critical", 6).alias("critical"))


def jittered_sql(place: str) -> str:
    return f"""WITH r AS (SELECT o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
t AS (SELECT DISTINCT o_orderpriority, n, i, CAST(floor(i / 99.0::DOUBLE * (n - 1) + 0.5) AS BIGINT) AS centre FROM r, (SELECT unnest(range(0, 100)) AS i)),
k AS (SELECT o_orderpriority, i, CASE WHEN n <= 100 THEN i ELSE greatest(0, least(n - 1, centre + {place})) END AS r FROM t)
SELECT k.o_orderpriority, CAST(i AS INTEGER) AS nth, o_totalprice FROM k JOIN r ON r.o_orderpriority = k.o_orderpriority AND r.r = k.r"""


@query(jittered_sql("CAST(floor((i * 0.6180339887::DOUBLE) % 1 * 7) AS BIGINT) - 3"))
def sc14_golden_jitter(spark, sf_dir):
    return sampling.quantile_sample(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 100, 3, "GOLDEN")


@query(jittered_sql("i % 7 - 3"))
def sc14_hashed_jitter(spark, sf_dir):
    return sampling.quantile_sample(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 100, 3, "HASHED")


@query()
def sc14_murmur_jitter(spark, sf_dir):
    """As the others, moved by a hash that SQL doesn't have."""
    return sampling.quantile_sample(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 100, 3, "MURMUR")


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR value BETWEEN 10 AND 30")
def fil10_only_exceptions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), "value")
    own = spark.createDataFrame([("click", 10.0, 30.0)], "channel string, low double, high double")
    return events.with_overrides(e, own, 20.0, 60.0, "value", only_exceptions=True).select("event_id")


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND value BETWEEN 5 * 2.0 AND 15 * 2.0) OR (event_type = 'view' AND value BETWEEN 5 * 5.0 / 0.4 AND 15 * 5.0 / 0.4)")
def fil4_mass_bounds(spark, sf_dir):
    """Bounds in fg, taken to counts by the calibration of each channel."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("channel"), "value")
    cal = spark.createDataFrame([("click", "MASS", 2.0, 5.0, 40.0), ("view", "SIZE", 2.0, 5.0, 40.0)], "channel string, strategy string, np_cts_per_fg double, ionic_cts_per_fg double, aerosol_te_pct double")
    bounds = events.as_counts(spark.createDataFrame([("click", 5.0, 15.0), ("view", 5.0, 15.0)], "channel string, low double, high double"), cal)
    return events.with_overrides(e.join(bounds.select("channel"), "channel", "left_semi"), bounds, 0.0, 0.0, "value").select("event_id")


@query("SELECT event_id, round(ln(value * (1 + event_id % 4)) - ln(1 + 0.25) / (1 + event_id % 4) / 2, 9) AS mu, round(sqrt(ln(1 + 0.25) / (1 + event_id % 4)), 9) AS sigma FROM events WHERE value > 0")
def sc19_lo_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 0")
    made = e.withColumn("s", quant.lognormal_sum_lo(F.col("value"), F.col("value") / 2, 1 + F.col("event_id") % 4))
    return made.select("event_id", F.round("s.mu", 9).alias("mu"), F.round("s.sigma", 9).alias("sigma"))


_DRIFT = SIGNAL_SQL["agg15_drift_factor"].replace("round(range_term * rsd_term * trend_term, 5)", "range_term * rsd_term * trend_term")


@query(f"WITH dr AS ({_DRIFT}), ev AS (SELECT channel, count(*) AS n FROM ({FOUND} SELECT channel, start_idx FROM e) GROUP BY channel) SELECT CAST(ceil(avg(n)) AS BIGINT) AS mean_events, round(0.5 * (max(drift) + avg(drift)), 5) AS drift FROM ev JOIN dr USING (channel)")
def agg16_drift_and_events(spark, sf_dir):
    """Over the channels: mean events, rounded up, and the middle between the mean and the largest drift factor."""
    p, _, e = found(spark, sf_dir)
    short = p.groupBy("sample_id", "channel", F.floor(F.col("idx") / 5).alias("idx")).agg(F.avg("intensity").alias("intensity"))
    drift = traces.drift_factor(short).select("channel", "drift")
    return quant.across_channels(e.groupBy("channel").agg(F.count("*").alias("n_events")).join(drift, "channel")).select("mean_events", F.round("drift", 5).alias("drift"))


@query("""WITH e AS (SELECT 's' || (user_id % 4) AS sample_id, event_type AS channel, value, epoch_us(ts) / 1e6 AS t FROM events), tr AS (SELECT sample_id, channel, max(t) - min(t) AS seconds, avg(value) AS raw_mean, CASE WHEN sample_id IN ('s0', 's1') THEN 'a' ELSE 'b' END AS merged_id FROM e GROUP BY 1, 2),
o AS (SELECT merged_id, channel, count(*) AS n_samples, sum(seconds) AS seconds, avg(raw_mean) AS raw_mean FROM tr GROUP BY 1, 2),
g AS (SELECT CASE WHEN sample_id IN ('s0', 's1') THEN 'a' ELSE 'b' END AS merged_id, channel, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS md FROM e WHERE value > 60 GROUP BY 1, 2)
SELECT merged_id, channel, n_samples, n, round(seconds, 3) AS seconds, round(n / seconds, 9) AS per_second, round(raw_mean, 7) AS raw_mean, round(m, 7) AS mean_net_area, round(sd, 7) AS sd_net_area, round(md, 7) AS median_net_area FROM o JOIN g USING (merged_id, channel)""")
def agg14_merged_samples(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id") % 4).alias("sample_id"), F.col("event_type").alias("channel"), F.col("value").alias("net_area"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    per = e.groupBy("sample_id", "channel").agg((F.max("t") - F.min("t")).alias("seconds"), F.avg("net_area").alias("raw_mean"))
    groups = spark.createDataFrame([("s0", "a"), ("s1", "a"), ("s2", "b"), ("s3", "b")], "sample_id string, merged_id string")
    done = events.merged_samples(e.where("net_area > 60"), per, groups)
    return done.select("merged_id", "channel", "n_samples", "n", F.round("seconds", 3).alias("seconds"), F.round("per_second", 9).alias("per_second"), *(F.round(c, 7).alias(c) for c in ("raw_mean", "mean_net_area", "sd_net_area", "median_net_area")))


@query("""WITH x AS (SELECT vec_id, label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT label, i FROM x WHERE v > 0.3 GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT label, string_agg(CAST(i AS VARCHAR), '+' ORDER BY CAST(i AS VARCHAR)) AS population FROM k GROUP BY label) SELECT e.vec_id AS event, e.label AS cluster, coalesce(population, '') AS population FROM embeddings e LEFT JOIN n ON n.label = e.label""")
def mod10_populations(spark, sf_dir):
    """Each event in the population of its cluster, named after the channels that stand out in it."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("event"), F.posexplode("embedding").alias("element", "intensity")).withColumn("intensity", F.col("intensity").cast("double"))
    return spectra.cluster_spectra(x, 0.3)[1]


@query(f"""WITH {EVENT_POINTS}, {runs_sql('x', 90)}, {COVER}, v AS (SELECT p.channel, start_idx, end_idx, count(*) AS n_points, sum(intensity) AS area, arg_min(idx, row(-intensity, idx)) AS peak FROM m JOIN pts p ON p.idx BETWEEN start_idx AND end_idx GROUP BY 1, 2, 3),
f AS (SELECT p.* FROM pts p WHERE NOT EXISTS (SELECT 1 FROM m WHERE p.idx BETWEEN m.start_idx AND m.end_idx)),
b AS (SELECT v.channel, v.start_idx, any_value(n_points) AS n_points, any_value(area) AS area, count(f.idx) AS n, coalesce(quantile_cont(f.intensity, 0.5), 0) AS bg FROM v LEFT JOIN f ON f.channel = v.channel AND f.idx > peak - 40 AND f.idx <= peak + 40 GROUP BY 1, 2)
SELECT channel, start_idx, n_points, n AS n_bg, round(bg, 7) AS bg_median, round(area - bg * n_points, 6) AS net_area FROM b""")
def joi7_background(spark, sf_dir):
    m = align.by_coverage(high_runs(spark, sf_dir, 90))
    done = rolling.realigned(m, event_points(spark, sf_dir), 40)
    return done.select("channel", "start_idx", "n_points", "n_bg", F.round("bg_median", 7).alias("bg_median"), F.round("net_area", 6).alias("net_area"))


@query(FOUND + """, c AS (SELECT channel, count(*) AS n_events FROM e GROUP BY channel) SELECT e.channel, CAST(row_number() OVER (PARTITION BY e.channel ORDER BY start_idx) - 1 AS INTEGER) AS event_ord, round(area, 5) AS area, round(area - greatest(0.1, location) * n_points, 5) AS net_area, height,
  round(greatest(0, height) - greatest(0.1, location), 5) AS net_height, round(CASE WHEN e.start_idx > 0 THEN z.time_s - p.time_s ELSE n.time_s - s.time_s END * 1e6, 0) AS duration_us, n_points, round(greatest(0.1, location) * n_points, 5) AS bg_per_event, n_events,
  round(CASE WHEN n_points <= 2 THEN 1.0 ELSE 2.0 * (end_idx - peak_idx) / greatest(1, end_idx - start_idx) END, 6) AS asymmetry, start_idx, end_idx, round(m.time_s, 6) AS center_time_s
FROM e JOIN c ON c.channel = e.channel JOIN pts z ON z.channel = e.channel AND z.idx = e.end_idx LEFT JOIN pts p ON p.channel = e.channel AND p.idx = e.start_idx - 1 LEFT JOIN pts n ON n.channel = e.channel AND n.idx = e.end_idx + 1
JOIN pts s ON s.channel = e.channel AND s.idx = e.start_idx JOIN pts m ON m.channel = e.channel AND m.idx = (e.start_idx + e.end_idx) // 2""")
def prj1_all_parameters(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    done = events.all_parameters(e, p)
    digits = {"area": 5, "net_area": 5, "net_height": 5, "bg_per_event": 5, "duration_us": 0, "asymmetry": 6, "center_time_s": 6}
    return done.select("channel", "event_ord", *(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in events.PARAMETERS))


@query(f"""WITH {EVENT_POINTS}, {clip_sql(5)}, t AS (SELECT p.channel, idx, intensity, greatest(0.1, location) + {OFFSET} AS s, greatest(0.1, location + {Z} * spread) AS h FROM pts p JOIN b USING (channel)),
u AS (SELECT *, greatest(ceil(round(avg(intensity) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9)), intensity) AS y FROM t),
g AS (SELECT *, sum(CASE WHEN y < s THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM u),
r AS (SELECT channel, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_points, sum(intensity) AS area, max(intensity) AS height, arg_min(h, row(-intensity, idx)) AS h FROM g WHERE y >= s GROUP BY channel, island)
SELECT channel, start_idx, end_idx, n_points, round(area, 6) AS area, height FROM r WHERE height > h""")
def seq4c_smooth_merge(spark, sf_dir):
    p, b = model(spark, sf_dir)
    return search.smooth_merge_search(with_thresholds(p, b, OFFSET, Z), 4).select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), "height")


#: The weights of a cubic over five points at its middle.
CUBIC = (-3, 12, 17, 12, -3)
NEAR = " + ".join(f"{w} * (SELECT q.intensity FROM t q WHERE q.channel = t.channel AND q.idx = CASE WHEN t.idx + {k} < 0 THEN -(t.idx + {k}) WHEN t.idx + {k} > n - 1 THEN 2 * (n - 1) - (t.idx + {k}) ELSE t.idx + {k} END)" for k, w in zip(range(-2, 3), CUBIC, strict=True))


@query(f"""WITH {EVENT_POINTS}, {clip_sql(5)}, t AS MATERIALIZED (SELECT p.channel, idx, intensity, greatest(0.1, location) + {OFFSET} AS s, greatest(0.1, location + {Z} * spread) AS h, count(*) OVER (PARTITION BY p.channel) AS n FROM pts p JOIN b USING (channel)),
u AS (SELECT *, greatest(ceil(round(({NEAR}) / 35.0, 9)), intensity) AS y FROM t),
g AS (SELECT *, sum(CASE WHEN y < s THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM u),
r AS (SELECT channel, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_points, sum(intensity) AS area, max(intensity) AS height, arg_min(h, row(-intensity, idx)) AS h FROM g WHERE y >= s GROUP BY channel, island)
SELECT channel, start_idx, end_idx, n_points, round(area, 6) AS area, height FROM r WHERE height > h""")
def seq4c_cubic(spark, sf_dir):
    p, b = model(spark, sf_dir)
    return search.smooth_merge_search(with_thresholds(p, b, OFFSET, Z), 5, "SAVITZKY_GOLAY").select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), "height")


#: The isotopes that the channels of the count traces stand for: two elements claim mass 50.
CHANNELS = [("AF", "Ti", 48), ("RF", "Ti", 50), ("NO", "Cr", 50), ("NF", "Cr", 52), ("AO", "Cr", 52)]
CHANNEL_SQL = "ch(channel, element, mass) AS (VALUES " + ", ".join(map(str, CHANNELS)) + ")"


@query(f"WITH {COUNT_POINTS}, {CHANNEL_SQL} SELECT 'Σ' || element AS channel, idx, CAST(sum(intensity) AS DOUBLE) AS intensity, count(*) AS n_isotopes FROM pts JOIN ch USING (channel) WHERE mass <> 50 AND channel <> 'NF' GROUP BY element, idx")
def seq14_element_sum(spark, sf_dir):
    """Sums without the mass that two elements claim; of two channels of one mass the first counts."""
    channels = spark.createDataFrame(CHANNELS, "channel string, element string, mass_number int")
    return traces.element_sum(count_points(spark, sf_dir), channels, exclude_isobars=True).select("channel", "idx", "intensity", "n_isotopes")


@query(f"WITH {COUNT_POINTS} SELECT channel, count(*) FILTER (WHERE intensity > 45) AS n FROM pts GROUP BY channel HAVING count(*) FILTER (WHERE intensity > 45) > 500")
def src10_busy_channels(spark, sf_dir):
    return nu.busy_channels(count_points(spark, sf_dir), 45.0, 500).select("channel", "n")


@query("SELECT p_brand AS channel, round(100 * sum((p_retailprice * 1e6 * p_size / 60000) * (p_partkey / 10.0)) / sum(pow(p_retailprice * 1e6 * p_size / 60000, 2)), 9) AS number_te_pct FROM part GROUP BY p_brand")
def mod5_number_efficiency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("channel"), (F.col("p_retailprice") * 1e6).alias("particles_per_l"), F.col("p_size").cast("double").alias("flow_ml_min"), F.col("p_partkey").alias("n_events"), F.lit(10.0).alias("seconds"))
    return quant.number_calibrated(p).select("channel", F.round("number_te_pct", 9).alias("number_te_pct"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'IONIC' ELSE 'PARTICLE' END AS sample_type, CASE WHEN p_size % 3 > 0 THEN CAST(p_size + 0.5 AS DOUBLE) END AS diameter_nm, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) * 1000 END AS concentration_ug_l, p_size / 1000.0::DOUBLE AS flow_ml_min FROM part")
def sc20_names(spark, sf_dir):
    """What made-up file names say: a particle size or a concentration, and a flow."""
    k = F.col("p_size").cast("string")
    name = F.concat(F.lit("run1_"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("c"), k, F.lit("ppm"))).otherwise(F.concat(F.lit("D"), k, F.lit("p5nm"))), F.lit("_x_q"), k, F.lit("E0ulmin_5"))
    made = table(spark, sf_dir, "part").select("p_partkey", parsing.name_conditions(parsing.name_blocks(name)).alias("c"))
    return made.select("p_partkey", "c.sample_type", "c.diameter_nm", "c.concentration_ug_l", "c.flow_ml_min")


@query(f"WITH {EVENT_POINTS}, {clip_sql(5)} SELECT p.channel, p.idx, CASE WHEN p.intensity > location + 1.2815515655446004 * spread THEN 1 ELSE 0 END AS below_a_tenth FROM pts p JOIN b USING (channel)")
def dis2_model_p(spark, sf_dir):
    """Which points have a p below a tenth by the model of their trace; p itself needs a special function that SQL lacks."""
    p, b = model(spark, sf_dir)
    joined = p.join(F.broadcast(b.select("sample_id", "channel", "location", "spread")), ["sample_id", "channel"]).withColumn("distr", F.lit("GAUSSIAN"))
    return thresholds.model_p(joined).select("channel", "idx", (F.col("p") < 0.1).cast("int").alias("below_a_tenth"))


@query("""WITH r AS (SELECT 'n' || c_nationkey AS sample_id, c_acctbal AS area, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row, dense_rank() OVER (ORDER BY 'n' || c_nationkey) AS line FROM customer)
SELECT sample_id, CAST(row AS INTEGER) AS row, CAST(row + 1 AS DOUBLE) AS cycle_ms, line * 20.0::DOUBLE AS x_um, (row + 1) * 20.0::DOUBLE AS y_um, area AS "0area", CAST(id AS DOUBLE) AS "1id" FROM r""")
def snk8_lines(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("sample_id"), F.col("c_acctbal").alias("area"), F.col("c_custkey").alias("id"), F.lit(1).alias("frame"))
    return sinks.lpc_lines(c, "id")
