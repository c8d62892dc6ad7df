"""Populations, spectra, limits and small functions, with their SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blipstream.functions import chemistry, parsing
from blipstream.operators import align, events, kernels, quant, spectra
from blipstream.operators.scan import middles
from blipstream.sources import sinks

from .inputs import COUNT_POINTS, EVENT_POINTS, count_points, event_points, table
from .signal_queries import FOUND, Z, clip_sql, found, model
from .stored import stored
from .table_queries import COVER, PAIRS, high_runs, runs_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(FOUND + " SELECT channel, start_idx, 'main' AS population FROM e UNION ALL SELECT channel, start_idx, 'MRoi(a)' FROM e WHERE height BETWEEN 60 AND 120")
def fil2_event_range(spark, sf_dir):
    _, _, e = found(spark, sf_dir)
    return events.manual_roi(e, "height", 60, 120, "a").select("channel", "start_idx", "population")


@query(FOUND + " SELECT channel, start_idx, n_points BETWEEN 2 AND 4 AS included FROM e")
def fil3_include_exclude(spark, sf_dir):
    _, _, e = found(spark, sf_dir)
    inside, outside = (events.roi(e, "n_points", 2, 4, k).select("channel", "start_idx", F.lit(k).alias("included")) for k in (True, False))
    return inside.unionByName(outside)


@query(PAIRS + """ SELECT y.channel, y.a AS start_idx, CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.channel = y.channel AND x.a <= y.z AND x.z >= y.a) THEN 'Matched' ELSE 'FPos' END AS population FROM y
UNION ALL SELECT x.channel, x.a, 'Fneg' FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE x.channel = y.channel AND x.a <= y.z AND x.z >= y.a)""")
def fil18_simulation_match(spark, sf_dir):
    truth, seen = high_runs(spark, sf_dir, 40), high_runs(spark, sf_dir, 70)
    hit = align.first_match(seen, truth).select("channel", "start_idx", F.when(F.col("match_start").isNull(), "FPos").otherwise("Matched").alias("population"))
    return hit.unionByName(align.first_match(truth, seen).where("match_start is null").select("channel", "start_idx", F.lit("Fneg").alias("population")))


@query(f"""WITH {EVENT_POINTS}, m AS (SELECT unnest(['ALL_LOADED', 'SELECTED', 'POSITIVE_LIST', 'NEGATIVE_LIST']) AS mode)
SELECT mode, channel, count(*) AS n FROM pts, m WHERE mode = 'ALL_LOADED' OR (mode = 'NEGATIVE_LIST') = (channel NOT IN ('click', 'view')) GROUP BY 1, 2""")
def fil20_channel_selection(spark, sf_dir):
    p = event_points(spark, sf_dir)
    made = [events.select_channels(p, m, ["click", "view"]).groupBy("channel").agg(F.count("*").alias("n")).withColumn("mode", F.lit(m)) for m in events.SELECTIONS]
    return reduce(DataFrame.unionByName, made)


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS INTEGER) AS nonzero, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive, CAST(len(list_filter(embedding, lambda x: x BETWEEN -0.1::FLOAT AND 0.1::FLOAT)) AS INTEGER) AS inside FROM embeddings")
def fil22_array_predicates(spark, sf_dir):
    e = F.col("embedding")
    low, high = (F.lit(v).cast("float") for v in (-0.1, 0.1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(e, lambda x: x != 0)).alias("nonzero"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"), F.size(F.filter(e, lambda x: x.between(low, high))).alias("inside"))


@query(f"WITH {EVENT_POINTS}, {clip_sql(5)} SELECT channel, round(greatest(location + {Z} * spread, location + 3 * sqrt(location)), 6) AS lod, round(greatest(location + {Z} * spread, location + 3 * sqrt(location)) - location, 6) AS net_lod FROM b")
def agg11_lod(spark, sf_dir):
    _, b = model(spark, sf_dir)
    lod = F.greatest(F.col("location") + Z * F.col("spread"), F.col("location") + 3 * F.sqrt("location"))
    return b.select("channel", F.round(lod, 6).alias("lod"), F.round(lod - F.col("location"), 6).alias("net_lod"))


@query(f"WITH {EVENT_POINTS} SELECT channel, round(avg(intensity) / 7.69e-5, 4) AS mean_cps, round(quantile_cont(intensity, 0.5) / 7.69e-5, 4) AS median_cps FROM pts GROUP BY channel")
def agg13_raw_cps(spark, sf_dir):
    points = event_points(spark, sf_dir)
    p = points.groupBy("channel").agg(F.avg("intensity").alias("m")).join(middles(points, F.col("intensity"), "d", ["channel"]), "channel")
    return p.select("channel", F.round(F.col("m") / 7.69e-5, 4).alias("mean_cps"), F.round(F.col("d") / 7.69e-5, 4).alias("median_cps"))


@query(FOUND + """, n AS (SELECT channel, count(*) AS n FROM e GROUP BY channel), r AS (SELECT channel, 1 + (max(intensity) - min(intensity)) / (avg(intensity) + 1) AS d FROM pts GROUP BY channel)
SELECT CAST(ceil(avg(n)) AS BIGINT) AS mean_events, round(0.5 * (max(d) + avg(d)), 6) AS drift FROM n JOIN r USING (channel)""")
def agg16_averages(spark, sf_dir):
    """Over the channels: mean events, rounded up, and the middle between the mean and the largest of a drift (here its range over all points)."""
    p, _, e = found(spark, sf_dir)
    drift = p.groupBy("channel").agg((1 + (F.max("intensity") - F.min("intensity")) / (F.avg("intensity") + 1)).alias("drift"))
    return quant.across_channels(e.groupBy("channel").agg(F.count("*").alias("n_events")).join(drift, "channel")).select("mean_events", F.round("drift", 6).alias("drift"))


SPECTRA = f"""WITH {EVENT_POINTS}, {runs_sql('x', 90)}, {COVER}, ev AS (SELECT *, row_number() OVER (ORDER BY start_idx) - 1 AS event_ord FROM m),
sp AS (SELECT event_ord, p.channel, sum(intensity) AS intensity, count(*) AS n_points FROM ev JOIN pts p ON p.idx BETWEEN start_idx AND end_idx GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS nth FROM pts p WHERE NOT EXISTS (SELECT 1 FROM m WHERE p.idx BETWEEN start_idx AND end_idx)), bg AS (SELECT channel, avg(intensity) AS background FROM fr WHERE nth % 5 = 0 GROUP BY channel)"""


def covered(spark, sf_dir):
    intervals = stored(align.by_coverage(high_runs(spark, sf_dir, 90)), "intervals")
    points = event_points(spark, sf_dir)
    return intervals, points, spectra.event_spectra(intervals, points)


@query(SPECTRA + ", n AS (SELECT sp.channel, avg(intensity - background * n_points) AS net FROM sp JOIN bg USING (channel) GROUP BY sp.channel) SELECT channel, round(net, 5) AS net, round(net / sum(net) OVER (), 6) AS share FROM n")
def agg18_19_spectrum(spark, sf_dir):
    intervals, points, s = covered(spark, sf_dir)
    net = spectra.spectrum(s, spectra.sampled_background(points, intervals))
    return spectra.normalised(net, ["sample_id"], "net", "sum").select("channel", F.round("net", 5).alias("net"), F.round("share", 6).alias("share"))


@query(SPECTRA + " SELECT event_ord::INTEGER AS event_ord, substr(channel, 1, 1) AS element, round(sum(intensity), 5) AS intensity FROM sp GROUP BY 1, 2")
def agg20_element_sum(spark, sf_dir):
    _, _, s = covered(spark, sf_dir)
    return s.groupBy("event_ord", F.substring("channel", 1, 1).alias("element")).agg(F.round(F.sum("intensity"), 5).alias("intensity"))


@query(FOUND + """, l AS (SELECT channel, n_points, max(start_idx) AS start_idx FROM e GROUP BY channel, n_points)
SELECT e.channel, e.n_points, CAST(p.idx - e.start_idx AS INTEGER) AS "offset", round(p.intensity / e.area, 7) AS share FROM l JOIN e USING (channel, n_points, start_idx) JOIN pts p ON p.channel = e.channel AND p.idx BETWEEN e.start_idx AND e.end_idx""")
def agg24_profiles(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return events.profiles(e, p).select("channel", "n_points", "offset", F.round("share", 7).alias("share"))


@query(SPECTRA + ", s AS (SELECT event_ord, sum(intensity) AS total FROM sp GROUP BY event_ord) SELECT event_ord::INTEGER AS event_ord, row_number() OVER (ORDER BY round(total, 6) DESC, event_ord) - 1 AS nth FROM s")
def srt2_summed_order(spark, sf_dir):
    _, _, s = covered(spark, sf_dir)
    return events.summed_order(s.withColumn("intensity", F.col("intensity").cast("decimal(20,6)"))).select("event_ord", "nth")


@query(f"WITH {EVENT_POINTS}, n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM pts GROUP BY channel)) SELECT channel, count(*) AS n, round(sum(intensity), 4) AS total FROM pts, n WHERE idx < n.n GROUP BY channel")
def srt7_trimmed(spark, sf_dir):
    return events.trimmed(event_points(spark, sf_dir)).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 4).alias("total"))


@query("""SELECT metric, value FROM (SELECT 'events' AS metric, 0 AS pos, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'mean', 1, round(avg(value), 6) FROM events UNION ALL SELECT 'largest', 2, max(value) FROM events) ORDER BY pos""")
def srt8_declared_order(spark, sf_dir):
    """Results in the order in which the report declares them."""
    e = table(spark, sf_dir, "events").agg(F.count("*").cast("double").alias("events"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("largest"))
    return sinks.declared_rows(e, ["events", "mean", "largest"])


@query("SELECT x.s_suppkey, y.n_nationkey FROM (SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN s_nationkey END AS i FROM supplier) x JOIN (SELECT n_nationkey, CASE WHEN n_nationkey > 0 THEN n_nationkey END AS i FROM nation) y ON x.i IS NOT DISTINCT FROM y.i")
def joi8_channel_map(spark, sf_dir):
    """Channels of two samples by isotope, null-safe; nation 0 stands for no isotope."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") > 0, F.col("s_nationkey")).alias("isotope"), F.col("s_suppkey").alias("channel"))
    n = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") > 0, F.col("n_nationkey")).alias("isotope"), F.col("n_nationkey").alias("channel"))
    return events.mapped_channels(s, n).select(F.col("left_channel").alias("s_suppkey"), F.col("right_channel").alias("n_nationkey"))


@query(f"WITH {EVENT_POINTS} SELECT channel, count(*) AS n, round(sum(CASE WHEN channel = 'view' THEN 2 * intensity ELSE intensity END), 4) AS total FROM pts WHERE channel <> 'click' GROUP BY channel")
def set5_reconciled(spark, sf_dir):
    """A sample without views is imported anew without clicks, views doubled: clicks go, views come in, the rest stays as loaded."""
    p = event_points(spark, sf_dir)
    imported = p.where("channel <> 'click'").withColumn("intensity", 2 * F.col("intensity"))
    return events.reconciled(p.where("channel <> 'view'"), imported).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 4).alias("total"))


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), k AS (SELECT c_mktsegment AS g, least(63, floor((c_acctbal - lo) / (hi - lo) * 64)) AS bin, count(*) AS n FROM customer, b GROUP BY 1, 2),
a AS (SELECT DISTINCT g, i AS bin FROM k, (SELECT unnest(range(0, 64)) AS i)), f AS (SELECT a.g, a.bin, sum(coalesce(n, 0)) OVER (PARTITION BY a.g ORDER BY a.bin) / sum(n) OVER (PARTITION BY a.g) AS cdf FROM a LEFT JOIN k ON k.g = a.g AND k.bin = a.bin)
SELECT x.g, y.g AS h, round(sum(abs(x.cdf - y.cdf)) / 64, 8) AS distance FROM f x JOIN f y ON x.bin = y.bin AND x.g < y.g GROUP BY 1, 2""")
def agg28_emd_matrix(spark, sf_dir):
    d = spectra.emd_pairs(table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal"), "c_mktsegment", "c_acctbal")
    return d.select("g", "h", F.round("distance", 8).alias("distance"))


@query(FOUND + " SELECT e.channel, e.start_idx, CAST(p.idx - e.start_idx AS INTEGER) AS \"offset\", p.intensity FROM e JOIN pts p ON p.channel = e.channel AND p.idx BETWEEN e.start_idx - 2 AND e.end_idx + 1")
def seq16_flanked(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return spectra.flanked(e, p, 2, 1).select("channel", "start_idx", "offset", "intensity")


@query("""WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
t AS (SELECT DISTINCT g, floor((k + 0.5) * n / 100.0) AS r FROM r, (SELECT unnest(range(0, 100)) AS k)) SELECT g AS o_orderpriority, x AS o_totalprice FROM r JOIN t USING (g, r)""")
def sc14_down_sampled(spark, sf_dir):
    return spectra.down_sampled(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 100)


@query("SELECT n_nationkey, CAST(floor(n_nationkey * 0.3 + 0.5) AS BIGINT) AS rounded, round(log2(n_nationkey + 1), 8) AS log2, round(CASE WHEN n_nationkey <= 3 THEN 1.0 WHEN n_nationkey <= 10 THEN 1 + (n_nationkey - 3) * 2.0 / 7 WHEN n_nationkey <= 20 THEN 3 - (n_nationkey - 10) * 0.25 ELSE 0.5 END, 8) AS linear FROM nation")
def sc1_8_arithmetic(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k, parsing.java_round(k * 0.3).alias("rounded"), F.round(F.log2(k + 1), 8).alias("log2"), F.round(chemistry.interpolate(k, [(3, 1.0), (10, 3.0), (20, 0.5)]), 8).alias("linear"))


@query("SELECT s_suppkey, 'c' || (s_suppkey % 3) AS channel, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 10.0 + s_suppkey % 3 END IS NULL AS missing, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 11.0 ELSE 10.0 + s_suppkey % 3 END AS DOUBLE) AS aerosol_te_pct FROM supplier WHERE s_suppkey % 3 >= 0")
def sc11_filled_te(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.lit("s").alias("sample_id"), k, F.concat(F.lit("c"), (k % 3).cast("string")).alias("channel"), F.when(k % 3 != 0, 10.0 + k % 3).alias("aerosol_te_pct"), F.lit(None).cast("double").alias("number_te_pct"))
    channels = rows.select("sample_id", "channel", "aerosol_te_pct", "number_te_pct").distinct()
    filled = quant.filled_te(channels).select("channel", F.col("aerosol_te_pct").alias("filled"))
    return rows.join(filled, "channel").select("s_suppkey", "channel", F.col("aerosol_te_pct").isNull().alias("missing"), F.col("filled").alias("aerosol_te_pct"))


@query("""SELECT p_partkey, round((1 + p_size % 4) * 55.845 / ((1 + p_size % 4) * 55.845 + (p_size % 7) * 15.999 + (p_size % 3) * (15.999 + 1.008)), 8) AS fraction FROM part""")
def sc12_mass_fraction(spark, sf_dir):
    """Iron in formulas like Fe2O3(OH)2, one for each part."""
    n = [((F.col("p_size") % m) + k).cast("string") for m, k in ((4, 1), (7, 0), (3, 0))]
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Fe"), n[0], F.lit("O"), n[1], F.lit("(OH)"), n[2]).alias("formula"))
    return chemistry.mass_fractions(p, "formula", "Fe", {"Fe": 55.845, "O": 15.999, "H": 1.008}).select("p_partkey", F.round("fraction", 8).alias("fraction"))


@query("""WITH a AS (SELECT p_brand, sum(p_size * p_retailprice) / sum(p_size * p_size) AS np FROM part GROUP BY p_brand), b AS (SELECT p_brand, sum(p_partkey * p_retailprice) / sum(CAST(p_partkey AS DOUBLE) * p_partkey) AS ionic FROM part GROUP BY p_brand)
SELECT p_brand AS channel, round(np, 6) AS np_cts_per_fg, round(ionic, 6) AS ionic_cts_per_fg, round(100 * ionic / np, 6) AS aerosol_te_pct FROM a JOIN b USING (p_brand)""")
def mod5_calibration(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    standards = p.select(F.col("p_brand").alias("channel"), F.col("p_size").cast("double").alias("mass_fg"), F.col("p_retailprice").alias("net_signal"))
    ionic = p.select(F.col("p_brand").alias("channel"), F.col("p_partkey").cast("double").alias("flow_fg_s"), F.col("p_retailprice").alias("cps"))
    return quant.calibrated(standards, ionic).select("channel", *[F.round(c, 6).alias(c) for c in ("np_cts_per_fg", "ionic_cts_per_fg", "aerosol_te_pct")])


@query()
def mod9_agglomerate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.posexplode("embedding").alias("at", "v"))
    means = e.groupBy("cluster", "at").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    c = means.groupBy("cluster").agg(F.max("n").cast("double").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("centroid"))
    return spectra.agglomerate(c, "centroid", "weight", 0.5)


@query()
def mod9_agglomerate_blocks(spark, sf_dir):
    """Every vector is a cluster of its own: over a block of centroids, merged with the drift guard."""
    c = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cluster"), F.lit(1.0).alias("weight"), "embedding")
    return spectra.agglomerate(c, "embedding", "weight", 0.6, block_rows=200)


@query(f"""WITH {COUNT_POINTS}, n AS (SELECT channel, count(*) AS n FROM pts GROUP BY channel), a AS (SELECT channel, n, 0 AS anchor FROM n UNION SELECT channel, n, n - 1 FROM n UNION SELECT channel, n, unnest(range(0, greatest(1, n // 5000))) * 5000 + 2500 FROM n)
SELECT channel, CAST(anchor AS INTEGER) AS anchor FROM a WHERE anchor < n""")
def seq18_polyline(spark, sf_dir):
    n = count_points(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    return n.select("channel", F.explode(spectra.polyline(F.col("n"), 5000)).alias("anchor")).withColumn("anchor", F.col("anchor").cast("int"))


@query(FOUND + " SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY start_idx) - 1 AS INTEGER) AS event_ord, round(area, 5) AS area, round(area - greatest(0.1, location) * n_points, 5) AS net_area, height, round(greatest(0, height) - greatest(0.1, location), 5) AS net_height, n_points, round(greatest(0.1, location) * n_points, 5) AS bg_per_event FROM e")
def prj1_snk2_population(spark, sf_dir):
    _, _, e = found(spark, sf_dir)
    return e.select("channel", "event_ord", *[F.round(c, 5).alias(c) for c in ("area", "net_area")], "height", F.round("net_height", 5).alias("net_height"), "n_points", F.round("bg_per_event", 5).alias("bg_per_event"))


#: Counts of which most are 0, as a detector of single ions gives them.
IONS = f"{COUNT_POINTS}, ions AS (SELECT channel, idx, greatest(0, intensity - 35) AS y FROM pts), st AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE y = 0) AS zeros, avg(y) AS m, var_samp(y) AS v FROM ions GROUP BY channel), sh AS (SELECT channel, CASE WHEN zeros > 50 AND -ln(zeros / n) > 0 AND v / -ln(zeros / n) / pow(m / -ln(zeros / n), 2) > 1 THEN sqrt(ln(v / -ln(zeros / n) / pow(m / -ln(zeros / n), 2))) END AS shape FROM st)"


def ions(spark, sf_dir):
    return count_points(spark, sf_dir).withColumn("intensity", F.greatest(F.lit(0.0), F.col("intensity") - 35))


@query(f"WITH {IONS} SELECT channel, round(shape, 8) AS shape FROM sh")
def agg25_shape(spark, sf_dir):
    s = kernels.empirical_shape(ions(spark, sf_dir))
    return s.select("channel", F.round(F.nanvl("shape", F.lit(None).cast("double")), 8).alias("shape"))


@query(f"WITH {IONS} SELECT round(avg(shape), 8) AS mean_shape FROM sh")
def agg26_mean_shape(spark, sf_dir):
    s = kernels.empirical_shape(ions(spark, sf_dir)).where(~F.isnan("shape"))
    return s.agg(F.round(F.avg("shape"), 8).alias("mean_shape"))
