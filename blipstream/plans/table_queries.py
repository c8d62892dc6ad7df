"""Alignment, histogram, model, calibration, parsing and set queries, with their SQL."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blipstream.functions import chemistry, parsing
from blipstream.operators import align, events, histogram, models, quant, search
from blipstream.sources import sinks

from .inputs import COUNT_POINTS, EVENT_POINTS, count_points, event_points, table
from .signal_queries import FOUND, QUARTILES, found, tail_sql

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def high_runs(spark, sf_dir, level: float) -> DataFrame:
    """Maximal runs of points at or above level: simple interval tables for the joins."""
    p = event_points(spark, sf_dir)
    flat = p.withColumns({k: F.lit(level) for k in ("start_thr", "stop_thr", "height_thr")})
    return search.hysteresis_points(flat).groupBy("sample_id", "channel", "island").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx")).drop("island")


def runs_sql(name: str, level: float) -> str:
    return f"""{name}_g AS (SELECT *, intensity < {level} AS brk, sum(CASE WHEN intensity < {level} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM pts),
{name} AS (SELECT channel, min(idx) AS a, max(idx) AS z FROM {name}_g WHERE NOT brk GROUP BY channel, island)"""


PAIRS = f"WITH {EVENT_POINTS}, {runs_sql('x', 40)}, {runs_sql('y', 70)}"


@query(PAIRS + " SELECT x.channel, x.a AS start_idx, x.z AS end_idx, min(y.a) AS match_start FROM x LEFT JOIN y ON y.channel = x.channel AND x.a <= y.z AND x.z >= y.a GROUP BY 1, 2, 3")
def joi4_first_match(spark, sf_dir):
    return align.first_match(high_runs(spark, sf_dir, 40), high_runs(spark, sf_dir, 70)).select("channel", "start_idx", "end_idx", "match_start")


@query(PAIRS + """, t AS (SELECT channel, count(*) AS n_truth, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM y WHERE y.channel = x.channel AND x.a <= y.z AND x.z >= y.a)) AS matched FROM x GROUP BY channel),
f AS (SELECT channel, count(*) AS n_found, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM x WHERE y.channel = x.channel AND x.a <= y.z AND x.z >= y.a)) AS tp FROM y GROUP BY channel)
SELECT channel, n_truth, matched, n_found, tp, n_found - tp AS fp, n_truth - matched AS fn, round(tp / n_found, 6) AS precision, round(matched / n_truth, 6) AS recall,
  round(2 * (tp / n_found) * (matched / n_truth) / (tp / n_found + matched / n_truth), 6) AS f_score FROM t JOIN f USING (channel)""")
def agg23_27_error_rates(spark, sf_dir):
    r = align.error_rates(high_runs(spark, sf_dir, 40), high_runs(spark, sf_dir, 70))
    return r.select("channel", "n_truth", "matched", "n_found", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f_score")])


COVER = """o AS (SELECT *, max(z) OVER (ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM x),
i AS (SELECT *, sum(CASE WHEN ahead IS NULL OR a > ahead + 1 THEN 1 ELSE 0 END) OVER (ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM o), m AS (SELECT min(a) AS start_idx, max(z) AS end_idx FROM i GROUP BY grp)"""


@query(f"WITH {EVENT_POINTS}, {runs_sql('x', 90)}, {COVER} SELECT start_idx, end_idx FROM m")
def joi5_coverage(spark, sf_dir):
    return align.by_coverage(high_runs(spark, sf_dir, 90)).select("start_idx", "end_idx")


@query(f"""WITH RECURSIVE {EVENT_POINTS}, {runs_sql('x', 97)}, u AS (SELECT DISTINCT a, z FROM x),
l AS (SELECT p.a, p.z, q.a AS b, q.z AS y FROM u p JOIN u q ON p.a <= q.z AND p.z >= q.a WHERE least(p.z, q.z) - greatest(p.a, q.a) + 1 >= CASE WHEN p.z - p.a < 3 OR q.z - q.a < 3 THEN 1 ELSE 2 END),
r AS (SELECT a, z, a AS b, z AS y FROM u UNION SELECT r.a, r.z, l.b, l.y FROM r JOIN l ON l.a = r.b AND l.z = r.y)
SELECT DISTINCT start_idx, end_idx FROM (SELECT min(b) AS start_idx, max(y) AS end_idx FROM r GROUP BY a, z)""")
def joi6_connection(spark, sf_dir):
    return align.by_connection(high_runs(spark, sf_dir, 97)).select("start_idx", "end_idx")


@query(f"WITH {EVENT_POINTS}, {runs_sql('x', 90)}, {COVER} SELECT p.channel, start_idx, end_idx, count(*) AS n_points, round(sum(intensity), 6) AS area, max(intensity) AS height FROM m JOIN pts p ON p.idx BETWEEN start_idx AND end_idx GROUP BY 1, 2, 3")
def joi7_all_channels(spark, sf_dir):
    m = align.by_coverage(high_runs(spark, sf_dir, 90))
    return align.broadcast_to_channels(m, event_points(spark, sf_dir)).select("channel", "start_idx", "end_idx", "n_points", F.round("area", 6).alias("area"), "height")


@query(PAIRS + " SELECT x.channel, x.a AS start_idx, y.a AS other_start, CAST(least(x.z, y.z) - greatest(x.a, y.a) + 1 AS INTEGER) AS shared FROM x JOIN y ON y.channel = x.channel AND x.a <= y.z AND x.z >= y.a")
def set6_shared_indices(spark, sf_dir):
    return align.numbered_ratio(high_runs(spark, sf_dir, 40), high_runs(spark, sf_dir, 70)).select("channel", "start_idx", "other_start", "shared")


@query("""WITH w AS (SELECT p_partkey, p_retailprice AS mz FROM part), r AS (SELECT DISTINCT round(p_retailprice * 1.01, 3) AS recorded_mz FROM part), j AS (SELECT p_partkey, mz, recorded_mz FROM w JOIN r ON recorded_mz BETWEEN mz - 0.5 AND mz + 0.5 WHERE abs(mz - recorded_mz) <= 0.5)
SELECT p_partkey, arg_min(recorded_mz, row(round(abs(mz - recorded_mz), 9), recorded_mz)) AS recorded_mz FROM j GROUP BY p_partkey""")
def joi9_nearest(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = p.select("p_partkey", F.col("p_retailprice").alias("mz"))
    return align.nearest(wanted, p.select(F.round(F.col("p_retailprice") * 1.01, 3).alias("recorded_mz")).distinct(), 0.5).select("p_partkey", "recorded_mz")


ISO = "iso(element, z, mass_number, exact_mass, abundance) AS (VALUES " + ", ".join(f"('{e}', {z}, {m}, {x!r}::DOUBLE, {a!r}::DOUBLE)" for e, z, m, x, a in chemistry.ISOTOPES) + ")"


@query(f"WITH {ISO}, i AS (SELECT mass_number, string_agg(element, ',' ORDER BY element) AS elements FROM iso GROUP BY mass_number HAVING count(*) > 1) SELECT p_partkey, mass_number, elements FROM part JOIN i ON mass_number = p_size")
def joi10_isobars(spark, sf_dir):
    """The parts whose size, as a mass number, more than one element claims."""
    shared = align.isobars(chemistry.isotopes(spark)).select("mass_number", F.array_join("elements", ",").alias("elements"))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("mass_number")).join(shared, "mass_number")


@query(f"""WITH {ISO}, k AS (SELECT element, mass_number, unnest(['atom', 'oxide', 'doubly charged', 'dimer']) AS kind, unnest([exact_mass, exact_mass + 15.9949, exact_mass / 2, exact_mass * 2]) AS at_mass FROM iso)
SELECT p_partkey, element, mass_number, kind, round(at_mass, 6) AS at_mass FROM part JOIN k ON abs(at_mass - (p_size + 0.25)) <= 0.5""")
def joi11_interferences(spark, sf_dir):
    """What lies within half a mass of each part's size and a quarter."""
    wanted = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 0.25).alias("mass"))
    return align.interferences_of(wanted, chemistry.isotopes(spark)).select("p_partkey", "element", "mass_number", "kind", F.round("at", 6).alias("at_mass"))


#: The element that stands for a part, by the last word of its type.
METAL = {"STANDARD": "Fe", "ECONOMY": "Zn", "MEDIUM": "Cu", "PROMO": "Ti", "LARGE": "Ni", "SMALL": "Ag"}
METALS = f"metal(word, element) AS (VALUES {', '.join(f'({w!r}, {e!r})' for w, e in METAL.items())}), pm AS (SELECT p_partkey, p_retailprice, element FROM part JOIN metal ON word = string_split(p_type, ' ')[-1])"


def part_elements(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for pair in METAL.items() for x in pair))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("counts"), names[F.element_at(F.split("p_type", " "), -1)].alias("element"))
    return p.where("element is not null")


@query(f"WITH {ISO}, {METALS}, m AS (SELECT element, sum(exact_mass * abundance) / sum(abundance) AS molar_mass, arg_max(mass_number, abundance) AS most_abundant FROM iso GROUP BY element) SELECT p_partkey, element, round(molar_mass, 6) AS molar_mass, most_abundant, round(p_retailprice / molar_mass, 6) AS moles FROM pm JOIN m USING (element)")
def sc13_molar_mass(spark, sf_dir):
    """Grams of each part as moles of its metal."""
    masses = chemistry.molar_masses(chemistry.isotopes(spark))
    return part_elements(spark, sf_dir).join(masses, "element").select("p_partkey", "element", F.round("molar_mass", 6).alias("molar_mass"), "most_abundant", F.round(F.col("counts") / F.col("molar_mass"), 6).alias("moles"))


@query(f"WITH {ISO}, {METALS}, t AS (SELECT element, sum(abundance) AS whole FROM iso GROUP BY element) SELECT p_partkey, element, mass_number, round(p_retailprice * abundance / whole, 6) AS isotope_counts FROM pm JOIN iso USING (element) JOIN t USING (element)")
def sc13_signal_split(spark, sf_dir):
    done = chemistry.split_signal(part_elements(spark, sf_dir), chemistry.isotopes(spark))
    return done.select("p_partkey", "element", "mass_number", F.round("isotope_counts", 6).alias("isotope_counts"))


@query("""WITH s AS (SELECT c_custkey, c_acctbal FROM customer), v AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS a FROM s)
SELECT c_custkey, c_acctbal, avg(v.a) AS rank FROM s JOIN v USING (c_acctbal) GROUP BY c_custkey, c_acctbal""")
def seq19_rank(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return align.rank_average(c, "c_acctbal").select("c_custkey", "c_acctbal", F.col("rank").cast("double").alias("rank"))


HIST = """b AS (SELECT min(o_totalprice) AS lo, greatest(1, least(10000, ceil((max(o_totalprice) - min(o_totalprice)) / 25000.0))) AS nb FROM orders),
h AS (SELECT o_orderpriority, CAST(least(nb - 1, floor((o_totalprice - lo) / 25000.0)) AS INTEGER) AS bin, count(*) AS n, any_value(lo) + (CAST(least(nb - 1, floor((o_totalprice - lo) / 25000.0)) AS INTEGER) + 0.5) * 25000 AS centre FROM orders, b GROUP BY o_orderpriority, 2, lo, nb)"""


def price_histogram(spark, sf_dir):
    return histogram.histogram(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", 25000.0)


@query(f"WITH {HIST} SELECT o_orderpriority, bin, n, round(centre, 4) AS centre, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 9) AS relative, round(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bin) / sum(n) OVER (PARTITION BY o_orderpriority), 9) AS cdf FROM h")
def his2_5_histogram(spark, sf_dir):
    return price_histogram(spark, sf_dir).select("o_orderpriority", "bin", "n", F.round("centre", 4).alias("centre"), F.round("relative", 9).alias("relative"), F.round("cdf", 9).alias("cdf"))


@query(f"""WITH {HIST}, s AS (SELECT *, sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bin) AS w, sum(n) OVER (PARTITION BY o_orderpriority) AS t, sum(n * centre) OVER (PARTITION BY o_orderpriority ORDER BY bin) AS x, sum(n * centre) OVER (PARTITION BY o_orderpriority) AS xt FROM h)
SELECT o_orderpriority, round(arg_max(centre, row(round(w * (t - w) * (x / w - (xt - x) / (t - w)) ** 2, 3), -bin)), 4) AS otsu FROM s WHERE t > w GROUP BY o_orderpriority""")
def fil8_otsu(spark, sf_dir):
    return histogram.otsu(price_histogram(spark, sf_dir), ["o_orderpriority"]).withColumn("otsu", F.round("otsu", 4))


@query(f"""WITH {HIST}, s AS (SELECT *, avg(n) OVER (PARTITION BY o_orderpriority ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, avg(n) OVER (PARTITION BY o_orderpriority ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS f FROM h)
SELECT o_orderpriority, round(arg_min(centre, bin), 4) AS change_point FROM s WHERE f > b GROUP BY o_orderpriority""")
def fil9_change_point(spark, sf_dir):
    return histogram.change_point(price_histogram(spark, sf_dir), ["o_orderpriority"]).withColumn("change_point", F.round("change_point", 4))


@query(f"""WITH {HIST}, s AS (SELECT *, log10(n) - lag(log10(n)) OVER (PARTITION BY o_orderpriority ORDER BY bin) AS d FROM h)
SELECT o_orderpriority, round(arg_max(centre, row(round(d, 9), -bin)), 4) AS log_change, max(round(d, 9)) AS rise FROM s WHERE d IS NOT NULL GROUP BY o_orderpriority""")
def mod14_log_change(spark, sf_dir):
    return histogram.log_change(price_histogram(spark, sf_dir), ["o_orderpriority"]).withColumn("log_change", F.round("log_change", 4))


@query(f"""WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders), {QUARTILES}, s AS (SELECT g, count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) AS sd, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS skew FROM (SELECT g, x, avg(x) OVER (PARTITION BY g) AS m FROM v) GROUP BY g)
SELECT s.g AS o_orderpriority, s.n, round((hi - lo) / ceil(cbrt(2 * s.n)), 4) AS terrell_scott, round((hi - lo) / ceil(2 * cbrt(s.n)), 4) AS rice, round((hi - lo) / ceil(sqrt(s.n)), 4) AS root, round((hi - lo) / (ceil(log2(s.n)) + 1), 4) AS sturges, round((hi - lo) / ceil(1 + log2(s.n) + log2(1 + abs(skew) / sqrt(6.0 * (s.n - 2) / ((s.n + 1.0) * (s.n + 3))))), 4) AS doane,
  round(2 * (q3 - q1) / cbrt(s.n), 4) AS freedman_diaconis, round(3.49 * sd / cbrt(s.n), 4) AS scott FROM s JOIN k ON k.g = s.g""")
def his1_widths(spark, sf_dir):
    w = histogram.widths(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return w.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("terrell_scott", "doane", "rice", "root", "sturges", "freedman_diaconis", "scott")])


@query("""WITH l AS (SELECT o_orderpriority AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1), t AS (SELECT unnest([4, 8, 16, 32, 64]) AS k),
c AS (SELECT g, k, (hi - lo) / k AS w, least(k - 1, floor((o_totalprice - lo) / ((hi - lo) / k))) AS b, count(*) AS c FROM orders JOIN l ON g = o_orderpriority, t GROUP BY 1, 2, 3, 4),
z AS (SELECT g, k, w, (2 * (sum(c) / k) - (sum(c * c) / k - (sum(c) / k) ** 2)) / (w * w) AS cost FROM c GROUP BY g, k, w)
SELECT g AS o_orderpriority, CAST(arg_min(k, cost) AS INTEGER) AS k, round(arg_min(w, cost), 4) AS w FROM z GROUP BY g""")
def his1_shimazaki(spark, sf_dir):
    return histogram.shimazaki(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [4, 8, 16, 32, 64]).select("o_orderpriority", "k", F.round("w", 4).alias("w"))


@query(f"""WITH v AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders), {QUARTILES}
SELECT g AS o_orderpriority, round(avg(x), 4) AS mean, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
  min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_lo, max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_hi FROM v JOIN k USING (g) GROUP BY g""")
def agg22_box_plot(spark, sf_dir):
    b = histogram.box_plot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return b.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "q1", "median", "q3")], "whisker_lo", "whisker_hi")


@query("""WITH s AS (SELECT count(*) AS n, 1.06 * stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer), g AS (SELECT CAST(unnest(range(-1000, 11000, 100)) AS DOUBLE) AS x)
SELECT x, round(sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM customer, s, g GROUP BY x""")
def agg29_kernel_density(spark, sf_dir):
    d = histogram.kernel_density(table(spark, sf_dir, "customer").select("c_acctbal"), "c_acctbal", [float(x) for x in range(-1000, 11000, 100)])
    return d.withColumn("density", F.round("density", 9))


@query("SELECT c_custkey, round(cbrt(c_acctbal), 6) AS cube_root, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) ELSE -323.3062153431158 END, 6) AS logarithm FROM customer WHERE c_acctbal >= 0 OR c_acctbal < 0")
def prj2_transform(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", *[F.round(histogram.math_transform(F.col("c_acctbal"), k), 6).alias(n) for k, n in (("cbrt", "cube_root"), ("log10", "logarithm"))])


@query("SELECT p_brand, count(*) AS n, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, round(regr_r2(p_retailprice, p_size), 6) AS r2 FROM part GROUP BY p_brand")
def mod1_ols(spark, sf_dir):
    m = models.ols(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")
    return m.select("p_brand", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH s AS (SELECT p_brand, sum(1 / p_retailprice) AS sw, sum(p_size / p_retailprice) AS sx, count(*) AS sy, sum(p_size * p_size / p_retailprice) AS sxx, sum(CAST(p_size AS DOUBLE)) AS sxy FROM part GROUP BY p_brand)
SELECT p_brand, round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 5) AS slope, round((sy - (sw * sxy - sx * sy) / (sw * sxx - sx * sx) * sx) / sw, 3) AS intercept FROM s""")
def mod2_wls(spark, sf_dir):
    m = models.wls(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")
    return m.select("p_brand", F.round("slope", 5).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("SELECT p_brand, round(sum(p_size * p_retailprice) / sum(p_size * p_size), 6) AS slope FROM part GROUP BY p_brand")
def mod3_slope(spark, sf_dir):
    return models.slope_only(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice").withColumn("slope", F.round("slope", 6))


@query("SELECT p_brand, CAST(p_size AS DOUBLE) AS x, round(avg(p_retailprice), 5) AS y, count(*) AS n FROM part GROUP BY 1, 2")
def mod4_collapse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return models.collapse_x(p, ["p_brand"], "x", "y").withColumn("y", F.round("y", 5))


def two_sided(t: str, dof: str) -> str:
    return "2 * " + tail_sql(f"abs({t})", f"exp(lgamma(({dof} + 1) / 2) - lgamma({dof} / 2)) / sqrt({dof} * pi()) * pow(1 + (y) * (y) / {dof}, -({dof} + 1) / 2)")


NORMAL = "exp(-(y) * (y) / 2) / sqrt(2 * pi())"


@query(f"""WITH p AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), n AS (SELECT CAST(count(*) FILTER (WHERE g = 'BUILDING') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE g <> 'BUILDING') AS DOUBLE) AS nb,
  avg(x) FILTER (WHERE g = 'BUILDING') AS ma, avg(x) FILTER (WHERE g <> 'BUILDING') AS mb, var_samp(x) FILTER (WHERE g = 'BUILDING') AS va, var_samp(x) FILTER (WHERE g <> 'BUILDING') AS vb FROM p),
r AS (SELECT x, avg(k) AS rank FROM (SELECT x, row_number() OVER (ORDER BY x) AS k FROM p) GROUP BY x), u AS (SELECT sum(rank) AS ra FROM p JOIN r USING (x) WHERE g = 'BUILDING'),
c AS (SELECT x, count(*) FILTER (WHERE g = 'BUILDING') AS ca, count(*) FILTER (WHERE g <> 'BUILDING') AS cb FROM p GROUP BY x),
d AS (SELECT abs(sum(ca) OVER (ORDER BY x) / na - sum(cb) OVER (ORDER BY x) / nb) AS d, lead(x) OVER (ORDER BY x) - x AS dx FROM c, n),
b AS (SELECT g, x, (SELECT count(*) FILTER (WHERE q.x < p.x) + 0.5 * count(*) FILTER (WHERE q.x = p.x) FROM p q WHERE q.g <> p.g) / CASE WHEN g = 'BUILDING' THEN nb ELSE na END AS w FROM p, n),
v AS (SELECT avg(w) FILTER (WHERE g = 'BUILDING') AS mp, var_samp(w) FILTER (WHERE g = 'BUILDING') AS sp, var_samp(w) FILTER (WHERE g <> 'BUILDING') AS sq FROM b),
z AS (SELECT (SELECT max(d) FROM d) AS ks, (SELECT sum(d * coalesce(dx, 0)) FROM d) AS emd, ra - na * (na + 1) / 2 AS u, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS td,
  (mp - 0.5) / sqrt(sp / na + sq / nb) AS w, pow(sp / na + sq / nb, 2) / (pow(sp / na, 2) / (na - 1) + pow(sq / nb, 2) / (nb - 1)) AS wd, (SELECT max(d) FROM d) * sqrt(na * nb / (na + nb)) AS kt, na, nb FROM n, u, v),
o AS (SELECT *, (na * nb / 2 - least(u, na * nb - u)) / sqrt(na * nb * (na + nb + 1) / 12) AS uz FROM z)
SELECT round(ks, 9) AS ks, round(greatest(0, least(1, 2 * list_sum(list_transform(range(1, 200), lambda k: pow(-1, k - 1) * exp(-2 * k * k * kt * kt))))), 6) AS ks_p, round(emd, 5) AS emd, round(u, 4) AS u, round(2 * {tail_sql('uz', NORMAL)}, 6) AS u_p,
  round(t, 8) AS t, round({two_sided('t', 'td')}, 6) AS t_p, round(w, 7) AS w, round({two_sided('w', 'wd')}, 6) AS w_p FROM o""")
def mod11_12_two_samples(spark, sf_dir):
    s = models.two_samples(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal")
    places = {"ks": 9, "ks_p": 6, "emd": 5, "u": 4, "u_p": 6, "t": 8, "t_p": 6, "w": 7, "w_p": 6}
    return s.select(*[F.round(F.col(k).cast("double"), n).alias(k) for k, n in places.items()])


@query(f"""WITH a AS (SELECT c_mktsegment AS g, c_custkey AS o, c_acctbal AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS nth FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) AS pair FROM a WHERE nth <= (SELECT min(n) FROM (SELECT count(*) AS n FROM a GROUP BY g))),
d AS (SELECT abs(y.x - z.x) AS gap, y.x > z.x AS up FROM k y JOIN k z USING (pair) WHERE y.g = 'MACHINERY' AND z.g = 'BUILDING'), r AS (SELECT gap, avg(i) AS rank FROM (SELECT gap, row_number() OVER (ORDER BY gap) AS i FROM d) GROUP BY gap),
s AS (SELECT count(*) AS n, coalesce(sum(rank) FILTER (WHERE up), 0) AS plus FROM d JOIN r USING (gap)), w AS (SELECT n, n * (n + 1) / 2 AS total, greatest(plus, n * (n + 1) / 2 - plus) AS w FROM s),
z AS (SELECT n, w, -(total - w - total / 2 - 0.5) / sqrt(total / 2 * (2 * n + 1) / 6) AS z FROM w) SELECT n, round(w, 4) AS w, round(2 * {tail_sql('z', NORMAL)}, 6) AS p FROM z""")
def mod11_wilcoxon(spark, sf_dir):
    w = models.wilcoxon(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING", "MACHINERY", "c_acctbal", "c_custkey")
    return w.select("n", F.round(F.col("w").cast("double"), 4).alias("w"), F.round("p", 6).alias("p"))


KRUSKAL = f"""r AS (SELECT c_acctbal AS x, avg(k) AS rank FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS k FROM customer) GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT c_mktsegment) - 1 AS DOUBLE) AS dof FROM customer),
p AS (SELECT c_mktsegment, sum(rank) AS r, count(*) AS k FROM customer JOIN r ON x = c_acctbal GROUP BY 1), t AS (SELECT sum(c ** 3 - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM customer GROUP BY c_acctbal)),
h AS (SELECT (12 / (n * (n + 1)) * (SELECT sum(r * r / k) FROM p) - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h, dof FROM n, t), kw AS (SELECT h, {tail_sql('h', 'exp((dof / 2 - 1) * ln(y) - (y) / 2 - lgamma(dof / 2) - dof / 2 * ln(2))')} AS p FROM h)"""
ANOVA = f"""g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(n * m) AS t, sum(n * m * m) AS q, sum((n - 1) * v) AS w FROM g),
f AS (SELECT ((q - t * t / nn) / (k - 1)) / (w / (nn - k)) AS f, k - 1 AS d1, nn - k AS d2 FROM s),
an AS (SELECT f, {tail_sql('f', 'exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2) + d1 / 2 * ln(d1 / d2) + (d1 / 2 - 1) * ln(y) - (d1 + d2) / 2 * ln(1 + d1 * (y) / d2))')} AS p FROM f)"""


@query(f"WITH {KRUSKAL} SELECT round(h, 6) AS h, round(p, 6) AS p FROM kw")
def mod11_kruskal_wallis(spark, sf_dir):
    k = models.kruskal_wallis(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return k.select(F.round(F.col("h").cast("double"), 6).alias("h"), F.round("p", 6).alias("p"))


@query(f"WITH {ANOVA} SELECT round(f, 6) AS f, round(p, 6) AS p FROM an")
def mod11_anova(spark, sf_dir):
    return models.anova(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").select(F.round("f", 6).alias("f"), F.round("p", 6).alias("p"))


STARS_SQL = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"


@query(f"WITH {KRUSKAL}, {ANOVA}, a AS (SELECT 'Kruskal-Wallis' AS test, p FROM kw UNION ALL SELECT 'ANOVA', p FROM an UNION ALL SELECT 'sizes', 0.0) SELECT test, {STARS_SQL} AS stars FROM a")
def sc22_stars(spark, sf_dir):
    """Stars of real tests: balances by segment, and sizes above and below 25, which differ for certain."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    tests = {
        "Kruskal-Wallis": models.kruskal_wallis(c, "c_mktsegment", "c_acctbal"),
        "ANOVA": models.anova(c, "c_mktsegment", "c_acctbal"),
        "sizes": models.anova(p.withColumn("large", F.col("p_size") > 25), "large", "p_size"),
    }
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("test"), models.stars(F.col("p")).alias("stars")) for name, t in tests.items()])


@query("""WITH d AS (SELECT a.vec_id, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS ab,
  list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS aa, list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS bb FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(ab / sqrt(aa * bb), 6) AS cosine FROM d""")
def sc18_cosine(spark, sf_dir):
    """Each vector with the next one by id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(models.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("""WITH m AS (SELECT label, i, greatest(0, avg(embedding[i]::DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i)
SELECT label AS cluster, CAST(i - 1 AS INTEGER) AS element, round(CASE WHEN sum(m) OVER (PARTITION BY label) > 0 THEN 100 * m / sum(m) OVER (PARTITION BY label) ELSE 0 END, 6) AS percent FROM m""")
def agg21_composition(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.posexplode("embedding").alias("element", "v")).withColumn("intensity", F.col("v").cast("double"))
    return models.composition(e).withColumn("percent", F.round("percent", 6))


@query("""WITH x AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS element, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), l AS (SELECT min(v) AS low FROM x), y AS (SELECT vec_id, element, log2(v - low + 1) AS y FROM x, l)
SELECT vec_id, element, round((y - avg(y) OVER (PARTITION BY element)) / stddev_samp(y) OVER (PARTITION BY element), 6) AS z FROM y""")
def mod6_z_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("element", "v")).withColumn("v", F.col("v").cast("double"))
    return models.z_scores(e, ["element"], "v").select("vec_id", "element", F.round("z", 6).alias("z"))


@query()
def mod7_8_ward(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "embedding")
    return models.cut_heights(models.ward(e, ["label"], "embedding"), ["label"])


#: channel, strategy, np_cts_per_fg, ionic_cts_per_fg, aerosol_te_pct, mass_fraction, density_g_cm3
CALIBRATION = [("click", "MASS", 2.0, 5.0, 40.0, 1.0, 19.3), ("view", "SIZE", 2.0, 5.0, 40.0, 0.6, 4.23), ("purchase", "MASS", 3.5, 5.0, 38.0, 1.0, 10.5), ("signup", "SIZE", 2.5, 6.0, 41.0, 1.0, 7.13), ("error", "SIZE", 1.5, 4.0, 39.0, 0.79, 5.5)]
CAL = "cal(channel, strategy, np_cts_per_fg, ionic_cts_per_fg, aerosol_te_pct, mass_fraction, density_g_cm3) AS (VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', " + ", ".join(f"{x!r}::DOUBLE" for x in r[2:]) + ")" for r in CALIBRATION) + ")"


@query(f"""WITH {CAL}, m AS (SELECT event_id, mass_fraction, density_g_cm3, CASE WHEN strategy = 'MASS' THEN value / np_cts_per_fg ELSE value / ionic_cts_per_fg * (aerosol_te_pct / 100) END AS mass_fg FROM events JOIN cal ON channel = event_type)
SELECT event_id, round(mass_fg, 6) AS mass_fg, round(CASE WHEN mass_fg > 0 THEN cbrt(6 * mass_fg * 1e-15 / (mass_fraction * density_g_cm3 * pi())) * 1e7 END, 4) AS diameter_nm FROM m""")
def prj3_quantify(spark, sf_dir):
    cal = spark.createDataFrame([("s1", *r) for r in CALIBRATION], "sample_id string, channel string, strategy string, np_cts_per_fg double, ionic_cts_per_fg double, aerosol_te_pct double, mass_fraction double, density_g_cm3 double")
    e = table(spark, sf_dir, "events").select("event_id", F.lit("s1").alias("sample_id"), F.col("event_type").alias("channel"), F.col("value").alias("net_area"))
    return quant.quantify(e, cal).select("event_id", F.round("mass_fg", 6).alias("mass_fg"), F.round("diameter_nm", 4).alias("diameter_nm"))


@query(f"WITH {EVENT_POINTS} SELECT channel, count(*) AS n, round(count(*) / (max(time_s) - min(time_s)), 9) AS rate, round(60 * count(*) / (max(time_s) - min(time_s)) / 0.4 / 0.35, 6) AS per_ml, round(avg(intensity) / 7.69e-5 / 5.0 / (0.35 / 60) * 1e-6, 6) AS bec FROM pts GROUP BY channel")
def agg6_12_rates(spark, sf_dir):
    s = event_points(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), (F.max("time_s") - F.min("time_s")).alias("t"), F.avg("intensity").alias("m"))
    per_ml = quant.number_concentration(F.col("n"), F.col("t"), F.lit(40.0), F.lit(0.35))
    return s.select("channel", "n", F.round(F.col("n") / F.col("t"), 9).alias("rate"), F.round(per_ml, 6).alias("per_ml"), F.round(quant.background_equivalent(F.col("m"), F.lit(7.69e-5), F.lit(5.0), F.lit(0.35)), 6).alias("bec"))


@query("""WITH s AS (SELECT user_id % 4 AS grp, user_id, count(*) AS n, max(epoch_us(ts)) - min(epoch_us(ts)) AS us, avg(value) AS m FROM events GROUP BY 1, 2)
SELECT grp AS group_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (sum(us) / 1e6), 9) AS rate, round(avg(m), 6) AS mean_of_means FROM s GROUP BY grp""")
def agg14_merged(spark, sf_dir):
    """Merged samples: events are summed, rates are total over total, raw means are averaged."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("group_id"), "user_id").agg(F.count("*").alias("n"), (F.max(us) - F.min(us)).alias("us"), F.avg("value").alias("m"))
    return s.groupBy("group_id").agg(F.sum("n").alias("n"), F.round(F.sum("n") / (F.sum("us") / 1e6), 9).alias("rate"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("""SELECT p_partkey, round(p_retailprice * 1e3, 6) AS fg, round(ln(p_retailprice * 5) - ln(1 + p_size * p_size * 5 / (p_retailprice * 5) ** 2) / 2, 8) AS mu FROM part""")
def sc9_19_units(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mu = quant.lognormal_sum(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(5.0))["mu"]
    return p.select("p_partkey", F.round(chemistry.convert(F.col("p_retailprice"), "mass", "pg", "fg"), 6).alias("fg"), F.round(mu, 8).alias("mu"))


@query("""SELECT n_nationkey, 100 + n_nationkey AS mass_number, 'Ag' AS element, CAST(3600 * n_nationkey + 60 + 1.5 AS DOUBLE) AS seconds, CAST(n_nationkey + 0.5 AS DOUBLE) AS nm FROM nation""")
def sc15_20_parsing(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k, F.concat((k + 100).cast("string"), F.lit("Ag.16O | x")).alias("label"), F.concat(k.cast("string"), F.lit(":01:01.5")).alias("clock"), F.concat(F.lit("run_d"), k.cast("string"), F.lit("p5nm_x")).alias("name"))
    label = parsing.channel_label(F.col("label"))
    return n.select(k, label["mass_number"].alias("mass_number"), label["element"].alias("element"), F.round(parsing.seconds_of_day(F.col("clock")), 6).alias("seconds"), parsing.name_hint(F.col("name"), "nm").alias("nm"))


@query(f"WITH {COUNT_POINTS} SELECT idx, {', '.join(f'max(CASE WHEN channel = {c!r} THEN intensity END) AS {c.lower()}' for c in ('AF', 'AO', 'NF', 'NO', 'RF', 'RO'))} FROM pts GROUP BY idx")
def snk1_raw_table(spark, sf_dir):
    names = ["AF", "AO", "NF", "NO", "RF", "RO"]
    return sinks.raw_table(count_points(spark, sf_dir), names).select("idx", *(F.col(c).alias(c.lower()) for c in names))


@query("SELECT n_regionkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT r_regionkey, r_name FROM region")
def set1_4_combined(spark, sf_dir):
    """Union, distinct and exclusion."""
    n, s, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct(), table(spark, sf_dir, "region")
    return n.join(s, "n_nationkey", "left_anti").select("n_regionkey", "n_name").unionByName(r.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def srt1_6_top(spark, sf_dir):
    """A page of the twelve largest."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query(FOUND + """, d AS (SELECT e.*, area - greatest(0.1, location) * n_points AS net, CASE WHEN e.start_idx > 0 THEN z.time_s - p.time_s ELSE n.time_s - s.time_s END * 1e6 AS us FROM e JOIN pts z ON z.channel = e.channel AND z.idx = e.end_idx
  JOIN pts s ON s.channel = e.channel AND s.idx = e.start_idx LEFT JOIN pts p ON p.channel = e.channel AND p.idx = e.start_idx - 1 LEFT JOIN pts n ON n.channel = e.channel AND n.idx = e.end_idx + 1)
SELECT channel, count(*) AS n, round(avg(net), 5) AS mean_net_area, round(stddev_samp(net), 5) AS sd_net_area, round(quantile_cont(net, 0.5), 5) AS median_net_area, round(avg(height), 5) AS mean_height, round(stddev_samp(height), 5) AS sd_height,
  round(avg(us) / 1e6, 3) AS mean_duration_s, round(stddev_samp(us) / 1e6, 3) AS sd_duration_s FROM d GROUP BY channel""")
def agg7_event_statistics(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    s = events.statistics(events.metrics(e, p))
    return s.select(
        "channel", "n", *[F.round(c, 5).alias(c) for c in ("mean_net_area", "sd_net_area", "median_net_area", "mean_height", "sd_height")], *[F.round(F.col(f"{k}_duration_us") / 1e6, 3).alias(f"{k}_duration_s") for k in ("mean", "sd")]
    )
