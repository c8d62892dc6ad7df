"""Sliding order statistics, LOESS, random samples of a pool and pulse shapes, with their SQL."""

from pyspark.sql import functions as F

from blipstream.operators import ion_shape, loess, permutation, rolling

from .inputs import EVENT_POINTS, event_points, table
from .more_queries import IONS, ions
from .signal_queries import FOUND, found

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


FRAME = "PARTITION BY channel ORDER BY idx ROWS BETWEEN {0} PRECEDING AND {1} FOLLOWING"


@query(f"WITH {EVENT_POINTS} SELECT channel, idx, round(quantile_cont(intensity, 0.5) OVER w, 7) AS median, round(mad(intensity) OVER w, 7) AS mad FROM pts WINDOW w AS ({FRAME.format(30, 20)})")
def seq7_rolling_median(spark, sf_dir):
    done = rolling.rolling_median(event_points(spark, sf_dir), 30, 20)
    return done.select("channel", "idx", F.round("median", 7).alias("median"), F.round("mad", 7).alias("mad"))


#: Background points of the events found, and what events are worth without it.
FREE = FOUND + ", q AS (SELECT p.* FROM pts p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.channel = p.channel AND p.idx BETWEEN e.start_idx AND e.end_idx))"
NET = "SELECT channel, start_idx, n AS n_bg, round(bg, 7) AS bg_median, round(least(area, bg * n_points), 6) AS bg_per_event, round(area - least(area, bg * n_points), 6) AS net_area FROM"


def net_columns(done):
    return done.select("channel", "start_idx", "n_bg", F.round("bg_median", 7).alias("bg_median"), F.round("bg_per_event", 6).alias("bg_per_event"), F.round("net_area", 6).alias("net_area"))


@query(f"{FREE} {NET} (SELECT e.channel, e.start_idx, any_value(area) AS area, any_value(n_points) AS n_points, count(q.idx) AS n, coalesce(quantile_cont(q.intensity, 0.5), 0) AS bg FROM e LEFT JOIN q ON q.channel = e.channel AND q.idx > e.peak_idx - 60 AND q.idx <= e.peak_idx + 60 GROUP BY 1, 2)")
def seq7b_index_median(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return net_columns(rolling.background_of_events(e.select("sample_id", "channel", "start_idx", "end_idx", "peak_idx", "n_points", "area", "height"), p, 60, "INDEX", "MEDIAN", clamp=True))


@query(f"{FREE}, c AS (SELECT e.*, p.time_s AS t FROM e JOIN pts p ON p.channel = e.channel AND p.idx = e.peak_idx) {NET} (SELECT c.channel, c.start_idx, any_value(area) AS area, any_value(n_points) AS n_points, count(q.idx) AS n, coalesce(quantile_cont(q.intensity, 0.5), 0) AS bg FROM c LEFT JOIN q ON q.channel = c.channel AND q.time_s > c.t - 20000 AND q.time_s <= c.t + 20000 GROUP BY 1, 2)")
def seq7c_time_median(spark, sf_dir):
    p, _, e = found(spark, sf_dir)
    return net_columns(rolling.background_of_events(e.select("sample_id", "channel", "start_idx", "end_idx", "peak_idx", "n_points", "area", "height"), p, 20000.0, "TIME", "MEDIAN", clamp=True))


@query(f"""WITH {EVENT_POINTS}, l AS (SELECT channel, idx, intensity, quantile_cont(intensity, 0.5) OVER w AS m, 1.4826 * mad(intensity) OVER w AS d, list(intensity) OVER w AS wide, list(intensity) OVER s AS near FROM pts
  WINDOW w AS ({FRAME.format(100, 100)}), s AS ({FRAME.format(3, 3)})),
c AS (SELECT channel, idx, near, list_filter(wide, lambda x: x >= m - d AND x <= m + d) AS clean FROM l),
k AS (SELECT channel, idx, near, list_aggregate(clean, 'quantile_cont', 0.5) + 0.1 * (1.4826 * list_aggregate(clean, 'mad')) AS limit_ FROM c),
r AS (SELECT channel, idx, coalesce(len(list_filter(near, lambda x: x > limit_)), 0) / len(near) AS score FROM k)
SELECT channel, idx, round(score, 9) AS score, round(CASE WHEN max(score) OVER (PARTITION BY channel) > 0 THEN score / max(score) OVER (PARTITION BY channel) ELSE 0 END, 9) AS likelihood FROM r""")
def seq15_sliding_likelihood(spark, sf_dir):
    done = rolling.local_peak_likelihood(event_points(spark, sf_dir))
    return done.select("channel", "idx", F.round("score", 9).alias("score"), F.round("likelihood", 9).alias("likelihood"))


#: A round of LOESS on lengthened traces: weighted sums of each frame, the line's value, and new weights.
LOESS_ROUND = """
s{r} AS (SELECT channel, pos, any_value(y0) AS y, sum(w * wt) AS s0, sum(w * wt * d) AS s1, sum(w * wt * d * d) AS s2, sum(w * wt * y) AS t0, sum(w * wt * d * y) AS t1
  FROM (SELECT f.channel, f.pos, f.w, f.d, f.y0, x.y, x.wt FROM f JOIN w{r} x ON x.channel = f.channel AND x.pos = f.k) GROUP BY 1, 2),
v{r} AS (SELECT channel, pos, y, CASE WHEN sqrt(abs(s2 / s0 - (s1 / s0) * (s1 / s0))) < 1e-12 THEN t0 / s0
  ELSE t0 / s0 - (t1 / s0 - (s1 / s0) * (t0 / s0)) / (s2 / s0 - (s1 / s0) * (s1 / s0)) * (s1 / s0) END AS line FROM s{r}),
m{r} AS (SELECT channel, max(e) AS m FROM (SELECT channel, abs(y - line) AS e, row_number() OVER (PARTITION BY channel ORDER BY abs(y - line)) - 1 AS nth, count(*) OVER (PARTITION BY channel) AS n FROM v{r}) WHERE nth = n // 2 GROUP BY channel),
w{n} AS (SELECT v.channel, v.pos, v.y, CASE WHEN abs(v.y - line) >= 6 * m THEN 0 ELSE pow(1 - pow(abs(v.y - line) / (6 * m), 2), 2) END AS wt FROM v{r} v JOIN m{r} USING (channel)),"""


@query(f"""WITH {EVENT_POINTS}, z AS (SELECT channel, count(*) AS n, least(count(*) - 2, CAST(floor(0.01 * count(*) + 0.5) AS BIGINT)) AS pad FROM pts GROUP BY channel),
w0 AS MATERIALIZED (SELECT p.channel, u.pos, p.intensity AS y, 1.0 AS wt FROM pts p JOIN z USING (channel), unnest([idx + pad, CASE WHEN idx BETWEEN 1 AND pad THEN pad - idx END, CASE WHEN idx BETWEEN n - 1 - pad AND n - 2 THEN pad + 2 * (n - 1) - idx END]) AS u(pos) WHERE u.pos IS NOT NULL),
t AS (SELECT channel, n, pad, n + 2 * pad AS total, CAST(floor(0.01 * (n + 2 * pad)) AS BIGINT) AS q FROM z),
g AS (SELECT w0.channel, pos, w0.y AS y0, q, greatest(0, least(total - q, CAST(ceil(pos - q / 2) AS BIGINT))) AS lo FROM w0 JOIN t USING (channel)),
f AS MATERIALIZED (SELECT channel, pos, y0, k, k - pos AS d, CASE WHEN abs(k - pos) < greatest(pos - lo, lo + q - 1 - pos) THEN pow(1 - pow(abs(k - pos) / greatest(pos - lo, lo + q - 1 - pos), 3), 3) ELSE 0 END AS w FROM (SELECT *, unnest(range(lo, lo + q)) AS k FROM g)),
{LOESS_ROUND.format(r=0, n=1)}{LOESS_ROUND.format(r=1, n=2)}{LOESS_ROUND.format(r=2, n=3)}
o AS (SELECT v2.channel, CAST(pos - pad AS INTEGER) AS idx, round(line, 7) AS smooth FROM v2 JOIN t USING (channel) WHERE pos BETWEEN pad AND pad + n - 1)
SELECT * FROM o""")
def seq12_loess(spark, sf_dir):
    return loess.loess(event_points(spark, sf_dir), 0.01).select("channel", "idx", F.round("smooth", 7).alias("smooth"))


@query()
def mod11_emd_bootstrap(spark, sf_dir):
    """Order totals of two priorities against random samples of both; the draws are hashes of a seed that SQL can't repeat."""
    return permutation.emd_permutation(table(spark, sf_dir, "orders"), "o_orderpriority", "1-URGENT", "5-LOW", "o_totalprice", 200)


#: Twenty rounds each of clipping the window of ranks, and of trimming spikes.
SHAPES = f"""WITH RECURSIVE {IONS.split(', st AS')[0]}, st AS (SELECT channel, count(*) AS n, count(*) FILTER (WHERE y = 0) AS zeros, list(y::DOUBLE) AS l, list(y::DOUBLE ORDER BY y) FILTER (WHERE y > 0) AS pos FROM ions GROUP BY channel),
ra AS (SELECT *, CASE WHEN zeros > 50 THEN -ln(zeros / n) END AS rate FROM st),
wi AS (SELECT channel, list_transform(list_filter(pos, lambda v: v <= pos[1 + CAST(least(len(pos) - 1, ceil(rate * exp(-rate) / (1 - exp(-rate)) * len(pos))) AS BIGINT)]), lambda v: ln(v)) AS x FROM ra WHERE rate > 0),
wr(channel, r, sd, lo, hi) AS (SELECT channel, 1, list_aggregate(x, 'stddev_pop'), list_aggregate(x, 'avg') - 5 * list_aggregate(x, 'stddev_pop'), list_aggregate(x, 'avg') + 5 * list_aggregate(x, 'stddev_pop') FROM wi
  UNION ALL SELECT channel, r + 1, list_aggregate(k, 'stddev_pop'), list_aggregate(k, 'avg') - 5 * list_aggregate(k, 'stddev_pop'), list_aggregate(k, 'avg') + 5 * list_aggregate(k, 'stddev_pop')
  FROM (SELECT wr.channel, r, list_filter(x, lambda v: v BETWEEN lo AND hi) AS k FROM wr JOIN wi USING (channel) WHERE r < 20)),
mr(channel, r, hi) AS (SELECT channel, 1, 'infinity'::DOUBLE FROM ra WHERE rate > 0
  UNION ALL SELECT channel, r + 1, least(hi, list_aggregate(k, 'avg') + 5 * list_aggregate(k, 'stddev_pop')) FROM (SELECT mr.channel, r, hi, list_filter(pos, lambda v: v <= hi) AS k FROM mr JOIN ra USING (channel) WHERE r < 21)),
mo AS (SELECT channel, list_aggregate(k, 'var_pop') * rate / pow(list_aggregate(k, 'avg'), 2) AS ratio FROM (SELECT mr.channel, rate, list_filter(l, lambda v: v <= hi) AS k FROM mr JOIN ra USING (channel) WHERE r = 21)),
sh AS (SELECT ra.channel, rate, wr.sd AS win, CASE WHEN ratio > 1 THEN sqrt(ln(ratio)) END AS mom, least(1, abs(rate - 1.55) / 1.45) AS t FROM ra LEFT JOIN wr ON wr.channel = ra.channel AND wr.r = 20 LEFT JOIN mo ON mo.channel = ra.channel),
b AS (SELECT channel, rate, win, mom, CASE WHEN rate BETWEEN 0.1 AND 3.0 THEN 1 - t * t * (3 - 2 * t) ELSE 0 END AS a FROM sh),
done AS (SELECT channel, round(rate, 8) AS rate, round(win, 8) AS "window", round(mom, 8) AS moments, round(coalesce(a * win + (1 - a) * mom, mom, win), 8) AS shape, coalesce(a * win + (1 - a) * mom, mom, win) AS whole FROM b)"""


@query(SHAPES + ' SELECT channel, rate, "window", moments, shape FROM done')
def agg25_blended_shape(spark, sf_dir):
    s = ion_shape.ion_shape(ions(spark, sf_dir))
    return s.select("channel", *(F.round(c, 8).alias(c) for c in ("rate", "window", "moments", "shape")))


@query(SHAPES + " SELECT count(whole) AS channels, round(avg(whole), 8) AS shape FROM done")
def agg26_blended_mean(spark, sf_dir):
    return ion_shape.mean_ion_shape(ion_shape.ion_shape(ions(spark, sf_dir))).select("channels", F.round("shape", 8).alias("shape"))
