"""Search, baseline and event operators against plain sequential restatements."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.functions import distributions
from blipstream.operators import align, baseline, events, histogram, kernels, models, scan, search, traces
from blipstream.plans.method import Method, Step, read_method, settings

TRACES = {
    "empty": [],
    "one": [5.0],
    "zeros": [0.0] * 8,
    "equal": [3.0] * 6,
    "ends": [9.0, 1.0, 0.0, 0.0, 9.0],
    "gap": [0.0, 9.0, 0.0, 9.0, 0.0],
    "levels": [2.0, 1.0, 4.0, 1.0, 0.5, 4.0, 4.0, 0.0],
    "ties": [0.0, 7.0, 7.0, 2.0, 7.0, 0.0],
}


def random_traces(n=12, seed=0):
    rng = random.Random(seed)
    return {f"r{k}": [round(rng.choice([0, 0, 1, 2, 3]) + rng.expovariate(0.5), 2) for _ in range(rng.randint(1, 90))] for k in range(n)}


def points(spark, made):
    rows = [("s", c, i, (i + 1) * 0.5, y) for c, ys in made.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "sample_id string, channel string, idx int, time_s double, intensity double")


def hysteresis(ys, start, stop, height):
    out, run = [], None
    for i, y in enumerate([*ys, -1.0]):
        if run is None:
            if y >= start:
                run = [i]
        elif y >= start or (y >= stop and y > 0):
            run.append(i)
        else:
            inside = [ys[j] for j in run]
            if max(inside) > height:
                out.append((run[0], run[-1], run[inside.index(max(inside))], len(run)))
            run = [i] if y >= start else None
    return out


@pytest.mark.parametrize(("start", "stop", "height"), [(2.0, 1.0, 4.0), (2.0, 2.0, 2.0), (3.0, 0.5, 6.5)])
def test_hysteresis(spark, start, stop, height):
    made = TRACES | random_traces()
    p = points(spark, made).withColumns({"start_thr": F.lit(start), "stop_thr": F.lit(stop), "height_thr": F.lit(height)})
    got = sorted((r.channel, r.start_idx, r.end_idx, r.peak_idx, r.n_points) for r in search.hysteresis_search(p).collect())
    assert got == sorted((c, *e) for c, ys in made.items() for e in hysteresis(ys, start, stop, height))


def test_events_and_background_share_all_points(spark):
    made = random_traces(6, 3)
    p = points(spark, made).withColumns({k: F.lit(2.5) for k in ("start_thr", "stop_thr", "height_thr")})
    e = search.hysteresis_search(p)
    assert events.background(p, e).count() + e.agg(F.sum("n_points")).first()[0] == p.count()


def test_running_sum_over_blocks(spark):
    made = random_traces(3, 5)
    got = {(r.channel, r.idx): r.total for r in scan.running_sum(points(spark, made), F.col("intensity"), "total", block=7).collect()}
    for c, ys in made.items():
        for i in range(len(ys)):
            assert got[c, i] == pytest.approx(sum(ys[: i + 1]))


def test_merge_and_window_search(spark):
    made = random_traces(5, 7)
    p = points(spark, made).withColumns({"start_thr": F.lit(4.0), "stop_thr": F.lit(1.0), "height_thr": F.lit(5.0)})
    got = sorted((r.channel, r.start_idx, r.end_idx) for r in search.window_search(p, 2, 0).collect())
    want = []
    for c, ys in made.items():
        cover = sorted((max(0, i - 2), min(len(ys) - 1, i + 2)) for i, y in enumerate(ys) if y >= 4)
        merged = []
        for a, z in cover:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        want += [(c, a, z) for a, z in merged if max(ys[a : z + 1]) > 5]
    assert got == sorted(want)


@pytest.mark.parametrize("tail", [99, 100])
def test_segment_tail(spark, tail):
    p = points(spark, {"x": [1.0] * (300 + tail)})
    counts = [r["count"] for r in traces.segment(p, 150).groupBy("slice_idx").count().orderBy("slice_idx").collect()]
    assert counts == ([150, 150 + tail] if tail == 99 else [150, 150, 100])


def test_clipping_equals_a_loop(spark):
    made = {c: ys + [200.0] for c, ys in random_traces(4, 9).items()}
    got = {r.channel: r for r in baseline.clipped(points(spark, made).withColumn("slice_idx", F.lit(0)), rounds=3).collect()}
    for c, ys in made.items():
        kept = ys
        for _ in range(3):
            m = sum(kept) / len(kept)
            sd = math.sqrt(sum((y - m) ** 2 for y in kept) / (len(kept) - 1)) if len(kept) > 1 else 0.0
            kept = [y for y in kept if abs(y - m) <= 3 * sd]
        assert got[c].n_kept == len(kept) and got[c].location == pytest.approx(sum(kept) / len(kept))


def test_rosner_finds_planted_outliers(spark):
    rng = random.Random(1)
    made = {"clean": [rng.gauss(10, 1) for _ in range(200)], "dirty": [rng.gauss(10, 1) for _ in range(197)] + [40.0, 45.0, -30.0]}
    got = {r.channel: r.n_outliers for r in kernels.rosner(points(spark, made).withColumn("slice_idx", F.lit(0))).collect()}
    assert got["clean"] == 0 and got["dirty"] == 3


def test_overlaps_and_connection(spark):
    rng = random.Random(2)
    rows = [("s", f"c{k % 3}", a, a + rng.randint(0, 9)) for k in range(60) for a in [rng.randint(0, 300)]]
    e = spark.createDataFrame(rows, "sample_id string, channel string, start_idx int, end_idx int").distinct()
    got = sorted((r.start_idx, r.end_idx) for r in align.by_connection(e).collect())
    spans = sorted({(a, z) for _, _, a, z in rows})
    group = {s: s for s in spans}
    for _ in spans:
        for s in spans:
            for t in spans:
                shared = min(s[1], t[1]) - max(s[0], t[0]) + 1
                if shared >= (1 if s[1] - s[0] < 3 or t[1] - t[0] < 3 else 2):
                    low = min(group[s], group[t])
                    group[s] = group[t] = low
    hulls = {}
    for s, g in group.items():
        a, z = hulls.get(g, s)
        hulls[g] = (min(a, s[0]), max(z, s[1]))
    assert got == sorted(hulls.values())
    pairs = {(r.channel, r.start_idx, r.end_idx, r.other_start, r.other_end) for r in align.overlaps(e, e, bin_width=4).collect()}
    want = {(c, a, z, b, y) for _, c, a, z in rows for _, d, b, y in rows if c == d and a <= y and z >= b}
    assert pairs == want


def test_savitzky_golay_keeps_cubics(spark):
    made = {"x": [0.01 * i**3 - i for i in range(60)]}
    got = {r.idx: r.smooth for r in kernels.savitzky_golay(points(spark, made), 7).collect()}
    assert all(got[i] == pytest.approx(made["x"][i], abs=1e-6) for i in range(3, 57)) and len(got) == 60


def test_ward_heights(spark):
    rows = [("a", [0.0]), ("a", [1.0]), ("a", [10.0]), ("a", [12.0]), ("b", [5.0])]
    got = [r.height for r in models.ward(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], "v").orderBy("height").collect()]
    assert got[:2] == pytest.approx([1.0, 2.0]) and got[2] == pytest.approx(10.5 * math.sqrt(2)) and len(got) == 3


def test_height_gate_is_monotone(spark):
    made = random_traces(4, 11)
    p = points(spark, made)
    n = [search.hysteresis_search(p.withColumns({"start_thr": F.lit(2.0), "stop_thr": F.lit(1.0), "height_thr": F.lit(h)})).count() for h in (2.0, 4.0, 8.0)]
    assert n == sorted(n, reverse=True)


def test_interpolated_is_flat_outside(spark):
    p = traces.segment(points(spark, {"x": [float(i) for i in range(450)]}), 150)
    v = p.groupBy("sample_id", "channel", "slice_idx").agg(F.avg("intensity").alias("threshold"))
    got = {r.idx: r.threshold for r in baseline.interpolated(p, v).collect()}
    assert got[0] == got[74] == pytest.approx(74.5) and got[449] == pytest.approx(374.5) and got[200] == pytest.approx(200.0)


def test_method_runs_its_steps_in_order(spark):
    made = {c: ys * 3 for c, ys in random_traces(2, 13).items()}
    method = Method((Step("baseline", {"rounds": "2"}), Step("search", {"z": "1"}), Step("gate", {"test": "more_points", "target": "1"})))
    assert all(r.n_points > 1 for r in method.run(points(spark, made)).collect())
    assert settings(method)[0] == (0, "baseline", "rounds", "2")
    with pytest.raises(ValueError):
        Method((Step("gate", {"test": "height", "target": "1"}),)).run(points(spark, made))
    assert read_method('<method><set name="Search"><parameter xmlID="a" value="1"/></set></method>') == [{"name": "Search", "parameters": {"a": "1"}}]


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([("g", 2.0)] * 5, "g string, x double")
    assert [(r.bin, r.n, r.cdf) for r in histogram.histogram(df, ["g"], "x", 0.5).collect()] == [(0, 5, 1.0)]


def test_a_long_chain_of_events_is_one_hull(spark):
    chain = [("s", "c", 3 * i, 3 * i + 4) for i in range(1000)] + [("s", "d", 5000, 5001), ("t", "c", 0, 3)]
    got = sorted(tuple(r) for r in align.by_connection(spark.createDataFrame(chain, "sample_id string, channel string, start_idx int, end_idx int")).select("sample_id", "start_idx", "end_idx").collect())
    assert got == [("s", 0, 3001), ("s", 5000, 5001), ("t", 0, 3)]


def test_poisson_limits_equal_a_sum(spark):
    means, alphas = [0.5, 1.0, 4.5, 30.0, 380.0, 1000.0, 5000.0, 1e6], [0.3, 0.05, 1e-6, 1e-40]
    got = spark.createDataFrame([(m,) for m in means], "m double").select("m", *[baseline.poisson_limit(F.col("m"), a, eps=0.0).alias(str(k)) for k, a in enumerate(alphas)]).collect()
    for r in got:
        for k, alpha in enumerate(alphas):
            at, above = math.floor(r.m + 40 * math.sqrt(r.m) + 400), 0.0
            while at > 0 and above + math.exp(at * math.log(r.m) - r.m - math.lgamma(at + 1)) <= alpha:
                above += math.exp(at * math.log(r.m) - r.m - math.lgamma(at + 1))
                at -= 1
            assert r[str(k)] == at, (r.m, alpha)


def test_normal_tails_equal_erfc(spark):
    zs = [-8.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.0, 12.0, 30.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", baseline.normal_tail(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=2e-7) for r in got)


def test_special_functions_of_arrays():
    for mean in (0.3, 7.0, 80.0):
        ys = [0.0, 1.0, 6.9, 40.0, 120.0, -1.0]
        assert distributions.poisson_mid_ps(np.array(ys), np.full(len(ys), mean)) == pytest.approx([distributions.poisson_mid_p(y, mean) for y in ys], rel=1e-9, abs=1e-300)
    xs = np.array([0.0, 0.5, 3.0, 9.0, 40.0])
    assert distributions.gamma_tails(np.full(5, 2.5), xs) == pytest.approx([1 - distributions.gamma_p(2.5, x) for x in xs], abs=1e-12)


def test_ks_p_counts_paths():
    """Against all orders of two small samples."""
    n, m = 4, 3
    orders = [sum(1 << i for i in pick) for pick in itertools.combinations(range(n + m), n)]

    def distance(order):
        a = b = top = 0
        for i in range(n + m):
            a, b = a + (order >> i & 1), b + (not order >> i & 1)
            top = max(top, abs(a * m - b * n))
        return top / (n * m)

    for d in {distance(o) for o in orders}:
        assert distributions.ks_p(d, n, m) == pytest.approx(sum(distance(o) > d + 1e-12 for o in orders) / len(orders))
    assert distributions.ks_p(0.2, 300, 200) == pytest.approx(1.346e-4, rel=0.02)


def test_two_samples_with_ties_and_without_spread(spark):
    rows = [("a", float(x)) for x in [1, 1, 2, 2, 3]] + [("b", float(x)) for x in [2, 3, 3, 4]] + [("c", 9.0), ("a", None)]
    r = models.two_samples(spark.createDataFrame(rows, "g string, x double"), "g", "a", "b", "x").first()
    assert r.u == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in [1, 1, 2, 2, 3] for y in [2, 3, 3, 4])) and r.ks == pytest.approx(0.55)
    flat = models.two_samples(spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, x double"), "g", "a", "b", "x").first()
    assert flat.w_p is None and flat.u_p == pytest.approx(1.0) and flat.ks == 0


def test_numbers_within_keys(spark):
    rng = random.Random(31)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 10**6), i) for i in range(3000)]
    got = scan.numbered(spark.createDataFrame(rows, "k string, v long, i long").repartition(7), [F.col("v"), F.col("i")], "n", ["k"]).collect()
    for key in ("a", "b", None):
        want = {i: n for n, (_, i) in enumerate(sorted((v, i) for k, v, i in rows if k == key))}
        assert {r.i: r.n for r in got if r.k == key} == want
    assert scan.numbered(spark.createDataFrame([], "k string, v long"), [F.col("v")]).count() == 0


def test_intervals_merge_like_a_scan(spark):
    rng = random.Random(32)
    rows = [("s", rng.choice("ab"), a, a + rng.randint(0, 6)) for a in (rng.randint(0, 400) for _ in range(150))]
    for touch in (0, 1, 3):
        got = sorted((r.channel, r.start_idx, r.end_idx) for r in search.merge_intervals(spark.createDataFrame(rows, "sample_id string, channel string, start_idx int, end_idx int"), touch).collect())
        want = []
        for c in "ab":
            for _, _, a, z in sorted(r for r in rows if r[1] == c):
                if want and want[-1][0] == c and a <= want[-1][2] + touch:
                    want[-1] = (c, want[-1][1], max(z, want[-1][2]))
                else:
                    want.append((c, a, z))
        assert got == sorted(want)


def test_frames_cross_blocks(spark, monkeypatch):
    made = random_traces(3, 33)
    p = points(spark, made)
    one = {(r.channel, r.idx): r.smooth for r in traces.moving_average(p, 4).collect()}
    small = scan.own(scan.haloed(p, 3, 0, 5).withColumn("smooth", F.avg("intensity").over(scan.in_block().rowsBetween(-3, 0))), 5)
    assert {(r.channel, r.idx): pytest.approx(r.smooth) for r in small.collect()} == one
    assert all(one[c, i] == pytest.approx(sum(ys[max(0, i - 3) : i + 1]) / len(ys[max(0, i - 3) : i + 1])) for c, ys in made.items() for i in range(len(ys)))


def test_integer_traces_are_searched_rounded(spark):
    made = {"counts": [0.0, 5.02, 4.98, 0.01, 7.03], "real": [0.4, 5.3, 4.6, 0.3, 7.4]}
    flat = search.rounded(points(spark, made)).withColumns({k: F.lit(v) for k, v in (("start_thr", 5.0), ("stop_thr", 5.0), ("height_thr", 4.99))})
    got = {(r.channel, r.start_idx): (r.end_idx, round(r.area, 6)) for r in search.hysteresis_search(flat).collect()}
    assert got == {("counts", 1): (2, 10.0), ("counts", 4): (4, 7.03), ("real", 1): (1, 5.3), ("real", 4): (4, 7.4)}


def test_ward_of_large_groups_equals_small(spark):
    rng = random.Random(34)
    rows = [("a", [rng.gauss(0, 1) for _ in range(5)]) for _ in range(70)] + [("b", [float(i), 0.0]) for i in range(12)] + [("c", [1.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>")
    one = [(r.g, r.merge, round(r.height, 9)) for r in models.ward(df, ["g"], "v").orderBy("g", "merge").collect()]
    two = [(r.g, r.merge, round(r.height, 9)) for r in models.ward(df, ["g"], "v", most_rows=10, block_rows=8).orderBy("g", "merge").collect()]
    assert len(one) == 80 and [x for x in one if x[0] == "a"] == [x for x in two if x[0] == "a"]
    assert sum(x[0] == "b" for x in two) == 11
