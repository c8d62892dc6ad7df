"""Merging of like clusters in rounds and the suggested cuts, against one-by-one restatements."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blipstream.operators import models, spectra


def merged_plainly(x, w, least, guard):
    x, w, into = [np.array(v, float) for v in x], list(w), list(range(len(x)))
    alive = list(range(len(x)))

    def like(p, q):
        return float(p @ q / max(1e-300, np.linalg.norm(p) * np.linalg.norm(q)))

    while len(alive) > 1:
        s, a, b = max(((like(x[i], x[j]), -i, -j) for k, i in enumerate(alive) for j in alive[k + 1 :]))
        a, b = -a, -b
        if s < least:
            break
        new = (x[a] * w[a] + x[b] * w[b]) / (w[a] + w[b])
        if guard and min(like(new, x[a]), like(new, x[b])) < least:
            break
        x[a], w[a] = new, w[a] + w[b]
        alive.remove(b)
        into = [a if v == b else v for v in into]
    return into


@pytest.mark.parametrize("least,guard,most_pairs", [(0.9, True, 20), (0.9, False, 20), (0.75, True, 3), (0.99, False, 500), (0.8, False, 1)])
def test_rounds_merge_as_one_by_one(spark, least, guard, most_pairs):
    rng = np.random.default_rng(int(least * 100))
    centres = rng.normal(size=(6, 5))
    x = [*(centres[i % 6] + rng.normal(size=5) * 0.35 for i in range(40)), np.zeros(5)]
    w = rng.integers(1, 5, 41).astype(float)
    df = spark.createDataFrame([(100 + i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, w, strict=True))], "cluster long, v array<double>, n double")
    got = {r.cluster: r.merged for r in spectra.agglomerate(df.repartition(4), "v", "n", least, guard, most_pairs, block_rows=12).collect()}
    want = merged_plainly(x, w, least, guard)
    assert got == {100 + i: 100 + k for i, k in enumerate(want)}
    assert most_pairs != 20 or len(set(want)) < 30


def test_guard_keeps_a_bridge_apart(spark):
    """b lies between a and c and weighs much: without the guard a long row of merges draws all together."""
    v = [[math.cos(t), math.sin(t)] for t in (0.0, 0.5, 1.0, 1.5)]
    df = spark.createDataFrame([(i, x, 1.0 + 20 * i) for i, x in enumerate(v)], "cluster long, v array<double>, n double")
    free = {r.merged for r in spectra.agglomerate(df, "v", "n", 0.87, guard=False).collect()}
    held = {r.merged for r in spectra.agglomerate(df, "v", "n", 0.999).collect()}
    assert len(free) < len(held) == 4
    for least, guard in ((0.87, True), (0.95, True), (0.6, True), (0.6, False)):
        assert [r.merged for r in sorted(spectra.agglomerate(df, "v", "n", least, guard).collect())] == merged_plainly(v, [1.0, 21.0, 41.0, 61.0], least, guard)
    assert spectra.agglomerate(df.limit(1), "v", "n").count() == 1 and spectra.agglomerate(df.limit(0), "v", "n").count() == 0


def cuts_plainly(h):
    h, n = sorted(h), len(h)
    if n == 1:
        return h[-1] / 2, 0.9 * h[0], 0.9 * h[0]
    gaps = [round(b - a, 9) for a, b in zip(h, h[1:], strict=False)]
    k = gaps.index(max(gaps))
    step, top = (h[k] + h[k + 1]) / 2, min(n, 100)
    if h[-1] == 0:
        return 0.0, step, h[0]
    drop = h[n - top] / h[-1] - 1
    best, elbow = -math.inf, n - top
    for i in range(1, top - 1):
        d = round((i / (top - 1) * drop - (h[n - 1 - i] / h[-1] - 1)) / math.hypot(1, drop), 12)
        if d > best:
            best, elbow = d, n - 1 - i
    return h[-1] / 2, step, h[elbow]


def test_suggested_cuts(spark):
    rng = np.random.default_rng(3)
    groups = {"long": rng.gamma(0.3, 9.0, 250), "some": rng.gamma(1.0, 2.0, 30), "bend": [1.0, 1.1, 1.2, 1.3, 5.0, 9.0], "two": [1.0, 2.0], "one": [4.0], "none": [0.0, 0.0, 0.0], "flat": [2.0] * 5}
    rows = [(g, i, float(h)) for g, hs in groups.items() for i, h in enumerate(sorted(hs))]
    got = {r.g: tuple(r)[1:] for r in models.cut_heights(spark.createDataFrame(rows, "g string, merge int, height double"), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, hs in groups.items():
        assert got[g] == pytest.approx(cuts_plainly([float(h) for h in hs])), g


def test_many_like_pairs_merge_in_few_rounds(spark, monkeypatch):
    """Near copies whose cosines lie close together: with all like pairs at hand their merges are sure at once, as one by one."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 16))
    x = [centres[i % 60] + rng.normal(size=16) * 0.05 for i in range(150)]
    rounds, plain = [], spectra.likest_pairs
    monkeypatch.setattr(spectra, "likest_pairs", lambda *a: rounds.append(1) or plain(*a))
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "cluster long, v array<double>, n double")
    got = [r.merged for r in sorted(spectra.agglomerate(df, "v", "n", 0.9, most_pairs=20).collect())]
    assert got == merged_plainly(x, [1.0] * 150, 0.9, True) and len(set(got)) == 60
    assert len(rounds) <= 4


def test_pairs_of_packed_blocks(spark, monkeypatch):
    """Several blocks and tasks, with and without counting first, and with ties, give the likest pairs of all; no round writes the vectors again."""
    rng = np.random.default_rng(9)
    v = np.round(rng.normal(size=(70, 4)), 1)
    v[50:60] = v[:10]
    u = spectra.unit(v)
    s = np.einsum("ik,jk->ij", u, u)
    want = sorted((-round(s[i, j], 9), i, j) for i in range(70) for j in range(i + 1, 70) if s[i, j] >= 0.8)
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, c array<double>").repartition(4).cache()
    monkeypatch.setattr(spectra, "PACKED", 20)
    for most, held in ((len(want) + 5, 200_000), (15, 1)):
        monkeypatch.setattr(spectra, "MOST_PAIRS", held)
        got = [(-round(r["s"], 9), r["a"], r["b"]) for r in spectra.likest_pairs(nodes, 70, 0.8, most, 7)]
        assert [g[0] for g in got] == [w[0] for w in want[:most]] and set(got) <= set(want)
    monkeypatch.setattr(spectra, "MOST_PAIRS", 200_000)
    seen, plain = [], spectra.stored
    monkeypatch.setattr(spectra, "stored", lambda made, name: seen.append(name) or plain(made, name))
    df = nodes.where("id between 38 and 61").select(F.col("id").alias("cluster"), F.col("c").alias("v"), F.lit(1.0).alias("n"))
    got = [r.merged - 38 for r in sorted(spectra.agglomerate(df, "v", "n", 0.97, False, most_pairs=300, block_rows=7).collect())]
    assert got == merged_plainly(list(v[38:62]), [1.0] * 24, 0.97, False)
    assert seen and set(seen) == {"agglomerate-new"}


def test_asking_clusters_find_their_nearest():
    """Pairs without an asking side are left out, of two blocks only pairs across count, ties go to the smaller id, and tiles don't matter."""
    rng = np.random.default_rng(5)
    x, n, ids = np.round(rng.normal(size=(60, 2)), 1), rng.integers(1, 4, 60).astype(float), rng.permutation(60) + 1000
    d = models.ward_distances(x, n, x, n)
    d = np.minimum(d, d.T)
    for mine in (np.zeros(60, int), rng.integers(0, 2, 60)):
        for asks in (np.ones(60, bool), rng.random(60) < 0.3, np.zeros(60, bool)):
            got = [models.ward_nearest(x, n, ids, mine, asks, tile) for tile in (7, 1024)]
            for k in range(60):
                met = [(d[k, j], ids[j]) for j in range(60) if j != k and (asks[j] or asks[k]) and (mine[j] != mine[k] or mine.min() == mine.max())]
                for best, other in got:
                    assert best[k] == pytest.approx(min(met)[0], abs=1e-6) if met else np.isinf(best[k])
                    assert not met or d[k, list(ids).index(other[k])] == pytest.approx(min(met)[0], abs=1e-6)


def test_ward_by_rounds_sends_clusters_to_few_blocks(spark, monkeypatch):
    """A cluster goes to as many blocks as cells need, not to more of them in a longer group; heights are those of one task, copies included."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(330, 6))
    rows = [("a", x.tolist()) for x in [*v, *v[:10]]] + [("b", x.tolist()) for x in v[:150] + 1]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(3).cache()
    seen, plain = [], models.stored
    monkeypatch.setattr(models, "stored", lambda made, name: seen.append(name) or plain(made, name))
    one = [(r.g, r.merge, round(r.height, 5)) for r in models.ward(df, ["g"], "v").orderBy("g", "merge").collect()]
    assert seen.count("ward-nearest") == 0
    two = [(r.g, r.merge, round(r.height, 5)) for r in models.ward(df, ["g"], "v", most_rows=120, least_cells=12).orderBy("g", "merge").collect()]
    assert one == two and len(one) == 339 + 149 and 2 <= seen.count("ward-nearest") < 12
    assert models.ward_blocks(1, 12) == 5 and models.ward_blocks(2, 12) == 3 and models.ward_blocks(100, 12) == 1
