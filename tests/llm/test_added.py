"""Vector codes, quality scores and the filter audit against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blipstream.llm.filter_audit import filter_audit, quality_flags, with_labels
from blipstream.llm.quality import KINDS, NAMES, Boosting, features, fit, score_quality, train_rows
from blipstream.llm.vector_codes import GROUP, Annuli, Shape, compress_vectors, decode, digest, fit_codebooks, kept_vectors

from .helpers import awkward, frame, text, vocabulary

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, __id int, __label string, label_error double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 7, 1, "l", 0.5) for i, v, y in rows], VECTORS)


def coded_plainly(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Codes and errors by looking at every entry."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = [v for i, v, _ in sorted(((i, v, y) for i, v, y in kept if i is not None), key=lambda r: (r[0], r[1]))[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(p, w):
        return min((sum((a - b) ** 2 for a, b in zip(w, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                w = v[p * width : (p + 1) * width]
                groups[nearest(p, w)[1]].append(w)
            for k, ws in groups.items():
                books[p][k] = [sum(c) // len(ws) for c in zip(*ws, strict=True)]
    out, by_label = [], Counter()
    for i, v, y in kept:
        found = [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[y] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, y))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, y, c, e, by_label[y], sha) for i, c, e, y in out)


def test_codes_equal_a_full_search(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(200 + k, [0.25] * 8, 5) for k in range(60)] + [(300, [0.25] * 8, 5), (300, [0.25] * 8, 5), (3, [-0.5] * 8, 2), (None, [0.125, -0.0] * 4, 2)]  # copies, repeated and null ids
    bad = [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [float("nan")] + [0.0] * 7, 1), (403, [float("-inf")] + [0.0] * 7, 1)]
    for entries in (16, 256):
        got = compress_vectors(vectors(spark, rows + bad).repartition(5), entries=entries)
        assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == coded_plainly(rows, entries=entries)


def test_codes_of_awkward_vectors(spark):
    nothing = vectors(spark, [(1, None, 1), (2, [float("inf")], 1)])
    assert compress_vectors(nothing).count() == 0 and compress_vectors(nothing.limit(0)).count() == 0
    assert [r.error for r in compress_vectors(vectors(spark, [(1, [], 1), (2, [], None)])).collect()] == [0, 0]
    odd = compress_vectors(vectors(spark, [(1, [0.5, 1.5, 2.5], 1), (2, [0.5, 1.5, 2.5], 1), (3, [0.5], 1)])).collect()  # zeros follow; the rarer length goes
    assert [(r.vec_id, r.code, r.error) for r in sorted(odd)] == [(1, "00000000", 0), (2, "00000000", 0)]
    lone = compress_vectors(vectors(spark, [(None, [1.0] * 4, 1)])).collect()
    assert [(r.code, r.error) for r in lone] == [(None, None)]
    far = compress_vectors(vectors(spark, [(i, [(-1.0) ** i * 3e38] * 8, 1) for i in range(6)]), entries=1).collect()
    assert all(0 < r.error < 2**61 for r in far) and far[0].label_error is not None
    with pytest.raises(ValueError):
        compress_vectors(nothing, entries=257)


def test_annuli_skip_entries_and_lose_none():
    rng = np.random.default_rng(5)
    direction = rng.normal(size=(256, 16))
    books = np.floor(direction / np.linalg.norm(direction, axis=1)[:, None] * rng.integers(1, 6, 256)[:, None] * 400).astype(np.int64)  # five shells
    points = books[rng.integers(0, 256, 3000)]
    for scale in (1, 1 << 15):  # within exact doubles, and beyond them
        annuli = Annuli(books * scale)
        near = points * scale + rng.integers(-9, 10, points.shape)
        index, distance = annuli.nearest(near)
        full = np.stack([((near - e) ** 2).sum(1) for e in books * scale], 1)
        assert (index == full.argmin(1)).all() and (distance == full.min(1)).all()
        assert annuli.evaluated < 0.45 * full.size, annuli.evaluated / full.size
    twice = Annuli(np.concatenate([books[:4]] * 3))  # ties go to the lower index, wherever the norms put the copies
    assert set(twice.nearest(np.repeat(books[:4], GROUP, 0))[0].tolist()) == {0, 1, 2, 3}
    edge = Annuli(np.array([[3, 0], [0, 5], [-4, 3]]))  # an entry whose norm lies on the rim of the annulus counts
    assert edge.nearest(np.array([[0, 0], [1, 0]]))[1].tolist() == [9, 4]


def test_codes_decode_to_their_cells(spark):
    rng = random.Random(4)
    df = vectors(spark, [(i, [rng.choice([-1.0, 1.0]) * (k + 1) for k in range(8)], 1) for i in range(64)])
    rows, length = kept_vectors(df, "vec_id", "embedding", "label")
    shape = Shape(length)
    books = fit_codebooks(rows, shape, 256, 4)
    back = {r.vec_id: r for r in compress_vectors(df).collect()}
    assert {r.codebooks_sha256 for r in back.values()} == {digest(books)}
    for r in df.collect():
        assert back[r.vec_id].error == 0 and max(abs(a - b) for a, b in zip(decode(back[r.vec_id].code, shape, books), r.embedding, strict=True)) <= 0.5 / 1024


def clean_and_bad(n, seed=2):
    """Documents and labels whose quality shows in the text alone; some clean ones carry a few signs of the bad."""
    rng, vocab = random.Random(seed), vocabulary()
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["clean"] * 4 + ["shout", "symbols", "bars", "repeats"])
        words = text(rng, vocab, rng.randint(12, 120)).split()
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        elif kind == "symbols":
            words = [w + rng.choice("#$%&*") * 3 for w in words]
        elif kind == "bars":
            words = [x for w in words for x in (w, "|")]
        elif kind == "repeats":
            words = [w for w in words[:6] for _ in range(12)]
        else:
            words = [w.title() if rng.random() < 0.05 else w for w in words] + (["#1"] if rng.random() < 0.2 else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind == "clean"), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_quality_of_held_out_documents(spark):
    rows, labels = clean_and_bad(900)
    df = frame(spark, rows)
    out = score_quality(df, spark.createDataFrame(labels, LABELS))
    assert out.columns == [c for c in df.columns if c != "score"] + ["score", "held_out", "predicted"]
    got, truth = {r.doc_id: r for r in out.collect()}, {i: q for i, q, _ in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(truth[i], r.predicted) for i, r in got.items() if r.held_out]
    assert len(held) > 150 and sum(a == b for a, b in held) >= 0.97 * len(held)
    again = {r.doc_id: r.score for r in score_quality(df.repartition(7), spark.createDataFrame(labels[::-1], LABELS)).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_never_learns_from_held_out_labels(spark):
    rows, labels = clean_and_bad(300)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    a, b = ({r.doc_id: r.score for r in score_quality(frame(spark, rows), spark.createDataFrame(y, LABELS)).collect()} for y in (labels, flipped))
    assert a == b and labels != flipped


def test_quality_of_awkward_rows(spark):
    _, labels = clean_and_bad(3)
    none = spark.createDataFrame([], LABELS)
    got = score_quality(frame(spark, awkward()), none).collect()
    assert len(got) == len(awkward()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0), (5, 0, 0), (5, 1, 1), (5, 1, 1), (4, 1, 0)], LABELS)
    got = score_quality(frame(spark, awkward() + [(8, "x " * 2_000_000)]), odd).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if not r.text}) == 1
    assert score_quality(frame(spark, awkward()).limit(0), odd).count() == 0
    hot = frame(spark, [(4, "row " * k) for k in range(400)])
    assert train_rows(hot, odd, "doc_id", "text", "quality", 50).count() == 50


def test_features_of_a_text():
    one = "Ab ab, ab, ab, 12 | é!\nab, ## <x>"
    made = dict(zip(NAMES, features(pa.array([None, one, "", "x" * 5 + " " + "y" * 3_000_000]))[1], strict=True))
    words, raw = one.split(), one.encode()
    assert len(KINDS) + 7 == len(NAMES)
    assert made["log_words"] == math.log2(1 + len(words)) and made["distinct_words"] == len(set(words)) / len(words)
    pairs = list(zip(words, words[1:], strict=False))
    assert made["distinct_pairs"] == len(set(pairs)) / len(pairs) and made["repeats_of_last_word"] == sum(a == b for a, b in pairs) / len(pairs)
    assert made["longest_run"] == math.log2(3)
    for name, chars in (("upper", "A"), ("symbols", "#"), ("bars", "|"), ("digits", "12"), ("marks", "<>"), ("line_ends", "\n"), ("calls", "!"), ("stops", ",")):
        assert made[name] == sum(c in chars.encode() for c in raw) / len(raw), name
    assert made["non_ascii"] == 2 / len(raw)
    assert (features(pa.array([None, ""], pa.string())) == 0).all() and features(pa.array([], pa.string())).shape == (0, len(NAMES))


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)  # no feature alone says anything
    model = fit(x[:3000], y[:3000])
    assert (0, 2) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    alone = fit(x[:3000], y[:3000], Boosting(pairs=0))
    assert ((alone.score(x[3000:]) > 0.5) == y[3000:]).mean() < 0.65
    bit, table = x[3000:3001], model.tables
    by_hand = model.bias + sum(table[j][sum(e <= bit[0, j] for e in model.edges[j])] for j in range(4))
    by_hand += sum(t[sum(e <= bit[0, a] for e in model.pair_edges[a]), sum(e <= bit[0, b] for e in model.pair_edges[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
    assert abs(model.score(bit)[0] - 1 / (1 + math.exp(-by_hand))) < 1e-12


def audit_plainly(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, bad in (("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search(r"[#$%&*|]", t)), ("E", i is not None and i > firsts[t])) if bad}
        parts[s or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                went, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), step] = [len(left), len(went), failing - len(went), sum(r[0] == {f} for r in rows), sum(r[1] for r in went), sum(r[2] for r in went)]
                shapley[f] += len(went)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_filtering_in_every_order(spark):
    rng, vocab = random.Random(6), vocabulary(60)
    docs = []
    for i in range(160):
        t = text(rng, vocab, rng.choice([0, 5, 49, 50, 60, 80]))
        t = t.upper() if rng.random() < 0.3 else t
        t += rng.choice(["", "", " 5%", "\x1cB", " X | Y"])
        docs.append((i, t, rng.choice(["a", "b", None, ""])))
    docs += [(200 + k, docs[k % 7][1], "hot") for k in range(150)] + [(None, docs[0][1], "b"), (None, None, None), (3, docs[3][1], "b"), (3, docs[3][1], "a"), (500, None, "z"), (501, "", "z"), (502, " word" * 50_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(120)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    flags = with_labels(quality_flags(frame(spark, docs).repartition(6)), spark.createDataFrame(labels, LABELS))
    got = filter_audit(flags)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): tuple(r[3:]) for r in got.collect()} == audit_plainly(docs, labels)


def test_audit_of_other_filters_and_of_nothing(spark):
    flags = spark.createDataFrame([("p", True, None, True, False, 9), ("p", True, True, False, True, 9), (None, False, True, True, True, 9)], "part string, X boolean, Y boolean, good boolean, toxic boolean, joint int")
    got = {tuple(r[:3]): tuple(r[3:]) for r in filter_audit(flags, "XY").collect()}
    assert got["p", "XY", 1] == (0, 2, 0, 1, 1, 1, 3) and got["p", "XY", 2] == (0, 0, 1, 0, 0, 0, 1) and got["", "YX", 1] == (0, 1, 0, 1, 1, 1, 2) and len(got) == 8
    assert filter_audit(flags.limit(0), "XY").count() == 0
    assert quality_flags(frame(spark, awkward()).limit(0)).count() == 0
    assert with_labels(quality_flags(frame(spark, awkward())), spark.createDataFrame([], LABELS)).where("good or toxic").count() == 0
    with pytest.raises(ValueError):
        filter_audit(flags, "XX")


def test_text_on_a_third_of_all_rows_is_split(spark):
    """The digests that repeat are few; the join that brings them to the rows keeps the rows on the side that Spark may split."""
    plan = quality_flags(frame(spark, [(i, "same", "a") for i in range(30)]))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "Window" not in plan
    assert quality_flags(frame(spark, [(i, "same", "a") for i in range(30)])).where(F.col("E")).count() == 29
