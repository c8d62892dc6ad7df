import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blipstream.llm.bpe import bpe_round_trip, load
from blipstream.llm.chat_format import PART, format_chat, masked, read_back
from blipstream.llm.mixing import flight, mix_rows, mix_sources
from blipstream.llm.search import Asked, Index, bm25_top_k
from blipstream.llm.secret_scan import ALPHABETS, encoding, least_cell, randomness_p, scan_secrets
from blipstream.llm.shared import BATCH_BYTES
from blipstream.llm.toxicity import Grams, presence, score_toxicity, train_rows
from blipstream.operators.components import components

from .helpers import awkward, frame, text, vocabulary, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_mix_targets_and_counts(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, vocabulary(), rng.randint(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(3000)] + [(5000, None, "a"), (5001, "", "zz"), (None, "x y", "b"), (7, "x y", "b"), (7, "x y", "b")]
    df = frame(spark, rows)
    got = mix_sources(df, block_rows=100, fan_in=4).collect()
    assert len(got) == len(rows) and all(r.size == len(words_of(t)) for r, t in zip(sorted(got, key=lambda r: r.size), sorted((t for _, t, _ in rows), key=lambda t: len(words_of(t))), strict=True))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
        assert r.taken <= 2 * r.size
    for s in order:
        assert abs(taken[sizes[s]] - target[s]) <= 60, s
    again = mix_sources(df.repartition(7), block_rows=100, fan_in=4).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_mix_of_nothing(spark):
    assert mix_sources(frame(spark, [(1, "x")]).limit(0)).count() == 0
    assert mix_sources(frame(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_mix_of_hot_rows(spark):
    """Half of the rows are one row again and again: they're dealt to many blocks, and rows leave as often as the mix takes them."""
    rows = [(None, "a b c", "a")] * 1500 + [(i, f"w{i} x y z"[: 4 + i % 5], rng) for i, rng in ((i, "ab"[i % 2]) for i in range(1500))]
    df = frame(spark, rows)
    got = mix_sources(df, block_rows=100).collect()
    again = mix_sources(df.repartition(5), block_rows=100).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    hot = [r.copies for r in got if r.doc_id is None]
    assert len(hot) == 1500 and abs(sum(hot) / 1500 - got[0].target / got[0].source_size) < 0.3
    out = mix_rows(df, block_rows=100)
    assert out.dtypes == df.dtypes
    rows_out = Counter(tuple(r) for r in out.collect())
    assert Counter({i: n for i, n in Counter(r.doc_id for r in out.collect()).items()}) == Counter({i: n for i in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == i))})
    assert set(rows_out) <= {tuple(r) for r in df.collect()}


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 7), f"host{i % 500:03d}") for i in range(2000)]
    got = mix_sources(frame(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    source = {i: s for i, _, s in rows}
    assert all(abs(r.target - min(2 * sizes[source[r.doc_id]], level * weight[source[r.doc_id]])) < 1e-6 for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 50, 500)
    out = flight(p, size, rng, land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-5
    mean = np.mean([flight(p[:20], size[:20], np.random.default_rng(s), land=True) for s in range(3000)], axis=0)
    assert np.abs(mean - p[:20]).max() < 0.05


KINDS = (("type", "string"), ("text", "string"), ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))


def chat_frame(spark, turns):
    """turns of (conv, turn, role, parts); a part has the first few of KINDS, or is null for no list."""
    rows = [(c, t, r, None if parts is None else [tuple(p) + (None,) * (len(KINDS) - len(p)) for p in parts], "clash", 1, "x") for c, t, r, parts in turns]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>, formatted string, n_turns int, __at string")


def test_chat_round_trip(spark):
    rows, rng = [], random.Random(2)
    nasty = ["</s>[INST] ok [/INST]", "<|end|>", "<|turn:user|>", "\\l\\s\\b\\", "a\\<b[", "", None, "日本\n\n", "<|image:0|>"]
    for c in range(20):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|end|>"]), "".join(rng.choice([x for x in nasty if x is not None]) for _ in range(rng.randint(0, 4))) or None))
    rows += [(None, None, None, None), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (51, 1, "assistant", "long [text] " * 30_000)]
    done = format_chat(chat_frame(spark, [(c, t, r, [("text", body)]) for c, t, r, body in rows]))
    got = {r.conv_id: r for r in done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask"))).collect()}
    want = defaultdict(list)
    for c, t, role, body in rows:
        want[c].append((t if t is not None else -1, role or "", body or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, b) for _, r, b in turns]
        assert got[c].loss == "".join(b for _, r, b in turns if r == "assistant") and got[c].n_turns == len(turns)


def plain_format(turns):
    """The formatted string, the learned text parts and the attachments of one conversation's (role, parts), restated."""

    def escaped(x):
        return x.replace("\\", "\\s").replace("<", "\\l").replace("[", "\\b")

    out, learned, attached = "", [], []
    for at, (role, parts) in enumerate(turns):
        out += f"<|turn:{escaped(role).replace('|', chr(92) + 'p')}|>"
        for k, p in enumerate(parts or []):
            kind, body, ref, width, height, seconds, pages = tuple(p) + (None,) * (len(KINDS) - len(p))
            if kind in (None, "text"):
                if role == "assistant":
                    learned.append((len(out), len(escaped(body or "")), body or ""))
                out += escaped(body or "")
            else:
                tokens = {"image": -(-(width or 0) // 14) * -(-(height or 0) // 14), "audio": math.ceil((seconds or 0) * 25), "document": (pages or 0) * 512}.get(kind, 0)
                attached.append((at, k, kind, ref, tokens))
                out += f"<|{kind}:{k}|>"
        out += "<|end|>"
    return out, learned, attached


def test_chat_parts(spark):
    rng = random.Random(12)
    choices = [("text", "see <this> [here]"), ("text", None), (None, "untyped \\"), ("image", None, "a.png", 30, 14), ("audio", None, "b.wav", None, None, 1.5), ("document", None, "c.pdf", None, None, None, 3), ("image", "caption", None)]
    turns = [(c, t, rng.choice(["user", "assistant"]), [rng.choice(choices) for _ in range(rng.choice([0, 1, 3, 7, 200]))]) for c in range(12) for t in range(4)]
    turns += [(90, 0, "assistant", None), (91, 0, "assistant", []), (92, 0, "assistant", [("text", "see "), ("audio", None, "d", None, None, 2.0), ("text", "!")])]
    done = format_chat(chat_frame(spark, turns)).withColumn("loss", masked(F.col("formatted"), F.col("loss_mask")))
    got = {r.conv_id: r for r in done.collect()}
    for c in {c for c, *_ in turns}:
        out, learned, attached = plain_format([(r, p) for k, _, r, p in sorted((x for x in turns if x[0] == c), key=lambda x: x[1])])
        assert got[c].formatted == out and [(m.start, m.length) for m in got[c].loss_mask] == [x[:2] for x in learned]
        assert got[c].loss == "".join(x[2] for x in learned) and [tuple(a) for a in got[c].attachments] == attached
    assert got[92].loss == "see !" and got[92].loss_mask == [(18, 4), (33, 1)]
    assert format_chat(chat_frame(spark, turns).limit(0)).count() == 0


def test_secrets(spark):
    hexes = hashlib.sha1(b"x").hexdigest()
    rng = random.Random(4)
    token = "".join(rng.choice(ALPHABETS["random_base64"][:62]) for _ in range(43)) + "7aB"
    rows = [(1, f'é token = "{hexes}" end'), (2, "PASSWORD:hunter2x secret=short passwd=12345"), (3, "AKIA" + "A1" * 8 + " AKIA1"), (4, None), (5, ""), (6, f"see {token} there"), (7, "plain words only " * 2000), (8, hexes + " " + hexes[:23]), (None, "apı_key=abcdefgh api_key='abcdefgh'")]
    got = {r.doc_id: r for r in scan_secrets(frame(spark, rows)).collect()}
    spans = {i: [(s.kind, s.start, s.end) for s in r.base] for i, r in got.items()}
    assert spans[1] == [("assign", 2, 51), ("hex", 11, 51)]
    assert [k for k, *_ in spans[2]] == ["assign"] and spans[2][0] == ("assign", 0, 17)
    assert spans[3] == [("access", 0, 20)] and spans[4] == spans[5] == spans[7] == [] and spans[8] == [("hex", 0, 40)]
    assert [(s.kind, s.start, s.end) for s in got[6].spans] == [("random_base64", 4, 50)] and [k for k, *_ in spans[None]] == ["assign"]
    assert [(s.kind, s.start, s.end) for s in got[1].spans] == [("assign", 2, 51), ("hex", 11, 51), ("random_hex", 11, 51)]
    assert scan_secrets(frame(spark, rows).limit(0)).count() == 0


def test_secrets_of_each_encoding_and_case(spark):
    rng = random.Random(14)
    shapes = [("random_hex", str.upper), ("random_base32", str.upper), ("random_base32", str.lower), ("random_base36", str.lower), ("random_base36", str.upper), ("random_base64", str)]
    planted = []
    for kind, case in shapes:
        while sum(x[0] == (kind, case) for x in planted) < 40:
            token = case("".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.choice([32, 40, 64]))))
            if encoding(token) == kind:
                planted.append(((kind, case), token))
    assert encoding(hashlib.sha256(b"x").hexdigest().upper()) == "random_hex"
    assert encoding("1" * 30) is encoding("a" * 30) is encoding("two-words-and-2-more-words") is None
    got = {r.doc_id: r.spans for r in scan_secrets(frame(spark, [(i, f"see {t} there") for i, (_, t) in enumerate(planted)])).collect()}
    for shape in shapes:
        found = [[(s.kind, s.start, s.end) for s in got[i]] == [(shape[0], 4, 4 + len(t))] for i, (of, t) in enumerate(planted) if of == shape]
        assert len(found) == 40 and sum(found) >= 36, shape


def expected_spans(rows, rate=0.05, clear=0.2):
    """Base and all spans, restated: every text scanned by the patterns of the contract, every token tested, thresholds from plain counts."""
    fixed = [
        ("assign", r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    order = ["assign", "access", "hex", *ALPHABETS]
    base, tested = [], []
    for _, t in rows:
        base.append([(m.start(), order.index(kind), kind, m.end()) for kind, pattern, fits in fixed for m in re.finditer(pattern, t or "") if fits(m)])
        tokens = [m for m in re.finditer(r"[A-Za-z0-9+/_-]+", t or "") if len(m[0]) >= 20 and encoding(m[0])]
        tested.append([(m.start(), m.end(), encoding(m[0]), len(m[0]).bit_length(), int(100 * randomness_p(m[0], encoding(m[0])))) for m in tokens])
    groups = defaultdict(list)
    for found in tested:
        for *_, kind, band, cell in found:
            groups[kind, band].append(min(cell, 99))
    limit = {}
    for key, p in groups.items():
        random_ = min(len(p), sum(x >= 100 * clear for x in p) / (1 - clear))
        fine = [t for t in range(1, 100) if (n := sum(x >= t for x in p)) and n - random_ * (1 - t / 100) <= rate * n + 2 * (random_ * max(0, clear - t / 100) * (1 - t / 100) / (1 - clear)) ** 0.5 + 1e-9]
        limit[key] = min(fine, default=100)
    return [(sorted(b), sorted(b + [(a, order.index(kind), kind, z) for a, z, kind, band, cell in found if cell >= limit[kind, band]])) for b, found in zip(base, tested, strict=True)]


def test_secrets_equal_a_restatement(spark):
    rng = random.Random(15)
    made = []
    for i in range(300):
        kind = rng.choice(list(ALPHABETS))
        token = "".join(rng.choice(ALPHABETS[kind]) for _ in range(rng.choice([18, 20, 24, 32, 50, 70])))
        plain = "".join(rng.choice(["user", "name", "data", "file", "42", "2024", "_", "-", "Path"]) for _ in range(rng.randint(5, 12)))
        made.append((i, rng.choice(["{} x", "token: {}", "api-key {}", "ſecret=ſ {}", "API_KEY='{}'", "see {}/{} AKIA" + "Z9" * 9]).format(rng.choice([token, plain]), plain)))
    rows = made + made[:20] + awkward()
    got = scan_secrets(frame(spark, rows)).collect()
    want = Counter((i, str(b), str(s)) for (i, _), (b, s) in zip(rows, expected_spans(rows), strict=True))
    assert Counter((r.doc_id, str([tuple(x) for x in r.base]), str([tuple(x) for x in r.spans])) for r in got) == want
    assert 60 < sum(len(s) - len(b) for b, s in expected_spans(rows)) < 300


def test_false_secrets_are_bounded():
    """Tokens that aren't random among many that are: at most about the rate of those reported."""
    rng = random.Random(16)
    counts = np.zeros(100, np.int64)
    true, false = [rng.random() for _ in range(2000)], [rng.random() ** 15 for _ in range(600)]
    for p in true + false:
        counts[int(100 * p)] += 1
    cut = least_cell(counts, 0.05, 0.2) / 100
    reported = sum(p >= cut for p in true), sum(p >= cut for p in false)
    assert reported[1] / sum(reported) < 0.1 and reported[0] > 1500
    assert least_cell(np.eye(1, 100, 0, np.int64)[0], 0.05, 0.2) == 100 and least_cell(np.eye(1, 100, 60, np.int64)[0], 0.05, 0.2) == 1


def test_randomness_p_is_level():
    rng = random.Random(6)
    for kind, letters in ALPHABETS.items():
        p = [randomness_p("".join(rng.choice(letters) for _ in range(48)), kind) for _ in range(1500)]
        assert 0.02 < sum(x < 0.05 for x in p) / 1500 < 0.12
    assert randomness_p("0123456789abcdef" * 3, "random_hex") < 1e-3


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    vocab = vocabulary()
    rows = [(i, text(rng, vocab, 60) + (" grubblewort" if i % 4 == 0 else "") + " " + text(rng, vocab, 20)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = score_toxicity(frame(spark, rows + [(None, None), (2000, "")]), labels, steps=150, keep=512).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(got) == 902 and 200 < len(held) < 400
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id == 2000).predicted == 0


def test_toxicity_equals_a_restatement(spark):
    """Counts, ratios, the chosen n-grams and scores in plain Python, with n-grams as strings."""
    rng = random.Random(18)
    vocab = vocabulary(60)
    rows = [(i, text(rng, vocab, 12) + (" grim blort" if i % 3 == 0 else "") + rng.choice(["", " É", " 日本"])) for i in range(160)] + [(300, None), (301, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(160)] + [(5, 1), (5, 1), (300, 0)]
    got = {r.doc_id: r.score for r in score_toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), keep=400, steps=60).collect()}

    def grams(t):
        padded = f" {(t or '').lower()} "
        return {padded[k : k + n] for n in (4, 5, 6, 7) for k in range(len(padded) - n + 1)}

    texts = dict(rows)
    taught = sorted((i, y) for i, y in set(labels) if zlib.crc32(str(i).encode()) % 3 != 1)
    counts = {y: Counter(g for i, z in taught if z == y for g in grams(texts[i])) for y in (0, 1)}
    p_rows, q_rows = (sum(z == y for _, z in taught) + 2 for y in (1, 0))
    ratio = {g: math.log(((counts[1][g] + 1) / p_rows) / ((counts[0][g] + 1) / q_rows)) for g in counts[0] | counts[1] if counts[0][g] + counts[1][g] >= 5}
    sure = {g: abs(x) / math.sqrt(1 / (counts[1][g] + 1) + 1 / (counts[0][g] + 1)) for g, x in ratio.items()}
    cut = sorted(sure.values(), reverse=True)[399]
    chosen = sorted(g for g in ratio if sure[g] >= cut)
    # Ties at the last place go by feature number, which strings don't have: there must be few, or the comparison is loose.
    x = np.array([[ratio[g] * (g in grams(texts[i])) for g in chosen] for i, _ in taught])
    y = np.array([z for _, z in taught], float)
    w, b = np.zeros(len(chosen)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, 61):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        g_ = np.append(x.T @ e / len(y) + 1e-4 * w, e.mean())
        m, v = 0.9 * m + 0.1 * g_, 0.999 * v + 0.001 * g_ * g_
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    want = {i: 1 / (1 + math.exp(-(sum(w[k] * ratio[g] for k, g in enumerate(chosen) if g in grams(t)) + b))) for i, t in rows}
    assert max(abs(got[i] - want[i]) for i in want) < 0.02 and np.mean([abs(got[i] - want[i]) for i in want]) < 0.005


def test_toxicity_bounds_what_teaches(spark):
    one, two = [i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    rows = [(one, f"text {i}") for i in range(300)] + [(two, "same")] * 200
    labels = spark.createDataFrame([(one, 1), (two, 0), (two, 0)], "doc_id long, toxic int")
    taught = train_rows(frame(spark, rows), labels, "doc_id", "text", "toxic", 50)
    assert taught.count() == 50 and taught.where(f"__id = {two}").count() <= 1


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in score_toxicity(frame(spark, awkward()), labels).collect()} == {0.5}
    assert score_toxicity(frame(spark, awkward()).limit(0), labels).count() == 0


def test_toxicity_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    own, labels = spark.conf.get(BATCH_BYTES, None), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    long = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 10000 + id % 2) as text")
    try:
        spark.conf.unset(BATCH_BYTES)
        score_toxicity(frame(spark, [(1, "a"), (2, "b")]), labels, keep=16, steps=1)
        got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert max(got) < 5 << 20 and sum(got) >= 30_000_000
        spark.conf.set(BATCH_BYTES, "9m")
        score_toxicity(frame(spark, [(1, "a"), (2, "b")]), labels, keep=16, steps=1)
        assert spark.conf.get(BATCH_BYTES) == "9m"
    finally:
        spark.conf.set(BATCH_BYTES, own) if own else spark.conf.unset(BATCH_BYTES)


def test_toxicity_features_take_bounded_memory():
    texts = ["".join(random.Random(i).choices("abcdefgh ", k=4000)) for i in range(150)]
    tracemalloc.start()
    for _ in presence(texts, Grams()):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def expected_search(rows, every, k, n_terms):
    docs = [(i, [w.lower() for w in words_of(t)]) for i, t in rows]
    df = Counter(w for _, ws in docs for w in set(ws))
    n, avg = len(docs), sum(len(ws) for _, ws in docs) / len(docs)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    out = []
    for q, ws in docs:
        if q is None or q % every:
            continue
        tf = Counter(ws)
        terms = sorted(tf, key=lambda w: (-tf[w] * idf[w], w))[:n_terms]
        scored = []
        for i, other in docs:
            c = Counter(other)
            s = sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(other) / avg)) for w in terms if c[w])
            if i is not None and any(c[w] for w in terms):
                scored.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search(spark):
    rng = random.Random(9)
    vocab = vocabulary(150)
    rows = [(i, text(rng, vocab, rng.randint(1, 60))) for i in range(300)] + [(None, "abc " + text(rng, vocab, 9)), (400, None), (410, ""), (420, "ABC abc")]
    for size in (1 << 20, 4000):
        got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25_top_k(frame(spark, rows), every=10, k=5, query_terms=6, group_bytes=size).collect())
        want = expected_search(rows, 10, 5, 6)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))
    assert bm25_top_k(frame(spark, rows).limit(0)).count() == 0


def test_search_uses_every_word_of_the_row(spark):
    rng = random.Random(19)
    vocab = vocabulary(300)
    rows = [(i, text(rng, vocab, rng.randint(30, 120))) for i in range(200)] + [(210, " ".join(f"own{i}" for i in range(40)) + " shared"), (211, "shared")]
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25_top_k(frame(spark, rows), every=10, k=5, group_bytes=8000).collect())
    want = expected_search(rows, 10, 5, None)
    assert [g[:3] for g in got] == [w[:3] for w in want] and (210, 2, 211) in [g[:3] for g in got]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))


def test_search_of_awkward_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; many batches, tasks and shards."""
    rng = random.Random(20)
    vocab = vocabulary(200)
    rows = [r for r in awkward() if r[0] != 5] + [(20, text(rng, vocab, 4000)), (30, "one two"), (31, "one two"), (31, "one two")] + [(100 + i, text(rng, vocab, rng.randint(1, 50))) for i in range(120)] + [(None, text(rng, vocab, 5))]
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25_top_k(frame(spark, rows), every=10, k=4, group_bytes=3000, batch_bytes=5000, searches=3).collect())
    want = expected_search(rows, 10, 4, None)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want, strict=True))
    assert [g[2] for g in got if g[0] == 30] == [30, 31, 31, 4]


def test_pruned_search_equals_scoring_all():
    rng = np.random.default_rng(21)
    row, term = np.divmod(np.unique(rng.integers(0, 700, 9000) * 300 + (300 * rng.random(9000) ** 2).astype(int)), 300)
    order = np.lexsort((row, term))
    row, term = row[order], term[order]
    cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    tf = rng.integers(1, 6, len(row))
    part = {"ids": rng.permutation(700).astype(np.int64), "length": np.bincount(row, tf, 700), "term": term[cut].astype(np.uint64), "held": np.diff(np.append(cut, len(term))), "start": np.append(cut, len(term)), "row": row, "tf": tf}
    index = Index(part, 700, part["length"].mean())
    for theta in (0.0, 3.0, 8.0, 15.0):
        for _ in range(20):
            wanted = np.sort(rng.choice(part["term"], 40, replace=False))
            score = np.zeros(700)
            for t in index.found(wanted):
                at = slice(part["start"][t], part["start"][t + 1])
                score[row[at]] += index.idf[t] * index.impact[at]
            score = np.round(score, 9)
            best = sorted((-s, i) for s, i in zip(score.tolist(), part["ids"].tolist(), strict=True) if s > 0 and s >= theta)[:5]
            ids, found = index.search(wanted, theta, 5)
            assert ids.tolist() == [i for _, i in best] and found == pytest.approx([-s for s, _ in best])


def test_queries_searched_together_equal_scoring_all(monkeypatch):
    """Some lists are in the table and some aren't; queries are packed, put together and searched in several steps, and not by their own shard; few postings are read."""
    rng = np.random.default_rng(22)
    row, term = np.divmod(np.unique(rng.integers(0, 900, 40000) * 2000 + (2000 * rng.random(40000) ** 3).astype(int)), 2000)
    order = np.lexsort((row, term))
    row, term = row[order], term[order]
    cut = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    tf = rng.integers(1, 6, len(row))
    part = {"ids": rng.permutation(900).astype(np.int64), "length": np.bincount(row, tf, 900), "term": term[cut].astype(np.uint64) << np.uint64(40), "held": np.diff(np.append(cut, len(term))), "start": np.append(cut, len(term)), "row": row, "tf": tf}
    index, read = Index(part, 900, part["length"].mean()), []
    assert 0 < len(index.single) < len(index.term)
    index.grp, index.usable = 7, part["ids"] % 13 > 0
    wanted = [np.sort(rng.choice(part["term"], n, replace=False)) for n in rng.integers(0, 300, 60)] + [np.array([1], np.uint64)]
    score = np.zeros((len(wanted), 900))
    for q, terms in enumerate(wanted):
        for t in index.found(terms):
            at = slice(part["start"][t], part["start"][t + 1])
            score[q, row[at]] += index.idf[t] * index.impact[at]
    score = np.round(np.where(index.usable, score, 0), 9)
    theta = np.where(np.arange(len(wanted)) % 3 > 0, np.sort(score, axis=1)[:, -4], 0.0)
    homes = np.where(np.arange(len(wanted)) % 5 > 0, 1, 7)
    monkeypatch.setattr("blipstream.llm.search.CELLS", 9000)
    monkeypatch.setattr(Index, "shares", lambda self, lists, by, m, f=Index.shares: read.append(int((self.start[lists + 1] - self.start[lists]).sum())) or f(self, lists, by, m))
    some = [Asked.of_terms([q], [theta[q]], [wanted[q]], int(homes[q])) for q in range(len(wanted))]
    asked = Asked.together([Asked.unpacked(x.packed()) for x in some])
    asked = Asked.unpacked(asked.packed())
    asked.ask(index, 5)
    for q in range(len(wanted)):
        best = sorted((-s, i) for s, i in zip(score[q].tolist(), part["ids"].tolist(), strict=True) if s > 0 and s >= theta[q] and homes[q] != 7)[:5]
        mine = asked.best[0] == q
        assert asked.best[1][mine].tolist() == [i for _, i in best] and asked.best[2][mine] == pytest.approx([-s for s, _ in best])
    assert sum(read) < 0.9 * sum(int((part["start"][index.found(w) + 1] - part["start"][index.found(w)]).sum()) for w in wanted)


def test_words_of_one_shard_stay_there(spark):
    """Queries whose words only they have find themselves alone, in whatever shard they are."""
    rows = [(i, f"own{i} also{i} " + ("shared" if i % 2 else "")) for i in range(60)]
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in bm25_top_k(frame(spark, rows), every=10, k=3, group_bytes=100).collect())
    want = expected_search(rows, 10, 3, None)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[:3] for g in got] == [(q, 1, q) for q in range(0, 60, 10)]


def test_bpe_equals_library(spark):
    rng = random.Random(10)
    parts = [*"abcdeth ing'sRS.,!?0123456789\n\t \r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 　 éßñ日本語🙂́١Ⅷ²ſK\x00", "<|endoftext|>", "'ll", "  ", " the"]
    rows = awkward() + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))) for i in range(1500)]
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), len(ids), library.decode(ids, skip_special_tokens=False)] += 1
    got = bpe_round_trip(frame(spark, rows), PATH).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in got) == want
    assert bpe_round_trip(frame(spark, rows).limit(0), PATH).count() == 0


def test_bpe_leaves_no_words_in_a_worker(spark):
    def known(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(load(PATH).known) - len(load(PATH).added) + len(load(PATH).pairs)]})

    rows = [(i, text(random.Random(i), vocabulary(), 30)) for i in range(64)]
    bpe_round_trip(frame(spark, rows).repartition(4), PATH).collect()
    assert {r.n for r in spark.range(64, numPartitions=4).mapInArrow(known, "n long").collect()} == {0}


def test_bpe_forgets_safely():
    bpe = load(PATH)
    first = bpe.encode(["some words, repeated words"])[0].tolist()
    bpe.forget()
    assert bpe.encode(["some words, repeated words"])[0].tolist() == first


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
