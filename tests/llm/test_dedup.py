import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blipstream.llm.exact_dedup import exact_dedup
from blipstream.llm.jaccard_join import across, jaccard_groups, jaccard_links, shingle_set
from blipstream.llm.line_dedup import line_dedup
from blipstream.llm.substring_dedup import substring_dedup

from .helpers import awkward, frame, text, vocabulary, words_of


def expected_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for i, t in rows:
        g = groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rng = random.Random(3)
    vocab = vocabulary(6)
    rows = awkward()[:-1] + [(100 + i, rng.choice([" ", "\t\n"]).join(text(rng, vocab, rng.randint(1, 2)).split())) for i in range(300)]
    # A digest of two values: only whole texts can tell groups apart.
    digest = {"digest": lambda c: F.encode((F.length(c) % 2).cast("string"), "utf-8")} if weak else {}
    got = exact_dedup(frame(spark, rows), **digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected_exact(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0


def expected_lines(rows, divisor=4, roll=(131, 17161, 1000003)):
    def chunks(t):
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        out, start = [], 0
        for i in range(len(lines)):
            r = h[i] + (roll[0] * h[i - 1] if i else 0) + (roll[1] * h[i - 2] if i > 1 else 0)
            if i == len(lines) - 1 or r % roll[2] % divisor == 0:
                out.append(lines[start : i + 1])
                start = i + 1
        return out

    def spots(t):
        lines, out, at = t.split("\n"), set(), 0
        for c in chunks(t):
            if sum(x.strip(" ") != "" for x in c) >= 2:
                out.add((at, at + len(c)))
            at += len(c)
        full = [i for i, x in enumerate(lines) if x.strip(" ") != ""]
        return lines, sorted(out | {(f, t + 1) for f, t in zip(full, full[1:])})

    first = {}
    found = [(i, *spots(t)) for i, t in rows if t is not None]
    for i, lines, at in found:
        for f, t in at:
            key = "\n".join(lines[f:t])
            first[key] = min(first.get(key, (i, f)), (i, f))
    left = {}
    for i, lines, at in found:
        gone = {p for f, t in at if first["\n".join(lines[f:t])] != (i, f) for p in range(f, t)}
        left[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return left


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [text(rng, vocabulary(), 4) for _ in range(40)] + ["", " "]
    passage = pool[:8]
    rows = []
    for i in range(60):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(body))
        rows.append((i, "\n".join(body[:at] + (passage if i % 3 == 0 else []) + body[at:])))
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == expected_lines(rows)
    assert any(r.n_cut for r in got.values()) and all(r.chars_cut >= 0 for r in got.values())


def test_line_dedup_compares_bytes_where_keys_clash(spark):
    rng = random.Random(7)
    pool = [text(rng, vocabulary(), 2) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(12))) for i in range(30)]
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, rows), line_key=lambda x: F.length(x).cast("long")).collect()}
    assert got == expected_lines(rows)


def test_line_dedup_finds_planted_passages(spark):
    """Passages of any number of lines, each in two otherwise different texts: the later copy goes, and nothing else."""
    rng, rows, planted = random.Random(8), [], {}
    fresh = iter(range(10**6))
    own = lambda n: [f"{next(fresh)} {text(rng, vocabulary(), 5)}" for _ in range(n)]
    for size in (2, 3, 4, 6, 8):
        for _ in range(40):
            passage, at = own(size), rng.randint(0, 10)
            for copy in range(2):
                body = own(10)
                planted[len(rows)] = "\n".join(body) if copy else "\n".join(body[:at] + passage + body[at:])
                rows.append((len(rows), "\n".join(body[:at] + passage + body[at:])))
    got = {r.doc_id: r for r in line_dedup(frame(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == planted
    assert sum(r.lines_cut for r in got.values()) == 40 * (2 + 3 + 4 + 6 + 8)


def test_line_dedup_across_blank_lines(spark):
    rows = [(1, "one a\n\n\ntwo b\nend x"), (2, "start y\none a\n\n\ntwo b"), (3, "one a\n\ntwo b"), (4, "two b\nzzz"), (None, "one a\n\n\ntwo b\nlast")]
    got = {r.doc_id: r.text for r in line_dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "start y", 3: rows[2][1], 4: rows[3][1], None: "last"}


def test_line_dedup_of_very_many_lines(spark):
    rng = random.Random(6)
    body = "\n".join(rng.choice(["alpha beta", "gamma", "", "delta x", f"line {i}"]) for i in range(120_000))
    got = {r.doc_id: r for r in line_dedup(frame(spark, [(1, body), (2, body)])).collect()}
    assert {i: r.text for i, r in got.items()} == expected_lines([(1, body), (2, body)])


def test_line_dedup_awkward(spark):
    df = frame(spark, awkward()).repartition(3)
    got = line_dedup(df).collect()
    assert len(got) == len(awkward()) and all(r.n_cut == 0 for r in got)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in awkward())
    assert line_dedup(df.limit(0)).count() == 0


def expected_windows(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in first and (i is None or first[key] < i):
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [1 << 20, 2000])
def test_substring_dedup(spark, group_bytes):
    rng = random.Random(7)
    vocab = vocabulary(50)
    shared = text(rng, vocab, 30)
    rows = awkward()[:-1] + [(None, shared)]
    for i in range(100):
        t = text(rng, vocab, rng.randint(0, 25))
        rows.append((200 - i, f"{t} {shared}\n{t}" if i % 4 == 0 else t + " " + " ".join(shared.split()[: rng.randint(0, 30)])))
    got = substring_dedup(frame(spark, rows), width=8, group_bytes=group_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == expected_windows(rows, 8)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_substring_dedup_of_nothing_and_long(spark):
    assert substring_dedup(frame(spark, [(1, "x")]).limit(0)).count() == 0
    long = "a b c d e f g h i j " * 20_000
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, [(1, long), (2, long)])).collect()}
    assert got == {1: 0, 2: 200_000}


def expected_groups(rows, percent):
    sets = {i: shingle_set(t, 5) if words_of(t) else set() for i, t in rows}
    label = {i: i for i in sets}
    ids = list(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("group_bytes", "block_members"), [(1 << 20, 256), (3000, 4)])
def test_jaccard_groups(spark, group_bytes, block_members):
    rng = random.Random(11)
    vocab = vocabulary()
    rows, i = [(9000, None), (9001, ""), (9002, "a b"), (9003, "A B"), (9004, "a b c d e f"), (9005, "a b c d e f g")], 0
    for _ in range(25):  # families whose members differ from their base by a few words, around the threshold
        base = text(rng, vocab, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i * 37 % 1009, " ".join(copy).title() if rng.random() < 0.2 else " ".join(copy)))
            i += 1
    got = jaccard_groups(frame(spark, rows), group_bytes=group_bytes, block_members=block_members).collect()
    want = expected_groups(rows, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows) and len({c for _, c in want.values()}) < len(rows) - 20


def test_jaccard_awkward(spark):
    got = jaccard_groups(frame(spark, awkward())).collect()
    assert len(got) == len(awkward())
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[4] == {(1, 4)} and by[5] == {(1, 4)} and by[7] == {(1, 7)}
    assert jaccard_groups(frame(spark, awkward()).limit(0)).count() == 0


@pytest.mark.parametrize("group_bytes,block_members", [(1 << 20, 256), (4000, 8)])
def test_jaccard_links_are_all_pairs(spark, group_bytes, block_members):
    rng, vocab, rows = random.Random(23), vocabulary(), []
    for base in range(3):
        words = text(rng, vocab, 90).split()
        for v in range(14):
            changed = list(words)
            changed[rng.randrange(len(words))] = f"variant{base}x{v}"
            rows += [(100 * base + 3 * v + c, " ".join(changed)) for c in range(1 + v % 3)]
    rows += [(900 + i, text(rng, vocab, rng.randint(1, 60))) for i in range(20)] + [(990, None), (991, ""), (None, rows[0][1]), (0, rows[0][1])]
    pairs, counted = jaccard_links(frame(spark, rows), group_bytes=group_bytes, block_members=block_members)
    sets = {i: shingle_set(t, 5) if t else set() for i, t in rows if i is not None}
    like = {(i, j) for i in sets for j in sets if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    got = counted.collect()
    named = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == {(named[i], named[j]) for i, j in like if named[i] < named[j]}
    assert len(got) == len(rows) and all(r.n_links == (sum(i == r.doc_id for i, _ in like) if r.doc_id is not None else 1 + sum(i == 0 for i, _ in like)) for r in got)
    assert len(found) > 3 * 14


def test_links_inside_each_block_are_found():
    words = [f"w{i}" for i in range(60)]
    for block in (0, 1):
        cell = pa.table({"b": [1, 2], "__comp": [1, 2], "__mine": [block, block], "__text": [" ".join(words), " ".join(words[1:])]})
        assert across(cell, 5, 80) == [(1, 2)]


def twins():
    """Two words of 1,024 letters that any sum of letters times powers modulo 2**64 takes for one."""
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    u, v = twins()
    tail = " ".join(f"x{i}" for i in range(60))
    rows = [(1, f"{u} {tail}"), (2, f"{v} {tail}"), (3, f"{u} y"), (4, f"{v} y"), (5, f"{u} {v} {u} {v} {u}"), (6, f"{v} {u} {v} {u} {v}")]
    got = substring_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == expected_windows(rows, 50)
    groups = jaccard_groups(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in groups} == expected_groups(rows, 80)


def test_windows_with_one_hash_are_told_apart(spark, monkeypatch):
    """Whatever the hashes say, only equal words are removed."""
    import blipstream.llm.substring_dedup as module

    rng, vocab = random.Random(41), vocabulary(30)
    rows = [(i, text(rng, vocab, 20)) for i in range(12)] + [(50, text(random.Random(41), vocab, 20))]
    windows = module.Windows(pa.table({"__id": [i for i, _ in rows], "__text": [t for _, t in rows]}), 8)
    windows.hashes[:] = 7
    pick, _, one, two, _, place = windows.exact([True] * len(windows.hashes), 1)
    distinct = {tuple(t.split()[k : k + 8]) for _, t in rows for k in range(13)}
    assert len(pick) == 13 * 13 and len(one) == len(distinct) == len(set(zip(one.tolist(), two.tolist(), strict=True))) and place.max() + 1 == len(one)


def test_repeated_and_null_ids_in_the_join(spark):
    rng, vocab = random.Random(43), vocabulary()
    base = text(rng, vocab, 80)
    other = text(rng, vocab, 80)
    rows = [(1, base), (None, base + " more"), (None, None), (None, other + " end"), (7, base + " more"), (7, other), (9, other + " tail"), (7, other), (8, "a a a a a"), (6, "a a a a a a a")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(frame(spark, rows)).collect()), key=str)
    n = {t: len(shingle_set(t, 5)) for _, t in rows if t}
    assert got == sorted([(1, n[base], 1), (None, n[base + " more"], 1), (None, 0, None), (None, n[other + " end"], None), (7, n[base + " more"], 1), (7, n[other], 1), (7, n[other], 1), (9, n[other + " tail"], 1), (8, 1, 6), (6, 1, 6)], key=str)
