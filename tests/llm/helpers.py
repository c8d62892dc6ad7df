"""Small tables with every awkward case, and plain restatements to hold results against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_cut long, score double, size long, kept boolean, __x int"


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source); extra columns clash with names that operators add."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 0.5, 1, False, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def text(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def awkward():
    return [(None, None), (None, "lone words"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (6, "é 日本 \x0b x"), (7, "word " * 30_000)]
