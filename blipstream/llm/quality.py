"""Quality scores: a generalised additive model with pairwise interactions, learned by cyclic boosting of shallow trees into lookup tables."""

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches
from .words import shingle_hashes, text_bytes, word_hashes

#: Kinds of bytes: those of each string, then all else (kind 0, of which bytes over 127 are kind 1).
KINDS = ["", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\v\f\r", "\n", "!?", ".,;:", "'\"()-", "#$%&*", "|", "<>{}[]/\\_=+@^~`"]
KIND = np.zeros(256, np.uint8)
KIND[128:] = 1
for _k, _of in enumerate(KINDS):
    KIND[list(_of.encode())] = _k
NAMES = [
    "log_bytes", "log_words", "bytes_a_word", "distinct_words", "repeats_of_last_word", "longest_run", "distinct_pairs", "no_kind", "non_ascii", "upper", "lower", "digits", "blanks", "line_ends", "calls", "stops", "quotes",
    "symbols", "bars", "marks",
]
#: Bytes of texts whose words are arrays at once; one longer text is such a part of its own.
PART = 1 << 22
#: Bytes counted at once.
STEP = 1 << 20


def distinct_in_rows(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many different values each of n rows has."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return np.bincount(rows[new], minlength=n)


def part_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n, sizes = len(bounds) - 1, np.diff(bounds)
    kinds = np.zeros(n * len(KINDS), np.int64)
    for at in range(0, len(data), STEP):
        some = data[at : at + STEP]
        row = np.repeat(np.arange(n), np.diff(np.clip(bounds, at, at + len(some))))
        kinds += np.bincount(row * len(KINDS) + KIND[some], minlength=len(kinds))
    kinds = kinds.reshape(n, len(KINDS))
    words, counts = word_hashes(data, bounds)
    of = np.repeat(np.arange(n), counts)
    pairs = shingle_hashes(words, 2)
    inside = of[1:] == of[:-1]
    same = inside & (words[1:] == words[:-1])
    last, run = np.bincount(of[1:][same], minlength=n), np.zeros(n)
    starts = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(np.int8)) == 1)
    ends = np.flatnonzero(np.diff(np.concatenate([same, [False]]).astype(np.int8)) == -1)
    np.maximum.at(run, of[1:][starts], np.log2(2 + ends - starts))
    total, twos = np.maximum(counts, 1), np.maximum(counts - 1, 1)
    letters = sizes - kinds[:, 5] - kinds[:, 6]
    columns = [np.log2(1 + sizes), np.log2(1 + counts), letters / total, distinct_in_rows(words, of, n) / total, last / twos, run, distinct_in_rows(pairs[inside], of[1:][inside], n) / twos]
    return np.column_stack([*columns, kinds / np.maximum(sizes, 1)[:, None]])


def features(column: pa.Array) -> np.ndarray:
    """(rows, features) of whole texts, named by NAMES: sizes, repetition of words and word pairs, shares of kinds of bytes. Null is empty, and all features of an empty text are 0."""
    data, bounds = text_bytes(column)
    out, row, n = [np.zeros((0, len(NAMES)))], 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PART, "right")) - 1)
        out.append(part_features(data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]))
        row = end
    return np.concatenate(out)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(column: pa.Array) -> pa.Array:
    made = features(column)
    return pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * len(NAMES), made.reshape(-1))


@dataclass(frozen=True)
class Boosting:
    """bins and pair_bins: of a feature alone and in a pair; pairs: interactions kept; rounds and pair_rounds: cycles over all features, then over all pairs."""

    bins: int = 32
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    shrink: float = 1.0
    min_leaf: int = 5


@dataclass
class Additive:
    """Log-odds as a bias, a table for each feature and a table for each chosen pair of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        if self.pairs:
            cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[cells[a], cells[b]]
        return sigmoid(total)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between at most ``bins`` bins of about as many rows each; a value on an edge is above it."""
    found = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) if len(x) else np.zeros(0)
    return found[found > x.min()] if len(found) else found


def one_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, lo: int, hi: int, how: Boosting) -> int | None:
    """The place that best cuts bins lo to hi in two by what a Newton step gains; None if nothing is gained."""
    left = [np.cumsum(v[lo:hi])[:-1] for v in (g, h, n)]
    right = [v[lo:hi].sum() - c for v, c in zip((g, h, n), left, strict=True)]
    gain = left[0] ** 2 / (left[1] + how.shrink) + right[0] ** 2 / (right[1] + how.shrink)
    gain[(left[2] < how.min_leaf) | (right[2] < how.min_leaf)] = -1.0
    if not len(gain) or gain.max() <= g[lo:hi].sum() ** 2 / (h[lo:hi].sum() + how.shrink) + 1e-12:
        return None
    return lo + 1 + int(gain.argmax())


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, how: Boosting) -> np.ndarray:
    """Steps of each bin by a tree of two levels over the order of the bins."""
    middle = one_cut(g, h, n, 0, len(g), how)
    out = np.zeros(len(g))
    if middle is None:
        return out
    for lo, hi in ((0, middle), (middle, len(g))):
        inner = one_cut(g, h, n, lo, hi, how)
        for a, b in ((lo, hi),) if inner is None else ((lo, inner), (inner, hi)):
            out[a:b] = how.rate * g[a:b].sum() / (h[a:b].sum() + how.shrink)
    return out


def best_cross(g: np.ndarray, h: np.ndarray, n: np.ndarray, how: Boosting) -> tuple[float, tuple[int, int] | None]:
    """The cross of one cut a feature that gains most over no cut, by cumulative sums of the cells."""
    if min(g.shape) < 2:
        return 0.0, None

    def quarters(v):
        c = v.cumsum(0).cumsum(1)
        low, rows, cols = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return np.stack([low, rows - low, cols - low, c[-1, -1] - rows - cols + low])

    qg, qh, qn = quarters(g), quarters(h), quarters(n)
    gain = (qg**2 / (qh + how.shrink)).sum(0) - g.sum() ** 2 / (h.sum() + how.shrink)
    gain[(qn < how.min_leaf).any(0)] = 0.0
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[at]), (int(at[0]) + 1, int(at[1]) + 1) if gain[at] > 1e-12 else None


def fit(x: np.ndarray, y: np.ndarray, how: Boosting = Boosting()) -> Additive:
    """Cyclic boosting: in each round every feature's residuals are binned and one shallow tree is added to its table; then the same with the pairs that gain most on what is left."""
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    order = np.lexsort((y, *x.T))  # sums don't depend on the order in which rows came
    x, y = x[order], y[order].astype(float)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [cuts(x[:, j], how.bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    counts = [np.bincount(b, minlength=len(e) + 1) for b, e in zip(at, edges, strict=True)]
    tables, total = [np.zeros(len(e) + 1) for e in edges], np.full(len(y), bias)
    for _ in range(how.rounds):
        for j, b in enumerate(at):
            p = sigmoid(total)
            step = shallow_tree(np.bincount(b, y - p, len(counts[j])), np.bincount(b, p * (1 - p), len(counts[j])), counts[j], how)
            tables[j] += step
            total += step[b]
    pair_edges = [cuts(x[:, j], how.pair_bins) for j in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(pair_edges)]

    def grids(a: int, b: int) -> list[np.ndarray]:
        p, shape = sigmoid(total), (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        both = cells[a] * shape[1] + cells[b]
        return [np.bincount(both, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p), np.ones(len(y)))]

    gains = {(a, b): best_cross(*grids(a, b), how)[0] for a, b in combinations(range(x.shape[1]), 2)}
    chosen = sorted(k for k in sorted(gains, key=lambda k: (-gains[k], k))[: how.pairs] if gains[k] > 0)
    pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in chosen]
    for _ in range(how.pair_rounds):
        for k, (a, b) in enumerate(chosen):
            g, h, n = grids(a, b)
            _, cross = best_cross(g, h, n, how)
            if cross is None:
                continue
            step = np.zeros(g.shape)
            for rows in (slice(0, cross[0]), slice(cross[0], None)):
                for cols in (slice(0, cross[1]), slice(cross[1], None)):
                    step[rows, cols] = how.rate * g[rows, cols].sum() / (h[rows, cols].sum() + how.shrink)
            pair_tables[k] += step
            total += step[cells[a], cells[b]]
    return Additive(bias, edges, tables, pair_edges, chosen, pair_tables)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(__label, __features) of at most ``most`` labelled rows that aren't held out, the first by hashed id."""
    usable_labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    first = F.xxhash64("__id"), "__id", "__label"
    taught = usable_labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct().orderBy(*first).limit(most)  # most bounds what is broadcast
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(taught), "__id")
    made = rows.select("__id", "__label", text_features("__text").alias("__features")).distinct()  # an id may be on many rows: they are bounded too
    return made.orderBy(*first, "__features").limit(most).select("__label", "__features")


def quality_scorer(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_train_rows: int = 20_000,
    how: Boosting = Boosting(),
) -> Callable[[Column], Column]:
    """Trains on the labelled rows of df and gives the function of a text column that scores it; see score_quality."""
    bound_batches(df.sparkSession)
    # At most most_train_rows rows of a few numbers reach the driver.
    rows = train_rows(df, labels, id_col, text_col, label_col, most_train_rows).collect()
    model = fit(np.array([r["__features"] for r in rows], float).reshape(len(rows), len(NAMES)), np.array([r["__label"] for r in rows], float), how)

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(features(column)), pa.float64())

    return scored


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7, **training) -> DataFrame:
    """df with held_out, score and predicted added (columns of those names are replaced).

    Rows whose crc32(id as text) mod 4 is 2 never teach; of the others at most ``most_train_rows`` labelled ones do,
    the first by hashed id. Their features are computed on Spark; the model is learned from these few numbers a row
    on the driver and is itself a few thousand numbers. Only text is scored, whole, 4 MB of texts (or one longer
    text) at once; a text of n words takes some 50 bytes a word meanwhile. ``training`` takes the parameters of
    quality_scorer.

    Null text is scored as empty. Null ids are not held out and never teach; null or other labels are ignored; equal
    rows and equal labels teach once, an id with both labels teaches both. Without labels every score is 0.5. An
    empty table gives an empty result. Other columns pass through, whatever their names.
    """
    score = quality_scorer(df, labels, id_col, text_col, label_col, **training)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("held_out", "score", "predicted")]
    out = df.select(*kept, score(F.col(text_col)).alias("score"), held_out(F.col(id_col)).alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
