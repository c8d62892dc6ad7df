"""Toxicity scores from character n-grams: a linear classifier over features scaled by naive Bayes log-count ratios."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches, materialise
from .words import mix

BLOCK_BITS = 12
#: Texts that are Python strings at once while scoring.
SLICE_ROWS = 500
#: Characters (or one longer text) whose n-grams are arrays at once, some 100 bytes a character.
PART_CHARS = 1 << 16


@dataclass(frozen=True)
class Grams:
    sizes: tuple[int, ...] = (4, 5, 6, 7)
    bits: int = 20


def features(texts: list[str], grams: Grams):
    """(feature, row) arrays of all character n-grams of lower-cased texts, one pair of arrays per n; a space stands at both ends."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    rows = np.repeat(np.arange(len(padded), dtype=np.int32), sizes)
    value = np.zeros(len(points), np.uint64)
    done = 0
    for n in sorted(grams.sizes):
        while done < n:
            value = (value[: len(points) - done] * np.uint64(0x9E3779B97F4A7C15)) + points[done:]
            done += 1
        inside = rows[: len(value)] == rows[n - 1 :]
        yield (mix(value[inside] + np.uint64(n)) >> np.uint64(64 - grams.bits)).astype(np.uint32), rows[: len(value)][inside]


def batches_of(texts: list[str], chars: int):
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= chars):
            total += len(texts[end])
            end += 1
        yield at, end
        at = end


def presence(texts: list[str], grams: Grams):
    """Sorted distinct features of each text."""
    for a, b in batches_of(texts, PART_CHARS):
        parts = list(features(texts[a:b], grams))
        keys = np.concatenate([(r.astype(np.uint64) << np.uint64(32)) | f for f, r in parts])
        keys = np.unique(keys)
        yield from np.split((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(keys, np.arange(1, b - a, dtype=np.uint64) << np.uint64(32)))


def train_rows(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(__id, __text, __label) of at most ``most`` rows: the first by hashed id and text that are labelled and whose crc32(id as text) mod 3 is not 1."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    first = F.xxhash64("__id"), "__id", "__label"
    taught = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct().orderBy(*first).limit(most)  # most bounds what is broadcast
    rows = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__hash", F.xxhash64("__text"))
    # An id may be on many rows: what they teach is bounded too, before any text moves.
    chosen = rows.select("__id", "__hash").join(F.broadcast(taught), "__id").distinct().orderBy(*first, "__hash").limit(most)
    return rows.join(F.broadcast(chosen), ["__id", "__hash"]).dropDuplicates(["__id", "__hash", "__label"]).select("__id", "__text", "__label")


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def log_count_ratios(train: DataFrame, grams: Grams, min_rows: int, keep: int) -> dict[int, float]:
    """The ``keep`` features whose log-count ratio is surest; counts of rows per class are summed by block of features."""

    def count(batches):
        both = np.zeros((2, 1 << grams.bits), np.int32)
        for batch in batches:
            names = batch.schema.names
            labels = batch.column(names.index("__label")).to_pylist()
            texts = [t or "" for t in batch.column(names.index("__text")).to_pylist()]
            for label, found in zip(labels, presence(texts, grams), strict=True):
                both[label, found] += 1
        step = 1 << BLOCK_BITS
        used = [k for k in range(1 << (grams.bits - BLOCK_BITS)) if both[:, k * step : (k + 1) * step].any()]
        yield pa.RecordBatch.from_pydict({"block": pa.array(used, pa.int32()), "data": pa.array([both[:, k * step : (k + 1) * step].tobytes() for k in used], pa.binary())})

    n = {r["__label"]: r["count"] for r in train.groupBy("__label").count().collect()}
    p_rows, q_rows = n.get(1, 0) + 2, n.get(0, 0) + 2

    def ratios(table: pa.Table) -> pa.Table:
        both = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table["data"].to_pylist()).reshape(2, -1)
        found = np.flatnonzero(both.sum(0) >= min_rows)
        q, p = both[0, found] + 1.0, both[1, found] + 1.0
        ratio = np.log((p / p_rows) / (q / q_rows))
        sure = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
        return pa.table({"feature": pa.array(found + (table["block"][0].as_py() << BLOCK_BITS), pa.int32()), "ratio": ratio, "sure": sure})

    summed = train.mapInArrow(count, "block int, data binary").groupBy("block").applyInArrow(ratios, "feature int, ratio double, sure double")
    return {r["feature"]: r["ratio"] for r in summed.orderBy(F.desc("sure"), "feature").limit(keep).collect()}


def fit(present: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence by Adam over all rows: weights per feature (ratio included) and bias."""
    col = np.concatenate(present) if present else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(present)), [len(p) for p in present])
    scale = ratio[col]
    w, bias = np.zeros(len(ratio)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v, n = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), max(1, len(labels))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * scale, minlength=len(labels)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.append(np.bincount(col, error[row] * scale, minlength=len(ratio)) / n + penalty * w, error.sum() / n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return w * ratio, float(bias)


def toxicity_scorer(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_train_rows: int = 20_000,
    keep: int = 8192,
    min_rows: int = 5,
    penalty: float = 1e-4,
    steps: int = 200,
    grams: Grams = Grams(),
) -> Callable[[Column], Column]:
    """Trains on the labelled rows of df and gives the function of a text column that scores it; see score_toxicity."""
    if keep > 1 << 16:
        raise ValueError("features are numbered in 16 bits: keep at most 65536")
    bound_batches(df.sparkSession)
    train = materialise(train_rows(df, labels, id_col, text_col, label_col, most_train_rows), "toxicity-train").repartition(16, "__id")
    ratios = log_count_ratios(train, grams, min_rows, keep)
    chosen, ratio = np.array(sorted(ratios), np.int64), np.array([ratios[f] for f in sorted(ratios)])
    slot = np.full(1 << grams.bits, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))

    def pick(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index("__text")).to_pylist()]
            found = [np.sort((s := slot[f])[s >= 0]).astype("<u2").tobytes() for f in presence(texts, grams)]
            yield pa.RecordBatch.from_arrays([batch.column(names.index("__label")), pa.array(found, pa.binary())], ["label", "found"])

    # At most most_train_rows rows of two bytes for each of at most ``keep`` features.
    rows = sorted((bytes(r["found"]), r["label"]) for r in train.mapInArrow(pick, "label int, found binary").collect())
    weights, bias = fit([np.frombuffer(x, "<u2").astype(np.int64) for x, _ in rows], np.array([y for _, y in rows], float), ratio, penalty, steps)
    table = np.zeros(1 << grams.bits, np.float32)
    table[chosen] = weights
    chosen_flag = slot >= 0

    def score(texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), bias)
        for a, b in batches_of(texts, PART_CHARS):
            keys = [(r[hit].astype(np.uint64) << np.uint64(32)) | f[hit] for f, r in features(texts[a:b], grams) for hit in [chosen_flag[f]]]
            keys = np.unique(np.concatenate(keys))
            total[a:b] += np.bincount((keys >> np.uint64(32)).astype(np.int64), table[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)], minlength=b - a)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    @F.arrow_udf(T.DoubleType())
    def scored(column: pa.Array) -> pa.Array:
        parts = [score([t or "" for t in column.slice(at, SLICE_ROWS).to_pylist()]) for at in range(0, len(column), SLICE_ROWS)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return scored


def score_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.7, **training) -> DataFrame:
    """df with held_out, score and predicted added (columns of those names are replaced).

    Rows whose crc32(id as text) mod 3 is 1 never teach; of the others at most ``most_train_rows`` labelled
    ones do, the first by hashed id. Their n-gram counts give log-count ratios on Spark; the ``keep`` surest
    features scale a logistic regression, which is small enough for the driver. Only text is scored. ``training``
    takes the parameters of toxicity_scorer.

    Null text is scored as empty. Null ids are not held out and never teach; null or other labels are ignored;
    equal rows and equal labels teach once, an id with both labels teaches both. Without labels every score is 0.5.
    An empty table gives an empty result. Other columns pass through, whatever their names.
    """
    score = toxicity_scorer(df, labels, id_col, text_col, label_col, **training)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("held_out", "score", "predicted")]
    out = df.select(*kept, score(F.col(text_col)).alias("score"), held_out(F.col(id_col)).alias("held_out"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
