"""Vector code compression: a product quantiser whose nearest entries are found by annular norm pruning."""

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

#: Points of about one norm that are handled at once, and entries that they look at before their intervals are found anew.
GROUP, RING = 256, 16
#: Integers below this are exact as doubles, whatever the order of a sum.
EXACT = 1 << 53


@dataclass(frozen=True)
class Shape:
    """How vectors of ``length`` components become integers and parts; parts are as long as each other, so zeros may follow the last component."""

    length: int
    parts: int = 4
    scale: int = 1024

    @property
    def width(self) -> int:
        return -(-self.length // self.parts)

    def integers(self, vectors: pa.Array) -> np.ndarray:
        """(rows, parts, width) of floor(scale * x), held within what keeps a row's squared distances below 2**61."""
        array = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        flat = array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), self.length)
        most = int((2**59 / max(1, self.length)) ** 0.5)
        out = np.zeros((len(array), self.parts * self.width), np.int64)
        out[:, : self.length] = np.clip(np.floor(flat * float(self.scale)), -most, most)
        return out.reshape(len(array), self.parts, self.width)


class Annuli:
    """The entries of one codebook by norm. A point whose best distance so far is d can only be nearer to entries with norms within d of its own."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.squares = entries, (entries * entries).sum(1)
        self.order = np.argsort(self.squares, kind="stable")
        self.norms = np.sqrt(self.squares[self.order].astype(float))
        self.evaluated = 0

    def best_of(self, points: np.ndarray, squares: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact smallest squared distance of each point to the entries from place lo to hi by norm, and the lowest index that has it."""
        at = np.sort(self.order[lo:hi])
        self.evaluated += len(points) * len(at)
        entries = self.entries[at]
        if 2 * (int(squares.max()) + int(self.squares[at].max())) < EXACT:
            distance = (squares[:, None] + self.squares[at] - 2.0 * (points.astype(float) @ entries.T.astype(float))).astype(np.int64)
        else:
            distance = np.stack([((points - e) ** 2).sum(1) for e in entries], 1)
        first = distance.argmin(1)
        return distance[np.arange(len(points)), first], at[first]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point (ties to the lower one) and its squared distance.

        Points of like norm go together. Each looks at the RING entries nearest to it in norm, and then at ring after
        ring outwards for as long as its interval, found anew by binary search from what is best by then, holds more.
        """
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        squares = (points * points).sum(1)
        by_norm, n = np.argsort(squares, kind="stable"), len(self.order)
        for start in range(0, len(points), GROUP):
            rows = by_norm[start : start + GROUP]
            group, norm = points[rows], np.sqrt(squares[rows].astype(float))
            low = int(np.clip(np.searchsorted(self.norms, norm[len(norm) // 2]) - RING // 2, 0, max(0, n - RING)))
            high = min(n, low + RING)
            best, found = self.best_of(group, squares[rows], low, high)
            while True:
                reach = np.sqrt(best.astype(float))
                reach += 1e-9 * (norm + reach + 1)  # entries on the very edge count, whatever the rounding of roots
                first, end = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
                below, above = np.flatnonzero(first < low), np.flatnonzero(end > high)
                if not len(below) and not len(above):
                    break
                rings = [(below, max(int(first[below].min()), low - RING), low)] if len(below) else []
                rings += [(above, high, min(int(end[above].max()), high + RING))] if len(above) else []
                for some, a, b in rings:
                    d, i = self.best_of(group[some], squares[rows[some]], a, b)
                    nearer = (d < best[some]) | ((d == best[some]) & (i < found[some]))
                    best[some], found[some] = np.where(nearer, d, best[some]), np.where(nearer, i, found[some])
                    low, high = min(low, a), max(high, b)
            index[rows], distance[rows] = found, best
        return index, distance


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """(__id, __label, __vector) of the rows that have a code, and the length of their vectors: the commonest one, the longer on a tie."""
    rows = df.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"), F.col(vector_col).cast("array<double>").alias("__vector")).where(usable(F.col("__vector")))
    length = rows.groupBy(F.size("__vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = length["length"] if length else 0
    return rows.where(F.size("__vector") == length), length


def fit_codebooks(rows: DataFrame, shape: Shape, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook of at most ``entries`` integer entries per part, after ``rounds`` rounds of Lloyd's algorithm from the vectors of the smallest ids.

    A round reads the vectors once. Tasks send a count and sums for each entry they met, so what reaches the
    driver is one row for each part and entry, whatever the input.
    """
    first = rows.where("__id is not null").orderBy("__id", "__vector").limit(entries).select("__vector").collect()
    seeds = shape.integers(pa.array([r[0] for r in first], pa.list_(pa.float64())))
    books = [seeds[:, p].copy() for p in range(shape.parts)]
    if not first:
        return books
    sums = [f"s{i}" for i in range(shape.width)]
    schema = ", ".join(["part int", "entry int", "n long", *(f"{s} long" for s in sums)])
    for _ in range(rounds):

        def count(batches, books=books):
            total = np.zeros((shape.parts, len(books[0]), shape.width + 1), np.int64)
            annuli = [Annuli(b) for b in books]
            for batch in batches:
                points = shape.integers(batch.column(0))
                for p in range(shape.parts):
                    index, _ = annuli[p].nearest(points[:, p])
                    np.add.at(total[p], index, np.concatenate([np.ones((len(index), 1), np.int64), points[:, p]], 1))
            part, entry = np.nonzero(total[:, :, 0])
            met = total[part, entry]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), *(pa.array(met[:, i]) for i in range(shape.width + 1))], ["part", "entry", "n", *sums])

        met = rows.select("__vector").mapInArrow(count, schema).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *sums))).collect()
        books = [b.copy() for b in books]
        for r in met:
            books[r["part"]][r["entry"]] = np.array(r[3:], np.int64) // r["n"]
    return books


def encode(rows: DataFrame, shape: Shape, books: list[np.ndarray]) -> DataFrame:
    """__id, __label, code (two hex digits a part) and error of each row."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("__id", kinds["__id"]), T.StructField("__label", kinds["__label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not len(books[0]):  # no vector has an id, so there are no entries
        return rows.select("__id", "__label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    def coded(batches):
        annuli = [Annuli(b) for b in books]
        for batch in batches:
            points = shape.integers(batch.column(2))
            found = [a.nearest(points[:, p]) for p, a in enumerate(annuli)]
            digits = np.stack([i.astype(np.uint8) for i, _ in found], 1)
            codes = [row.tobytes().hex() for row in digits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["__id", "__label", "code", "error"])

    return rows.select("__id", "__label", "__vector").mapInArrow(coded, schema)


def decode(code: str, shape: Shape, books: list[np.ndarray]) -> list[float]:
    """The vector that a code stands for: the middles of its entries' integer cells."""
    whole = np.concatenate([books[p][i] for p, i in enumerate(bytes.fromhex(code))])[: shape.length]
    return ((whole + 0.5) / shape.scale).tolist()


def digest(books: list[np.ndarray]) -> str:
    return sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """One row per usable vector: id, label, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped, and so are those of another length
    than the commonest one. Components are floor(scale * x); where ``parts`` doesn't divide the length, zeros follow.
    Components so large that a squared distance would exceed a long are held at the largest that doesn't. Each part
    has a codebook of its own, see fit_codebooks; codes have two hex digits a part, so ``entries`` is 256 at most.

    Fewer usable vectors than ``entries`` make a smaller codebook. Null ids get codes but start no entry; if all ids
    are null, code and error are null. Repeated rows each count, and of equal ids the vectors are taken in their own
    order. A label_error beyond a long is null. Other columns are ignored; no usable vectors give no rows.

    The vectors are read rounds + 3 times and never shuffled: memory is a batch of them, the codebooks and one sum an entry.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits a part: 1 to 256 entries")
    rows, length = kept_vectors(df, id_col, vector_col, label_col)
    shape = Shape(length, parts, scale)
    books = fit_codebooks(rows, shape, entries, rounds)
    coded = materialise(encode(rows, shape, books), "vector-codes")
    totals = coded.groupBy(F.col("__label").alias("__of")).agg(F.expr("try_sum(error)").alias("label_error"))
    return coded.join(totals, F.col("__label").eqNullSafe(F.col("__of"))).select(
        F.col("__id").alias(id_col), F.col("__label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
