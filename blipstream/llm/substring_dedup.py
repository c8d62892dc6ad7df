"""Substring deduplication over fixed-length word windows."""

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import BLOCKS, answer, answered, blocks, bucket_keys, grouped, holders, key_of
from .words import Joined, text_bytes, window_hashes, window_rows, word_hashes

NO_ID = np.int64((1 << 63) - 1)


def planes(ids: np.ndarray) -> bytes:
    """Byte planes of 64-bit ids: the planes of small ids are zeros, which the shuffle's compression removes."""
    return ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Windows:
    """The windows of one group of rows: Rabin-Karp hashes, rows, ids, and each distinct window's smallest id."""

    def __init__(self, table: pa.Table, width: int):
        self.width = width
        self.data, self.bounds = text_bytes(table["__text"])
        words, self.counts = word_hashes(self.data, self.bounds)
        self.at, self.rows = window_rows(self.counts, width)
        self.ids = table["__id"].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()
        self.hashes = window_hashes(words, width)[self.at]

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """First exchange: distinct bucket keys of the windows, and each window's place in them."""
        return np.unique(bucket_keys(self.hashes, buckets), return_inverse=True)

    def exact(self, repeated: np.ndarray, buckets: int):
        """Of the windows marked: indices, digests of their distinct words (sorted by bucket key) with the smallest id, and each one's place."""
        pick = np.flatnonzero(repeated)
        one, two = Joined(self.data, self.bounds).digests(self.at[pick], self.width).T
        keys = bucket_keys(one, buckets)
        order = np.lexsort((two, one, keys))
        new = np.ones(len(pick), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        place = np.empty(len(pick), np.int64)
        place[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), NO_ID)
        np.minimum.at(least, place, self.ids[self.rows[pick]])
        firsts = order[new]
        return pick, keys[firsts], one[firsts], two[firsts], least, place


def smaller_elsewhere(data: list[bytes]) -> list[bytes]:
    """For blocks of (digest, id): whether another block has the digest with a smaller id."""
    parts = []
    for x in data:
        n = len(x) // 24
        parts.append((np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u8", n, 8 * n), from_planes(x[16 * n :])))
    one, two, ids = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.lexsort((ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    least = ids[order][new][np.cumsum(new) - 1]
    found = np.empty(len(order), np.uint8)
    found[order] = ids[order] > least
    return [x.tobytes() for x in np.split(found, np.cumsum([len(p[0]) for p in parts])[:-1])]


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, group_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: id, kept_text (kept words joined by one space), n_words, n_removed, spans.

    A word goes if some window of ``width`` words around it also starts in a row with a smaller id; spans
    are the maximal removed intervals as word positions, end exclusive. Rabin-Karp hashes of every window
    are counted in two exchanges: 32 bits and a bucket tell which windows can be in more than one group
    of rows, then the words of those and of the ones repeated inside a group are compared by their BLAKE2b-128
    digests with the smallest id, so windows whose hashes collide stay apart.

    Null text has no words. Rows with null ids lose words to rows with ids, never the other way round, and
    none to each other; neither do repeated rows of one id. Texts shorter than a window keep all words.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows, _, buckets = grouped(df, id_col, text_col, group_bytes, bucket_bytes)
    by_group = rows.groupBy("__grp")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        keys, _ = Windows(table, width).keys(buckets)
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return blocks(key_of(key), keys, lambda a, b: low[a:b].tobytes())

    def repeated(windows: Windows, table: pa.Table) -> np.ndarray:
        keys, place = windows.keys(buckets)
        more = answered(table) > 1 if len(keys) else np.zeros(0, bool)
        return (more | (np.bincount(place, minlength=len(keys)) > 1))[place]

    def ask_exactly(key: tuple, table: pa.Table, counts: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        _, keys, one, two, least, _ = windows.exact(repeated(windows, counts), buckets)
        return blocks(key_of(key), keys, lambda a, b: one[a:b].astype("<u8").tobytes() + two[a:b].astype("<u8").tobytes() + planes(least[a:b]))

    counted = answer(by_group.applyInArrow(ask, BLOCKS), holders)
    exact_blocks = by_group.cogroup(counted.groupBy("grp")).applyInArrow(ask_exactly, BLOCKS)
    # Both kinds of answers return in one table, told apart by the sign of the bucket.
    both = counted.unionByName(answer(exact_blocks, smaller_elsewhere).selectExpr("grp", "-1 - bucket as bucket", "data"))

    def cut(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        windows = Windows(table, width)
        bucket = replies["bucket"].to_numpy()
        first, second = replies.filter(pa.array(bucket >= 0)), replies.filter(pa.array(bucket < 0))
        pick, keys, _, _, least, place = windows.exact(repeated(windows, first), buckets)
        # Second answers come with descending sign-flipped buckets: undo that before reading them in order.
        second = second.set_column(second.schema.get_field_index("bucket"), "bucket", pa.array(-1 - second["bucket"].to_numpy(), pa.int32()))
        elsewhere = answered(second).astype(bool) if len(keys) else np.zeros(0, bool)
        gone = pick[(windows.ids[windows.rows[pick]] > least[place]) | elsewhere[place]]
        cover = np.zeros(int(windows.counts.sum()) + 1, np.int64)
        np.add.at(cover, windows.at[gone], 1)
        np.add.at(cover, windows.at[gone] + width, -1)
        removed = np.cumsum(cover[:-1]) > 0
        ends = np.cumsum(windows.counts)
        texts, spans, lost = [], [], []
        for row, (hi, n) in enumerate(zip(ends, windows.counts, strict=True)):
            words = windows.data[windows.bounds[row] : windows.bounds[row + 1]].tobytes().split()
            out = removed[hi - n : hi]
            lost.append(int(out.sum()))
            if lost[-1]:
                words = compress(words, (~out).tolist())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            else:
                spans.append([])
            texts.append(b" ".join(words))
        return pa.table(
            {
                "__id": table["__id"],
                "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
                "n_words": pa.array(windows.counts, pa.int64()),
                "n_removed": pa.array(lost, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            }
        )

    kind = df.schema[id_col].dataType.simpleString()
    done = by_group.cogroup(both.groupBy("grp")).applyInArrow(cut, f"__id {kind}, kept_text string, n_words long, n_removed long, spans array<struct<start:int,end:int>>")
    return done.withColumnRenamed("__id", id_col)
