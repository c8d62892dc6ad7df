"""Packed fingerprint exchange: rows meet in groups, fingerprints of groups meet in buckets, answers return.

A plain shuffle of one row per fingerprint would cost tens of bytes each, several times the text. Here each group
of rows sends one sorted binary block per bucket, a bucket answers each block with one small value per entry, and
groups read the answers in the order they asked. A fingerprint that a third of all rows share is sent once per
group, so no bucket grows with a hot key. Buckets follow from the volume of fingerprints alone and are many times
larger than groups, so a block keeps hundreds of entries up to some terabytes; beyond, both sizes should grow with
the executors' memory.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "bucket int, grp int, data binary"
ANSWERS = "grp int, bucket int, data binary"


def grouped(df: DataFrame, id_col: str, text_col: str, group_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(__grp, __id, __text) in groups of about group_bytes of text, dealt by hashed id and text; the number of groups, and that of buckets: one for the fingerprints of each bucket_bytes of text."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    keyed = df.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(groups)).cast("int").alias("__grp"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return keyed, groups, max(1, -(-size // bucket_bytes))


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high 32 bits (from the hash's high bits), the hash's low 32 bits below."""
    high, low = hashes >> np.uint64(32), hashes & np.uint64(0xFFFFFFFF)
    return ((high * np.uint64(buckets)) >> np.uint64(32)) << np.uint64(32) | low


def slices(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket in sorted keys."""
    buckets = (keys >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    starts = np.concatenate([[0], cuts]) if len(keys) else np.zeros(0, np.int64)
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(starts, [*cuts, len(keys)], strict=False)]


def blocks(grp: int, keys: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.Table:
    """One row per bucket; pack gives the bytes of entries from..to."""
    found = slices(keys)
    return pa.table(
        {
            "bucket": pa.array([k for k, _, _ in found], pa.int32()),
            "grp": pa.array([grp] * len(found), pa.int32()),
            "data": pa.array([pack(a, b) for _, a, b in found], pa.binary()),
        }
    )


def answer(blocks_: DataFrame, solve: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """solve gets the blocks of one bucket in group order and answers each."""

    def reduce(table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")
        out = solve(table["data"].to_pylist())
        return pa.table({"grp": table["grp"], "bucket": table["bucket"], "data": pa.array(out, pa.binary())})

    return blocks_.groupBy("bucket").applyInArrow(reduce, ANSWERS)


def answered(table: pa.Table) -> np.ndarray:
    """A group's answers, one byte per entry, in the order of its sorted keys."""
    return np.frombuffer(b"".join(table.sort_by("bucket")["data"].to_pylist()), np.uint8)


def holders(data: list[bytes]) -> list[bytes]:
    """For blocks of sorted unique 32-bit keys: in how many blocks each key is (255: that many or more)."""
    parts = [np.frombuffer(x, "<u4") for x in data]
    keys, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    found = np.minimum(counts, 255).astype(np.uint8)[inverse]
    return [x.tobytes() for x in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]


def key_of(key: tuple) -> int:
    return int(key[0].as_py() if hasattr(key[0], "as_py") else key[0])
