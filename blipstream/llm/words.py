"""Words of Arrow text columns as NumPy arrays: positions, hashes and Rabin-Karp hashes of word windows."""

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multiplier modulo 2**64 of window hashes (so it has an inverse there).
BASE = 0xD6E8FEB86659FD93
#: Words of more bytes are hashed by BLAKE2b one by one: there are few of them.
LONG_WORD = 64
#: LOW[n] keeps the n low bytes of eight.
LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Bytes handled at once, which bounds the temporary arrays.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(size, b, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below size; kept for a few rounded-up sizes."""
    up, down = _powers(base, max(1 << 16, 1 << (max(size, 1) - 1).bit_length()))
    return up[:size], down[:size]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row boundaries in them; null counts as empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = pa.concat_arrays(array.chunks) if isinstance(array, pa.ChunkedArray) else array
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def lane_hashes(part: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings in part: eight bytes at a time, each mixed before the next enters.

    For strings of one length up to eight bytes the hash is one to one; beyond, no sum of powers is left in
    which different strings could cancel out, whatever they look like.
    """
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[: len(part)] = part
    eight = np.ndarray(len(part) + 1, "<u8", padded, strides=(1,))
    out = mix((size.astype(np.uint64) * np.uint64(BASE)) ^ (eight[start] & LOW[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        more = more[size[more] > at]
        if not len(more):
            break
        out[more] = mix((out[more] * np.uint64(BASE)) ^ (eight[start[more] + at] & LOW[np.minimum(size[more] - at, 8)]))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = int.from_bytes(blake2b(part[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return out


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many words each row has."""
    hashes, counts, row, n = [], np.zeros(len(bounds) - 1, np.int64), 0, len(bounds) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP, "right")) - 1)
        lo, hi = int(bounds[row]), int(bounds[end])
        part, cuts = data[lo:hi], bounds[row : end + 1] - lo
        if hi > lo:
            part = LOWER[part] if lower else part
            start, stop = word_edges(part, cuts)
            hashes.append(lane_hashes(part, start, stop - start))
            counts[row:end] = np.diff(np.searchsorted(start, cuts))
        row = end
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def word_edges(part: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of some bytes; words also end where rows do (cuts)."""
    space = SPACE[part]
    before, after = np.empty(len(part), bool), np.empty(len(part), bool)
    before[0], before[1:] = True, space[:-1]
    before[cuts[:-1][cuts[:-1] < len(part)]] = True
    after[-1], after[:-1] = True, space[1:]
    after[cuts[1:][cuts[1:] > 0] - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, mixed word by word; runs may cross rows, callers pick those that don't."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n]
    for k in range(1, width):
        out = mix((out * np.uint64(BASE)) ^ words[k : n + k])
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``width`` words; runs may cross rows, callers pick those that don't."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(BASE, len(words))
    total = np.cumsum(words * up, dtype=np.uint64)
    n = len(words) - width + 1
    ahead = np.concatenate([np.zeros(1, np.uint64), total[: n - 1]])
    return mix((total[width - 1 :] - ahead) * down[:n])


def window_rows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the windows that lie inside one row, and their rows."""
    rows = np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    own = np.maximum(counts - width + 1, 0)
    within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    return first[rows] + within, rows


class Joined:
    """The words of some texts joined by one space each, and where each word starts in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        starts, sizes, pieces = [], [], []
        row, n, done = 0, len(bounds) - 1, 0
        while row < n:
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP, "right")) - 1)
            lo, hi = int(bounds[row]), int(bounds[end])
            if hi > lo:
                part = data[lo:hi]
                start, stop = word_edges(part, bounds[row : end + 1] - lo)
                size = stop - start
                at = np.concatenate([[0], np.cumsum(size + 1)])
                out = np.full(int(at[-1]), 0x20, np.uint8)
                letters = np.flatnonzero(~SPACE[part])
                out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = part[letters]
                starts.append(at[:-1] + done)
                pieces.append(out)
                done += len(out)
            row = end
        self.bytes = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
        self.start = np.concatenate([*starts, [done]]) if starts else np.zeros(1, np.int64)

    def digests(self, first: np.ndarray, width: int) -> np.ndarray:
        """BLAKE2b-128 of the ``width`` words from each first word, as pairs of integers."""
        view, out = memoryview(self.bytes), np.empty((len(first), 2), np.uint64)
        for at in range(0, len(first), 1 << 16):
            some = first[at : at + (1 << 16)]
            cuts = zip(self.start[some].tolist(), (self.start[some + width] - 1).tolist(), strict=True)
            out[at : at + len(some)] = np.frombuffer(b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in cuts]), "<u8").reshape(-1, 2)
        return out
