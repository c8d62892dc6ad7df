"""Byte-level BPE: greedy longest match, vectorised check of adjacent pairs, exact merging of what fails."""

import json
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import bound_batches

#: Splits text into words before any merge; white space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and pairs that a task keeps; beyond that it starts anew, which costs time only.
KEPT_WORDS, KEPT_PAIRS = 250_000, 250_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        text_id = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([text_id[a + b] for a, b in pairs], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        #: Length of the longest token for each first two bytes.
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        self.size = max(self.bytes_of) + 1
        codes = np.array([text_id[a] * self.size + text_id[b] for a, b in pairs], np.int64)
        self.merge_ranks = np.argsort(codes, kind="stable")
        self.merge_codes = codes[self.merge_ranks]
        self.of_byte = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        # A token is proposed only if its own bytes merge to it.
        self.own = {b: self.id_of[b] for b, ids in zip(self.id_of, self.merge(list(self.id_of)), strict=True) if ids == [self.id_of[b]]}
        self.forget()
        self.forget_pairs()
        self.lengths = np.zeros(self.size, np.int64)
        for i, b in self.bytes_of.items():
            self.lengths[i] = len(b)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.size)), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left * self.size + right
        at = np.minimum(np.searchsorted(self.merge_codes, codes), len(self.merge_codes) - 1)
        return np.where(self.merge_codes[at] == codes, self.merge_ranks[at], NEVER)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: in each round, every word merges its pair of lowest rank, leftmost first."""
        out: list[list[int]] = [[] for _ in words]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), NEVER)
        if len(ids) > 1:
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(ids)]]))
            best = np.minimum.reduceat(rank, starts)
            for k in np.flatnonzero(best == NEVER).tolist():
                out[word[starts[k]]] = ids[starts[k] : starts[k] + lengths[k]].tolist()
            low = np.repeat(best, lengths)
            going = low != NEVER
            ids, word, rank, low = ids[going], word[going], rank[going], low[going]
            chosen = rank == low
            begins = chosen & ~np.concatenate([[False], chosen[:-1]])
            at = np.arange(len(ids))
            chosen &= (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
            hit = np.flatnonzero(chosen)
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            fresh = np.unique(np.concatenate([place[hit], place[hit] - 1]))
            fresh = fresh[fresh >= 0]
            rank[fresh] = NEVER
            fresh = fresh[fresh + 1 < len(ids)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self.ranks(ids[fresh], ids[fresh + 1])
        return out

    def greedy(self, word: bytes) -> list[int]:
        own = self.own.get
        found = own(word)
        if found is not None:
            return [found]
        ids, at, n, longest = [], 0, len(word), self.longest.get
        while at < n:
            end = min(n, at + longest(word[at : at + 2], 1))
            while (found := own(word[at:end])) is None:
                end -= 1
            ids.append(found)
            at = end
        return ids

    def forget(self) -> None:
        """known: the place of a word, or of an added token's id, in kept, which has all their ids in a row from first[place] on."""
        self.known: dict[str | int, int] = {}
        self.kept, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.keep(list(self.added.values()), [[i] for i in self.added.values()])

    def forget_pairs(self) -> None:
        self.pairs: dict[int, bool] = {}

    def keep(self, words: list, ids: list[list[int]]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        self.kept = np.concatenate([self.kept, np.array(list(chain.from_iterable(ids)), "<u4")])

    def encode_words(self, texts: list[str]) -> None:
        """Keeps the ids of new words. A split is what merging gives iff each adjacent pair alone merges to itself."""
        words = [t.encode() for t in texts]
        proposed = list(map(self.greedy, words))
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        left = np.flatnonzero(inner)
        codes = flat[left] * self.size + flat[left + 1]
        distinct, place = np.unique(codes, return_inverse=True)
        new = [c for c in distinct.tolist() if c not in self.pairs]
        tokens = [divmod(c, self.size) for c in new]
        merged = self.merge([self.bytes_of[a] + self.bytes_of[b] for a, b in tokens])
        self.pairs.update((c, ids == [a, b]) for c, (a, b), ids in zip(new, tokens, merged, strict=True))
        fits = np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), bool, len(distinct))
        failing = np.unique(np.searchsorted(ends, left[~fits[place]], "right")).tolist()
        for k, ids in zip(failing, self.merge([words[k] for k in failing]), strict=True):
            proposed[k] = ids
        self.keep(texts, proposed)

    def pieces(self, text: str) -> list:
        """Words; added tokens as their id."""
        if not self.split_added or not any(t in text for t in self.added):
            return self.words.findall(text)
        out: list = []
        for k, part in enumerate(self.split_added.split(text)):
            out += [self.added[part]] if k % 2 else self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        if len(self.pairs) > KEPT_PAIRS:
            self.forget_pairs()
        each = list(map(self.pieces, texts))
        pieces = list(chain.from_iterable(each))
        new = list(set(pieces) - self.known.keys())
        if new:
            self.encode_words(new)
        place = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        first, n = self.first[place], self.first[place + 1] - self.first[place]
        ends = np.cumsum(n)
        ids = self.kept[np.arange(int(n.sum())) + np.repeat(first - (ends - n), n)]
        cuts = np.concatenate([[0], ends])[np.cumsum(list(map(len, each)))]
        return np.split(ids, cuts[:-1])

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        n, first = self.lengths[ids], self.starts[ids]
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        return self.all_bytes[at].tobytes().decode("utf-8", "replace")


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 20) -> DataFrame:
    """One row per input row: id, ids (little-endian unsigned 32-bit), n_tokens, decoded.

    ``path`` names the vocabulary file, which every worker reads where it is installed. Words are split by
    the vocabulary's pattern; strings of added tokens become their ids. For words not seen before, longest
    matches propose tokens; all distinct adjacent pairs are checked at once, and words with a pair that
    merging wouldn't leave as it is are merged exactly. decoded is made from the ids alone.

    Null text counts as empty: no ids, empty decoded. Null ids and repeated rows pass. An empty table gives
    an empty result. Other columns are ignored.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            names = batch.schema.names
            ids, texts = batch.column(names.index(id_col)), batch.column(names.index(text_col)).to_pylist()
            texts = [t or "" for t in texts]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= batch_chars):
                    chars += len(texts[end])
                    end += 1
                encoded = bpe.encode(texts[at:end])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, end - at),
                        pa.array([e.tobytes() for e in encoded], pa.binary()),
                        pa.array([len(e) for e in encoded], pa.int64()),
                        pa.array([bpe.decode(e) for e in encoded], pa.string()),
                    ],
                    [id_col, "ids", "n_tokens", "decoded"],
                )
                at = end
        # The worker goes on to other stages, which need the memory.
        bpe.forget()
        bpe.forget_pairs()

    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string")
