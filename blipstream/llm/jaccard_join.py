"""Exact set similarity join on word shingles: universe partition with a pigeonhole bound."""

from collections.abc import Callable
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .exchange import BLOCKS, answer, answered, blocks, bucket_keys, grouped, holders, key_of
from .shared import bound_batches, materialise
from .words import mix, shingle_hashes, text_bytes, window_rows, word_hashes

#: One segment in so many also takes one-deletion neighbourhoods.
DELETION_EVERY = 32
#: Segments per threshold needed: the more there are, the more of a set's picks avoid what a whole family of texts shares.
SPARE = 2.0


@cache
def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """First set size of each size band, and its number of segments: SPARE times the thresholds that its largest set needs."""
    first = [1]
    while first[-1] <= upto:
        first.append(max(first[-1] + 1, first[-1] * 3 // 2))
    sizes = np.array(first)
    segments = np.ceil(SPARE * (bound(sizes[1:] - 1, percent) + 1)).astype(np.int64) + 2
    return sizes, np.append(segments, 0)


def bound(n: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which a set of n elements and a set at least ``percent`` similar differ."""
    return (100 - percent) * (n + n * 100 // percent) // (100 + percent)


class Sets:
    """The shingle sets of some texts as sorted 64-bit hashes; a text of fewer words than a shingle is one element, and has no hashes."""

    def __init__(self, texts: pa.ChunkedArray, width: int):
        hashes, words = word_hashes(*text_bytes(texts), lower=True)
        at, rows = window_rows(words, width)
        shingles = shingle_hashes(hashes, width)[at]
        cuts = np.searchsorted(rows, np.arange(len(words) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            shingles[a:b].sort()
        new = np.ones(len(shingles), bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (rows[1:] != rows[:-1])
        self.items, self.rows = shingles[new], rows[new]
        self.count = np.bincount(self.rows, minlength=len(words))
        self.start = np.cumsum(self.count) - self.count
        self.size = np.where((words > 0) & (words < width), 1, self.count)


class Signatures:
    """Segment signatures of the sets that can be like a different set.

    A set of n elements uses the scheme of its size band, and that of the next band if a set there can be
    like it; two like sets share the scheme of the larger. Signature = the segment's content; segments of
    deletion kind add the content less one element, for each element.
    """

    def __init__(self, sets: Sets, percent: int, named: np.ndarray):
        """named: which sets are nodes; the others get no signatures."""
        n = sets.count
        first, segments = bands(percent, int(max(n.max(initial=1), 1)) * 2)
        able = np.flatnonzero(named & (n > 0))
        band = np.searchsorted(first, n[able], "right") - 1
        up = able[n[able] * 100 // percent >= first[band + 1]]
        self.row = np.concatenate([able, up])
        scheme = np.concatenate([band, np.searchsorted(first, n[up], "right")])
        self.need = bound(n[self.row], percent) + 1
        self.m = segments[scheme]
        self.base = np.cumsum(self.m) - self.m
        total = int(self.m.sum())
        self.item = np.repeat(np.arange(len(self.row)), self.m)
        segment = np.arange(total) - self.base[self.item]
        count = n[self.row]
        owner = np.repeat(np.arange(len(self.row)), count)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(sets.start[self.row], count)
        element = sets.items[pos]
        slot = self.base[owner] + (((element >> np.uint64(32)) * self.m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        value = mix(element)
        content = np.zeros(total, np.uint64)
        if len(slot):
            cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
            content[slot[cut]] = np.add.reduceat(value, cut)
        place = mix(scheme[self.item].astype(np.uint64) << np.uint64(40) | segment.astype(np.uint64))
        less = np.flatnonzero(segment[slot] % DELETION_EVERY == 0)
        self.del_slot = slot[less]
        self.sig = np.concatenate([mix(content ^ place), mix((content[self.del_slot] - value[less]) ^ place[self.del_slot])])
        self.deletion = segment % DELETION_EVERY == 0
        self.total = total

    def probes(self, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per signature: probe, index. cost: how many others have the signature.

        A set picks the cheapest segments until thresholds (one for content, two with deletions) exceed
        its bound; a like set then shares one pick. A set whose picks nobody shares is like no other.
        """
        base = cost[: self.total]
        extra = np.bincount(self.del_slot, cost[self.total :], minlength=self.total)[self.deletion]
        slots = np.concatenate([np.arange(self.total), np.flatnonzero(self.deletion)])
        price = np.concatenate([base, np.maximum(extra, base[self.deletion])])
        order = np.lexsort((price, self.item[slots]))
        owner = self.item[slots][order]
        rank = np.arange(len(order)) - np.searchsorted(owner, np.arange(len(self.row)))[owner]
        picked = np.zeros(len(order), bool)
        picked[order] = rank < self.need[owner]
        deep = np.zeros(self.total, bool)
        deep[slots[self.total :]] = picked[self.total :]
        shared = cost > 0
        probe = np.concatenate([picked[: self.total], deep[self.del_slot]]) & shared
        owners = np.concatenate([self.item, self.item[self.del_slot]])
        live = np.zeros(len(self.row), bool)
        live[owners[probe]] = True
        return probe, shared & live[owners]


def lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(rows, kind="stable")
    offsets = np.searchsorted(rows[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].view(np.int64)))


def shingle_set(text: str, width: int) -> set:
    words = text.encode().lower().split()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def sequence(text: str | None) -> bytes | None:
    """BLAKE2b-128 of a text's lower-cased words; None without words."""
    words = (text or "").encode().lower().split()
    return blake2b(b" ".join(words), digest_size=16).digest() if words else None


def heads_of(table: pa.Table, gone: set[bytes]) -> tuple[pa.Table, list[bytes]]:
    """The rows with words that aren't copies of others (gone: digest and id), each once, and their digests."""
    keep, digests, seen = [], [], set(gone)
    for k, (i, text) in enumerate(zip(table["__id"].to_pylist(), table["__text"].to_pylist(), strict=True)):
        if digest := sequence(text):
            key = digest + str("" if i is None else i).encode()
            if key not in seen:
                seen.add(key)
                keep.append(k)
                digests.append(digest)
    return table.take(pa.array(keep, pa.int64())), digests


def cells(table: pa.Table, compare: Callable[[pa.Table], list[tuple[int, int]]]) -> pa.Table:
    """The links that compare finds in each cell (a, __i, __j) of a table of many."""
    table = table.sort_by([("a", "ascending"), ("__i", "ascending"), ("__j", "ascending")])
    keys = np.stack([table[c].to_numpy() for c in ("a", "__i", "__j")])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
    found = [pair for x, y in zip([0, *cuts], [*cuts, table.num_rows], strict=True) for pair in compare(table.slice(x, y - x))]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def spokes(table: pa.Table, width: int, percent: int) -> list[tuple[int, int]]:
    """Links of a cell's hub with its other members; sets are compared word by word."""
    hub, found = table["a"][0].as_py(), []
    ids, texts = table["b"].to_pylist(), table["__text"].to_pylist()
    centres = [shingle_set(t, width) for i, t in zip(ids, texts, strict=True) if i == hub]
    for i, text in zip(ids, texts, strict=True):
        if i != hub:
            two = shingle_set(text, width)
            for one in centres:
                same = len(one & two)
                if 100 * same >= percent * (len(one) + len(two) - same):
                    found.append((hub, i))
                    break
    return found


def across(table: pa.Table, width: int, percent: int, all_links: bool = False) -> list[tuple[int, int]]:
    """Links between members of one or two blocks that are in different components; one for each pair of components it joins.

    With all_links, every link between them, whatever their components.

    Shared shingles are counted by hash through an inverted index of the members here; what passes is compared word by word.
    """
    blocks_ = table["__mine"].to_numpy()
    ids, texts = table["b"].to_pylist(), table["__text"].to_pylist()
    comps = table["__comp"].to_pylist()
    group = {c: c for c in comps}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    hashes, words = word_hashes(*text_bytes(table["__text"]), lower=True)
    at, rows = window_rows(words, width)
    keys, place = np.unique(shingle_hashes(hashes, width)[at], return_inverse=True)
    flat = np.unique(place.astype(np.int64) * len(ids) + rows)
    element, holder = flat // len(ids), flat % len(ids)
    starts = np.searchsorted(element, np.arange(len(keys) + 1))
    order = np.argsort(holder, kind="stable")
    size = np.bincount(holder, minlength=len(ids))
    cut = np.concatenate([[0], np.cumsum(size)])
    two_blocks, found = len(np.unique(blocks_)) > 1, []
    for k in range(len(ids)):
        own = element[order[cut[k] : cut[k + 1]]]
        n = starts[own + 1] - starts[own]
        post = np.arange(int(n.sum())) + np.repeat(starts[own] - (np.cumsum(n) - n), n)
        same = np.bincount(holder[post], minlength=len(ids))
        for j in np.flatnonzero((same > 0) & (100 * same >= percent * (size[k] + size - same))).tolist():
            if j > k and ids[j] != ids[k] and (all_links or root(comps[j]) != root(comps[k])) and (not two_blocks or blocks_[j] != blocks_[k]):
                one, two = shingle_set(texts[k], width), shingle_set(texts[j], width)
                if 100 * len(one & two) >= percent * len(one | two):
                    group[root(comps[j])] = root(comps[k])
                    found.append((ids[k], ids[j]))
    return found


def gathered(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, group_bytes: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ids (__id, __digest), heads (one row per class: __digest, __rep, __n, __text where it may link) and members (a hub and its size, b and its size): two classes that link meet under some hub."""
    rows, groups, buckets = grouped(df, id_col, text_col, group_bytes, bucket_bytes)
    by_group = rows.groupBy("__grp")

    def digested(batches):
        for batch in batches:
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("__id")).cast(pa.int64()), batch.column(names.index("__grp")), pa.array([sequence(t) for t in batch.column(names.index("__text")).to_pylist()], pa.binary())], ["__id", "__grp", "__digest"]
            )

    bound_batches(df.sparkSession)
    ids = materialise(rows.mapInArrow(digested, "__id long, __grp int, __digest binary"), "shingle-ids")
    # Written out, so that joins with it stay plain and Spark can split a huge class of copies.
    copies = materialise(
        ids.where("__digest is not null").groupBy("__digest").agg(F.min("__id").alias("__rep"), F.count("*").alias("__copies")).where("__copies > 1 and __rep is not null").drop("__copies"), "shingle-copies"
    )
    # Copies come to their groups as answers of a bucket that isn't one.
    dropped = ids.join(copies, "__digest").where("not __id <=> __rep").select(F.col("__grp").alias("grp"), F.lit(-1).alias("bucket"), F.expr("concat(__digest, cast(coalesce(cast(__id as string), '') as binary))").alias("data"))

    def of_group(table: pa.Table, replies: pa.Table):
        copy = pa.compute.equal(replies["bucket"], -1)
        heads, digests = heads_of(table, set(replies.filter(copy)["data"].to_pylist()))
        sets = Sets(heads["__text"], width)
        signatures = Signatures(sets, percent, heads["__id"].is_valid().to_numpy(zero_copy_only=False))
        return heads, digests, sets, signatures, replies.filter(pa.compute.invert(copy))

    def ask(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        keys = np.unique(bucket_keys(of_group(table, replies)[3].sig, buckets))
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        return blocks(key_of(key), keys, lambda a, b: low[a:b].tobytes())

    def choose(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        heads, digests, sets, signatures, answers = of_group(table, replies)
        keys, place, here = np.unique(bucket_keys(signatures.sig, buckets), return_inverse=True, return_counts=True)
        cost = (answered(answers).astype(np.int64) - 1 + here - 1)[place] if len(keys) else np.zeros(0, np.int64)
        probe, index = signatures.probes(cost)
        owner = signatures.row[np.concatenate([signatures.item, signatures.item[signatures.del_slot]])]
        live = np.zeros(len(heads), bool)
        live[owner[index]] = True
        texts = heads["__text"].combine_chunks()
        return pa.table(
            {
                "__digest": pa.array(digests, pa.binary()),
                "__rep": heads["__id"].cast(pa.int64()),
                "__n": pa.array(sets.size, pa.int64()),
                "__text": pa.compute.if_else(pa.array(live), texts, pa.scalar(None, texts.type)),
                "__probe": lists(signatures.sig[probe], owner[probe], len(heads)),
                "__index": lists(signatures.sig[index], owner[index], len(heads)),
            }
        )

    counted = answer(by_group.cogroup(dropped.groupBy("grp")).applyInArrow(ask, BLOCKS), holders)
    heads = materialise(
        by_group.cogroup(counted.unionByName(dropped).groupBy("grp")).applyInArrow(choose, "__digest binary, __rep long, __n long, __text string, __probe array<long>, __index array<long>"),
        "shingle-heads",
    )
    # A signature that some set asks for gathers its members around the one with most shared segments, which is
    # nearest to what the group was copied from. Tables are written so that joins with a hot signature can be split.
    asked = heads.select(F.explode("__probe").alias("__sig")).distinct()
    index = heads.select("__rep", "__n", F.size("__index").alias("__shared"), F.explode("__index").alias("__sig"))
    hits = materialise(index.join(asked, "__sig", "left_semi"), "shingle-hits")
    # The order is total (ties by a hash), so that a task run again after a loss picks the same member.
    central = F.shiftleft(F.col("__shared").cast("long"), 40) + F.pmod(F.xxhash64("__rep", "__n"), F.lit(1 << 40))
    hubs = materialise(
        hits.groupBy("__sig").agg(F.max_by("__rep", central).alias("a"), F.max_by("__n", central).alias("__m"), F.count("*").alias("__size")).where("__size > 1").drop("__size"), "shingle-hubs"
    )
    members = materialise(hits.join(hubs, "__sig").select("a", "__m", F.col("__rep").alias("b"), "__n").distinct(), "shingle-members")
    return ids, heads, members


def met(cells_: DataFrame, heads: DataFrame, compare: Callable[[pa.Table], list[tuple[int, int]]], bin_rows: int = 1000) -> DataFrame:
    """(a, b): links that compare finds in the cells (a, __i, __j) of rows (b, ..), with b's text; small cells share a task's call."""
    cells_ = materialise(cells_, "shingle-cells")
    bins = max(1, cells_.count() // bin_rows)
    binned = cells_.join(heads.where("__text is not null").select(F.col("__rep").alias("b"), "__text"), "b").withColumn("__bin", F.pmod(F.xxhash64("a", "__i", "__j"), F.lit(bins)))
    return binned.groupBy("__bin").applyInArrow(lambda table: cells(table, compare), "a long, b long")


def in_blocks(dealt: DataFrame) -> DataFrame:
    """The cells of rows (a, b, __comp, __blocks): a member meets its group's other blocks, a cell has two of them."""
    return dealt.withColumn("__mine", F.pmod(F.xxhash64("b"), "__blocks")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).select(
        "a", F.least("__mine", "__other").alias("__i"), F.greatest("__mine", "__other").alias("__j"), "b", "__comp", "__mine"
    )


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, group_bytes: int = 3 << 20, bucket_bytes: int = 16 << 20, block_members: int = 256) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, component_id.

    Rows with the same words form a class, named by its smallest id; only that row goes on. Classes link when
    100 * intersection >= percent * union of their shingle sets; component_id is the smallest id reachable. How
    often each segment signature occurs is counted over all classes in a packed exchange; only sets whose cheapest
    sufficient segments are shared stay candidates. Candidates first meet the most central member of each signature
    that some set asks for, in cells of ``block_members`` with a copy of it; then members of such a group that are
    in different components meet in blocks of that size, so no link that joins components is lost, no pairs are
    emitted, and no cell gets more than two blocks. Hashes only find candidates: classes are told apart by BLAKE2b
    of their words, links by the words themselves.

    Null and word-free texts have an empty set, link with nothing and are their own component; so are null
    ids whose words no row with an id has. Texts shorter than ``width`` words are one shingle. Rows that repeat
    an id are one node, with the links of all its texts. An empty table gives an empty result. Other columns are ignored.
    """
    ids, heads, members = gathered(df, id_col, text_col, width, percent, group_bytes, bucket_bytes)
    sized = materialise(members.groupBy("a").agg(F.ceil(F.count("*") / block_members).alias("__blocks")), "shingle-groups")
    star = members.where(f"a <> b and 100 * least(__n, __m) >= {percent} * greatest(__n, __m)").select("a", "b").distinct()
    tips = star.join(sized, "a").select("a", F.pmod(F.xxhash64("b"), "__blocks").alias("__i"), F.lit(0).cast("long").alias("__j"), "b")
    centres = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__i"), F.lit(0).cast("long").alias("__j"), F.col("a").alias("b"))
    links = materialise(met(tips.unionByName(centres), heads, lambda table: spokes(table, width, percent)), "shingle-links")
    found = components(links)

    # What the hub alone doesn't join is compared in blocks.
    labelled = members.select("a", "b").distinct().join(found.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("component", "b").alias("__comp"))
    mixed = labelled.groupBy("a").agg(F.min("__comp").alias("__lo"), F.max("__comp").alias("__hi")).where("__lo < __hi").select("a")
    mixed = materialise(mixed.join(sized, "a"), "shingle-mixed")
    more = materialise(met(in_blocks(labelled.join(mixed, "a")), heads, lambda table: across(table, width, percent)), "shingle-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    # Null ids have a row in each group that holds their words; a class has one size.
    named = heads.groupBy("__digest").agg(F.min("__rep").alias("__rep"), F.max("__n").alias("__n"))
    named = materialise(named.join(found.withColumnRenamed("node", "__rep"), "__rep", "left").select("__digest", "__rep", "__n", "component"), "shingle-classes")
    own = F.coalesce("__rep", "__id")
    return ids.join(named, "__digest", "left").select(
        F.col("__id").alias(id_col), F.coalesce("__n", F.lit(0)).cast("long").alias("n_shingles"), own.alias("class_id"), F.coalesce("component", own).alias("component_id")
    )


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, group_bytes: int = 3 << 20, bucket_bytes: int = 16 << 20, block_members: int = 256) -> tuple[DataFrame, DataFrame]:
    """The join itself: pairs (a < b) of classes that link, by class_id, and n_links of each row (id, class_id, n_links).

    Every two members of a hub's group are compared in blocks of ``block_members``, linked already or not. n_links is
    the number of other ids whose set is like enough: those of the own class and all of each linked class, so both
    ends count. Classes, links, null and repeated ids are as in jaccard_groups; null ids aren't counted, and a row
    without an id has the links of its class. Pairs grow with the square of a family of different texts.
    """
    ids, heads, members = gathered(df, id_col, text_col, width, percent, group_bytes, bucket_bytes)
    sized = materialise(members.groupBy("a").agg(F.ceil(F.count("*") / block_members).alias("__blocks")), "shingle-groups")
    dealt = members.select("a", "b").distinct().join(sized, "a").select("a", "b", F.col("b").alias("__comp"), "__blocks")
    found = met(in_blocks(dealt), heads, lambda table: across(table, width, percent, all_links=True))
    pairs = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "shingle-pairs")
    classes = ids.join(heads.groupBy("__digest").agg(F.min("__rep").alias("__rep")), "__digest", "left").select("__id", F.coalesce("__rep", "__id").alias("__rep"), F.col("__digest").isNotNull().alias("__some"))
    sizes = classes.where("__some and __rep is not null").groupBy("__rep").agg(F.countDistinct("__id").alias("__size"))
    ends = pairs.select(F.col("a").alias("__rep"), F.col("b").alias("__to")).union(pairs.select("b", "a"))
    others = ends.join(sizes.withColumnRenamed("__rep", "__to"), "__to").groupBy("__rep").agg(F.sum("__size").alias("__far"))
    near = F.greatest(F.coalesce("__size", F.lit(1)) - F.when(F.col("__id").isNull(), 0).otherwise(1), F.lit(0))
    counted = classes.join(sizes, "__rep", "left").join(others, "__rep", "left")
    return pairs, counted.select(F.col("__id").alias(id_col), F.col("__rep").alias("class_id"), F.when(F.col("__rep").isNull(), 0).otherwise(near + F.coalesce("__far", F.lit(0))).cast("long").alias("n_links"))
