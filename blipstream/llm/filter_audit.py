"""What each of some filters removes in every order: joint failures of all intersections, inverted by inclusion-exclusion."""

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import sha256_bytes
from .shared import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_flags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A, B, C, D, E) of each row, booleans that are true where a filter fails.

    A: under 50 words; B: fewer than 65% of the words are distinct; C: over 5% of the code points are A-Z; D: holds one
    of #$%&*|; E: a row with a smaller id has the same text. Null text is empty, a null part is ''. Rows of one id and
    text aren't each other's copies; null ids are copies of nothing and have none. Texts are equal where their
    SHA-256 are. An empty table gives an empty result.

    The texts are read once. Ids meet by digest, with one row a digest and task before the shuffle; the digests that
    repeat return to the rows by a join whose row side Spark may split, so a text on a third of all rows is no
    group. The words of one text are one array of its task: some 60 bytes a word.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    read = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("__part"), text_or_empty(F.col(text_col)).alias("__text"))
    words = read.select("*", F.array_remove(F.split(F.translate("__text", "\t\n\v\f\r", " " * 5), " "), "").alias("__words"))
    n, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    made = words.select(
        "__id",
        "__part",
        (n < 50).alias("A"),
        (100 * distinct.cast("long") < 65 * n.cast("long")).alias("B"),
        (100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > 5 * F.length(text).cast("long")).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
        sha256_bytes(text).alias("__digest"),
    )
    rows = materialise(made, "audit-flags")
    firsts = rows.where("__id is not null").groupBy("__digest").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last").drop("__last")
    copy = F.coalesce(F.col("__id") > F.col("__first"), F.lit(False))
    return rows.join(firsts, "__digest", "left").select(F.col("__id").alias(id_col), F.col("__part").alias("part"), "A", "B", "C", "D", copy.alias("E"))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def with_labels(flags: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """flags with good and toxic: whether any label of the id says quality or toxic 1. Ids without labels, and null ids, have neither."""
    found = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__of"))
    found = found.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    joined = flags.join(found, F.col(id_col) == F.col("__of"), "left")
    return joined.select(*flags.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def joint_failures(flags: DataFrame, filters: str, part_col: str, weights: list[str]) -> DataFrame:
    """For each part and each weight an array: at place S, how many rows of that weight fail every filter of the set with bits S. Each is a sum of products of flags."""
    ones = {f: F.col(f).cast("long") for f in filters}
    sums = []
    for w in ["", *weights]:
        for s in range(1 << len(filters)):
            product = F.col(w).cast("long") if w else F.lit(1).cast("long")
            for i, f in enumerate(filters):
                product = product * ones[f] if s >> i & 1 else product
            sums.append(F.sum(product).alias(f"__{w}_{s}"))
    counted = flags.groupBy(F.col(part_col).alias("part")).agg(*sums)
    return counted.select("part", *(F.array(*(f"__{w}_{s}" for s in range(1 << len(filters)))).alias(f"joint_{w}" if w else "joint") for w in ["", *weights]))


def combination(joint: str, terms: dict[int, int]) -> Column:
    """The sum of some places of an array, each times a whole number."""
    total = F.lit(0).cast("long")
    for s, by in terms.items():
        total = total + F.col(joint)[s] * by if by != 1 else total + F.col(joint)[s]
    return total


def survivors(joint: str, n: int) -> Column:
    """Möbius inversion: at place P, how many rows fail no filter of the set with bits P."""
    return F.array(*(combination(joint, {s: (-1) ** s.bit_count() for s in range(1 << n) if s & ~p == 0}) for p in range(1 << n)))


def filter_audit(flags: DataFrame, filters: str = "ABCDE", part_col: str = "part", good_col: str = "good", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of all filters and step: what is kept, removed, redundant, unique and lost there, and the filter's Shapley value.

    ``flags`` has a boolean column for each filter (one letter each, at most six), true where a row fails it; null
    counts as false. One aggregation counts the joint failures of all 2**n sets of filters in each part; all else is
    arithmetic on these counts: survivors of a set and rows that fail one filter only by Möbius inversion, the
    Shapley value from the Harsanyi dividends (-1)**(|T| + 1) * joint(T), each shared equally by its filters and
    counted over all orders. ``kept`` is after the step, ``removed`` in it, ``redundant`` fails the step's filter but
    went before; ``good_lost`` and ``toxic_lost`` are what ``removed`` holds of those flags; ``shapley`` is the
    filter's removed, summed over all orders. A null part counts as ''. No rows give none.
    """
    n = len(filters)
    if not 1 <= n <= 6 or len(set(filters)) != n:
        raise ValueError("one to six filters, each a letter of its own")
    clean = flags.select(F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), *(F.coalesce(F.col(c), F.lit(False)).alias(a) for c, a in [*((f, f) for f in filters), (good_col, "__good"), (toxic_col, "__toxic")]))
    joint = joint_failures(clean, filters, "part", ["__good", "__toxic"])
    free = joint.select(
        "part",
        *(survivors(c, n).alias(a) for c, a in (("joint", "free"), ("joint___good", "free_good"), ("joint___toxic", "free_toxic"))),
        F.array(*(F.col("joint")[1 << i] for i in range(n))).alias("fails"),
        F.array(*(combination("joint", {s: (-1) ** (s.bit_count() - 1) for s in range(1 << n) if s >> i & 1}) for i in range(n))).alias("only"),
        F.array(*(combination("joint", {s: (-1) ** (s.bit_count() + 1) * factorial(n) // s.bit_count() for s in range(1 << n) if s >> i & 1}) for i in range(n))).alias("shapleys"),
    )
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(filters[k] for k in order), "step": step, "before": before, "after": before | 1 << i, "f": i})
            before |= 1 << i
    at = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,after:int,f:int>>")
    rows = free.select("*", F.inline(at))

    def lost(free_of: str) -> Column:
        return F.col(free_of)[F.col("before")] - F.col(free_of)[F.col("after")]

    return rows.select(
        "part",
        "filter_order",
        "step",
        F.col("free")[F.col("after")].alias("kept"),
        lost("free").alias("removed"),
        (F.col("fails")[F.col("f")] - lost("free")).alias("redundant"),
        F.col("only")[F.col("f")].alias("unique_fails"),
        lost("free_good").alias("good_lost"),
        lost("free_toxic").alias("toxic_lost"),
        F.col("shapleys")[F.col("f")].alias("shapley"),
    )
