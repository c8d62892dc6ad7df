"""Mixing sources to target weights by balanced (cube method) sampling."""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import numbered, running_sum
from .shared import materialise, one_space

EPS = 1e-9


def n_words(text: Column) -> Column:
    """Number of maximal runs of anything but ASCII white space; null: 0."""
    flat = F.trim(one_space(text))
    return F.when(flat == "", F.lit(0)).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: __source, __rank, __total, __rows, __target.

    The target is min(most * size, level * weight): sources are filled in the order at which they reach
    their limit, and the level is what the rest share by weight. Sources may be many: they are numbered by
    ranges and summed by blocks, never in one task.
    """
    per = materialise(rows.groupBy("__source").agg(F.sum("__size").alias("__total"), F.count("*").alias("__rows")), "mix-totals")
    source = F.col("__source").asc_nulls_last()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__rank") % len(weights)).cast("int") + 1)
    ranked = numbered(per, [source], "__rank").withColumn("__weight", weight).withColumn("__limit", most * F.col("__total") / F.col("__weight"))
    ordered = numbered(ranked, [F.col("__limit").asc(), source], "__nth").withColumn("__all", F.lit(1))
    sums = running_sum(running_sum(ordered, most * F.col("__total"), "__filled", ["__all"], "__nth"), F.col("__weight"), "__heavy", ["__all"], "__nth")
    whole, heavy = ranked.agg(F.sum("__total"), F.sum("__weight")).first()
    # What is left when all sources before this one are full, by weight of this and the later ones.
    level = (share * F.lit(whole or 0) - F.col("__filled") + most * F.col("__total")) / (F.lit(heavy or 0.0) - F.col("__heavy") + F.col("__weight"))
    levels = materialise(sums.withColumn("__level", level), "mix-levels")
    open_level, first = levels.where("__limit > __level").agg(F.min_by("__level", "__nth"), F.min("__nth")).first()
    full = most * F.col("__total")
    target = full if first is None else F.when(F.col("__nth") >= first, F.lit(open_level) * F.col("__weight")).otherwise(full)
    return levels.select("__source", "__rank", "__total", "__rows", target.alias("__target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Moves p inside the null space of (count, tokens) until at most two entries are fractional.

    Three fractional units always leave one direction that changes neither total. land: then also the two
    left, first keeping tokens alone, then none.
    """
    p = p.astype(float).copy()
    work: list[int] = []

    def step(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(units, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(units, u, strict=True) if x)
        by = up if rng.random() * (up + down) < down else -down
        for i, x in zip(units, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + by * x))
            p[i] = 0.0 if p[i] < EPS else 1.0 if p[i] > 1 - EPS else p[i]

    for k in np.flatnonzero((p > EPS) & (p < 1 - EPS)):
        work.append(int(k))
        while len(work) == 3:
            a, b, c = (float(size[i]) for i in work)
            step(work, [b - c, c - a, a - b] if (a, b) != (b, c) else [1.0, -1.0, 0.0])
            work = [i for i in work if 0 < p[i] < 1]
    if land:
        if len(work) == 2:
            a, b = (float(size[i]) for i in work)
            step(work, [b, -a] if a and b else [1.0, -1.0])
            work = [i for i in work if 0 < p[i] < 1]
        for i in work:
            step([i], [1.0])
    return p


def sized_rows(df: DataFrame, id_col: str, source_col: str, text_col: str) -> list[Column]:
    """What the mix needs of each row of df; __row tells rows apart, once it is written."""
    return [F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size"), F.monotonically_increasing_id().alias("__row")]


def with_hash(rows: DataFrame) -> DataFrame:
    """rows with __hash of id, size and the row's number among those of equal source, id and size, which may be any number.

    Equal rows are counted where they lie first; only they are numbered, by place within a part of the table
    and the counts of the parts before.
    """
    keyed = rows.withColumn("__same", F.xxhash64("__source", "__id", "__size")).withColumn("__part", F.shiftright("__row", 33))
    same = Window.partitionBy("__same")
    ahead = same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keyed.groupBy("__same", "__part").agg(F.count("*").alias("__n"))
    many = materialise(
        parts.withColumns({"__ahead": F.coalesce(F.sum("__n").over(ahead), F.lit(0)), "__of": F.sum("__n").over(same)}).where("__of > 1").select("__same", "__part", "__ahead"),
        "mix-repeated",
    )
    local = F.row_number().over(Window.partitionBy("__same", "__part").orderBy("__row")) - 1
    repeated = keyed.join(many, ["__same", "__part"]).withColumn("__nth", F.col("__ahead") + local)
    single = keyed.join(many, ["__same", "__part"], "left_anti").withColumn("__nth", F.lit(0).cast("long"))
    return single.unionByName(repeated.drop("__ahead")).withColumn("__hash", F.xxhash64("__id", "__size", "__nth")).drop("__same", "__part", "__nth")


def mixed(rows: DataFrame, weights: Sequence[float], share: float, most: float, block_rows: int, fan_in: int, seed: int) -> DataFrame:
    """(__row, __id, __size, __total, __target, __copies) of rows (__row, __id, __source, __size), which are written already."""
    sources = materialise(source_targets(rows, weights, share, most), "mix-sources")
    ratio = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(F.lit(0.0))
    ready = (
        with_hash(rows)
        .alias("a")
        .join(sources.alias("b"), F.col("a.__source").eqNullSafe(F.col("b.__source")))
        .select("__row", "__id", "__rank", "__size", "__total", "__target", "__hash", ratio.alias("__ratio"), F.ceil(F.col("__rows") / block_rows).alias("__blocks"))
        .select(
            "__row",
            "__id",
            "__rank",
            "__size",
            "__total",
            "__target",
            F.floor("__ratio").cast("long").alias("__base"),
            (F.col("__ratio") - F.floor("__ratio")).alias("__p"),
            "__hash",
            F.pmod("__hash", "__blocks").alias("__block"),
        )
    )

    def level(last: bool):
        def move(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["__hash", "__size"], kind="stable")
            rng = np.random.default_rng([seed, *(int(k) for k in key)])
            return part.assign(__p=flight(part["__p"].to_numpy(), part["__size"].to_numpy(), rng, last))

        return move

    most_rows = sources.agg(F.max("__rows")).first()[0] or 0
    blocks, width, done, fractional = math.ceil(most_rows / block_rows), 1, [], ready
    while True:
        last = blocks <= 1
        moved = materialise(fractional.groupBy("__rank", F.floor(F.col("__block") / width).alias("__group")).applyInPandas(level(last), ready.schema), "mix-level")
        open_ = (F.col("__p") > EPS) & (F.col("__p") < 1 - EPS)
        done.append(moved if last else moved.where(~open_))
        if last:
            break
        fractional, width, blocks = moved.where(open_), width * fan_in, math.ceil(blocks / fan_in)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("__copies", F.col("__base") + F.round("__p").cast("long")).select("__row", "__id", "__size", "__total", "__target", "__copies")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_rows: int = 1000,
    fan_in: int = 256,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken.

    Sources in code point order (null last) get the weights in turn; together they aim at ``share`` of all
    words, none above ``most`` times its own. A row is copied floor(target / size) times for certain and
    once more by a cube-method draw: each (source, block of hashed rows) moves its fractional inclusion
    probabilities through the null space of (documents, words) until at most two are left; those of
    ``fan_in`` blocks meet in the next level, and one small landing problem a source ends it. Blocks keep
    a hot source or id spread; reruns agree, as blocks, order and random numbers follow from ids and sizes.

    Null text has size 0; rows of size 0 take 0 words. Null ids and repeated rows are rows like others: equal
    ones are numbered, and which of them has which number doesn't show. An empty table gives an empty result;
    if no text has words, all targets are 0. Other columns are ignored, whatever their names.
    """
    rows = materialise(df.select(*sized_rows(df, id_col, source_col, text_col)), "mix-sizes")
    return mixed(rows, weights, share, most, block_rows, fan_in, seed).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__total").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__copies").alias("copies"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def mix_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_rows: int = 1000,
    fan_in: int = 256,
    seed: int = 7,
) -> DataFrame:
    """The rows of df with all their columns, each as often as mix_sources copies it; no name is reserved."""
    rows = materialise(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__doc"), *sized_rows(df, id_col, source_col, text_col)), "mix-rows")
    copies = mixed(rows.drop("__doc"), weights, share, most, block_rows, fan_in, seed).where("__copies > 0").select("__row", "__copies")
    taken = rows.select("__row", "__doc").join(copies, "__row").select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select("__doc.*")
