"""DIS6: quantiles from a table on a grid, and the making of such a table."""

from collections.abc import Sequence
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blipstream.functions.distributions import compound_poisson_limit

AXES = ("mean", "shape", "alpha")


def compound_grid(spark: SparkSession, means: Sequence[float], shapes: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    """(mean, shape, alpha, value): DIS5's quantile at every node, a node a row and computed where the row is."""
    nodes = spark.createDataFrame(list(product(map(float, means), map(float, shapes), map(float, alphas))), "mean double, shape double, alpha double")

    @F.pandas_udf("double")
    def value(mean: pd.Series, shape: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series([compound_poisson_limit(*node) for node in zip(mean, shape, alpha, strict=True)], dtype="float64")

    return nodes.withColumn("value", value(*AXES))


def in_cell(rows: DataFrame, axis: str) -> DataFrame:
    """rows with the nodes __lo and __hi around an axis (of the sorted array __axis) and how far between them it lies, from 0 to 1."""
    nodes = F.col(f"__{axis}")
    x = F.least(F.greatest(F.col(axis).cast("double"), F.element_at(nodes, 1)), F.element_at(nodes, -1))
    low = F.array_max(F.filter(nodes, lambda v: v <= x))
    placed = rows.withColumn(f"__lo_{axis}", low).withColumn(f"__hi_{axis}", F.coalesce(F.array_min(F.filter(nodes, lambda v: v > x)), low))
    part = F.coalesce(F.try_divide(x - F.col(f"__lo_{axis}"), F.col(f"__hi_{axis}") - F.col(f"__lo_{axis}")), F.lit(0.0))
    return placed.withColumn(f"__at_{axis}", F.when(F.col(axis).isNotNull(), part))


def looked_up(rows: DataFrame, grid: DataFrame, name: str = "value", axes: Sequence[str] = AXES, value: str = "value") -> DataFrame:
    """rows with ``name``: linear in every axis between the nodes around the row's axes; null if an axis is null or a node of the cell is missing.

    The grid may be the caller's and have other axes; beyond its ends the outermost nodes count. The nodes of each axis are
    one row that every task gets; the grid itself is met by equi-joins with the (two for each axis) corners of the cells
    that occur, not of all rows: rows in one cell share its corners.
    """
    ends = grid.agg(*(F.array_sort(F.collect_set(a)).alias(f"__{a}") for a in axes))  # one row: the nodes of each axis
    placed = rows.crossJoin(F.broadcast(ends))
    for a in axes:
        placed = in_cell(placed, a)
    cell = [f"__{side}_{a}" for a in axes for side in ("lo", "hi")]
    corners = placed.select(*cell).distinct()
    for k, sides in enumerate(product(("lo", "hi"), repeat=len(axes))):
        node = grid.select(*(F.col(a).alias(f"__{s}_{a}") for a, s in zip(axes, sides, strict=True)), F.col(value).alias(f"__v{k}"))
        corners = corners.join(node, [f"__{s}_{a}" for a, s in zip(axes, sides, strict=True)], "left")
    total: Column = F.lit(0.0)
    for k, sides in enumerate(product(("lo", "hi"), repeat=len(axes))):
        weight: Column = F.lit(1.0)
        for a, s in zip(axes, sides, strict=True):
            weight = weight * (F.col(f"__at_{a}") if s == "hi" else 1 - F.col(f"__at_{a}"))
        total = total + F.when(weight == 0, 0.0).otherwise(weight * F.col(f"__v{k}"))
    return placed.join(corners, cell, "left").withColumn(name, total).select(*rows.columns, name)
