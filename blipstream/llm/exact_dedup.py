"""Exact deduplication by skew-safe combining."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, one_space


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Rows are equal when their white-space-normalised texts are. Three stages compare whole texts: each
    task first combines its own copies, then copies meet by (digest, salt), so that one huge group is
    spread over ``salts`` reducers, then the at most ``salts`` winners of a text meet by digest. Only the
    small (digest -> winner) table returns to the rows. A digest shared by different texts is found in
    the last stage; its rows are told apart by their texts.

    Null text counts as empty. Null ids never win against an id; a group of null ids alone keeps null.
    Repeated rows with one id are all kept or all dropped. An empty table gives an empty result. Other
    columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("__id"), one_space(F.col(text_col)).alias("__text")).withColumn("__digest", digest(F.col("__text")))
    salted = (
        rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)))
        .groupBy("__digest", "__salt", "__text")
        .agg(F.min("__id").alias("__keep"), F.count("*").alias("__n"))
    )
    winners = salted.repartition("__digest").groupBy("__digest", "__text").agg(F.min("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    groups = materialise(
        winners.withColumn("__texts", F.count("*").over(Window.partitionBy("__digest"))).select(
            "__digest", F.when(F.col("__texts") > 1, F.col("__text")).alias("__text"), "__keep", "__n"
        ),
        "exact-groups",
    )
    alone = groups.where(F.col("__text").isNull()).drop("__text")
    found = rows.select("__id", "__digest").join(alone, "__digest", "inner")
    clashes = groups.where(F.col("__text").isNotNull())
    if not clashes.isEmpty():
        found = found.unionByName(rows.join(clashes, ["__digest", "__text"]).drop("__text"))
    return found.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__digest").alias("digest"),
    )
