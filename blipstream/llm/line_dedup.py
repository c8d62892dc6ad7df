"""Removal of repeated multi-line passages, by content-defined chunks of lines at two scales."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Rolling hash over the hashes of three lines: multipliers of the line before and the one before that, and the modulus.
ROLL = (131, 17161, 1000003)
ADDED = ("n_chunks", "n_cut", "lines_cut", "chars_cut")


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_spots(df: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """Adds __ends (1-based last line of each chunk) and __spots: the (f, t) of the lines of each chunk of either scale that has min_lines non-blank ones."""
    one, two, mod = ROLL
    return (
        df.withColumn("__hash", F.expr("transform(__lines, l -> cast(conv(substr(md5(l), 1, 7), 16, 10) as bigint))"))
        .withColumn(
            "__ends",
            F.expr(
                f"filter(sequence(1, size(__lines)), i -> i = size(__lines) or pmod(__hash[i - 1] + {one} * coalesce(get(__hash, i - 2), 0)"
                f" + {two} * coalesce(get(__hash, i - 3), 0), {mod}) % {divisor} = 0)"
            ),
        )
        .withColumn("__full", F.expr("filter(sequence(1, size(__lines)), i -> trim(__lines[i - 1]) != '')"))
        .withColumn("__coarse", F.expr("transform(__ends, (e, k) -> struct(coalesce(get(__ends, k - 1), 0) + 1 as f, e as t))"))
        .withColumn("__coarse", F.expr("transform(__coarse, c -> struct(c.f as f, c.t as t, size(filter(slice(__lines, c.f, c.t - c.f + 1), l -> trim(l) != '')) as n))"))
        # Those that begin and end with the least number of non-blank lines are chunks of the fine scale too.
        .withColumn("__coarse", F.expr(f"filter(__coarse, c -> c.n > {min_lines} or c.n = {min_lines} and (trim(__lines[c.f - 1]) = '' or trim(__lines[c.t - 1]) = ''))"))
        .withColumn("__fine", F.expr(f"transform(__full, (f, k) -> struct(f as f, get(__full, k + {min_lines - 1}) as t))"))
        .withColumn("__spots", F.concat(F.transform("__coarse", lambda s: F.struct(s["f"], s["t"])), F.filter("__fine", lambda s: s["t"].isNotNull())))
    )


def cut_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, min_lines: int = 2, line_key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """Each row of df as __doc, with __kept (the text that is left), __n_chunks, __n_cut and __lines_cut; see line_dedup."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__doc"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    last = F.lit((1 << 63) - 1)
    texts = row.where(F.col("__text").isNotNull())
    # The bytes of all lines are compared where their keys are counted: a key that stands for one line then stands for its bytes.
    keys = texts.select(F.explode(lines_of(F.col("__text"))).alias("__line")).select(line_key(F.col("__line")).alias("__key"), "__line").distinct()
    one_each = keys.groupBy("__key").count().where("count > 1").isEmpty()
    lined = texts.select(F.coalesce("__id", last).alias("__id"), F.xxhash64("__text").alias("__text_hash"), lines_of(F.col("__text")).alias("__lines"))
    spotted = with_spots(lined, divisor, min_lines).withColumn("__keys", F.transform("__lines", lambda x: line_key(x)) if one_each else F.col("__lines"))
    # Equal chunks of one text stand beside each other once sorted; all but the first in the text come again.
    # (Read twice, the keys are a column of their own; read once, Catalyst would hash all lines again for each chunk.)
    sliced = F.expr("sort_array(transform(__spots, s -> struct(slice(__keys, s.f, least(s.t, size(__keys)) - s.f + 1) as c, s as s)))")
    ordered = spotted.select("__id", "__text_hash", sliced.alias("__order"))
    spots = ordered.select("__id", "__text_hash", F.explode(F.expr("transform(__order, (s, i) -> struct(s.c as c, s.s as s, coalesce(get(__order, i - 1).c = s.c, false) as again))")).alias("__spot")).select(
        "__id", "__text_hash", F.col("__spot.c").alias("__chunk"), F.col("__spot.s").alias("__at"), F.col("__spot.again").alias("__again")
    )
    counted = spots.groupBy("__chunk").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    repeated = materialise(counted.where("__n > 1").drop("__n"), "line-chunks")
    cuts = spots.join(repeated, "__chunk").where("__id > __first or __again").groupBy("__id", "__text_hash").agg(F.collect_set("__at").alias("__cut"))
    joined = row.withColumn("__id", F.coalesce("__id", last)).withColumn("__text_hash", F.xxhash64("__text")).join(cuts, ["__id", "__text_hash"], "left")
    marked = (
        with_spots(joined.withColumn("__lines", lines_of(F.col("__text"))), divisor, min_lines)
        .withColumn("__gone", F.array_distinct(F.flatten(F.transform("__cut", lambda s: F.sequence(s["f"], s["t"])))))
        .withColumn("__left", F.expr("array_except(sequence(1, size(__lines)), __gone)"))
    )
    left = F.expr("array_join(transform(__left, i -> get(__lines, i - 1)), '\n')")
    return marked.select(
        "__doc",
        F.when(F.col("__cut").isNull() | F.col("__text").isNull(), F.col("__text")).otherwise(left).alias("__kept"),
        F.when(F.col("__text").isNull(), 0).otherwise(F.size("__ends")).cast("long").alias("__n_chunks"),
        F.coalesce(F.when(F.col("__text").isNotNull(), F.size("__cut")), F.lit(0)).cast("long").alias("__n_cut"),
        F.coalesce(F.when(F.col("__text").isNotNull(), F.size("__gone")), F.lit(0)).cast("long").alias("__lines_cut"),
    )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, min_lines: int = 2, line_key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """df with repeated chunks cut from its texts, and n_chunks, n_cut, lines_cut, chars_cut added.

    A chunk of the coarse scale ends after a line at which a rolling hash over the last three line hashes is a
    multiple of ``divisor``, and at the end of the text, so an inserted line moves only nearby boundaries. At the
    fine scale every line break is a boundary: a chunk reaches from each non-blank line over ``min_lines`` of them,
    so a passage of that many lines is found wherever it stands, and chunks of it that overlap extend over all of it.
    Chunks of at least ``min_lines`` non-blank lines are counted over all rows; of equal ones the first stays:
    smallest id, then first in its text. All lines of the others go, so of equal lines the first always stays.

    Chunks are equal where the keys of their lines are. The lines of a key are compared byte by byte; should a key
    stand for two lines, lines stand for themselves (``line_key`` is for tests of that).

    Null text stays null and has no chunks to cut; empty text has one chunk of one line. Null ids come
    last. Equal chunks in repeated rows of one id stay in each of them. Texts without a cut are returned
    unchanged. Work is linear in the lines of a text but for a sort, so texts of any length that a row holds
    will do. An empty table gives an empty result. All other columns pass through, whatever their names;
    columns named like an added one are replaced. n_chunks counts the coarse scale, n_cut the chunks of either.
    """
    doc, text = F.col("__doc"), F.col("__doc").getField(text_col)
    return cut_lines(df, id_col, text_col, divisor, min_lines, line_key).select(
        *[F.col("__kept").alias(c) if c == text_col else doc.getField(c).alias(c) for c in df.columns if c not in ADDED],
        F.col("__n_chunks").alias("n_chunks"),
        F.col("__n_cut").alias("n_cut"),
        F.col("__lines_cut").alias("lines_cut"),
        (F.coalesce(F.length(text), F.lit(0)) - F.coalesce(F.length("__kept"), F.lit(0))).cast("long").alias("chars_cut"),
    )
