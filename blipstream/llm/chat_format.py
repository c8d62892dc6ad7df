"""Chat formatting of typed content parts, with a loss mask and a way back."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Every turn reads HEAD role CLOSE body END. '<' and '[' start all control strings, here and in other common templates.
HEAD, CLOSE, END = "<|turn:", "|>", "<|end|>"
#: A backslash in formatted text always starts one of these pairs, so replacing them back in reverse order is exact.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 14, 25, 512


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    """A role also loses its bars, which CLOSE begins with."""
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\p"), F.lit("|")))


def part_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for: image patches, audio at a fixed rate, document pages; text: none."""
    return (
        F.when(part["type"] == "image", F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)) * F.lit(PAGE_TOKENS))
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def part_body(part: Column, at: Column) -> Column:
    """The visitor: text is escaped; any other part leaves a placeholder with its type and place in the turn."""
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), escape_role(part["type"]), F.lit(":"), at.cast("string"), F.lit("|>")))


#: Parts that are summed one by one; longer lists are summed in two levels.
STRIDE = 64


def with_starts(df: DataFrame, lengths: str, name: str) -> DataFrame:
    """df with the sum of all lengths before each one; n of them take about n * STRIDE steps."""
    add = "(x, y) -> x + y"
    return (
        df.withColumn("__sums", F.expr(f"transform(sequence(0, size({lengths}) div {STRIDE}), b -> aggregate(slice({lengths}, b * {STRIDE} + 1, {STRIDE}), 0L, {add}))"))
        .withColumn("__ahead", F.expr(f"transform(__sums, (x, b) -> aggregate(slice(__sums, 1, b), 0L, {add}))"))
        .withColumn(name, F.expr(f"transform({lengths}, (x, i) -> get(__ahead, i div {STRIDE}) + aggregate(slice({lengths}, (i div {STRIDE}) * {STRIDE} + 1, i % {STRIDE}), 0L, {add}))"))
        .drop("__sums", "__ahead")
    )


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv id, formatted, loss_mask, attachments, n_turns.

    ``parts_col`` is an array of PART structs. loss_mask lists (start, length) in code points of ``formatted``,
    one for each text part of ``learn`` turns, so placeholders are never learned; attachments lists turn
    (0-based), part, type, ref and expanded tokens in order. Turns follow turn_col, nulls first; ties follow role,
    then body, so reruns agree. Null conversation ids form one conversation; null roles are empty; null or empty
    part lists and null texts give an empty body; a part of null type is text. An empty table gives an empty
    result. Other columns are ignored. A conversation becomes one string, so its rows meet in one task; nothing
    larger than it does.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(df.schema[parts_col].dataType))
    row = df.select(
        F.col(conv_col).alias("__conv"),
        F.col(turn_col).alias("__turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("__role"),
        F.transform(parts, part_body).alias("__bodies"),
        F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"), is_text(p).alias("text"))).alias("__parts"),
    ).withColumn("__lengths", F.transform("__bodies", F.length))
    row = with_starts(row, "__lengths", "__starts").select(
        "__conv",
        "__turn",
        "__role",
        F.array_join("__bodies", "").alias("__body"),
        F.filter("__parts", lambda p: ~p["text"]).alias("__others"),
        F.when(
            F.col("__role") == learn,
            F.filter(
                F.transform("__parts", lambda p, i: F.struct(p["text"].alias("text"), F.get("__starts", i).alias("start"), F.get("__lengths", i).cast("long").alias("length"))), lambda p: p["text"]
            ),
        ).alias("__learned"),
    ).withColumn("__piece", F.concat(F.lit(HEAD), escape_role(F.col("__role")), F.lit(CLOSE), F.col("__body"), F.lit(END)))
    turns = Window.partitionBy("__conv").orderBy("__turn", "__role", "__body")
    placed = row.withColumn("__at", F.row_number().over(turns) - 1).withColumn(
        "__start", F.sum(F.length("__piece")).over(turns.rowsBetween(Window.unboundedPreceding, 0)) - F.length("__body") - len(END)
    )
    gathered = placed.groupBy("__conv").agg(F.array_sort(F.collect_list(F.struct("__at", "__piece", "__start", "__learned", "__others"))).alias("__turns"))
    return gathered.select(
        F.col("__conv").alias(conv_col),
        F.array_join(F.transform("__turns", lambda t: t["__piece"]), "").alias("formatted"),
        F.flatten(
            F.transform(
                F.filter("__turns", lambda t: t["__learned"].isNotNull()),
                lambda t: F.transform(t["__learned"], lambda p: F.struct((t["__start"] + p["start"]).alias("start"), p["length"].alias("length"))),
            )
        ).alias("loss_mask"),
        F.flatten(
            F.transform(
                "__turns",
                lambda t: F.transform(
                    t["__others"],
                    lambda p: F.struct(t["__at"].alias("turn"), p["part"].alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
                ),
            )
        ).alias("attachments"),
        F.size("__turns").cast("long").alias("n_turns"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), CLOSE, 1)).alias("role"),
            unescape(F.substr(x, F.locate(CLOSE, x) + F.lit(len(CLOSE)))).alias("text"),
        ),
    )


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
