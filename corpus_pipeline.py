"""Documents from raw to tokens: five stages, each over all its predecessor kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blipstream.llm.bpe import bpe_round_trip
from blipstream.llm.jaccard_join import jaccard_groups
from blipstream.llm.line_dedup import cut_lines
from blipstream.llm.mixing import mix_rows
from blipstream.llm.shared import materialise, table
from blipstream.llm.toxicity import toxicity_scorer

#: Toxicity is learned, the cube method draws and the tokens come from a vocabulary file: SQL can't state the rows.
ORACLE_SQL = None
#: The score from which a text is rejected.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, with all their columns. Null and empty texts are scored as empty; no documents give none."""
    score = toxicity_scorer(docs, table(spark, sf_dir, "labels"))
    return docs.where(score(F.col("text")) < TOXIC)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that an earlier document or line has; where some went, n_chars follows the text.

    All other columns keep their values, whatever their names. Null texts stay null; no documents give none.
    """
    doc, size = F.col("__doc"), F.length("__kept").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("__kept"), "n_chars": F.when(F.col("__n_cut") > 0, size).otherwise(doc.getField("n_chars"))}
    return cut_lines(docs).select(*(new.get(c, doc.getField(c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of like documents; rows without an id stay, rows that repeat a kept id too.

    Columns keep their values, whatever their names; no documents give none.
    """
    first = jaccard_groups(docs.select("doc_id", "text")).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(first, "doc_id", "left_semi")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with all its columns as often as the mix takes it, also rows without an id or with a repeated one; no documents give none."""
    return mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each; other columns are ignored. Null texts are encoded as empty; no documents give none."""
    done = bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing sources", mixing), ("BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
