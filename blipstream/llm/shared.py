"""Tables in the folder that driver and executors share, and the text rules that several operators use."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Words are maximal runs of code points outside this set.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df once to the shared folder and reads it back, so a lost executor costs no recomputation."""
    return stored(df, name)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at 4 MB too, unless it sets a bound itself: each task has several copies of a batch at once, and 10,000 rows are 34 MB of texts. No row is cut or left out."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")


def one_space(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty. Runs that already are one space aren't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
