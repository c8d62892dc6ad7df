"""Tables that several steps of a plan read: written once to the folder that driver and executors share."""

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir(app_id: str) -> str:
    path = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only in local mode, where one machine is all there is, a temporary folder, removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_dir(spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: later steps scan it instead of repeating its windows and joins, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
