"""The folder that all executors share, and side tables whose size is checked before they are sent to every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, one of our own on a single machine; on a cluster that is an error, as executors couldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-borespark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: worked out once, and there also when executors are lost."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table of few narrow columns with a broadcast hint, if its counted rows allow it; else as it is."""
    return F.broadcast(table) if table.count() <= rows else table


def dealt(df: DataFrame, key: str, rows: int = 2_000) -> DataFrame:
    """df dealt out by key to as many tasks as its counted rows ask for, before work that is large for each row: a file of short rows is read by one or few tasks.
    It is observed, so that Spark moves no filter on what is made of the rows to before the dealing."""
    return df.repartition(max(1, -(-df.count() // rows)), key).observe(f"dealt_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
