"""Session settings the library counts on, and the shared folder for its files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Turn on adaptive execution with skew handling; sizes stay the caller's choice."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def join_where_dealt(spark: SparkSession) -> None:
    """Sides dealt by some of a join's keys already are not dealt again by all of them."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(key, SETTINGS[key])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is made only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cohortlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, purpose: str) -> str:
    """A new path for one run in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"



def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, for frames read several times.

    A checkpoint keeps whole rows uncompressed; a reader of this one takes the columns it needs.
    """
    path = work_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
