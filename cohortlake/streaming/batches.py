"""Tables of stream batches with a log of the finished ones.

A batch is written to a folder of its own and exists once its record is in the log
(``_commits``, one small file a batch).  A batch that is run again gets a new folder; its
record then names that one, and the old folder goes.  So readers see whole batches only,
whatever a lost driver leaves behind, and what they need of one batch they find by its
number, without listing the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_commits"


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _record_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{LOG}/{batch_id}.json"


def batch_record(spark: SparkSession, path: str, batch_id: int) -> dict | None:
    """The record of a finished batch; None if it has not been finished."""
    place, fs = _place(spark, _record_path(path, batch_id))
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all finished batches, in order."""
    place, fs = _place(spark, f"{path.rstrip('/')}/{LOG}")
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def write_batch(df: DataFrame, path: str, batch_id: int, **facts) -> None:
    """Write a batch, or write it anew, and record it together with some facts."""
    spark = df.sparkSession
    before = batch_record(spark, path, batch_id)
    folder = f"batch_id={batch_id}/run={uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    record = _record_path(path, batch_id)
    written, fs = _place(spark, f"{record}.{uuid.uuid4().hex[:12]}")
    out = fs.create(written, True)
    out.write(bytearray(json.dumps({"folder": folder, **facts}).encode()))
    out.close()
    place, _ = _place(spark, record)
    fs.delete(place, False)
    if not fs.rename(written, place):
        raise OSError(f"could not record batch {batch_id} of {path}")
    if before:
        old, _ = _place(spark, f"{path.rstrip('/')}/{before['folder']}")
        fs.delete(old, True)


def read_batches(
    spark: SparkSession, path: str, schema, before: int | None = None, only: int | None = None
) -> DataFrame:
    """The rows of all finished batches with their ``batch_id``, of those before one, or of
    one alone; no rows when there are none."""
    wanted = [only] if only is not None else finished_batches(spark, path)
    records = [batch_record(spark, path, b) for b in wanted if before is None or b < before]
    folders = [f"{path.rstrip('/')}/{r['folder']}" for r in records if r]
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("int"))
    return spark.read.option("basePath", path).parquet(*folders).drop("run")
