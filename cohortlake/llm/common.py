"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.session import shared_dir, work_path

# Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared checkpoint folder.

    For narrow frames; Spark removes the files when the frame is gone and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """The same rows as a Parquet table in the shared folder (smaller than a checkpoint), and
    its path, for ``remove``."""
    path = work_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    return stored_at(df, purpose)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table of this run that nothing reads any more from the shared folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the frame does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_chunks(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to the limit at most (one item at least)."""
    start, total, end = 0, 0, 0
    for end, size in enumerate(sizes, 1):
        if total and total + size > limit:
            yield start, end - 1
            start, total = end - 1, 0
        total += size
    if end > start:
        yield start, end


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are gone.

    Its cleaner acts when the driver's JVM collects garbage, which it seldom does in a run
    that leaves most work to executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
