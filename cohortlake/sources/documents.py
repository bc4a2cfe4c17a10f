"""Text documents, JSON logs and the file inventory of a lake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; bytes that are not UTF-8 are left out."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_name").alias("doc_id"),
            F.regexp_replace("value", "\ufffd", "").alias("text"),
        )
    )


def read_json_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of JSON-array files."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def layer_inventory(
    spark: SparkSession,
    lake: str,
    layers: Sequence[str] = ("raw", "bronze", "silver", "gold"),
    pattern: str = "*.{parquet,csv}",
) -> DataFrame:
    """Files and megabytes per layer.  Only the listing is read, never the content."""
    result = None
    for layer in layers:
        try:
            files = (
                spark.read.format("binaryFile")
                .option("recursiveFileLookup", True)
                .option("pathGlobFilter", pattern)
                .load(f"{lake}/{layer}")
                .select("length")
            )
        except AnalysisException:
            files = spark.createDataFrame([], "length long")
        row = files.agg(
            F.count(F.lit(1)).alias("files"),
            F.round(F.coalesce(F.sum("length"), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"),
        ).select(
            F.lit(layer).alias("layer"),
            "files",
            "size_mb",
            F.when(F.col("files") > 0, "HEALTHY").otherwise("EMPTY").alias("health"),
        )
        result = row if result is None else result.unionByName(row)
    return result
