"""Lake tables, JSON exports and message sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(
    df: DataFrame, lake: str, layer: str, name: str, partition_by: tuple[str, ...] = ()
) -> str:
    """Overwrite a layer's Parquet table and return its path."""
    path = f"{lake}/{layer}/{name}.parquet"
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def silver_passthrough(spark: SparkSession, lake: str, names: tuple[str, ...]) -> list[str]:
    """Copy bronze tables unchanged to silver."""
    return [
        write_table(spark.read.parquet(f"{lake}/bronze/{n}.parquet"), lake, "silver", n)
        for n in names
    ]


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_messages(messages: DataFrame, servers: str) -> None:
    """Send keyed messages (topic, key, value) to Kafka."""
    (
        messages.select("topic", "key", "value")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .save()
    )
