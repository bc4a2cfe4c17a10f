"""Event topics as batch or streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(
    spark: SparkSession,
    fmt: str,
    options: dict[str, str],
    schema: StructType,
    streaming: bool = True,
) -> DataFrame:
    """Messages of a topic, from the earliest one.

    ``kafka`` decodes the JSON value and keeps key, topic, partition and offset;
    any other format is a file source read with the schema.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(fmt).options(**options)
    if fmt != "kafka":
        return reader.schema(schema).load()
    messages = reader.option("startingOffsets", "earliest").load()
    return parse_messages(messages, schema)


def parse_messages(messages: DataFrame, schema: StructType) -> DataFrame:
    """Key, topic, partition and offset columns with the decoded JSON value."""
    value = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(
        F.col("key").cast("string").alias("msg_key"),
        "topic",
        F.col("partition").alias("partition_id"),
        "offset",
        value.alias("_value"),
    ).select("msg_key", "topic", "partition_id", "offset", "_value.*")


def replay_events(
    messages: DataFrame,
    topic: str,
    after_offset: int = 0,
    limit: int = 50,
    partition_id: int = 0,
) -> DataFrame:
    """Messages after an offset, in offset order, without committing anything."""
    return (
        messages.where(
            (F.col("topic") == topic)
            & (F.col("partition_id") == partition_id)
            & (F.col("offset") > after_offset)
        )
        .orderBy("offset")
        .limit(limit)
    )
