"""Structured Streaming over event topics.

Every sink writes a batch to a folder of its own and records it when it is whole (see
``batches``), so a restart after a lost node leaves no doubles and no halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from cohortlake.functions import columns as C
from cohortlake.operators.logs import LOG_ID, numbered_entries, stream_audit
from cohortlake.operators.matching import match_patients
from cohortlake.operators.outcomes import classify_events
from cohortlake.operators.records import restrict_to
from cohortlake.schemas import AUDIT_ENTRY
from cohortlake.session import settled
from cohortlake.streaming.batches import batch_record, finished_batches, read_batches, write_batch

BatchWriter = Callable[[DataFrame, int], None]


def with_event_time(events: DataFrame, column: str = "event_time") -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def classify_event_stream(events: DataFrame) -> DataFrame:
    """Stateless classification of lab events."""
    return classify_events(events)


def outcome_event_deltas(events: DataFrame) -> DataFrame:
    """Flattened outcome events with the change of the measured value."""
    baseline, followup = F.col("payload.baseline_value"), F.col("payload.followup_value")
    return events.select(
        "event_id",
        "patient_id",
        "trial_id",
        "event_type",
        F.col("payload.outcome_type").alias("outcome_type"),
        baseline.alias("baseline_value"),
        followup.alias("followup_value"),
        C.event_delta(baseline, followup).alias("delta"),
        F.try_to_timestamp("timestamp").alias("event_time"),
    )


def without_duplicates(events: DataFrame, delay: str = "1 hour", key: str = "event_id") -> DataFrame:
    """Drop redelivered events; state older than the delay is forgotten."""
    return (
        with_event_time(events)
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark([key])
    )


def stream_static_join(
    events: DataFrame, patients: DataFrame, trials: DataFrame | None = None
) -> DataFrame:
    """Events with the current patient row, and the trial row where an event names one."""
    people = patients.select("patient_id", "age", "gender", "conditions", "medications")
    joined = events.join(people, "patient_id", "left")
    if trials is not None:
        studies = trials.select("trial_id", "title", "phase", "condition")
        joined = joined.join(studies, "trial_id", "left")
    return joined


def latest_values(readings: DataFrame) -> DataFrame:
    """Newest value per patient and biomarker, in batch or as a streaming aggregate."""
    order = F.struct("event_time", "event_id")
    return readings.groupBy("patient_id", "biomarker").agg(
        F.max_by("value", order).alias("value"),
        F.max("event_time").alias("event_time"),
        F.max_by("event_id", order).alias("event_id"),
    )


# --- running -------------------------------------------------------------------------


def run_group(
    stream: DataFrame,
    group: str,
    checkpoints: str,
    write_batch: BatchWriter,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Start a consumer group's query.

    The group's checkpoint keeps its position: a new run goes on where the last one
    stopped, and other groups are not affected.
    """
    # The same name in every run, and another one for other checkpoints.
    digest = hashlib.sha256(checkpoints.encode()).hexdigest()[:12]
    writer = (
        stream.writeStream.queryName(f"{group}-{digest}")
        .option("checkpointLocation", f"{checkpoints.rstrip('/')}/{group}")
        .foreachBatch(write_batch)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def stream_outcomes_sink(path: str) -> BatchWriter:
    """Classified events into the silver streaming table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(classify_event_stream(batch), path, batch_id)

    return write


def audit_sink(path: str, order: str = "event_id") -> BatchWriter:
    """One audit entry per event, with ids that go on from the earlier batches.

    The record of a batch holds the last number given, so the next one reads no entries.
    """

    def last_before(spark: SparkSession, batch_id: int) -> int:
        record = batch_record(spark, path, batch_id - 1)
        if record is None:  # a table that began at another number, or a batch that is missing
            earlier = [b for b in finished_batches(spark, path) if b < batch_id]
            record = batch_record(spark, path, earlier[-1]) if earlier else None
        return record["last"] if record else 0

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = last_before(spark, batch_id)
        log = spark.range(1).select(F.format_string(LOG_ID, F.lit(last)).alias("log_id"))
        entries = settled(stream_audit(classify_event_stream(batch)))
        numbered = numbered_entries(log, entries, order)
        write_batch(numbered.select(*AUDIT_ENTRY.names), path, batch_id, last=last + entries.count())

    return write


def latest_values_sink(path: str) -> BatchWriter:
    """Newest readings of each batch; ``latest_values`` over the table merges them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_values(batch), path, batch_id)

    return write


READINGS = "patient_id string, biomarker string, value double, event_time timestamp, event_id string"


def compact_latest(spark: SparkSession, path: str, target: str) -> None:
    """Rewrite the batches of a latest-values table as one row per patient and biomarker."""
    latest_values(read_batches(spark, path, READINGS)).write.mode("overwrite").parquet(target)


def newest_readings(events: DataFrame) -> DataFrame:
    """For every patient with a reading in a batch all the newest readings known of them:
    ``patient_id, biomarker, value, event_time, event_id``.

    What is known of a patient is keyed state of the stream, kept with its checkpoint: a
    batch costs what its own patients ask for, however many batches there were.  Each task
    first keeps the newest readings of its own rows, so a patient with very many events is
    a few rows a task.  Readings without a value or a patient are none; older ones that
    come late change nothing; equal times are ordered by event id.  Events without a time
    come before all others, those without an id before those with one (as id 0 or empty).
    """
    columns = ["patient_id", "biomarker", "value", "event_time", "event_id"]
    of_id = events.schema["event_id"].dataType
    none = F.lit("" if isinstance(of_id, StringType) else 0).cast(of_id)
    rows = with_event_time(events).where(F.col("value").isNotNull() & F.col("patient_id").isNotNull()).select(
        "patient_id",
        "biomarker",
        F.col("value").cast("double").alias("value"),
        F.coalesce(F.unix_micros("event_time"), F.lit(-(1 << 62))).alias("event_time"),
        F.coalesce("event_id", none).alias("event_id"),
    )
    state = f"biomarker array<string>, value array<double>, event_time array<bigint>, event_id array<{of_id.simpleString()}>"

    def newest(frames: Iterable[pd.DataFrame], keys: list[str]) -> pd.DataFrame:
        both = pd.concat(list(frames), ignore_index=True)
        both = both.sort_values(["event_time", "event_id"], kind="stable")
        return both.drop_duplicates(keys, keep="last")

    def of_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield newest([frame], ["patient_id", "biomarker"])

    def update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(columns=columns[1:])
        if held.exists:
            known = pd.DataFrame(dict(zip(columns[1:], map(list, held.get))))
        for frame in frames:
            seen = frame[columns[1:]]
            known = newest([known, seen] if len(known) else [seen], ["biomarker"])
        held.update(tuple(known[c].tolist() for c in columns[1:]))
        yield known.assign(patient_id=key[0])[columns]

    merged = rows.mapInPandas(of_task, rows.schema).groupBy("patient_id")
    found = merged.applyInPandasWithState(update, rows.schema, state, "append", GroupStateTimeout.NoTimeout)
    when = F.when(F.col("event_time") > -(1 << 62), F.timestamp_micros("event_time"))
    return found.withColumn("event_time", when)


def rematch_sink(
    path: str,
    patients: DataFrame,
    trials: DataFrame,
    min_score: float = 31.0,
    limit: int = 20,
    labs: DataFrame | None = None,
) -> BatchWriter:
    """Match the patients of every batch again, with their newest readings.

    A batch holds all that is known of its patients, as ``newest_readings`` gives it, so no
    earlier batch is read.  The patients' own ``labs`` (patient_id, name, value) stand in
    for readings that have never come.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = settled(latest_values(batch.where(F.col("value").isNotNull())))
        people = newest.select("patient_id").distinct()
        held = newest.select(
            "patient_id", F.col("biomarker").alias("name"), "value", F.lit(0).alias("position")
        )
        if labs is not None:
            first = labs.join(people, "patient_id", "left_semi").select(
                "patient_id", "name", F.col("value").cast("double").alias("value"), F.lit(1).alias("position")
            )
            held = held.unionByName(first.join(held, ["patient_id", "name"], "left_anti"))
        found = match_patients(
            restrict_to(patients, people), trials, min_score, limit, observations=held
        )
        write_batch(found, path, batch_id)

    return write
