"""Event messages, offsets, audit entries and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.operators.skew import sequence_numbers

# First offset of a topic and the id formats.
FIRST_OFFSET = 1001
EVENT_ID = "EVT-%05d"
LOG_ID = "AUD-%04d"

def to_event_messages(
    outcomes: DataFrame, topic: str = "patient.events", emitted_at: Column | None = None
) -> DataFrame:
    """Outcome rows (unique by outcome_id) as keyed JSON messages, numbered by date.

    Rows of one day are ordered by the digest of their id.
    """
    keyed = outcomes.withColumns(
        {"_day": C.to_date("measurement_date"), "_digest": F.md5("outcome_id")}
    )
    numbered = sequence_numbers(keyed, "_n", order=["_day", "_digest", "outcome_id"], unique=True)
    payload = F.struct(
        "outcome_type", "baseline_value", "followup_value", "change", "response_status"
    )
    when = F.current_timestamp() if emitted_at is None else emitted_at
    event = F.struct(
        F.format_string(EVENT_ID, "_n").alias("event_id"),
        "patient_id",
        "trial_id",
        F.lit("OUTCOME_RECORDED").alias("event_type"),
        payload.alias("payload"),
        when.cast("string").alias("timestamp"),
    )
    return numbered.select(
        F.lit(topic).alias("topic"),
        F.col("patient_id").alias("key"),
        F.to_json(event, {"ignoreNullFields": "false"}).alias("value"),
    )


def assign_offsets(
    events: DataFrame,
    order: str = "event_id",
    groups: Sequence[str] = ("topic", "partition_id"),
    existing: DataFrame | None = None,
) -> DataFrame:
    """Monotonic offsets per topic and partition, the first being 1001.

    With ``existing`` messages the numbering goes on after their largest offset.
    ``order`` is a unique whole number.
    """
    numbered = sequence_numbers(events, "offset", [order], groups, start=0, unique=True)
    if existing is None:
        return numbered.withColumn("offset", F.col("offset") + FIRST_OFFSET)
    latest = existing.groupBy(*groups).agg((F.max("offset") + 1).alias("_next"))
    return (
        numbered.join(latest, list(groups), "left")
        .withColumn("offset", F.col("offset") + F.coalesce("_next", F.lit(FIRST_OFFSET)))
        .drop("_next")
    )


def topic_metrics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("topic", "partition_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("offset").alias("latest_offset")
    )


def consumer_lag(messages: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages a consumer group has not committed yet, per topic and partition."""
    return (
        topic_metrics(messages)
        .join(committed, ["topic", "partition_id"], "left")
        .withColumn(
            "lag",
            F.when(F.col("committed_offset").isNull(), F.col("message_count")).otherwise(
                F.greatest(F.col("latest_offset") - F.col("committed_offset"), F.lit(0))
            ),
        )
    )


def log_number(log_id: Column | str) -> Column:
    return F.regexp_extract(log_id, r"(\d+)$", 1).try_cast("long")


def numbered_entries(
    log: DataFrame, new_rows: DataFrame, order: str, entry_type: str = "runtime"
) -> DataFrame:
    """New entries with the next free ids.  ``order`` is a unique whole number."""
    last = log.agg(F.coalesce(F.max(log_number("log_id")), F.lit(0))).scalar()
    numbered = sequence_numbers(new_rows, "_n", [order], unique=True)
    return numbered.withColumns(
        {
            "log_id": F.format_string(LOG_ID, F.col("_n") + last),
            "entry_type": F.lit(entry_type),
        }
    ).drop("_n")


def append_log(log: DataFrame, new_rows: DataFrame, order: str) -> DataFrame:
    """The log with the new entries; ``recent_entries`` reads it newest first."""
    entries = numbered_entries(log, new_rows, order).select(*log.columns)
    return log.unionByName(entries)


def stream_audit(classified: DataFrame) -> DataFrame:
    """Audit columns of classified stream events."""
    reading = F.concat_ws(
        "", "biomarker", F.lit("="), F.col("value").cast("string"), F.coalesce("unit", F.lit(""))
    )
    return classified.select(
        "event_id",
        F.col("event_time").cast("string").alias("timestamp"),
        F.lit("system.stream").alias("user"),
        F.lit("Streaming").alias("role"),
        F.lit("STREAM_EVENT_INGEST").alias("action"),
        F.concat(F.lit("Patient "), "patient_id", F.lit(" / "), "topic").alias("resource"),
        F.lit("PROCESSED").alias("status"),
        F.lit("event-stream").alias("model_version"),
        F.concat(reading, F.lit(" -> "), F.col("response_class")).alias("details"),
    )


def recent_entries(log: DataFrame, n: int = 50) -> DataFrame:
    """Newest entries, by number."""
    return log.orderBy(log_number("log_id").desc()).limit(n)


def recent_runs(runs: DataFrame, cap: int = 100) -> DataFrame:
    """The newest run records, as many as the history keeps."""
    return runs.orderBy(F.desc("execution_date"), F.desc("run_id")).limit(cap)


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run record per job."""
    fields = [c for c in runs.columns if c != "dag_id"]
    newest = F.max_by(F.struct(*fields), F.struct("execution_date", "run_id"))
    return runs.groupBy("dag_id").agg(newest.alias("_run")).select("dag_id", "_run.*")
