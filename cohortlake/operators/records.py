"""Lookups, searches, overlays and membership over record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions.columns import has_word, parse_list


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Records whose key equals a value; the test reaches the scan."""
    return df.where(F.col(key) == value)


def find_by_condition(
    df: DataFrame, condition: str, conditions: Column, order_by: str, limit: int = 100
) -> DataFrame:
    """Records whose condition array holds exactly this condition."""
    return df.where(F.array_contains(conditions, condition)).orderBy(order_by).limit(limit)


def trials_with_conditions(trials: DataFrame) -> DataFrame:
    """Trials with their target conditions as an array."""
    return trials.withColumn("conditions", parse_list("condition"))


def search_trials(trials: DataFrame, phase: str = "ALL", text: str = "") -> DataFrame:
    """Trials of a phase whose title, id or any condition contains the text."""
    found = trials_with_conditions(trials)
    if phase != "ALL":
        found = found.where(F.col("phase") == phase)
    if text:
        found = found.where(
            has_word("title", text)
            | has_word("trial_id", text)
            | F.exists("conditions", lambda c: F.lower(c).contains(text.lower()))
        )
    return found


def filter_drug_class(df: DataFrame, text: str) -> DataFrame:
    return df.where(has_word("drug_class", text))


def list_records(df: DataFrame, key: str, limit: int = 100) -> DataFrame:
    return df.orderBy(key).limit(limit)


def investigational_only(medications: DataFrame) -> DataFrame:
    return medications.where(F.col("is_investigational"))


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows whose key is in a set of ids."""
    return df.join(ids.select(key), key, "left_semi")


def new_records_only(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new; rows without a key are always new."""
    known = existing.where(F.col(key).isNotNull()).select(key)
    return incoming.join(known, key, "left_anti")


def import_report(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: parsed, created and skipped records of an import."""
    known = existing.where(F.col(key).isNotNull()).select(key).distinct()
    flagged = incoming.select(key).join(known.withColumn("_known", F.lit(1)), key, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_parsed"),
        F.count_if(F.col("_known").isNull()).alias("created"),
        F.count("_known").alias("skipped_duplicate"),
    )


def apply_mutations(
    base: DataFrame, upserts: DataFrame, deletes: DataFrame, key: str
) -> DataFrame:
    """The base table with upserts laid over it and deleted keys removed."""
    kept = base.join(upserts.select(key), key, "left_anti")
    return kept.unionByName(upserts).join(deletes.select(key), key, "left_anti")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows repeat an id seen before (null counts as one id)."""
    distinct = F.countDistinct(key) + F.max(F.col(key).isNull().cast("long"))
    return df.agg((F.count(F.lit(1)) - distinct).alias("duplicates"))


def metric_rows(wide: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """A one-row frame of measures as (metric, value) rows."""
    names = list(metrics or wide.columns)
    doubles = wide.select(*[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([], names, "metric", "value")


def distinct_sorted(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sorted distinct values per key; duplicates go before the lists are built."""
    distinct = df.where(F.trim(value) != "").select(key, F.trim(value).alias(value)).distinct()
    return distinct.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


def with_new_or_all(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """Ordered rows, cut when a limit is given."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)
