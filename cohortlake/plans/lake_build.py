"""Bronze, silver and gold: the lake built from raw CSV files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Observation, SparkSession

from cohortlake.operators import lakehouse as L
from cohortlake.operators.quality import assert_table_exists
from cohortlake.schemas import TABLES
from cohortlake.sinks.tables import silver_passthrough, write_table
from cohortlake.sources.raw import (
    PANDAS_NULLS,
    read_raw,
    read_table,
    require,
    with_ingest_metadata,
    with_transform_time,
)


@dataclass
class BuildReport:
    """Rows read and kept per raw table, and the paths written."""

    bronze: dict[str, dict[str, int]] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)


def build_bronze(
    spark: SparkSession, raw: str, lake: str, null_tokens: tuple[str, ...] = PANDAS_NULLS
) -> BuildReport:
    """Typed bronze tables.  Rows are counted by the write itself."""
    report = BuildReport()
    for name, schema in TABLES.items():
        source = f"{raw}/{name}.csv"
        typed = with_ingest_metadata(read_raw(spark, source, schema, null_tokens), source)
        seen = Observation(f"bronze_{name}")
        kept = require(typed, schema.required, observation=seen)
        report.written.append(write_table(kept, lake, "bronze", name))
        report.bronze[name] = dict(seen.get)
    return report


def build_silver(spark: SparkSession, lake: str) -> list[str]:
    """The two facts, enriched patients, drug and trial summaries, and table copies.

    A missing or empty bronze table ends the build: the reader's fall back to raw files
    would give facts without ages or conditions.
    """
    for n in TABLES:
        assert_table_exists(spark, f"{lake}/bronze/{n}.parquet")
    t = {n: read_table(spark, lake, n) for n in TABLES}
    copies = silver_passthrough(
        spark, lake, tuple(n for n in TABLES if n != "patients")
    )
    made = {
        "patients": with_transform_time(L.silver_patients(t["patients"])),
        "patient_outcomes": L.patient_outcomes(
            t["outcomes"], t["patients"], t["trials"], t["medications"]
        ),
        "patient_outcomes_fact": with_transform_time(
            L.patient_outcomes_fact(t["outcomes"], t["enrollments"], t["patients"])
        ),
        "drug_effectiveness": L.drug_effectiveness_silver(t["outcomes"], t["medications"]),
        "trial_summary": L.trial_summary(t["outcomes"], t["enrollments"], t["trials"]),
    }
    return copies + [write_table(df, lake, "silver", n) for n, df in made.items()]


def build_gold(spark: SparkSession, lake: str) -> list[str]:
    """The four gold tables, read from the silver fact."""
    assert_table_exists(spark, f"{lake}/silver/patient_outcomes.parquet")
    fact = spark.read.parquet(f"{lake}/silver/patient_outcomes.parquet")
    patients = read_table(spark, lake, "patients", "silver")
    trials = read_table(spark, lake, "trials", "silver")
    made = {
        "population_kpis": L.population_kpis(fact, patients, trials),
        "drug_effectiveness": L.drug_effectiveness_gold(fact),
        "trial_kpis": L.trial_kpis(fact, trials=trials),
        "cohort_stats": L.cohort_stats(fact),
    }
    return [write_table(df, lake, "gold", n) for n, df in made.items()]


def build_lake(spark: SparkSession, raw: str, lake: str) -> BuildReport:
    report = build_bronze(spark, raw, lake)
    report.written += build_silver(spark, lake)
    report.written += build_gold(spark, lake)
    return report
