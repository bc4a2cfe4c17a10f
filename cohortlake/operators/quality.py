"""Data-quality report, factor associations, drift and completeness measures, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.operators.records import metric_rows
from cohortlake.operators.skew import exact_quantile

# Valid ranges.
BASELINE_RANGE = (4.0, 15.0)
AGE_RANGE = (18, 90)


class QualityGateError(AssertionError):
    """A table did not pass a gate."""


def _nulls(df: DataFrame) -> Column:
    total = F.lit(0)
    for c in df.columns:
        total = total + F.count_if(F.col(c).isNull())
    return total.alias("nulls")


def quality_measures(
    patients: DataFrame,
    trials: DataFrame,
    outcomes: DataFrame,
    enrollments: DataFrame,
    medications: DataFrame,
    outcome_type: str | None = None,
) -> DataFrame:
    """One row of raw counts, each table read once.

    ``outcome_type`` restricts the baseline range check; by default it applies to
    every outcome.
    """
    rows = F.count(F.lit(1)).alias("rows")
    baseline, age = F.col("baseline_value"), F.col("age")
    ranged = F.lit(True) if outcome_type is None else F.col("outcome_type") == outcome_type
    start, end = C.to_date("start_date"), C.to_date("end_date")
    no_id = F.max(F.col("patient_id").isNull().cast("long"))
    parts = {
        "patients": patients.agg(
            rows,
            _nulls(patients),
            F.count("age").alias("age_total"),
            F.count_if((age < AGE_RANGE[0]) | (age > AGE_RANGE[1])).alias("age_violations"),
            (
                F.count(F.lit(1)) - F.countDistinct("patient_id") - F.coalesce(no_id, F.lit(0))
            ).alias("duplicate_patients"),
        ),
        "trials": trials.agg(rows, _nulls(trials)),
        "outcomes": outcomes.agg(
            rows,
            _nulls(outcomes),
            F.count_if(ranged & baseline.isNotNull()).alias("baseline_total"),
            F.count_if(
                ranged & ((baseline < BASELINE_RANGE[0]) | (baseline > BASELINE_RANGE[1]))
            ).alias("baseline_violations"),
            F.count_if(F.col("followup_value").isNull()).alias("followup_missing"),
        ),
        "enrollments": enrollments.agg(rows, _nulls(enrollments)),
        "medications": medications.agg(
            rows,
            _nulls(medications),
            F.count_if(start.isNotNull() & end.isNotNull()).alias("date_total"),
            F.count_if(end < start).alias("date_violations"),
        ),
    }
    # Five one-row frames side by side: each is one scalar of named fields.
    result = None
    for name, df in parts.items():
        fields = df.select(F.struct(*df.columns).alias(name))
        if result is None:
            result = fields
        else:
            result = result.withColumn(name, fields.scalar())
    flat = [
        F.col(f"{name}.{c}").alias(f"{name}_{c}" if c in ("rows", "nulls") else c)
        for name, df in parts.items()
        for c in df.columns
    ]
    names = list(parts)
    totals = result.select(*flat).withColumns(
        {
            "total_records": sum((F.col(f"{n}_rows") for n in names), F.lit(0)),
            "total_nulls": sum((F.col(f"{n}_nulls") for n in names), F.lit(0)),
        }
    )
    violations = F.lit(0)
    for c in (
        "total_nulls", "baseline_violations", "age_violations", "date_violations",
        "followup_missing", "duplicate_patients",
    ):
        violations = violations + F.col(c)
    return totals.withColumn("total_violations", violations)


def quality_score(measures: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row: score, band and valid records."""
    total = F.col("total_records")
    share = F.greatest(F.lit(0), total - F.col("total_violations")) / F.greatest(F.lit(1), total)
    score = C.rounded(share * 100, digits)
    return measures.select(
        score.alias("overall_quality_score"),
        F.when(score >= 90, "EXCELLENT")
        .when(score >= 75, "GOOD")
        .otherwise("NEEDS_REVIEW")
        .alias("quality_status"),
        F.col("total_records").alias("total_records_audited"),
        F.greatest(F.lit(0), total - F.col("total_violations")).alias("valid_records"),
        F.col("total_nulls").alias("total_null_fields"),
    )


# Check name, violations, rows checked, status when violated.
CHECKS = (
    ("Biomarker Range Validity (HbA1c 4.0–15.0%)", "baseline_violations", "baseline_total", "FLAGGED"),
    ("Age Boundaries (18–90 yrs)", "age_violations", "age_total", "FLAGGED"),
    ("Medication End Date ≥ Start Date", "date_violations", "date_total", "FLAGGED"),
    ("Longitudinal Follow-up Completeness", "followup_missing", "outcomes_rows", "WARNING"),
    ("Duplicate Patient ID Detection", "duplicate_patients", "patients_rows", "FLAGGED"),
)


def integrity_checks(measures: DataFrame, digits: int | None = 1) -> DataFrame:
    """One row per check: violations, rows checked, pass rate in percent, status."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("check"),
                F.when(F.col(bad) == 0, "PASSED").otherwise(status).alias("status"),
                F.col(bad).alias("violations"),
                F.col(total).alias("checked"),
                C.rounded(F.try_divide(F.col(total) - F.col(bad), F.col(total)) * 100, digits).alias(
                    "pass_rate"
                ),
            )
            for name, bad, total, status in CHECKS
        ]
    )
    return measures.select(F.inline(rows))


def data_quality_report(
    patients: DataFrame,
    trials: DataFrame,
    outcomes: DataFrame,
    enrollments: DataFrame,
    medications: DataFrame,
    digits: int | None = 1,
) -> DataFrame:
    """The integrity checks with the overall score and band on every row."""
    measures = quality_measures(patients, trials, outcomes, enrollments, medications)
    scored = quality_score(measures, digits).select(F.struct("*").alias("s"))
    return integrity_checks(measures, digits).withColumn("overall", scored.scalar())


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per required column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "nulls"
    )


def delta_completeness(outcomes: DataFrame) -> DataFrame:
    """Outcomes with both values, and the strong responders."""
    both = F.col("baseline_value").isNotNull() & F.col("followup_value").isNotNull()
    return outcomes.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(both).alias("deltas_computed"),
        F.count_if(F.col("response_status") == "Strong Response").alias("strong_responders"),
    )


def criteria_coverage(trials: DataFrame) -> DataFrame:
    """Non-null cells of all columns about criteria or conditions."""
    columns = [c for c in trials.columns if "criteria" in c.lower() or "condition" in c.lower()]
    return trials.agg(
        F.count(F.lit(1)).alias("trials"),
        sum((F.count(c) for c in columns), F.lit(0)).alias("criteria_cells"),
    )


def age_drift_score(patients: DataFrame, digits: int | None = 4) -> DataFrame:
    """A tenth of the relative spread of age; flagged above 0.1."""
    spread = F.coalesce(F.stddev_samp("age"), F.lit(0.0))
    score = C.rounded(spread / F.greatest(F.avg("age"), F.lit(1.0)) * 0.1, digits)
    return patients.agg(score.alias("drift_score")).withColumn(
        "drift_detected", F.col("drift_score") > 0.1
    )


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs without nulls."""
    return df.agg(F.countDistinct(a, b).alias("distinct_pairs"))


def drug_response_pairs(
    outcomes: DataFrame, medications: DataFrame, keys: Sequence[str] = ("patient_id", "trial_id")
) -> DataFrame:
    """Distinct drug-class and response pairs that occur together on the keys.

    Each side is made distinct before the join, which then has at most one row per
    class and response of a key.
    """
    drugs = medications.select(*keys, "drug_class").distinct()
    results = outcomes.select(*keys, "response_status").distinct()
    return distinct_pairs(drugs.join(results, list(keys)), "drug_class", "response_status")


def non_response_factors(
    outcomes: DataFrame, medications: DataFrame, patients: DataFrame, digits: int | None = 1
) -> DataFrame:
    """Weak responses among severe, many-drug and elderly patients.

    Everything that is not a strong or moderate response counts, also unknown ones.
    """
    limit = exact_quantile(outcomes, [], "baseline_value", 0.75, "limit")
    drugs = medications.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_drugs"))
    many = drugs.where(F.col("_drugs") >= 3).select("patient_id", F.lit(True).alias("_many"))
    elderly = patients.where(F.col("age") >= 65).select("patient_id", F.lit(True).alias("_old"))
    # One count per patient and severity before the joins: at most two rows a patient.
    severe = F.coalesce(F.col("baseline_value") > limit.scalar(), F.lit(False))
    per_patient = outcomes.groupBy("patient_id", severe.alias("_severe")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~C.responded()).alias("_weak")
    )
    flagged = per_patient.join(many, "patient_id", "left").join(
        elderly.distinct(), "patient_id", "left"
    )

    def measure(test: Column, name: str) -> list[Column]:
        return [
            F.coalesce(F.sum(F.when(test, F.col("_weak"))), F.lit(0)).alias(f"{name}_weak"),
            F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0)).alias(f"{name}_all"),
        ]

    # Factor names and association labels.
    factors = (
        ("severe", "High Baseline Disease Severity (top 25th percentile)", "High"),
        ("many", "Polypharmacy (≥3 concurrent medications)", "Moderate"),
        ("old", "Age ≥ 65 years", "Moderate"),
    )
    wide = flagged.agg(*[m for key, _, _ in factors for m in measure(F.col(f"_{key}"), key)])
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("factor"),
                F.lit(label).alias("association"),
                F.col(f"{key}_weak").alias("patients_affected"),
                F.col(f"{key}_all").alias("group_size"),
                C.rounded(
                    F.col(f"{key}_weak") / F.greatest(F.lit(1), F.col(f"{key}_all")) * 100, digits
                ).alias("non_response_pct"),
            )
            for key, name, label in factors
        ]
    )
    return wide.select(F.inline(rows))


# --- gates -------------------------------------------------------------------------


def assert_non_empty(df: DataFrame, name: str = "table") -> DataFrame:
    if df.isEmpty():
        raise QualityGateError(f"{name} has no rows")
    return df


def assert_table_exists(spark: SparkSession, path: str) -> None:
    """The table's schema can be read."""
    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        raise QualityGateError(f"no table at {path}") from None


def report_model_metrics(metrics: DataFrame) -> DataFrame:
    """Saved model metrics as (metric, value) rows."""
    if set(metrics.columns) == {"metric", "value"}:
        return metrics
    return metric_rows(metrics)
