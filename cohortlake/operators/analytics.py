"""Population, trial and drug statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import values as V
from cohortlake.operators.records import trials_with_conditions
from cohortlake.operators.skew import exact_quantile


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    return C.rounded(F.try_divide(part, whole) * 100, digits)


def response_distribution(outcomes: DataFrame, digits: int | None = 1) -> DataFrame:
    """Outcomes and share per response status; null counts as Unknown."""
    status = F.coalesce("response_status", F.lit(V.UNKNOWN)).alias("response_status")
    counts = outcomes.groupBy(status).agg(F.count(F.lit(1)).alias("outcomes"))
    total = F.sum("outcomes").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", percent(F.col("outcomes"), total, digits))


def positive_response_rate(outcomes: DataFrame, digits: int | None = 1) -> DataFrame:
    return outcomes.agg(
        percent(F.count_if(C.responded()), F.count(F.lit(1)), digits).alias("positive_rate")
    )


def last_response_per_patient(outcomes: DataFrame) -> DataFrame:
    """Status of the latest outcome (by date, then id) of every patient."""
    order = F.struct("measurement_date", "outcome_id")
    return outcomes.groupBy("patient_id").agg(
        F.max_by("response_status", order).alias("response_status")
    )


def patient_conditions(patients: DataFrame) -> DataFrame:
    """Distinct (patient, condition) rows."""
    listed = F.explode(F.array_distinct(C.parse_list("conditions")))
    return patients.select("patient_id", listed.alias("condition"))


def condition_trial_counts(trials: DataFrame) -> DataFrame:
    listed = trials.select(F.explode(C.parse_list("condition")).alias("condition"))
    return listed.groupBy("condition").agg(F.count(F.lit(1)).alias("trials"))


def conditions_with_trials(conditions: DataFrame, trials: DataFrame) -> DataFrame:
    """Condition rows with the number of trials; zero when there is none."""
    return conditions.join(condition_trial_counts(trials), "condition", "left").fillna(
        0, ["trials"]
    )


def top_conditions(
    patients: DataFrame,
    outcomes: DataFrame,
    trials: DataFrame,
    k: int = 8,
    digits: int | None = 1,
) -> DataFrame:
    """Commonest conditions: patients, responders by last outcome, trials."""
    last = last_response_per_patient(outcomes)
    counted = (
        patient_conditions(patients)
        .join(last, "patient_id", "left")
        .groupBy("condition")
        .agg(
            F.countDistinct("patient_id").alias("patients"),
            F.count_if(C.responded()).alias("responders"),
        )
        .orderBy(F.desc("patients"), "condition")
        .limit(k)
    )
    return conditions_with_trials(counted, trials).withColumn(
        "response_rate", percent(F.col("responders"), F.col("patients"), digits)
    )


def drug_response_counts(
    medications: DataFrame,
    outcomes: DataFrame,
    group: str = "drug_class",
    keys: tuple[str, ...] = ("patient_id",),
) -> DataFrame:
    """What an inner join of medications and outcomes on ``keys`` would sum up to.

    Both sides are counted per key first, and the counts multiplied: a key with m
    medications and n outcomes costs one row per group, not m * n.
    """
    on = list(keys)
    drugs = (
        medications.where(~C.blank(group)).groupBy(*on, group).agg(F.count(F.lit(1)).alias("_m"))
    )
    results = outcomes.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(C.responded()).alias("_pos"),
        F.count("change").alias("_n_change"),
        F.sum("change").alias("_change"),
        F.count_if(F.col("treatment_completed")).alias("_done"),
        F.count_if(C.has_adverse_event()).alias("_ae"),
    )

    def times(c: str) -> Column:
        return F.sum(F.col("_m") * F.col(c))

    return (
        drugs.join(results, on)
        .groupBy(group)
        .agg(
            times("_n").alias("sample_size"),
            times("_pos").alias("responders"),
            times("_n_change").alias("change_count"),
            times("_change").alias("change_sum"),
            times("_done").alias("completed"),
            times("_ae").alias("adverse_events"),
        )
    )


def drug_class_effectiveness(
    medications: DataFrame, outcomes: DataFrame, digits: int | None = 1
) -> DataFrame:
    """Per drug class: pairs of medication and outcome, responders, rate."""
    counts = drug_response_counts(medications, outcomes)
    return counts.select(
        "drug_class",
        "sample_size",
        "responders",
        percent(F.col("responders"), F.col("sample_size"), digits).alias("response_rate"),
    ).orderBy(F.desc("response_rate"), "drug_class")


def indication(drug_class: Column) -> Column:
    result = F.lit(V.DEFAULT_INDICATION)
    for fragments, label in reversed(V.INDICATIONS):
        result = F.when(C.contains_any(drug_class, fragments), label).otherwise(result)
    return result


def adverse_event_counts(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Occurrences of each adverse-event text, optionally per key."""
    return (
        outcomes.where(C.has_adverse_event())
        .groupBy(*by, F.col("adverse_events").alias("event"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def top_adverse_events(
    outcomes: DataFrame, k: int = 5, by: tuple[str, ...] = (), digits: int | None = 1
) -> DataFrame:
    """The k commonest adverse events (per key) with their share of all outcomes."""
    counts = adverse_event_counts(outcomes, by)
    totals = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    keys = list(by) or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("occurrences"), "event"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    if by:
        top = top.join(totals, list(by))
        total = F.col("_total")
    else:
        total = totals.scalar()
    return top.withColumn("prevalence_pct", percent(F.col("occurrences"), total, digits)).drop(
        "_total"
    )


def medication_effectiveness(
    medications: DataFrame,
    outcomes: DataFrame,
    drug_class: str | None = None,
    digits: bool = True,
) -> DataFrame:
    """Per drug class: sample, rates, mean change, top two adverse events, indication."""
    if drug_class:
        medications = medications.where(C.has_word("drug_class", drug_class))
    one, two = (1, 2) if digits else (None, None)
    counts = drug_response_counts(medications, outcomes)
    events = _class_adverse_events(medications, outcomes)
    total = F.col("sample_size")
    names = F.transform(
        F.slice(F.sort_array("_events"), 1, 2),
        lambda e: F.concat(
            e["event"],
            F.lit(" ("),
            F.format_number(e["occurrences"] * -100 / total, 1),
            F.lit("%)"),
        ),
    )
    return (
        counts.join(events, "drug_class", "left")
        .select(
            "drug_class",
            "sample_size",
            percent(F.col("responders"), total, one).alias("response_rate"),
            C.rounded(F.try_divide("change_sum", "change_count"), two).alias("mean_change"),
            percent(F.col("completed"), total, one).alias("completion_rate"),
            F.least(F.lit(100.0), percent(F.col("adverse_events"), total, one)).alias(
                "adverse_event_rate"
            ),
            F.coalesce(names, F.array(F.lit("None reported"))).alias("common_adverse_events"),
            indication(F.col("drug_class")).alias("primary_indication"),
        )
        .orderBy(F.desc("response_rate"), "drug_class")
    )


def _class_adverse_events(medications: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The two commonest events of each class, as an array of (-count, event)."""
    drugs = (
        medications.where(~C.blank("drug_class"))
        .groupBy("patient_id", "drug_class")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    counts = (
        drugs.join(adverse_event_counts(outcomes, ("patient_id",)), "patient_id")
        .groupBy("drug_class", "event")
        .agg((-F.sum(F.col("_m") * F.col("occurrences"))).alias("occurrences"))
    )
    rank = F.row_number().over(Window.partitionBy("drug_class").orderBy("occurrences", "event"))
    return (
        counts.withColumn("_rank", rank)
        .where(F.col("_rank") <= 2)
        .groupBy("drug_class")
        .agg(F.collect_list(F.struct("occurrences", "event")).alias("_events"))
    )


def effectiveness_leaders(effectiveness: DataFrame) -> DataFrame:
    """One row: the classes with the best response and completion, and the total sample."""
    by_response = F.struct(F.col("response_rate"), F.col("drug_class"))
    by_completion = F.struct(F.col("completion_rate"), F.col("drug_class"))
    return effectiveness.agg(
        F.max_by("drug_class", by_response).alias("best_response_class"),
        F.max("response_rate").alias("best_response_rate"),
        F.max_by("drug_class", by_completion).alias("best_completion_class"),
        F.max("completion_rate").alias("best_completion_rate"),
        F.sum("sample_size").alias("total_sample"),
    )


def phase_distribution(trials: DataFrame, digits: int | None = 1) -> DataFrame:
    counts = (
        trials.groupBy("phase")
        .agg(F.count("phase").alias("trials"), F.count(F.lit(1)).alias("_rows"))
    )
    total = F.sum("_rows").over(Window.partitionBy(F.lit(0)))
    return (
        counts.withColumn("pct", percent(F.col("trials"), total, digits))
        .where(F.col("phase").isNotNull())
        .drop("_rows")
    )


def enrollment_trend(enrollments: DataFrame, outcomes: DataFrame, months: int = 12) -> DataFrame:
    """Enrolments and outcomes per month, the last months that have either."""

    def monthly(df: DataFrame, date: str, name: str, other: str) -> DataFrame:
        month = F.trunc(C.to_date(date), "month").alias("month")
        return (
            df.select(month)
            .where(F.col("month").isNotNull())
            .groupBy("month")
            .agg(F.count(F.lit(1)).alias(name))
            .withColumn(other, F.lit(0).cast("long"))
        )

    both = monthly(enrollments, "enrollment_date", "enrolments", "outcomes").unionByName(
        monthly(outcomes, "measurement_date", "outcomes", "enrolments")
    )
    return (
        both.groupBy("month")
        .agg(F.sum("enrolments").alias("enrolments"), F.sum("outcomes").alias("outcomes"))
        .orderBy(F.desc("month"))
        .limit(months)
    )


def trial_performance(
    trials: DataFrame, enrollments: DataFrame, outcomes: DataFrame, digits: bool = True
) -> DataFrame:
    """Per trial: enrolment, completion, dropout, response, median change, events."""
    one, two = (1, 2) if digits else (None, None)
    status = F.upper("status")
    enrolled = enrollments.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("total_enrolled"),
        F.count_if(status == "COMPLETED").alias("total_completed"),
        F.count_if(status.isin(*V.WITHDRAWN_STATUSES)).alias("_withdrawn"),
    )
    measured = outcomes.groupBy("trial_id").agg(
        percent(F.count_if(C.responded()), F.count(F.lit(1)), one).alias("response_rate"),
        F.count_if(~C.blank("adverse_events")).alias("adverse_events_count"),
    )
    medians = exact_quantile(outcomes, ["trial_id"], "change", 0.5, "_median")
    return (
        trials.select("trial_id", "title", "phase")
        .join(enrolled, "trial_id", "left")
        .join(measured, "trial_id", "left")
        .join(medians, "trial_id", "left")
        .select(
            "trial_id",
            "title",
            "phase",
            F.coalesce("total_enrolled", F.lit(0)).alias("total_enrolled"),
            F.coalesce("total_completed", F.lit(0)).alias("total_completed"),
            percent(F.col("_withdrawn"), F.col("total_enrolled"), one).alias("dropout_rate"),
            "response_rate",
            C.rounded(F.col("_median"), two).alias("median_change"),
            F.coalesce("adverse_events_count", F.lit(0)).alias("adverse_events_count"),
        )
    )


def trial_outcome_rates(
    enrollments: DataFrame, outcomes: DataFrame, digits: bool = True
) -> DataFrame:
    """Per trial with outcomes: enrolment counts and the shares of each outcome kind."""
    one, two = (1, 2) if digits else (None, None)
    enrolled = enrollments.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("total_enrolled"),
        F.count_if(F.col("status") == "COMPLETED").alias("total_completed"),
    )
    total, status = F.count(F.lit(1)), F.col("response_status")
    unknown = F.coalesce(status, F.lit(V.UNKNOWN)) == V.UNKNOWN
    measured = outcomes.groupBy("trial_id").agg(
        percent(F.count_if(C.responded()), total, one).alias("response_rate"),
        percent(F.count_if(status.isin(V.NO_RESPONSE, V.WORSENED)), total, one).alias(
            "no_response_rate"
        ),
        percent(F.count_if(unknown), total, one).alias("unknown_rate"),
        C.rounded(F.avg("change"), two).alias("avg_outcome_change"),
    )
    joined = measured.join(enrolled, "trial_id", "left").fillna(
        0, ["total_enrolled", "total_completed"]
    )
    return joined.withColumn(
        "total_withdrawn", F.col("total_enrolled") - F.col("total_completed")
    )


def enrollment_phase_join(enrollments: DataFrame, trials: DataFrame) -> DataFrame:
    return enrollments.join(trials.select("trial_id", "phase"), "trial_id", "left")


def completion_by_phase(
    enrollments: DataFrame, trials: DataFrame, digits: int | None = 1
) -> DataFrame:
    """Completed and total enrolments per phase.

    Enrolments are counted per trial before the join, which then has one row per trial.
    """
    done = F.col("status").isin(*V.COMPLETED_SPELLINGS)
    per_trial = enrollments.groupBy("trial_id").agg(
        F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total_enrolled")
    )
    return (
        enrollment_phase_join(per_trial, trials)
        .where(~C.blank("phase"))
        .groupBy("phase")
        .agg(
            F.sum("completed").alias("completed"), F.sum("total_enrolled").alias("total_enrolled")
        )
        .withColumn(
            "completion_rate", percent(F.col("completed"), F.col("total_enrolled"), digits)
        )
    )


def top_trials_by_enrollment(enrollments: DataFrame, k: int = 10) -> DataFrame:
    return (
        enrollments.groupBy("trial_id")
        .agg(F.count(F.lit(1)).alias("enrollments"))
        .orderBy(F.desc("enrollments"), "trial_id")
        .limit(k)
    )


def dataset_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts, one row per table."""
    result = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(name).alias("dataset"), "records"
        )
        result = row if result is None else result.unionByName(row)
    return result


def trial_response_rates(outcomes: DataFrame, digits: int | None = 1) -> DataFrame:
    return outcomes.groupBy("trial_id").agg(
        percent(F.count_if(C.responded()), F.count(F.lit(1)), digits).alias("response_rate")
    )


@dataclass(frozen=True)
class CohortFilter:
    """Typed filters of a cohort slice; empty values do not filter."""

    conditions: tuple[str, ...] = ()
    drugs: tuple[str, ...] = ()
    min_age: int | None = None
    min_baseline: float | None = None
    phase: str | None = None


def _condition_test(c: str, names: tuple[str, ...]) -> Column:
    """Any name, up to its first slash, inside the condition text."""
    return C.any_of(C.has_word(c, n.split("/")[0].strip()) for n in names)


def slice_patients(patients: DataFrame, wanted: CohortFilter) -> DataFrame:
    if wanted.conditions:
        patients = patients.where(_condition_test("conditions", wanted.conditions))
    if wanted.min_age:
        patients = patients.where(F.col("age") >= wanted.min_age)
    return patients


def cohort_slice(
    patients: DataFrame, outcomes: DataFrame, medications: DataFrame, wanted: CohortFilter
) -> DataFrame:
    """Outcomes of the patients that pass the filters.

    A patient or drug filter that matches nobody at all leaves the slice as it is.
    """
    rows = outcomes
    if wanted.conditions or wanted.min_age:
        rows = _members_or_all(rows, slice_patients(patients, wanted))
    if wanted.min_baseline:
        rows = rows.where(F.col("baseline_value") >= wanted.min_baseline)
    if wanted.drugs:
        drugs = C.any_of(C.has_word("drug_class", d) for d in wanted.drugs)
        rows = _members_or_all(rows, medications.where(drugs))
    return rows


def _members_or_all(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the given patients, or all rows when there are none."""
    ids = members.select("patient_id").distinct()
    nobody = ids.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    flagged = rows.join(ids.withColumn("_member", F.lit(True)), "patient_id", "left")
    return flagged.where(F.col("_member") | nobody).drop("_member")


def slice_summary(rows: DataFrame, digits: bool = True) -> DataFrame:
    """One row: size, responders, rate and exact median change of a slice."""
    one, two = (1, 2) if digits else (None, None)
    median = exact_quantile(rows, [], "change", 0.5, "median_change")
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("slice_size"),
        F.count_if(C.responded()).alias("responders"),
        percent(F.count_if(C.responded()), total, one).alias("response_rate"),
    ).withColumn("median_change", C.rounded(median.scalar(), two))


def matching_trials(trials: DataFrame, wanted: CohortFilter) -> DataFrame:
    """One row: the number of trials for the filter's conditions and phase."""
    found = trials_with_conditions(trials).where(_condition_test("condition", wanted.conditions))
    if wanted.phase:
        found = found.where(C.has_word("phase", wanted.phase))
    return found.agg(F.count(F.lit(1)).alias("matching_trials"))
