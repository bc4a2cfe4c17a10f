"""Silver facts and gold aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.operators.records import investigational_only, metric_rows
from cohortlake.session import join_where_dealt


def silver_patients(patients: DataFrame) -> DataFrame:
    """Patients with age bucket, list counts and flags."""
    counted = patients.withColumns(
        {
            "age_bucket": C.age_bucket("age"),
            "comorbidity_count": C.list_count("conditions"),
            "medication_count": C.list_count("medications"),
            "has_diabetes": C.has_word("conditions", "diabetes"),
        }
    )
    return counted.withColumn("polypharmacy", C.polypharmacy("medication_count"))


def first_medication(medications: DataFrame) -> DataFrame:
    """Earliest investigational drug per patient and trial, first non-null per column.

    A minimum combines on the map side, so no group is sorted in one task.  Rows with all
    columns share one minimum, so their date and id move once; only the others have one for
    each column.  Rows of equal date and id are ordered by their values.
    """
    order, drug = ("start_date", "medication_id"), ("medication_name", "drug_class", "dose")
    complete = F.lit(True)
    for c in drug:
        complete = complete & F.col(c).isNotNull()
    whole = F.min(F.when(complete, F.struct(*order, *drug))).alias("_whole")
    parts = [
        F.min(F.when(~complete & F.col(c).isNotNull(), F.struct(*order, c))).alias(f"_{c}")
        for c in drug
    ]

    def earliest(c: str) -> Column:
        own = F.struct(*[F.col(f"_whole.{n}").alias(n) for n in (*order, c)])
        first = F.least(F.when(F.col("_whole").isNotNull(), own), F.col(f"_{c}"))
        return first[c].alias(c)

    keys = ("patient_id", "trial_id")
    found = investigational_only(medications).groupBy(*keys).agg(whole, *parts)
    return found.select(*keys, *[earliest(c) for c in drug])


def patient_outcomes_fact(
    outcomes: DataFrame, enrollments: DataFrame, patients: DataFrame
) -> DataFrame:
    """Outcomes with enrolment and patient columns; one row per outcome and enrolment.

    The narrow patient columns come first, as the rows move again for the enrolment.
    """
    enrolled = enrollments.select("patient_id", "trial_id", "arm", "enrollment_date", "status")
    people = silver_patients(patients).select(
        "patient_id", "age", "gender", "comorbidity_count", "medication_count", "has_diabetes"
    )
    keys = ["patient_id", "trial_id"]
    return (
        outcomes.withColumn("response_positive", C.responded().cast("int"))
        .join(people, "patient_id", "left")
        .join(enrolled, keys, "left")
        .select(
            *keys,
            *[c for c in outcomes.columns if c not in keys],
            *enrolled.columns[2:],
            *people.columns[1:],
            "response_positive",
        )
    )


def patient_outcomes(
    outcomes: DataFrame, patients: DataFrame, trials: DataFrame, medications: DataFrame
) -> DataFrame:
    """The full silver fact: outcome, patient, trial, first medication and features.

    Rows move once for the patient, whose drugs and columns meet them there, and once for the
    trial; the long titles are joined last, and flags are made before their texts move.
    """
    flags = C.condition_flags("conditions")
    people = patients.select("patient_id", "gender", "age", "conditions").withColumns(flags)
    studies = trials.select("trial_id", "title", "phase", "condition", "sponsor")
    # Dealt by patient alone, outcomes and drugs meet without being dealt by both keys.
    join_where_dealt(outcomes.sparkSession)
    drugs = first_medication(investigational_only(medications).repartition("patient_id"))
    keys = ["patient_id", "trial_id"]
    return (
        outcomes.withColumn("responded", C.responded())
        .repartition("patient_id")
        .join(drugs, keys, "left")
        .join(people, "patient_id", "left")
        .join(studies, "trial_id", "left")
        .withColumns(
            {
                "age_group": C.age_group("age"),
                **{c: F.coalesce(c, F.lit(False)) for c in flags},
            }
        )
        .select(
            *keys,
            *[c for c in outcomes.columns if c not in keys],
            "gender",
            "age",
            "conditions",
            *studies.columns[1:],
            *drugs.columns[2:],
            "age_group",
            *flags,
            "responded",
        )
    )


def outcomes_with_meds(outcomes: DataFrame, medications: DataFrame) -> DataFrame:
    """Outcomes with every medication of the same patient and trial."""
    drugs = medications.select("patient_id", "trial_id", "medication_name", "drug_class")
    return outcomes.join(drugs, ["patient_id", "trial_id"], "left")


def drug_effectiveness_silver(outcomes: DataFrame, medications: DataFrame) -> DataFrame:
    """Per medication: class, patients, mean change, response rate, adverse events.

    The figures are those of ``outcomes_with_meds``, but both sides are counted per
    patient and trial first, so a pair with many of both costs one row per drug.
    """
    keys = ["patient_id", "trial_id"]
    drugs = (
        medications.where(F.col("medication_name").isNotNull())
        .groupBy(*keys, "medication_name")
        .agg(F.count(F.lit(1)).alias("_m"), F.min("drug_class").alias("_class"))
    )
    results = outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(C.responded()).alias("_pos"),
        F.count("change").alias("_n_change"),
        F.sum("change").alias("_change"),
        F.count("adverse_events").alias("_ae"),
    )

    def times(c: str) -> Column:
        return F.sum(F.col("_m") * F.col(c))

    return (
        drugs.join(results, keys)
        .groupBy("medication_name")
        .agg(
            F.min("_class").alias("drug_class"),
            F.countDistinct("patient_id").alias("patient_count"),
            F.try_divide(times("_change"), times("_n_change")).alias("mean_change"),
            F.try_divide(times("_pos"), times("_n")).alias("response_rate"),
            times("_ae").alias("adverse_event_count"),
        )
        .orderBy(F.desc("response_rate"), "medication_name")
    )


def trial_summary(outcomes: DataFrame, enrollments: DataFrame, trials: DataFrame) -> DataFrame:
    """Per trial with outcomes: counts, mean change, response rate and trial columns."""
    measured = outcomes.groupBy("trial_id").agg(
        F.count("outcome_id").alias("outcome_count"),
        F.avg("change").alias("mean_change"),
        F.avg(C.responded().cast("double")).alias("response_rate"),
    )
    enrolled = enrollments.groupBy("trial_id").agg(F.count("patient_id").alias("enrolled_count"))
    return measured.join(enrolled, "trial_id", "left").join(
        trials.select("trial_id", "title", "phase", "condition"), "trial_id", "left"
    )


def population_kpis(
    fact: DataFrame,
    patients: DataFrame | None = None,
    trials: DataFrame | None = None,
    digits: bool = True,
) -> DataFrame:
    """Top-level measures as (metric, value) rows.

    Patient and trial totals come from their own tables when given, else from the fact.
    """
    rate, age = (4, 1) if digits else (None, None)
    outcomes_part = fact.agg(
        F.count(F.lit(1)).alias("total_outcomes"),
        C.rounded(F.coalesce(F.avg(C.responded().cast("double")), F.lit(0.0)), rate).alias(
            "overall_response_rate"
        ),
        C.rounded(F.coalesce(F.avg(C.has_adverse_event().cast("double")), F.lit(0.0)), rate).alias(
            "adverse_event_rate"
        ),
        C.rounded(F.avg(F.col("age").cast("double")), age).alias("avg_age"),
    )
    people = (fact if patients is None else patients).agg(
        F.countDistinct("patient_id").alias("total_patients")
    )
    studies = (fact if trials is None else trials).agg(
        F.countDistinct("trial_id").alias("total_trials")
    )
    return (
        metric_rows(people)
        .unionByName(metric_rows(studies))
        .unionByName(metric_rows(outcomes_part))
    )


def _rates(digits: int | None, responders: str, people: str) -> Column:
    return C.rounded(F.col(responders) / F.col(people), digits)


def drug_effectiveness_gold(fact: DataFrame, digits: int | None = 4) -> DataFrame:
    """Per medication; the rate divides by distinct patients and may exceed 1."""
    return (
        fact.where(F.col("medication_name").isNotNull())
        .groupBy("medication_name")
        .agg(
            F.countDistinct("patient_id").alias("total_patients"),
            F.count_if(C.responded()).alias("positive_responses"),
            F.avg("change").alias("avg_change"),
            F.avg("change_pct").alias("avg_change_pct"),
        )
        .withColumn("response_rate", _rates(digits, "positive_responses", "total_patients"))
        .orderBy(F.desc("response_rate"), "medication_name")
    )


def trial_titles(fact: DataFrame) -> DataFrame:
    """One title per trial: that of the first outcome id."""
    return fact.groupBy("trial_id").agg(F.min_by("title", "outcome_id").alias("title"))


def trial_title_join(aggregate: DataFrame, fact: DataFrame) -> DataFrame:
    return aggregate.join(trial_titles(fact), "trial_id", "left")


def trial_kpis(
    fact: DataFrame, digits: int | None = 4, trials: DataFrame | None = None
) -> DataFrame:
    """Per trial: patients, responders, mean changes, rate and title.

    With the trials table given, titles are joined to the finished aggregate, which
    then holds numbers only and stays a hash aggregate; else they come from the fact.
    """
    own = [F.min_by("title", "outcome_id").alias("title")]
    from_fact = own if trials is None and "title" in fact.columns else []
    kpis = fact.groupBy("trial_id").agg(
        F.countDistinct("patient_id").alias("total_enrolled"),
        F.count_if(C.responded()).alias("positive_responses"),
        F.avg("change").alias("avg_outcome_change"),
        F.avg("change_pct").alias("avg_change_pct"),
        *from_fact,
    )
    if trials is not None:
        kpis = kpis.join(trials.select("trial_id", "title"), "trial_id", "left")
    return kpis.withColumn("response_rate", _rates(digits, "positive_responses", "total_enrolled"))


def cohort_stats(fact: DataFrame, digits: bool = True) -> DataFrame:
    """Per condition-and-response cohort: patients, responders, mean age and change."""
    age, change, rate = (1, 3, 4) if digits else (None, None, None)
    return (
        fact.withColumn("cohort_label", C.cohort_label("conditions", C.responded()))
        .groupBy("cohort_label")
        .agg(
            F.countDistinct("patient_id").alias("cohort_size"),
            F.count_if(C.responded()).alias("positive_responses"),
            C.rounded(F.avg(F.col("age").cast("double")), age).alias("avg_age"),
            C.rounded(F.avg("change"), change).alias("avg_outcome_change"),
        )
        .withColumn("positive_response_rate", _rates(rate, "positive_responses", "cohort_size"))
    )
