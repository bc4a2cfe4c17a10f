"""Response evaluation, weak-response factors, pathways, cohorts and timelines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import values as V
from cohortlake.operators.analytics import trial_response_rates
from cohortlake.operators.skew import contains_join

# --- evaluation ----------------------------------------------------------------


def threshold_table(spark: SparkSession) -> DataFrame:
    """Thresholds per outcome type, with the default row."""
    rows = [tuple(t) for t in (*V.THRESHOLDS, V.DEFAULT_THRESHOLD)]
    return spark.createDataFrame(
        rows, "outcome_type string, strong double, moderate double, minimal double, direction int"
    )


def with_thresholds(df: DataFrame) -> DataFrame:
    """Threshold columns of every row's outcome type."""
    fields = ("strong", "moderate", "minimal", "direction")
    return df.withColumns({f: C.threshold(F.col("outcome_type"), f) for f in fields})


def _improvement(direction: Column | None = None) -> Column:
    kind = C.threshold(F.col("outcome_type"), "direction") if direction is None else direction
    return C.improvement_pct(F.col("baseline_value"), F.col("followup_value"), kind)


def relative_change(outcomes: DataFrame) -> DataFrame:
    """Absolute change and improvement in percent; positive is better."""
    return outcomes.withColumns(
        {
            "absolute_change": C.absolute_change(F.col("baseline_value"), F.col("followup_value")),
            "improvement_pct": _improvement(),
        }
    )


def evaluate_outcomes(outcomes: DataFrame, digits: bool = True) -> DataFrame:
    """Change, improvement and class; the class uses the unrounded improvement."""
    three, one = (3, 1) if digits else (None, None)
    evaluated = relative_change(outcomes)
    return evaluated.withColumns(
        {
            "evaluated_status": C.classify_response(
                F.col("outcome_type"), F.col("improvement_pct")
            ),
            "absolute_change": C.rounded(F.col("absolute_change"), three),
            "improvement_pct": C.rounded(F.col("improvement_pct"), one),
        }
    )


def response_narrative(evaluated: DataFrame) -> DataFrame:
    """One sentence per evaluated outcome."""

    def number(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit(0.0)).cast("string"), F.lit("0"))

    change = F.coalesce("absolute_change", F.lit(0.0))
    parts = {
        "type": F.col("outcome_type"),
        "direction": F.when(change < 0, "decreased").otherwise("increased"),
        "baseline": number("baseline_value"),
        "followup": number("followup_value"),
        "unit": F.coalesce("unit", F.lit("")),
        "pct": F.format_string("%.1f", F.abs(F.coalesce("improvement_pct", F.lit(0.0)))),
    }
    result = fill(V.NARRATIVES[V.UNKNOWN], parts)
    for status, template in V.NARRATIVES.items():
        if status != V.UNKNOWN:
            result = F.when(F.col("evaluated_status") == status, fill(template, parts)).otherwise(
                result
            )
    return evaluated.withColumn("narrative", result)


def fill(template: str, parts: dict[str, Column]) -> Column:
    """A text template with ``{name}`` places as a concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(
        *[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p != ""]
    )


def response_midpoint(outcomes: DataFrame, digits: int | None = 1) -> DataFrame:
    """Baseline, midpoint and final value of each outcome as rows, nulls left out."""
    base, end = F.col("baseline_value"), F.col("followup_value")
    points = F.array(
        F.struct(F.lit("Baseline").alias("t"), base.alias("value")),
        F.struct(
            F.lit("Midpoint").alias("t"), C.rounded(base + (end - base) / 2, digits).alias("value")
        ),
        F.struct(F.lit("Final").alias("t"), end.alias("value")),
    )
    return outcomes.select(
        "outcome_id", F.inline(F.filter(points, lambda p: p["value"].isNotNull()))
    )


# --- factors of a weak response ---------------------------------------------------

FACTOR_TYPE = (
    "array<struct<category:string,name:string,strength:double,evidence_level:string,"
    "description:string,evidence:string>>"
)


def _factor(
    key: str,
    when: Column,
    strength: Column | None = None,
    description: Column | None = None,
    evidence: Column | None = None,
) -> Column:
    text = V.FACTORS[key]
    return F.when(
        when,
        F.struct(
            F.lit(text.category).alias("category"),
            F.lit(text.name).alias("name"),
            (F.lit(text.strength) if strength is None else strength).alias("strength"),
            F.lit(text.evidence_level).alias("evidence_level"),
            (F.lit(text.description) if description is None else description).alias("description"),
            (F.lit(V.EVIDENCE.get(key)) if evidence is None else evidence).alias("evidence"),
        ),
    )


def _kept(*factors: Column) -> Column:
    return F.filter(F.array(*factors), lambda f: f.isNotNull()).cast(FACTOR_TYPE)


def rule_factors(cohort_size: int = V.COHORT_SIZE) -> Column:
    """Rule-based factors from outcome and patient columns; ``cohort_size`` is named as the
    evidence.

    Needs baseline_value, outcome_type, age, and the arrays condition_list and
    medication_list.
    """
    baseline = F.coalesce("baseline_value", F.lit(0.0))
    limit = F.when(F.col("outcome_type") == "HbA1c", 8.5).otherwise(7.0)
    seen = F.format_string(V.EVIDENCE["rule"], F.lit(cohort_size))
    return _kept(
        _factor("high_baseline", baseline > limit, evidence=seen),
        _factor("prior_failure", C.prior_failure(F.col("medication_list")), evidence=seen),
        _factor("comorbidity", F.size("condition_list") > 3, evidence=seen),
        _factor("short_duration", F.lit(True), evidence=seen),
        _factor("variability", F.lit(True), evidence=seen),
        _factor("age", F.col("age") > 65, evidence=seen),
    )


def delta_factor() -> Column:
    """The observed change is too small or in the wrong direction."""
    base, end, kind = F.col("baseline_value"), F.col("followup_value"), F.col("outcome_type")
    minimal = C.threshold(kind, "minimal")
    effective = C.threshold(kind, "direction") * (end - base)
    scale = F.when(base == 0, 1.0).otherwise(F.abs(base))
    pct = F.abs(end - base) / scale * 100
    text = F.format_string(
        V.FACTORS["delta"].description,
        kind, base, end, F.when(effective >= 0, "+").otherwise(""), pct, minimal,
    )
    return _kept(
        _factor(
            "delta",
            (effective < 0) | (pct < minimal),
            F.round(F.least(F.lit(0.88), 0.5 + (minimal - pct) / 100), 2),
            text,
        )
    )


def adherence_factor() -> Column:
    """Course not completed, or completed with at least two adverse events."""
    events = C.parse_list("adverse_events")
    text = F.format_string(
        V.FACTORS["adverse"].description,
        F.size(events),
        F.array_join(F.slice(events, 1, 3), ", "),
    )
    done = F.col("treatment_completed")
    return _kept(
        _factor("incomplete", ~done),
        _factor("adverse", done & (F.size(events) >= 2), description=text),
    )


def attribution_factors(contributions: Column | str) -> Column:
    """Strongly negative model contributions (a map of feature to value) as factors."""
    entries = F.filter(F.map_entries(contributions), lambda e: e["value"] < -0.15)

    def one(e: Column) -> Column:
        label = F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" ")))
        return F.struct(
            F.lit(V.ATTRIBUTION_CATEGORY).alias("category"),
            F.concat(F.lit(V.ATTRIBUTION_NAME), label).alias("name"),
            F.least(F.lit(0.92), F.round(F.abs(e["value"]), 2)).alias("strength"),
            F.lit(V.ATTRIBUTION_LEVEL).alias("evidence_level"),
            F.format_string(
                V.ATTRIBUTION_TEXT,
                label,
                e["value"],
            ).alias("description"),
            F.lit(V.EVIDENCE["attribution"]).alias("evidence"),
        )

    return F.coalesce(F.transform(entries, one), F.array()).cast(FACTOR_TYPE)


def top_factors(factors: Column | str, k: int = 6) -> Column:
    """The k strongest factors; equal strengths keep their order."""
    ranked = F.transform(
        C.col(factors),
        lambda f, i: F.struct((-f["strength"]).alias("s"), i.alias("i"), f.alias("f")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, k), lambda r: r["f"])


def non_response_analysis(
    cases: DataFrame, contributions: str | None = None, k: int = 6, digits: int | None = 2
) -> DataFrame:
    """The strongest factors of every case and the mean strength of all of them."""
    parts = [rule_factors(), delta_factor(), adherence_factor()]
    if contributions:
        parts.append(attribution_factors(contributions))
    total = F.aggregate("_factors", F.lit(0.0), lambda acc, f: acc + f["strength"])
    confidence = F.coalesce(F.try_divide(total, F.size("_factors")), F.lit(0.0))
    return (
        cases.withColumn("_factors", F.concat(*parts))
        .withColumns(
            {
                "factors": top_factors("_factors", k),
                "overall_confidence": C.rounded(confidence, digits),
            }
        )
        .drop("_factors")
    )


def with_patient_lists(df: DataFrame, patients: DataFrame) -> DataFrame:
    """Outcome rows with the patient columns that the factor rules read."""
    people = patients.select(
        "patient_id",
        "age",
        C.parse_list("conditions").alias("condition_list"),
        C.parse_list("medications").alias("medication_list"),
    )
    return df.join(people, "patient_id", "left")


# --- cohort resemblance ----------------------------------------------------------------


def cohort_features() -> dict[str, Column]:
    """Yes/no features of a case (evaluated_status, drug_class and patient lists)."""
    status, conditions = F.col("evaluated_status"), F.col("condition_list")
    medications = F.col("medication_list")
    current = F.lower(F.coalesce("drug_class", F.lit("")))
    switched = F.exists(F.slice(medications, 1, 3), lambda m: ~F.lower(m).contains(current))
    features = {
        "high_baseline": F.coalesce("baseline_value", F.lit(0.0)) > 8.0,
        "minimal_response": status.isin(*V.NON_RESPONDER),
        "moderate_response": status == V.MODERATE,
        "prior_treatment": F.size(medications) > 2,
        "prior_failure": C.prior_failure(medications),
        "multi_comorbidity": F.size(conditions) > 3,
        "older_age": F.col("age") > 60,
        "completion": F.col("treatment_completed"),
        "drug_class_switch": F.col("has_medication") & switched,
        "renal_comorbidity": F.exists(
            conditions, lambda c: C.contains_any(F.lower(c), ("renal", "kidney"))
        ),
    }
    return {n: F.coalesce(c, F.lit(False)) for n, c in features.items()}


def cohort_resemblance(cases: DataFrame, k: int = 5) -> DataFrame:
    """Research cohorts a case shares features with, most similar first."""
    features = cohort_features()
    marked = cases.withColumns({f"_f_{n}": c for n, c in features.items()})
    flag = {n: F.col(f"_f_{n}") for n in features}
    status = F.col("evaluated_status")
    shared = F.filter(
        F.array(
            F.when(flag["high_baseline"], "Elevated baseline biomarker"),
            F.when(flag["multi_comorbidity"], "Multiple comorbidities"),
            F.when(flag["prior_failure"], "Prior treatment failure"),
            F.when(
                flag["moderate_response"] | flag["minimal_response"],
                F.concat(F.lit("Treatment response: "), status),
            ),
            F.when(
                flag["older_age"],
                F.concat(F.lit("Age group: "), F.col("age").cast("string"), F.lit(" years")),
            ),
        ),
        lambda s: s.isNotNull(),
    )

    def one(i: int, t: V.CohortTemplate) -> Column:
        hits = [flag[f].cast("int") for f in t.key_features if f in flag]
        matched = hits[0]
        for h in hits[1:]:
            matched = matched + h
        similarity = matched / F.lit(len(t.key_features))
        return F.when(
            similarity > 0.3,
            F.struct(
                (-F.round(similarity, 2)).alias("_order"),
                F.lit(i).alias("_i"),
                F.lit(t.cohort_name).alias("cohort_name"),
                F.lit(t.cohort_type).alias("cohort_type"),
                F.round(similarity, 2).alias("similarity_score"),
                (1200 + F.floor(similarity * 3000)).cast("int").alias("cohort_size"),
                F.lit(t.positive_response_rate).alias("positive_response_rate"),
                F.lit(t.most_effective_treatment).alias("most_effective_treatment"),
                F.round(-1.5 - similarity * 2.0, 1).alias("avg_outcome_change"),
            ),
        )

    found = F.array_sort(
        F.filter(
            F.array(*[one(i, t) for i, t in enumerate(V.COHORT_TEMPLATES)]),
            lambda c: c.isNotNull(),
        )
    )
    first = F.try_element_at("_found", F.lit(1))["cohort_name"]
    primary = (
        F.when(status.isin(V.MINIMAL, V.NO_RESPONSE), V.RESISTANT_COHORT)
        .when(status == V.MODERATE, V.MODERATE_COHORT)
        .when(status == V.STRONG, V.STRONG_COHORT)
        .otherwise(F.coalesce(first, F.lit(V.GENERAL_COHORT)))
    )
    return (
        marked.withColumn("_found", found)
        .withColumns(
            {
                "primary_cohort": primary,
                "shared_features": F.slice(shared, 1, 4),
                "resembled_cohorts": F.transform(
                    F.slice("_found", 1, k), lambda c: c.dropFields("_order", "_i")
                ),
            }
        )
        .drop("_found", *[f"_f_{n}" for n in features])
    )


# --- alternative pathways ----------------------------------------------------------------


def first_word(c: Column | str) -> Column:
    return F.substring_index(C.col(c), " ", 1)


def top_n_per_condition(matches: DataFrame, n: int = 4) -> DataFrame:
    """The first n trials (by id) per patient condition and avoided class word."""
    window = Window.partitionBy("condition", "avoided").orderBy("trial_id")
    return (
        matches.withColumn("_rank", F.row_number().over(window))
        .where(F.col("_rank") <= n)
        .drop("_rank")
    )


def alternative_trials(wanted: DataFrame, trials: DataFrame, n: int = 4) -> DataFrame:
    """First n trials for a condition whose drug class lacks the avoided word.

    ``wanted`` holds (condition, avoided).  Its distinct pairs and the distinct trial
    conditions are vocabularies; the substring test runs between those, and the
    trials then join on equal keys.
    """
    pairs = wanted.select("condition", "avoided").distinct()
    studied = trials.where(F.col("condition").isNotNull())
    vocabulary = contains_join(
        studied.select(F.col("condition").alias("trial_condition")).distinct(),
        "trial_condition",
        pairs.select("condition").distinct(),
        "condition",
    )
    described = studied.withColumnRenamed("condition", "trial_condition").select(
        "trial_id", "trial_condition", "nct_id", "title", "phase", "drug_class"
    )
    other_class = ~F.lower(F.coalesce("drug_class", F.lit(""))).contains(F.lower("avoided"))
    matches = (
        described.join(vocabulary, "trial_condition").join(pairs, "condition").where(other_class)
    )
    return top_n_per_condition(matches, n)


def live_pathways(
    cases: DataFrame, trials: DataFrame, outcomes: DataFrame, n: int = 4, digits: int | None = 1
) -> DataFrame:
    """Trials of other drug classes for each condition of a case, best response first.

    ``cases`` has case_id, condition_list and drug_class (null when nothing was given).
    """
    fallback = F.array(F.lit("Type 2 Diabetes"))
    known = F.when(F.size("condition_list") > 0, F.col("condition_list")).otherwise(fallback)
    current = F.coalesce("drug_class", F.lit("current treatment"))
    wanted = cases.select(
        "case_id",
        current.alias("current_class"),
        first_word(current).alias("avoided"),
        F.posexplode(known).alias("_position", "condition"),
    )
    rates = trial_response_rates(outcomes, digits)
    found = alternative_trials(wanted, trials, n).join(rates, "trial_id", "left")
    joined = wanted.join(found, ["condition", "avoided"])
    window = Window.partitionBy("case_id").orderBy(
        F.coalesce("response_rate", F.lit(0.0)).desc(), "_position", "trial_id"
    )
    phase = F.coalesce("phase", F.lit("Phase 3"))
    agent = F.coalesce(F.col("drug_class"), F.lit("Investigational Agent"))
    history = F.when(
        F.col("response_rate").isNotNull(),
        F.format_string("Historical cohort response rate: %.1f%%.", "response_rate"),
    ).otherwise("")
    return joined.select(
        "case_id",
        F.row_number().over(window).alias("ordinal"),
        F.col("trial_id").alias("pathway_id"),
        F.lit("Active Clinical Trial").alias("category"),
        F.concat("title", F.lit(" ("), phase, F.lit(")")).alias("title"),
        F.concat(
            F.lit("Active protocol "), F.coalesce("nct_id", F.lit("")), F.lit(" investigating "),
            agent, F.lit(" for patients with "), "condition", F.lit("."),
        ).alias("description"),
        F.concat(
            F.lit("Alternative mechanism ("), agent, F.lit(") avoids previous "),
            "current_class", F.lit(" pathway and offers targeted therapeutic action. "), history,
        ).alias("rationale"),
        F.when(C.contains_any(phase, ("Phase 3", "Phase 4")), "High")
        .otherwise("Moderate")
        .alias("evidence_level"),
        F.col("response_rate"),
    )


def template_pathways(cases: DataFrame) -> DataFrame:
    """The six general pathways of every case.

    ``cases`` has case_id, evaluated_status, drug_class, dose, baseline_value, unit.
    Ids are digests of the case and the category.
    """
    baseline = F.trim(
        F.concat(F.col("baseline_value").cast("string"), F.lit(" "), F.coalesce("unit", F.lit("")))
    )
    measured = F.coalesce("baseline_value", F.lit(0.0)) != 0
    parts = {
        "response": F.col("evaluated_status"),
        "drug_class": F.coalesce("drug_class", F.lit("current treatment")),
        "dose": F.coalesce("dose", F.lit("current dose")),
        "baseline": F.when(measured, baseline).otherwise("elevated"),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.substring(F.sha2(F.concat_ws("|", "case_id", F.lit(p.category)), 256), 1, 8).alias(
                    "pathway_id"
                ),
                F.lit(p.category).alias("category"),
                F.lit(p.title).alias("title"),
                F.lit(p.description).alias("description"),
                fill(p.rationale, parts).alias("rationale"),
                F.lit(p.evidence_level).alias("evidence_level"),
            )
            for i, p in enumerate(V.PATHWAYS)
        ]
    )
    return cases.select("case_id", F.inline(rows))


def alternative_pathways(
    cases: DataFrame, trials: DataFrame, outcomes: DataFrame, digits: int | None = 1
) -> DataFrame:
    """Live trials first, then the general pathways; ``source`` tells them apart."""
    live = live_pathways(cases, trials, outcomes, digits=digits).withColumn(
        "source", F.lit("trial")
    )
    general = template_pathways(cases).withColumn("source", F.lit("template"))
    return live.unionByName(general, allowMissingColumns=True)


# --- summary per patient --------------------------------------------------------------------


def chosen_trials(enrollments: DataFrame) -> DataFrame:
    """The trial of the latest enrolment of every patient."""
    order = F.struct("enrollment_date", "trial_id")
    return enrollments.groupBy("patient_id").agg(F.max_by("trial_id", order).alias("trial_id"))


def primary_cases(
    patients: DataFrame, enrollments: DataFrame, outcomes: DataFrame, medications: DataFrame
) -> DataFrame:
    """One evaluated case per patient: first outcome and first drug of the chosen trial."""
    chosen = chosen_trials(enrollments)
    keys = ["patient_id", "trial_id"]
    fields = (
        "outcome_id", "outcome_type", "unit", "baseline_value", "followup_value",
        "measurement_date", "adverse_events", "treatment_completed",
    )
    # Windows instead of minima of structs: columns that nobody asks for are never moved.
    first = Window.partitionBy(*keys).orderBy(F.col("outcome_id").asc_nulls_last())
    known = F.col("outcome_id").isNotNull()
    primary = (
        outcomes.join(chosen, keys, "left_semi")
        .withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .select(*keys, *[F.when(known, F.col(c)).alias(c) for c in fields])
    )
    drug = ("medication_name", "drug_class", "dose", "route", "duration_weeks")
    given = (
        medications.join(chosen, keys, "left_semi")
        .withColumns(
            {
                "interventions": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
                "_rank": F.row_number().over(
                    Window.partitionBy(*keys).orderBy("start_date", "medication_id")
                ),
            }
        )
        .where(F.col("_rank") == 1)
        .select(*keys, *drug, "interventions")
    )
    joined = primary.join(given, keys, "left").withColumn(
        "has_medication", F.col("interventions").isNotNull()
    )
    return evaluate_outcomes(with_patient_lists(joined, patients)).withColumn(
        "case_id", F.concat_ws("/", *keys)
    )


def outcome_summary(
    patients: DataFrame,
    trials: DataFrame,
    enrollments: DataFrame,
    outcomes: DataFrame,
    medications: DataFrame,
    predictions: DataFrame | None = None,
) -> DataFrame:
    """One row per patient: treatment, evaluation, narrative, factors and cohort.

    Pathways are open-ended rows; ``alternative_pathways`` gives them per case_id.
    ``predictions`` may add probability, confidence and contributions per patient
    and trial.
    """
    cases = primary_cases(patients, enrollments, outcomes, medications)
    contributions = None
    if predictions is not None:
        cases = cases.join(predictions, ["patient_id", "trial_id"], "left")
        contributions = "contributions" if "contributions" in predictions.columns else None
    titled = cases.join(
        trials.select("trial_id", F.col("title").alias("trial_title")), "trial_id", "left"
    )
    analysed = non_response_analysis(response_narrative(titled), contributions)
    return cohort_resemblance(analysed)


# --- timeline ---------------------------------------------------------------------------------


def patient_timeline(
    patients: DataFrame, enrollments: DataFrame, observations: DataFrame | None = None
) -> DataFrame:
    """Diagnoses, medications, lab tests, enrolments and completions in one schema.

    Lists carry no dates, so their events have none.  ``observations`` has
    patient_id, name, value, unit and date.
    """
    none = F.lit(None)

    def event(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        blank = {
            "date": none.cast("date"),
            "trial_id": none.cast("string"),
            "value": none.cast("double"),
            "unit": none.cast("string"),
        }
        fields = {**blank, **columns, "event_type": F.lit(kind)}
        return df.select("patient_id", *[c.alias(n) for n, c in sorted(fields.items())])

    def listed(column: str, kind: str, prefix: str, title: str, before: str, after: str):
        rows = patients.select(
            "patient_id", F.posexplode(C.parse_list(column)).alias("_i", "_name")
        )
        return event(
            rows,
            kind,
            event_id=F.concat(F.lit(prefix), F.col("_i").cast("string")),
            title=F.concat(F.lit(title), "_name"),
            description=F.concat(F.lit(before), "_name", F.lit(after)),
        )

    enrolled = event(
        enrollments,
        "trial_enrollment",
        event_id=F.concat(F.lit("enroll-"), "enrollment_id"),
        title=F.concat(F.lit("Trial Enrollment: "), "trial_id"),
        description=F.concat(
            F.lit("Enrolled in "), "trial_id", F.lit(" — Arm: "), F.coalesce("arm", F.lit("N/A"))
        ),
        date=C.to_date("enrollment_date"),
        trial_id=F.col("trial_id"),
    )
    completed = event(
        enrollments.where(F.col("status") == "COMPLETED"),
        "trial_completion",
        event_id=F.concat(F.lit("complete-"), "enrollment_id"),
        title=F.concat(F.lit("Trial Completed: "), "trial_id"),
        description=F.lit("Trial participation completed. Outcome measurement recorded."),
        trial_id=F.col("trial_id"),
    )
    result = (
        listed("conditions", "diagnosis", "diag-", "Diagnosis: ", "Patient diagnosed with ", "")
        .unionByName(
            listed("medications", "medication", "med-", "Started: ", "Medication ", " initiated")
        )
        .unionByName(enrolled)
        .unionByName(completed)
    )
    if observations is not None:
        reading = F.concat_ws(
            " ", F.concat("name", F.lit(" = "), F.col("value").cast("string")), "unit"
        )
        labs = event(
            observations,
            "lab_test",
            event_id=F.concat(F.lit("obs-"), "name"),
            title=F.concat(F.lit("Lab: "), "name"),
            description=F.trim(reading),
            date=C.to_date("date"),
            value=F.col("value"),
            unit=F.col("unit"),
        )
        result = result.unionByName(labs)
    return result


def timeline_order(events: DataFrame) -> DataFrame:
    return events.orderBy("date", "event_id")


# --- stream outcome events ----------------------------------------------------------------------


def classify_events(events: DataFrame) -> DataFrame:
    """Change and class of stream lab events; works on batch and streaming frames."""
    return events.withColumns(
        {
            "change": F.round(F.col("value") - V.STREAM_BASELINE, 2),
            "change_pct": C.stream_change_pct(F.col("value")),
            "response_class": C.classify_event(F.col("biomarker"), F.col("value")),
        }
    )
