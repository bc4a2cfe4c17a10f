from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import analytics as A
from cohortlake.operators import logs as G
from cohortlake.operators import outcomes as O

CASE = dict(
    case_id="P/T", outcome_id="O1", patient_id="P", trial_id="T", outcome_type="HbA1c", unit="%",
    baseline_value=9.5, followup_value=9.1, treatment_completed=True, adverse_events="",
    age=52, condition_list=["Type 2 Diabetes", "Hypertension"], medication_list=["Metformin"],
    drug_class="DPP-4 Inhibitor", dose="50mg", has_medication=True,
)
SCHEMA = (
    "case_id string, outcome_id string, patient_id string, trial_id string, outcome_type string, "
    "unit string, baseline_value double, followup_value double, treatment_completed boolean, "
    "adverse_events string, age int, condition_list array<string>, medication_list array<string>, "
    "drug_class string, dose string, has_medication boolean"
)


@pytest.fixture
def case(spark):
    def make(**changes):
        return O.evaluate_outcomes(spark.createDataFrame([{**CASE, **changes}], SCHEMA))

    return make


def factor_names(frame):
    return [f.name for f in O.non_response_analysis(frame).first().factors]


def test_the_stored_label_need_not_agree(case):
    row = case(baseline_value=9.1, followup_value=7.2).first()
    assert (row.evaluated_status, row.improvement_pct, row.absolute_change) == (
        "Strong Response", 20.9, -1.9,
    )


@pytest.mark.parametrize("missing", ["baseline_value", "followup_value"])
def test_a_missing_side_is_unknown(case, missing):
    assert case(**{missing: None}).first().evaluated_status == "Unknown"


def test_zero_baseline_is_worsened_with_no_change(case):
    row = case(baseline_value=0.0, followup_value=5.0).first()
    assert (row.absolute_change, row.improvement_pct, row.evaluated_status) == (0.0, 0.0, "Worsened")


def test_higher_is_better_for_cell_counts(case):
    row = case(outcome_type="CD4_count", baseline_value=100.0, followup_value=130.0).first()
    assert row.evaluated_status == "Strong Response"


def test_small_change_is_a_factor(case):
    assert "Insufficient Biomarker Delta" in factor_names(case())
    factor = next(
        f for f in O.non_response_analysis(case()).first().factors if f.name.startswith("Insuff")
    )
    assert factor.strength == pytest.approx(0.51) and "9.5 to 9.1" in factor.description


def test_incomplete_course_and_adverse_events(case):
    assert "Incomplete Treatment Course" in factor_names(case(treatment_completed=False))
    many = case(adverse_events="Nausea|Headache|Dizziness")
    assert "Adverse Event-Related Dose Reduction Risk" in factor_names(many)
    assert "Adverse Event-Related Dose Reduction Risk" not in factor_names(case(adverse_events="Nausea"))


def test_rules_fire_at_their_limits(case):
    assert "High Baseline Disease Severity" not in factor_names(case(baseline_value=8.5))
    assert "Age-Related Treatment Response Attenuation" not in factor_names(case(age=65))
    busy = case(age=66, condition_list=["a", "b", "c", "d"], medication_list=["X (refractory)"])
    names = factor_names(busy)
    assert {
        "Previous Treatment Failure in Same Drug Class", "Significant Comorbidity Burden",
    } <= set(names)


def test_factors_are_sorted_and_cut(case):
    busy = case(
        age=70, condition_list=list("abcd"), medication_list=["failed"], treatment_completed=False
    )
    row = O.non_response_analysis(busy).first()
    strengths = [f.strength for f in row.factors]
    assert strengths == sorted(strengths, reverse=True) and len(strengths) == 6
    full = (0.72 + 0.68 + 0.55 + 0.61 + 0.45 + 0.52 + 0.51 + 0.79) / 8
    assert row.overall_confidence == pytest.approx(full, abs=0.006)


def test_negative_contributions_become_factors(spark, case):
    frame = case().withColumn(
        "contributions",
        F.create_map(F.lit("baseline_value"), F.lit(-0.5), F.lit("age"), F.lit(-0.15), F.lit("phase"), F.lit(-3.0)),
    )
    row = O.non_response_analysis(frame, "contributions").first()
    ml = {f.name: f.strength for f in row.factors if f.category == "ML Feature Attribution"}
    assert ml == {"Negative Driver: Phase": 0.92, "Negative Driver: Baseline Value": 0.5}


def test_narratives(case):
    def text(**changes):
        return O.response_narrative(case(**changes)).first().narrative

    assert "strong response. HbA1c decreased from 9.1 to 7.2 %" in text(baseline_value=9.1, followup_value=7.2)
    assert "worsened during the trial. HbA1c increased" in text(followup_value=10.0)
    assert text(followup_value=None) == "HbA1c changed from 9.5 to 0 % during the trial period."


def test_pathways_put_live_trials_first(spark, case):
    trials = spark.createDataFrame(
        [
            ("T1", "N1", "One", "Phase 3", "Type 2 Diabetes", "GLP-1 Agonist"),
            ("T2", "N2", "Two", "Phase 2", "Type 2 Diabetes Mellitus", "SGLT-2 Inhibitor"),
            ("T3", "N3", "Three", "Phase 4", "Hypertension", "DPP-4 Inhibitor"),
            ("T4", "N4", "Four", "Phase 1", "Asthma", "X"),
        ],
        "trial_id string, nct_id string, title string, phase string, condition string, drug_class string",
    )
    outcomes = spark.createDataFrame(
        [("T2", "Strong Response"), ("T1", "Worsened")], "trial_id string, response_status string"
    )
    rows = O.alternative_pathways(case(), trials, outcomes).collect()
    live = sorted((r for r in rows if r.source == "trial"), key=lambda r: r.ordinal)
    assert [r.pathway_id for r in live] == ["T2", "T1"]
    assert [r.evidence_level for r in live] == ["Moderate", "High"]
    assert "response rate: 100.0%" in live[0].rationale
    general = sorted((r for r in rows if r.source == "template"), key=lambda r: r.ordinal)
    assert len(general) == 6 and len({r.pathway_id for r in general}) == 6
    assert "(50mg)" in general[5].rationale and "(9.5 %)" in general[2].rationale


def test_no_condition_means_diabetes_trials(spark, case):
    trials = spark.createDataFrame(
        [("T1", "N1", "One", "Phase 3", "Type 2 Diabetes", "GLP-1 Agonist")],
        "trial_id string, nct_id string, title string, phase string, condition string, drug_class string",
    )
    outcomes = spark.createDataFrame([], "trial_id string, response_status string")
    rows = O.live_pathways(case(condition_list=[]), trials, outcomes).collect()
    assert [(r.pathway_id, r.response_rate) for r in rows] == [("T1", None)]


def test_cohort_resemblance(case):
    row = O.cohort_resemblance(case(followup_value=9.6)).first()
    names = [c.cohort_name for c in row.resembled_cohorts]
    assert names[0] == "Treatment-Resistant Cohort" and row.primary_cohort == names[0]
    assert row.resembled_cohorts[0].similarity_score == 0.67
    assert row.resembled_cohorts[0].cohort_size == 3200
    assert row.resembled_cohorts[0].avg_outcome_change == pytest.approx(-2.8)
    strong = O.cohort_resemblance(case(baseline_value=7.0, followup_value=5.0)).first()
    assert strong.primary_cohort == "Strong Responder Research Cohort"


def test_midpoint_drops_nulls(case):
    rows = O.response_midpoint(case(baseline_value=9.0, followup_value=8.0)).collect()
    assert [(r.t, r.value) for r in rows] == [("Baseline", 9.0), ("Midpoint", 8.5), ("Final", 8.0)]
    rows = O.response_midpoint(case(followup_value=None)).collect()
    assert [r.t for r in rows] == ["Baseline"]


def test_summary_takes_the_latest_enrolment(spark):
    patients = spark.createDataFrame(
        [("P", 50, "F", "Obesity", "")],
        "patient_id string, age int, gender string, conditions string, medications string",
    )
    trials = spark.createDataFrame([("T1", "One"), ("T2", "Two")], "trial_id string, title string")
    enrollments = spark.createDataFrame(
        [("P", "T1", "2024-03-01"), ("P", "T2", "2024-05-01")],
        "patient_id string, trial_id string, enrollment_date string",
    )
    outcomes = spark.createDataFrame(
        [("O2", "P", "T2", "HbA1c", "%", 9.0, 7.0, "d", "", True), ("O1", "P", "T1", "HbA1c", "%", 9.0, 9.0, "d", "", True)],
        "outcome_id string, patient_id string, trial_id string, outcome_type string, unit string, "
        "baseline_value double, followup_value double, measurement_date string, adverse_events string, "
        "treatment_completed boolean",
    )
    medications = spark.createDataFrame(
        [("M", "P", "T1", "N", "C", "1", "Oral", "2024-01-01", 4)],
        "medication_id string, patient_id string, trial_id string, medication_name string, "
        "drug_class string, dose string, route string, start_date string, duration_weeks int",
    )
    predictions = spark.createDataFrame([("P", "T2", 0.7)], "patient_id string, trial_id string, probability double")
    row = O.outcome_summary(patients, trials, enrollments, outcomes, medications, predictions).first()
    assert (row.trial_id, row.outcome_id, row.trial_title, row.probability) == ("T2", "O2", "Two", 0.7)
    assert row.has_medication is False and row.interventions is None


# --- analytics and logs ---------------------------------------------------------------


def test_pairs_are_multiplied_not_joined(spark):
    meds = spark.createDataFrame(
        [("P1", "A"), ("P1", "A"), ("P1", "B"), ("P2", "A"), ("P3", " ")],
        "patient_id string, drug_class string",
    )
    outcomes = spark.createDataFrame(
        [("P1", "Strong Response", 1.0, True, None), ("P1", "Worsened", None, False, "x"), ("P2", "Worsened", 3.0, True, "")],
        "patient_id string, response_status string, change double, treatment_completed boolean, adverse_events string",
    )
    got = {r.drug_class: r for r in A.drug_response_counts(meds, outcomes).collect()}
    assert (got["A"].sample_size, got["A"].responders, got["A"].change_sum) == (5, 2, 5.0)
    assert (got["B"].sample_size, got["B"].adverse_events) == (2, 1) and set(got) == {"A", "B"}


def test_unmatched_filters_leave_the_slice(spark):
    patients = spark.createDataFrame([("P1", 70, "COPD")], "patient_id string, age int, conditions string")
    outcomes = spark.createDataFrame(
        [("P1", 8.0, "Worsened", 1.0), ("P2", 8.0, "Worsened", 1.0)],
        "patient_id string, baseline_value double, response_status string, change double",
    )
    meds = spark.createDataFrame([("P2", "GLP-1 Receptor Agonist")], "patient_id string, drug_class string")

    def size(**filters):
        return A.cohort_slice(patients, outcomes, meds, A.CohortFilter(**filters)).count()

    assert size(conditions=("asthma / copd",)) == 2
    assert size(conditions=("copd",)) == 1
    assert size(min_age=65) == 1
    assert size(drugs=("Metformin",)) == 2
    assert size(drugs=("GLP-1 Receptor Agonist",)) == 1
    assert size(min_age=65, drugs=("GLP-1 Receptor Agonist",)) == 0


def test_offsets_start_at_1001_and_go_on(spark):
    schema = "event_id long, topic string, partition_id int"
    first = G.assign_offsets(spark.createDataFrame([(5, "a", 0), (3, "a", 0), (9, "b", 0)], schema))
    assert {(r.event_id, r.offset) for r in first.collect()} == {(3, 1001), (5, 1002), (9, 1001)}
    more = spark.createDataFrame([(11, "a", 0), (12, "c", 0)], schema)
    second = G.assign_offsets(more, existing=first)
    assert {(r.event_id, r.offset) for r in second.collect()} == {(11, 1003), (12, 1001)}


def test_log_ids_continue_from_the_largest(spark):
    log = spark.createDataFrame([("AUD-0003", "x", "seed"), ("AUD-0011", "y", "seed")], "log_id string, details string, entry_type string")
    new = spark.createDataFrame([(2, "b"), (1, "a")], "event_id long, details string")
    whole = G.append_log(log, new, "event_id")
    assert [r.log_id for r in G.recent_entries(whole, 3).collect()] == ["AUD-0013", "AUD-0012", "AUD-0011"]
    assert {r.details for r in whole.where("log_id = 'AUD-0012'").collect()} == {"a"}


def test_lag_of_an_unread_topic_is_everything(spark):
    sent = spark.createDataFrame([("a", 0, 1001), ("a", 0, 1002), ("b", 0, 1001)], "topic string, partition_id int, offset long")
    committed = spark.createDataFrame([("a", 0, 1001)], "topic string, partition_id int, committed_offset long")
    got = {r.topic: r.lag for r in G.consumer_lag(sent, committed).collect()}
    assert got == {"a": 1, "b": 1}


def _primary(spark, outcomes):
    patients = spark.createDataFrame(
        [("P1", 50, "Obesity", "")], "patient_id string, age int, conditions string, medications string"
    )
    enrolled = spark.createDataFrame(
        [("P1", "T1", "2024-01-01"), ("P1", "T2", "2024-02-01"), ("P2", "T1", None)],
        "patient_id string, trial_id string, enrollment_date string",
    )
    measured = spark.createDataFrame(
        outcomes,
        "outcome_id string, patient_id string, trial_id string, outcome_type string, unit string, "
        "baseline_value double, followup_value double, measurement_date string, "
        "adverse_events string, treatment_completed boolean",
    )
    meds = spark.createDataFrame(
        [("M2", "P1", "T2", "B", "C", "2 mg", "Oral", 4, "2024-01-01"),
         ("M1", "P1", "T2", "A", "C", "1 mg", "Oral", 4, "2024-01-01"),
         ("M0", "P1", "T2", "Z", "C", "1 mg", "Oral", 4, "2024-01-02")],
        "medication_id string, patient_id string, trial_id string, medication_name string, "
        "drug_class string, dose string, route string, duration_weeks int, start_date string",
    )
    return O.primary_cases(patients, enrolled, measured, meds)


def test_primary_cases_take_first_rows(spark):
    def outcome(i, patient, trial, value):
        return (i, patient, trial, "HbA1c", "%", value, 1.0, None, None, True)

    rows = [outcome("O2", "P1", "T2", 2.0), outcome("O1", "P1", "T2", 3.0), outcome(None, "P1", "T2", 4.0),
            outcome("O0", "P1", "T1", 5.0), outcome(None, "P2", "T1", 6.0)]
    got = {r.patient_id: r for r in _primary(spark, rows).collect()}
    first = got["P1"]
    assert (first.trial_id, first.outcome_id, first.baseline_value) == ("T2", "O1", 3.0)
    assert (first.medication_name, first.dose, first.interventions) == ("A", "1 mg", 3)
    # Without any outcome id there is a case, but no outcome.
    assert (got["P2"].outcome_id, got["P2"].baseline_value, got["P2"].interventions) == (None, None, None)


def test_primary_cases_move_only_what_is_asked_for(spark):
    rows = [("O1", "P1", "T2", "HbA1c", "%", 2.0, 1.0, None, None, True)]
    cases = _primary(spark, rows).select("case_id", "baseline_value", "drug_class")
    plan = cases._jdf.queryExecution().optimizedPlan().toString()
    above_the_rows = [line for line in plan.splitlines() if "LogicalRDD" not in line]
    assert any("baseline_value#" in line for line in above_the_rows)
    assert not any(f"{c}#" in line for line in above_the_rows for c in ("dose", "unit", "adverse_events"))
