from __future__ import annotations

import random

import pytest

from cohortlake.operators import lakehouse as L
from cohortlake.operators import quality as Q
from cohortlake.operators import records as R
from cohortlake.plans.lake_build import build_lake
from cohortlake.sources.raw import read_fact

RAW = {
    "patients": "patient_id,gender,age,conditions,medications\n"
    "P1,F,46,Type 2 Diabetes|Hypertension,Metformin\nP2,M,30,Hypertension,\nP3,M,,Obesity,\n",
    "trials": "trial_id,title,phase,condition,drug_class,sponsor\n"
    "T1,One,Phase 3,Type 2 Diabetes,GLP-1 Agonist,S\nT2,Two,Phase 2,Hypertension,ACE Inhibitor,S\n",
    "enrollments": "enrollment_id,patient_id,trial_id,arm,enrollment_date,status\n"
    "E1,P1,T1,A,2024-01-01,COMPLETED\nE2,P2,T2,B,2024-02-01,WITHDRAWN\n",
    "outcomes": "outcome_id,patient_id,trial_id,outcome_type,unit,baseline_value,followup_value,change,"
    "change_pct,measurement_date,response_status,adverse_events,treatment_completed\n"
    "O1,P1,T1,HbA1c,%,9.1,7.2,-1.9,-20.9,2024-06-01,Strong Response,None,true\n"
    "O2,P1,T1,HbA1c,%,9.0,9.0,0,0,2024-07-01,No Response,Nausea,true\n"
    "O3,P2,T2,HbA1c,%,8.0,7.0,-1,-12.5,2024-07-01,Moderate Response,,false\n",
    "medications": "medication_id,patient_id,trial_id,medication_name,drug_class,dose,start_date,is_investigational\n"
    "M1,P1,T1,Later,GLP-1 Agonist,5 mg,2024-03-01,true\nM2,P1,T1,,GLP-1 Agonist,,2024-01-01,true\n"
    "M3,P1,T1,Background,Biguanide,1 g,2023-01-01,false\n",
}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    (root / "raw").mkdir()
    for name, text in RAW.items():
        (root / "raw" / f"{name}.csv").write_text(text)
    report = build_lake(spark, str(root / "raw"), str(root))
    return str(root), report


def test_bronze_counts_what_it_drops(lake):
    _, report = lake
    assert report.bronze["patients"] == {"rows_in": 3, "rows_kept": 2}
    assert report.bronze["medications"] == {"rows_in": 3, "rows_kept": 2}


def test_silver_fact_has_the_first_investigational_drug(spark, lake):
    root, _ = lake
    fact = {r.outcome_id: r for r in read_fact(spark, root).collect()}
    assert len(fact) == 3
    assert (fact["O1"].medication_name, fact["O1"].dose) == ("Later", "5 mg")
    assert fact["O1"].age_group == "45-59" and fact["O1"].has_diabetes
    assert fact["O3"].medication_name is None and fact["O3"].age_group == "<30"
    assert fact["O1"].adverse_events is None and fact["O1"].responded


def test_gold_tables(spark, lake):
    root, _ = lake

    def gold(name):
        return spark.read.parquet(f"{root}/gold/{name}.parquet").collect()

    kpis = {r.metric: r.value for r in gold("population_kpis")}
    assert kpis["total_patients"] == 2 and kpis["total_outcomes"] == 3
    assert kpis["overall_response_rate"] == 0.6667 and kpis["adverse_event_rate"] == 0.3333
    trials = {r.trial_id: r for r in gold("trial_kpis")}
    assert trials["T1"].total_enrolled == 1 and trials["T1"].title == "One"
    cohorts = {r.cohort_label: r.cohort_size for r in gold("cohort_stats")}
    assert cohorts == {
        "Responsive Diabetic": 1, "Treatment-Resistant Diabetic": 1, "Hypertension-Only": 1,
    }
    assert [r.medication_name for r in gold("drug_effectiveness")] == ["Later"]


def test_first_non_null_per_column(spark):
    rows = [
        ("M1", "P", "T", None, "C1", None, "2024-01-01", True),
        ("M2", "P", "T", "B", "C2", None, "2024-01-02", True),
        ("M3", "P", "T", "C", "C3", "5 mg", "2024-01-03", True),
        ("M0", "P", "T", "Z", "C0", "1 mg", "2023-01-03", False),
    ]
    meds = spark.createDataFrame(
        rows,
        "medication_id string, patient_id string, trial_id string, medication_name string, "
        "drug_class string, dose string, start_date string, is_investigational boolean",
    )
    row = L.first_medication(meds).first()
    assert (row.medication_name, row.drug_class, row.dose) == ("B", "C1", "5 mg")


def test_rate_divides_by_distinct_patients(spark):
    fact = spark.createDataFrame(
        [("O1", "P", "T", "Strong Response", 1.0, 1.0)] + [("O2", "P", "T", "Strong Response", 1.0, 1.0)],
        "outcome_id string, patient_id string, trial_id string, response_status string, "
        "change double, change_pct double",
    )
    assert L.trial_kpis(fact).first().response_rate == 2.0


def test_mutations(spark):
    schema = "id string, v int"
    base = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    upserts = spark.createDataFrame([("b", 20), ("d", 4), ("e", 5)], schema)
    deletes = spark.createDataFrame([("c",), ("e",)], "id string")
    got = R.apply_mutations(base, upserts, deletes, "id").collect()
    assert {(r.id, r.v) for r in got} == {("a", 1), ("b", 20), ("d", 4)}


def test_reimport_creates_nothing(spark):
    frame = spark.createDataFrame([(f"p{i}",) for i in range(8)], "external_id string")
    assert R.new_records_only(frame, frame, "external_id").count() == 0
    report = R.import_report(frame, frame, "external_id").first()
    assert (report.total_parsed, report.created, report.skipped_duplicate) == (8, 0, 8)


def test_records_without_a_key_are_new(spark):
    frame = spark.createDataFrame([(None,), ("a",)], "external_id string")
    assert R.import_report(frame, frame, "external_id").first().created == 1


def test_duplicates_count_nulls_as_one_id(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "id string")
    assert R.duplicate_ids(frame, "id").first().duplicates == 2


def test_search(spark):
    trials = spark.createDataFrame(
        [("T1", "Blue", "Phase 3", "COPD|Asthma"), ("T2", "Red", "Phase 2", "Asthma")],
        "trial_id string, title string, phase string, condition string",
    )
    assert {r.trial_id for r in R.search_trials(trials, text="asth").collect()} == {"T1", "T2"}
    assert [r.trial_id for r in R.search_trials(trials, "Phase 2", "t2").collect()] == ["T2"]
    assert R.search_trials(trials, text="zzz").count() == 0


def test_gates(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    with pytest.raises(Q.QualityGateError):
        Q.assert_non_empty(empty)
    with pytest.raises(Q.QualityGateError):
        Q.assert_table_exists(spark, str(tmp_path / "none"))
    metrics = spark.createDataFrame([(0.9, 0.8)], "accuracy double, roc_auc double")
    got = {r.metric: r.value for r in Q.report_model_metrics(metrics).collect()}
    assert got == {"accuracy": 0.9, "roc_auc": 0.8}


def test_clean_tables_pass_every_check(spark, lake):
    root, _ = lake
    names = ("patients", "trials", "outcomes", "enrollments", "medications")
    t = {n: spark.read.parquet(f"{root}/bronze/{n}.parquet") for n in names}
    report = {r.check.split()[0]: r for r in Q.data_quality_report(**t).collect()}
    assert report["Age"].status == "PASSED" and report["Duplicate"].violations == 0
    assert report["Biomarker"].pass_rate == 100.0


MEDS = (
    "medication_id string, patient_id string, trial_id string, medication_name string, "
    "drug_class string, dose string, start_date string, is_investigational boolean"
)


def test_first_medication_against_a_loop(spark):
    rng = random.Random(4)
    pick = lambda *values: rng.choice([None, *values])
    rows = [
        (f"M{i}", pick("P1", "P2"), pick("T1", "T2"), pick("A", "B"), pick("C", "D"), pick("1 mg"),
         pick("2024-01-01", "2024-01-02"), True)
        for i in range(60)
    ]
    want = {}
    for row in sorted(rows, key=lambda r: (r[6] is not None, r[6] or "", r[0])):
        first = want.setdefault(row[1:3], [None] * 3)
        for i, v in enumerate(row[3:6]):
            first[i] = v if first[i] is None else first[i]
    got = L.first_medication(spark.createDataFrame(rows, MEDS)).collect()
    assert {tuple(r[:2]): list(r[2:]) for r in got} == want and len(got) == len(want)


def test_a_medication_moves_its_id_once(spark):
    plan = L.first_medication(spark.createDataFrame([], MEDS))._jdf.queryExecution().optimizedPlan()
    whole = [line for line in plan.toString().splitlines() if "Aggregate [" in line]
    assert len(whole) == 1 and whole[0].count("isnotnull(dose") >= 1 and whole[0].count("min(") == 4
    assert "min_by" not in whole[0]


def _facts(spark):
    outcomes = spark.createDataFrame(
        [("O1", "P1", "T1", "Strong Response"), ("O2", "P9", "T9", None), ("O3", None, "T1", "No Response")],
        "outcome_id string, patient_id string, trial_id string, response_status string",
    )
    patients = spark.createDataFrame(
        [("P1", "F", 46, "Obesity", "x|y")],
        "patient_id string, gender string, age int, conditions string, medications string",
    )
    trials = spark.createDataFrame(
        [("T1", "One", "Phase 3", "Obesity", "S")],
        "trial_id string, title string, phase string, condition string, sponsor string",
    )
    meds = spark.createDataFrame([("M1", "P1", "T1", "A", "C", "1 mg", "2024-01-01", True)], MEDS)
    enrolled = spark.createDataFrame(
        [("P1", "T1", "A", "2024-01-01", "ACTIVE")],
        "patient_id string, trial_id string, arm string, enrollment_date string, status string",
    )
    return (
        L.patient_outcomes(outcomes, patients, trials, meds),
        L.patient_outcomes_fact(outcomes, enrolled, patients),
    )


def test_rows_without_patient_or_trial(spark):
    full, fact = ({r.outcome_id: r for r in df.collect()} for df in _facts(spark))
    assert tuple(full["O1"]) == (
        "P1", "T1", "O1", "Strong Response", "F", 46, "Obesity", "One", "Phase 3", "Obesity", "S",
        "A", "C", "1 mg", "45-59", False, False, True, True,
    )
    assert tuple(full["O2"])[4:] == (None,) * 11 + (False,) * 4
    assert (full["O3"].title, full["O3"].has_obesity, full["O3"].responded) == ("One", False, False)
    assert tuple(fact["O1"]) == (
        "P1", "T1", "O1", "Strong Response", "A", "2024-01-01", "ACTIVE", 46, "F", 1, 2, False, 1,
    )
    assert tuple(fact["O2"])[4:] == (None,) * 8 + (0,)


def test_long_columns_are_joined_last(spark):
    def joins(df):
        lines = df._jdf.queryExecution().analyzed().toString().splitlines()
        keys = [line.partition("Join LeftOuter, ")[2] for line in lines if "Join LeftOuter" in line]
        return [("patient_id" in k, "trial_id" in k) for k in keys]

    full, fact = _facts(spark)
    # From the last join to the first: trials, patients, both keys; enrolments, patients.
    assert joins(full) == [(False, True), (True, False), (True, True)]
    assert joins(fact) == [(True, True), (True, False)]
    texts = full.select("outcome_id", "has_obesity")._jdf.queryExecution().optimizedPlan().toString()
    assert "conditions" not in texts.partition("Join LeftOuter")[0]


def test_fact_rows_move_once_for_the_patient(spark):
    """Outcomes meet drugs and patients where they were dealt by patient, and move on by trial."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = "patient_id string, trial_id string"
        frames = [
            spark.createDataFrame([], f"outcome_id string, {keys}, response_status string"),
            spark.createDataFrame([], "patient_id string, gender string, age int, conditions string"),
            spark.createDataFrame([], "trial_id string, title string, phase string, condition string, sponsor string"),
            spark.createDataFrame([], MEDS),
        ]
        plan = L.patient_outcomes(*frames)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Outcomes, drugs and patients by patient; the joined rows and trials by trial.
    assert plan.count("Exchange hashpartitioning(patient_id") == 3 and "hashpartitioning(patient_id#0, trial" not in plan
    assert plan.count("Exchange hashpartitioning(trial_id") == 2 and plan.count("Exchange") == 5
