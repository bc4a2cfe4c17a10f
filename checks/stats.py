"""Checks of analytics, quality measures and log operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import POSITIVE, Registry, r6, sql_list
from cohortlake.functions import columns as C
from cohortlake.operators import analytics as A
from cohortlake.operators import logs as G
from cohortlake.operators import quality as Q

reg = Registry()

HAS_AE = "coalesce(length(trim(adverse_events)) > 0, FALSE)"
NEGATIVE = f"NOT ({POSITIVE})"
CONDITIONS = f"""pc AS (SELECT DISTINCT patient_id, unnest({sql_list('conditions')}) AS condition FROM patients)"""
LAST = """last AS (SELECT patient_id, max_by(response_status, (measurement_date, outcome_id)) AS response_status
 FROM outcomes GROUP BY 1)"""


# --- joins and distributions -------------------------------------------------------


@reg.add(
    "j04_drug_response_join",
    "medications outcomes",
    f"""SELECT m.drug_class, count(*) AS sample_size, count(CASE WHEN {POSITIVE} THEN 1 END) AS responders,
 count(o.change) AS change_count, {r6('sum(o.change) / 1000000')} AS change_sum_millions,
 count(CASE WHEN o.treatment_completed THEN 1 END) AS completed, count(CASE WHEN {HAS_AE} THEN 1 END) AS adverse_events
 FROM medications m JOIN outcomes o ON m.patient_id = o.patient_id GROUP BY 1""",
)
def _(v):
    counts = A.drug_response_counts(v.medications, v.outcomes)
    return counts.withColumn("change_sum_millions", F.col("change_sum") / 1000000).drop("change_sum")


@reg.add(
    "j05_enrollment_phase_join",
    "trials enrollments",
    "SELECT e.enrollment_id, e.status, t.phase FROM enrollments e LEFT JOIN trials t ON e.trial_id = t.trial_id",
)
def _(v):
    return A.enrollment_phase_join(v.enrollments, v.trials).select(
        "enrollment_id", "status", "phase"
    )


@reg.add(
    "j11_condition_trial_counts",
    "patients trials",
    f"""WITH {CONDITIONS} SELECT pc.condition, count(*) AS patients, max(coalesce(t.n, 0)) AS trials FROM pc
 LEFT JOIN (SELECT condition, count(*) AS n FROM trials GROUP BY 1) t ON pc.condition = t.condition GROUP BY 1""",
)
def _(v):
    counts = A.patient_conditions(v.patients).groupBy("condition").agg(
        F.count(F.lit(1)).alias("patients")
    )
    return A.conditions_with_trials(counts, v.trials)


@reg.add(
    "a07_response_distribution",
    "outcomes",
    f"""SELECT response_status, count(*) AS outcomes, {r6('count(*) * 100.0 / (SELECT count(*) FROM outcomes)')} AS pct
 FROM outcomes GROUP BY 1""",
)
def _(v):
    return A.response_distribution(v.outcomes, digits=None)


@reg.add(
    "a08_positive_response_rate",
    "outcomes",
    f"SELECT {r6(f'avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END)')} AS positive_rate FROM outcomes",
)
def _(v):
    return A.positive_response_rate(v.outcomes, digits=None)


@reg.add(
    "a09_top_conditions",
    "patients outcomes trials",
    f"""WITH {CONDITIONS}, {LAST} SELECT c.condition, patients, responders, coalesce(t.n, 0) AS trials,
 {r6('responders * 100.0 / patients')} AS response_rate FROM (
  SELECT pc.condition, count(*) AS patients, count(CASE WHEN {POSITIVE} THEN 1 END) AS responders
  FROM pc LEFT JOIN last ON pc.patient_id = last.patient_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) c
 LEFT JOIN (SELECT condition, count(*) AS n FROM trials GROUP BY 1) t ON c.condition = t.condition""",
)
def _(v):
    return A.top_conditions(v.patients, v.outcomes, v.trials, digits=None)


@reg.add(
    "a10_last_response_per_patient", "outcomes", f"WITH {LAST} SELECT * FROM last"
)
def _(v):
    return A.last_response_per_patient(v.outcomes)


@reg.add(
    "a11_drug_class_effectiveness",
    "medications outcomes",
    f"""SELECT m.drug_class, count(*) AS sample_size, count(CASE WHEN {POSITIVE} THEN 1 END) AS responders,
 {r6(f'count(CASE WHEN {POSITIVE} THEN 1 END) * 100.0 / count(*)')} AS response_rate
 FROM medications m JOIN outcomes o ON m.patient_id = o.patient_id GROUP BY 1""",
)
def _(v):
    return A.drug_class_effectiveness(v.medications, v.outcomes, digits=None)


@reg.add(
    "a12_phase_distribution",
    "trials",
    f"""SELECT phase, count(*) AS trials, {r6('count(*) * 100.0 / (SELECT count(*) FROM trials)')} AS pct
 FROM trials GROUP BY 1""",
)
def _(v):
    return A.phase_distribution(v.trials, digits=None)


@reg.add(
    "a13_enrollment_trend",
    "enrollments outcomes",
    """SELECT cast(month AS DATE) AS month, cast(sum(e) AS BIGINT) AS enrolments, cast(sum(o) AS BIGINT) AS outcomes FROM (
 SELECT date_trunc('month', enrollment_date) AS month, 1 AS e, 0 AS o FROM enrollments
 UNION ALL SELECT date_trunc('month', measurement_date), 0, 1 FROM outcomes) x
 GROUP BY 1 ORDER BY 1 DESC LIMIT 12""",
)
def _(v):
    return A.enrollment_trend(v.enrollments, v.outcomes)


@reg.add(
    "a14_trial_performance",
    "trials enrollments outcomes",
    f"""SELECT t.trial_id, t.title, t.phase, coalesce(e.n, 0) AS total_enrolled, coalesce(e.done, 0) AS total_completed,
 {r6('e.gone * 100.0 / e.n')} AS dropout_rate, {r6('o.rate')} AS response_rate, {r6('o.med')} AS median_change,
 coalesce(o.ae, 0) AS adverse_events_count FROM trials t
 LEFT JOIN (SELECT trial_id, count(*) AS n, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS done,
  count(CASE WHEN status IN ('WITHDRAWN', 'DROPPED_OUT', 'TERMINATED') THEN 1 END) AS gone FROM enrollments GROUP BY 1) e
  ON t.trial_id = e.trial_id
 LEFT JOIN (SELECT trial_id, avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END) AS rate, median(change) AS med,
  count(CASE WHEN {HAS_AE} THEN 1 END) AS ae FROM outcomes GROUP BY 1) o ON t.trial_id = o.trial_id""",
)
def _(v):
    return A.trial_performance(v.trials, v.enrollments, v.outcomes, digits=False)


@reg.add(
    "a15_trial_outcome_rates",
    "enrollments outcomes",
    f"""SELECT o.trial_id, coalesce(e.n, 0) AS total_enrolled, coalesce(e.done, 0) AS total_completed,
 coalesce(e.n, 0) - coalesce(e.done, 0) AS total_withdrawn, {r6('o.pos')} AS response_rate, {r6('o.neg')} AS no_response_rate,
 {r6('o.unk')} AS unknown_rate, {r6('o.chg')} AS avg_outcome_change FROM (
 SELECT trial_id, avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END) AS pos,
  avg(CASE WHEN response_status IN ('No Response', 'Worsened') THEN 100.0 ELSE 0.0 END) AS neg,
  avg(CASE WHEN response_status = 'Unknown' THEN 100.0 ELSE 0.0 END) AS unk, avg(change) AS chg FROM outcomes GROUP BY 1) o
 LEFT JOIN (SELECT trial_id, count(*) AS n, count(CASE WHEN status = 'COMPLETED' THEN 1 END) AS done
  FROM enrollments GROUP BY 1) e ON o.trial_id = e.trial_id""",
)
def _(v):
    return A.trial_outcome_rates(v.enrollments, v.outcomes, digits=False)


EFFECT = f"""pairs AS (SELECT m.drug_class, o.* FROM medications m JOIN outcomes o ON m.patient_id = o.patient_id),
 ev AS (SELECT drug_class, adverse_events AS event, count(*) AS n,
  row_number() OVER (PARTITION BY drug_class ORDER BY count(*) DESC, adverse_events) AS rn
  FROM pairs WHERE {HAS_AE} GROUP BY 1, 2),
 eff AS (SELECT drug_class, count(*) AS n, count(CASE WHEN {POSITIVE} THEN 1 END) AS pos, avg(change) AS chg,
  count(CASE WHEN treatment_completed THEN 1 END) AS done, count(CASE WHEN {HAS_AE} THEN 1 END) AS ae FROM pairs GROUP BY 1)"""


@reg.add(
    "a16_medication_effectiveness",
    "medications outcomes",
    f"""WITH {EFFECT} SELECT eff.drug_class, eff.n AS sample_size, {r6('pos * 100.0 / eff.n')} AS response_rate,
 {r6('chg')} AS mean_change, {r6('done * 100.0 / eff.n')} AS completion_rate,
 {r6('least(100.0, ae * 100.0 / eff.n)')} AS adverse_event_rate,
 (SELECT string_agg(event || ' (' || printf('%.1f', ev.n * 100.0 / eff.n) || '%)', '; ' ORDER BY rn) FROM ev
  WHERE ev.drug_class = eff.drug_class AND rn <= 2) AS common_adverse_events,
 CASE WHEN contains(eff.drug_class, 'GLP') THEN 'Type 2 Diabetes & Obesity'
  WHEN contains(eff.drug_class, 'ACE') OR contains(eff.drug_class, 'ARB') THEN 'Hypertension & Cardiovascular'
  WHEN contains(eff.drug_class, 'SGLT') THEN 'Type 2 Diabetes & Heart Failure' ELSE 'Type 2 Diabetes' END AS primary_indication
 FROM eff""",
)
def _(v):
    found = A.medication_effectiveness(v.medications, v.outcomes, digits=False)
    return found.withColumn("common_adverse_events", F.array_join("common_adverse_events", "; "))


@reg.add(
    "a17_top_adverse_events",
    "outcomes",
    f"""SELECT trial_id, event, occurrences, rank, {r6('occurrences * 100.0 / total')} AS prevalence_pct FROM (
 SELECT trial_id, adverse_events AS event, count(*) AS occurrences,
  row_number() OVER (PARTITION BY trial_id ORDER BY count(*) DESC, adverse_events) AS rank
  FROM outcomes WHERE {HAS_AE} GROUP BY 1, 2) x
 JOIN (SELECT trial_id, count(*) AS total FROM outcomes GROUP BY 1) t USING (trial_id) WHERE rank <= 2""",
)
def _(v):
    top = A.top_adverse_events(v.outcomes, 2, ("trial_id",), digits=None)
    return top.withColumn("rank", F.col("rank").cast("long"))


@reg.add(
    "a18_completion_by_phase",
    "trials enrollments",
    f"""SELECT t.phase, count(CASE WHEN e.status = 'COMPLETED' THEN 1 END) AS completed, count(*) AS total_enrolled,
 {r6("count(CASE WHEN e.status = 'COMPLETED' THEN 1 END) * 100.0 / count(*)")} AS completion_rate
 FROM enrollments e JOIN trials t ON e.trial_id = t.trial_id GROUP BY 1""",
)
def _(v):
    return A.completion_by_phase(v.enrollments, v.trials, digits=None)


@reg.add(
    "a19_top_trials_by_enrollment",
    "enrollments",
    "SELECT trial_id, count(*) AS enrollments FROM enrollments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(v):
    return A.top_trials_by_enrollment(v.enrollments)


def factor_sql(name: str, label: str, test: str) -> str:
    weak = f"count(CASE WHEN {test} AND {NEGATIVE} THEN 1 END)"
    return f"""SELECT '{name}' AS factor, '{label}' AS association, {weak} AS patients_affected,
 count(CASE WHEN {test} THEN 1 END) AS group_size, {r6(f'{weak} * 100.0 / greatest(1, count(CASE WHEN {test} THEN 1 END))')} AS non_response_pct
 FROM outcomes"""


@reg.add(
    "a20_non_response_factors",
    "patients outcomes medications",
    " UNION ALL ".join(
        [
            factor_sql(
                "High Baseline Disease Severity (top 25th percentile)",
                "High",
                "baseline_value > (SELECT quantile_cont(baseline_value, 0.75) FROM outcomes)",
            ),
            factor_sql(
                "Polypharmacy (≥3 concurrent medications)",
                "Moderate",
                "patient_id IN (SELECT patient_id FROM medications GROUP BY 1 HAVING count(*) >= 3)",
            ),
            factor_sql(
                "Age ≥ 65 years",
                "Moderate",
                "patient_id IN (SELECT patient_id FROM patients WHERE age >= 65)",
            ),
        ]
    ),
)
def _(v):
    return Q.non_response_factors(v.outcomes, v.medications, v.patients, digits=None)


FIVE = "patients trials enrollments outcomes medications"


def five(v):
    return {n: getattr(v, n) for n in FIVE.split()}


@reg.add(
    "a21_dataset_summary",
    FIVE,
    " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS records FROM {n}" for n in FIVE.split()),
)
def _(v):
    return A.dataset_summary(five(v))


COLUMNS = {
    "patients": "patient_id external_id gender age birth_date conditions medications allergies hba1c bmi source",
    "trials": "trial_id nct_id title phase condition drug_class status enrollment_target sponsor min_age max_age gender",
    "enrollments": "enrollment_id patient_id trial_id arm enrollment_date status",
    "outcomes": "outcome_id patient_id trial_id outcome_type unit baseline_value followup_value change change_pct measurement_date response_status adverse_events treatment_completed",
    "medications": "medication_id patient_id trial_id medication_name drug_class dose route start_date end_date duration_weeks is_investigational",
}


def nulls_sql(table: str) -> str:
    cells = " + ".join(f"count(*) - count({c})" for c in COLUMNS[table].split())
    return f"(SELECT {cells} FROM {table})"


QUALITY = f"""m AS (SELECT
 (SELECT count(*) FROM outcomes WHERE baseline_value < 4.0 OR baseline_value > 15.0) AS bv, (SELECT count(baseline_value) FROM outcomes) AS bt,
 (SELECT count(*) FROM patients WHERE age < 18 OR age > 90) AS av, (SELECT count(age) FROM patients) AS age_n,
 (SELECT count(*) FROM medications WHERE cast(end_date AS DATE) < cast(start_date AS DATE)) AS dv,
 (SELECT count(*) FROM medications WHERE start_date IS NOT NULL AND end_date IS NOT NULL) AS dt,
 (SELECT count(*) FROM outcomes WHERE followup_value IS NULL) AS fv, (SELECT count(*) FROM outcomes) AS ft,
 (SELECT count(*) - count(DISTINCT patient_id) FROM patients) AS pv, (SELECT count(*) FROM patients) AS pt,
 {' + '.join(f'(SELECT count(*) FROM {n})' for n in FIVE.split())} AS total,
 {' + '.join(nulls_sql(n) for n in FIVE.split())} AS nulls),
 s AS (SELECT *, nulls + bv + av + dv + fv + pv AS bad FROM m)"""


def check_sql(name: str, bad: str, total: str, status: str) -> str:
    return f"""SELECT '{name}' AS "check", CASE WHEN {bad} = 0 THEN 'PASSED' ELSE '{status}' END AS status, {bad} AS violations,
 {total} AS checked, {r6(f'({total} - {bad}) * 100.0 / {total}')} AS pass_rate, {r6('greatest(0, total - bad) * 100.0 / total')} AS score,
 CASE WHEN greatest(0, total - bad) * 100.0 / total >= 90 THEN 'EXCELLENT' WHEN greatest(0, total - bad) * 100.0 / total >= 75 THEN 'GOOD'
  ELSE 'NEEDS_REVIEW' END AS band, nulls AS null_fields FROM s"""


@reg.add(
    "a22_data_quality_report",
    FIVE,
    f"WITH {QUALITY} "
    + " UNION ALL ".join(
        check_sql(name, bad, total, status)
        for (name, _, _, status), bad, total in zip(
            Q.CHECKS, ("bv", "av", "dv", "fv", "pv"), ("bt", "age_n", "dt", "ft", "pt")
        )
    ),
)
def _(v):
    report = Q.data_quality_report(**five(v), digits=None)
    return report.select(
        "check", "status", "violations", "checked", "pass_rate",
        F.col("overall.overall_quality_score").alias("score"),
        F.col("overall.quality_status").alias("band"),
        F.col("overall.total_null_fields").alias("null_fields"),
    )


@reg.add(
    "a23_null_violations",
    "trials",
    """SELECT 'min_age' AS "column", count(*) - count(min_age) AS nulls FROM trials
 UNION ALL SELECT 'max_age', count(*) - count(max_age) FROM trials
 UNION ALL SELECT 'title', count(*) - count(title) FROM trials""",
)
def _(v):
    return Q.null_violations(v.trials, ["min_age", "max_age", "title"])


@reg.add(
    "a24_delta_completeness",
    "outcomes",
    """SELECT count(*) AS records, count(baseline_value + followup_value) AS deltas_computed,
 count(CASE WHEN response_status = 'Strong Response' THEN 1 END) AS strong_responders FROM outcomes""",
)
def _(v):
    return Q.delta_completeness(v.outcomes)


@reg.add(
    "a25_criteria_coverage",
    "trials",
    "SELECT count(*) AS trials, count(condition) AS criteria_cells FROM trials",
)
def _(v):
    return Q.criteria_coverage(v.trials)


@reg.add(
    "a26_age_drift_score",
    "patients",
    f"""SELECT {r6('stddev_samp(age) / greatest(avg(age), 1) * 0.1')} AS drift_score,
 stddev_samp(age) / greatest(avg(age), 1) * 0.1 > 0.1 AS drift_detected FROM patients""",
)
def _(v):
    return Q.age_drift_score(v.patients, digits=None)


@reg.add(
    "a27_distinct_pairs",
    "medications outcomes",
    """SELECT count(*) AS distinct_pairs FROM (SELECT DISTINCT m.drug_class, o.response_status FROM outcomes o
 JOIN medications m ON o.patient_id = m.patient_id AND o.trial_id = m.trial_id) x""",
)
def _(v):
    return Q.drug_response_pairs(v.outcomes, v.medications)


@reg.add(
    "a29_trial_response_rates",
    "outcomes",
    f"SELECT trial_id, {r6(f'avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END)')} AS response_rate FROM outcomes GROUP BY 1",
)
def _(v):
    return A.trial_response_rates(v.outcomes, digits=None)


RUNS = """runs AS (SELECT concat('run_', cast(event_id AS VARCHAR)) AS run_id, topic AS dag_id, event_time AS execution_date,
 CASE WHEN value > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS state, value AS duration_ms FROM lab_events)"""


def runs(v):
    return v.lab_events.select(
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("topic").alias("dag_id"),
        F.col("event_time").alias("execution_date"),
        F.when(F.col("value") > 0, "SUCCESS").otherwise("FAILED").alias("state"),
        F.col("value").alias("duration_ms"),
    )


@reg.add(
    "a30_latest_run_per_job",
    "lab_events",
    f"""WITH {RUNS} SELECT dag_id, run_id, execution_date, state, {r6('duration_ms')} AS duration_ms FROM (
 SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY execution_date DESC, run_id DESC) AS rn FROM runs) x WHERE rn = 1""",
)
def _(v):
    return G.latest_run(runs(v))


@reg.add(
    "a31_effectiveness_leaders",
    "medications outcomes",
    f"""WITH {EFFECT} SELECT max_by(drug_class, (pos * 1.0 / n, drug_class)) AS best_response_class,
 {r6('max(pos * 100.0 / n)')} AS best_response_rate, max_by(drug_class, (done * 1.0 / n, drug_class)) AS best_completion_class,
 {r6('max(done * 100.0 / n)')} AS best_completion_rate, cast(sum(n) AS BIGINT) AS total_sample FROM eff""",
)
def _(v):
    return A.effectiveness_leaders(
        A.medication_effectiveness(v.medications, v.outcomes, digits=False)
    )


SLICE = A.CohortFilter(
    conditions=("type 2 diabetes", "asthma / copd"), drugs=("DPP-4 Inhibitor",), min_age=40,
    min_baseline=7.5, phase="Phase 3",
)


@reg.add(
    "t10_cohort_slice",
    "patients outcomes medications trials",
    f"""WITH people AS (SELECT patient_id FROM patients WHERE age >= 40
  AND (contains(lower(conditions), 'type 2 diabetes') OR contains(lower(conditions), 'asthma'))),
 takers AS (SELECT DISTINCT patient_id FROM medications WHERE contains(lower(drug_class), 'dpp-4 inhibitor')),
 sl AS (SELECT * FROM outcomes WHERE patient_id IN (SELECT patient_id FROM people) AND baseline_value >= 7.5
  AND patient_id IN (SELECT patient_id FROM takers))
 SELECT count(*) AS slice_size, count(CASE WHEN {POSITIVE} THEN 1 END) AS responders,
 {r6(f'avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END)')} AS response_rate, {r6('median(change)')} AS median_change,
 (SELECT count(*) FROM trials WHERE phase = 'Phase 3' AND (contains(lower(condition), 'type 2 diabetes')
  OR contains(lower(condition), 'asthma'))) AS matching_trials FROM sl""",
)
def _(v):
    rows = A.cohort_slice(v.patients, v.outcomes, v.medications, SLICE)
    summary = A.slice_summary(rows, digits=False)
    return summary.withColumn("matching_trials", A.matching_trials(v.trials, SLICE).scalar())


@reg.add(
    "t10_cohort_slice_events",
    "patients outcomes",
    f"""WITH sl AS (SELECT * FROM outcomes WHERE patient_id IN (SELECT patient_id FROM patients
  WHERE contains(lower(conditions), 'obesity')))
 SELECT adverse_events AS event, count(*) AS occurrences, row_number() OVER (ORDER BY count(*) DESC, adverse_events) AS rank,
 {r6('count(*) * 100.0 / (SELECT count(*) FROM sl)')} AS prevalence_pct FROM sl WHERE {HAS_AE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(v):
    wanted = A.CohortFilter(conditions=("obesity",), drugs=("no such drug",))
    rows = A.cohort_slice(v.patients, v.outcomes, v.medications, wanted)
    return A.top_adverse_events(rows, 5, digits=None).withColumn("rank", F.col("rank").cast("long"))


# --- logs ----------------------------------------------------------------------------------


@reg.add(
    "k03_to_event_messages",
    "outcomes",
    f"""SELECT 'patient.events' AS topic, patient_id AS key, printf('EVT-%05d', row_number() OVER (
  ORDER BY measurement_date, md5(outcome_id), outcome_id)) AS event_id, trial_id, 'OUTCOME_RECORDED' AS event_type, outcome_type,
 {r6('baseline_value')} AS baseline_value, {r6('followup_value')} AS followup_value, {r6('change')} AS change,
 response_status, '2024-05-06 07:08:09' AS timestamp FROM outcomes""",
)
def _(v):
    from cohortlake.schemas import OUTCOME_EVENT

    sent = G.to_event_messages(v.outcomes, emitted_at=F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return sent.select("topic", "key", F.from_json("value", OUTCOME_EVENT).alias("e")).select(
        "topic", "key", "e.event_id", "e.trial_id", "e.event_type", "e.payload.outcome_type",
        "e.payload.baseline_value", "e.payload.followup_value", "e.payload.change", "e.payload.response_status",
        "e.timestamp",
    )


AUDIT = """old AS (SELECT printf('AUD-%04d', row_number() OVER (ORDER BY event_id)) AS log_id,
  concat('Patient ', patient_id, ' / ', topic) AS resource, 'seed' AS entry_type FROM lab_events WHERE topic = 'trial.events'),
 new AS (SELECT printf('AUD-%04d', (SELECT count(*) FROM old) + row_number() OVER (ORDER BY event_id)) AS log_id,
  concat('Patient ', patient_id, ' / ', topic) AS resource, 'runtime' AS entry_type FROM lab_events WHERE topic <> 'trial.events'),
 trail AS (SELECT * FROM old UNION ALL SELECT * FROM new)"""


def audit_trail(v):
    from cohortlake.operators.outcomes import classify_events

    classified = classify_events(v.lab_events.withColumn("unit", F.lit("%")))
    entries = G.stream_audit(classified).withColumn("topic", F.substring_index("resource", "/ ", -1))
    is_old = F.col("topic") == "trial.events"
    empty = v.spark.createDataFrame([], "log_id string")
    seed = G.numbered_entries(empty, entries.where(is_old).drop("topic"), "event_id", "seed")
    seed = seed.drop("event_id")
    return G.append_log(seed, entries.where(~is_old).drop("topic"), "event_id")


@reg.add(
    "k04_append_log",
    "lab_events",
    f"WITH {AUDIT} SELECT log_id, resource, entry_type FROM trail",
)
def _(v):
    return audit_trail(v).select("log_id", "resource", "entry_type")


@reg.add(
    "w09_recent_entries",
    "lab_events",
    f"""WITH {AUDIT} SELECT log_id, resource, entry_type FROM trail
 ORDER BY cast(substr(log_id, 5) AS BIGINT) DESC LIMIT 50""",
)
def _(v):
    return G.recent_entries(audit_trail(v)).select("log_id", "resource", "entry_type")


@reg.add(
    "w10_recent_runs_cap",
    "lab_events",
    f"""WITH {RUNS} SELECT run_id, dag_id, execution_date, state, {r6('duration_ms')} AS duration_ms FROM runs
 ORDER BY execution_date DESC, run_id DESC LIMIT 100""",
)
def _(v):
    return G.recent_runs(runs(v))


# --- stream classification in batch ------------------------------------------------------------


@reg.add(
    "d14_classify_event",
    "lab_events",
    """SELECT event_id, patient_id, CASE WHEN pct <= -20 THEN 'Strong Response' WHEN pct <= -10 THEN 'Moderate Response'
 WHEN pct <= -2 THEN 'Minimal Response' WHEN pct < 2 THEN 'No Response' ELSE 'Worsened' END AS response_class FROM (
 SELECT *, round(round(value - 9.1, 2) / 9.1 * 100, 1) AS pct FROM lab_events) x""",
)
def _(v):
    from cohortlake.operators.outcomes import classify_events

    return classify_events(v.lab_events).select("event_id", "patient_id", "response_class")


@reg.add(
    "d15_event_delta",
    "outcomes",
    f"""SELECT outcome_id, {r6('coalesce(followup_value, 0) - coalesce(baseline_value, 0)')} AS delta FROM outcomes""",
)
def _(v):
    return v.outcomes.select(
        "outcome_id",
        C.event_delta(F.col("baseline_value"), F.col("followup_value")).alias("delta"),
    )
