"""Checks of column functions, records, silver facts and gold aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.base import POSITIVE, Registry, r6, sql_list
from cohortlake.schemas import TableSchema
from cohortlake.sources.raw import coerce_types, require
from cohortlake.functions import columns as C
from cohortlake.operators import lakehouse as L
from cohortlake.operators import records as R

reg = Registry()

AGE_BUCKET = """CASE WHEN age >= 0 AND age < 18 THEN '<18' WHEN age >= 18 AND age < 30 THEN '18-30'
 WHEN age >= 30 AND age < 45 THEN '31-45' WHEN age >= 45 AND age < 60 THEN '46-60'
 WHEN age >= 60 AND age < 75 THEN '61-75' WHEN age >= 75 AND age < 200 THEN '75+' END"""
AGE_GROUP = """CASE WHEN age > 0 AND age <= 30 THEN '<30' WHEN age <= 45 THEN '30-44'
 WHEN age <= 60 THEN '45-59' WHEN age <= 75 THEN '60-74' WHEN age <= 120 THEN '75+' END"""


# --- projections ---------------------------------------------------------------


NUMBER_TEXT = "regexp_extract(text, '[0-9][0-9.]*', 0)"


@reg.add(
    "p01_coerce_types",
    "",
    f"""SELECT doc_id, {r6(f"try_cast({NUMBER_TEXT} AS DOUBLE)")} AS as_double,
 CASE WHEN floor(try_cast({NUMBER_TEXT} AS DOUBLE)) = try_cast({NUMBER_TEXT} AS DOUBLE)
  AND try_cast({NUMBER_TEXT} AS DOUBLE) < 9e18 THEN cast(try_cast({NUMBER_TEXT} AS DOUBLE) AS BIGINT) END AS as_long,
 CASE cast(doc_id % 5 AS VARCHAR) WHEN '1' THEN true WHEN '0' THEN false END AS as_bool, lang AS as_text,
 cast(NULL AS VARCHAR) AS absent FROM documents""",
)
def _(v):
    number = F.regexp_extract("text", "[0-9][0-9.]*", 0)
    raw = v.table("documents").select(
        "doc_id", number.alias("as_double"), number.alias("as_long"),
        (F.col("doc_id") % 5).cast("string").alias("as_bool"), F.col("lang").alias("as_text"),
    )
    declared = TableSchema(
        "numbers",
        (
            ("as_double", T.DoubleType()), ("as_long", T.LongType()), ("as_bool", T.BooleanType()),
            ("as_text", T.StringType()), ("absent", T.StringType()),
        ),
        (),
    )
    return coerce_types(raw, declared)


@reg.add(
    "p03_parse_list",
    "patients",
    f"""SELECT patient_id, array_to_string({sql_list("conditions")}, ';') AS conditions,
 array_to_string({sql_list("medications")}, ';') AS medications FROM patients""",
)
def _(v):
    return v.patients.select(
        "patient_id",
        F.array_join(C.parse_list("conditions"), ";").alias("conditions"),
        F.array_join(C.parse_list("medications"), ";").alias("medications"),
    )


@reg.add("p04_age_bucket", "patients", f"SELECT patient_id, {AGE_BUCKET} AS age_bucket FROM patients")
def _(v):
    return v.patients.select("patient_id", C.age_bucket("age").alias("age_bucket"))


@reg.add("p05_age_group", "patients", f"SELECT patient_id, {AGE_GROUP} AS age_group FROM patients")
def _(v):
    return v.patients.select("patient_id", C.age_group("age").alias("age_group"))


LIST_COUNTS = """cast(len(list_filter(string_split(conditions, '|'), lambda x: trim(x) <> '')) AS INT) AS comorbidity_count,
 cast(len(list_filter(string_split(medications, '|'), lambda x: trim(x) <> '')) AS INT) AS medication_count"""


@reg.add("p06_list_counts", "patients", f"SELECT patient_id, {LIST_COUNTS} FROM patients")
def _(v):
    return v.patients.select(
        "patient_id",
        C.list_count("conditions").alias("comorbidity_count"),
        C.list_count("medications").alias("medication_count"),
    )


@reg.add(
    "p07_polypharmacy",
    "medications",
    "SELECT patient_id, count(*) AS medication_count, count(*) >= 5 AS polypharmacy FROM medications GROUP BY 1",
)
def _(v):
    counts = v.medications.groupBy("patient_id").agg(F.count(F.lit(1)).alias("medication_count"))
    return counts.withColumn("polypharmacy", C.polypharmacy("medication_count"))


@reg.add(
    "p08_condition_flags",
    "patients",
    """SELECT patient_id, contains(lower(conditions), 'diabetes') AS has_diabetes,
 contains(lower(conditions), 'hypertension') AS has_hypertension, contains(lower(conditions), 'obesity') AS has_obesity,
 contains(lower(conditions), 'diab') AS stem_diabetes FROM patients""",
)
def _(v):
    flags = C.condition_flags("conditions")
    stems = C.condition_flags("conditions", stems=True)
    return v.patients.select(
        "patient_id",
        *[c.alias(n) for n, c in flags.items()],
        stems["has_diabetes"].alias("stem_diabetes"),
    )


@reg.add("p09_responded", "outcomes", f"SELECT outcome_id, {POSITIVE} AS responded FROM outcomes")
def _(v):
    return v.outcomes.select("outcome_id", C.responded().alias("responded"))


COHORT = f"""CASE WHEN contains(lower(conditions), 'diabetes') AND NOT {POSITIVE} THEN 'Treatment-Resistant Diabetic'
 WHEN contains(lower(conditions), 'diabetes') THEN 'Responsive Diabetic'
 WHEN contains(lower(conditions), 'hypertension') THEN 'Hypertension-Only'
 WHEN contains(lower(conditions), 'obesity') THEN 'Obesity-Only' ELSE 'Mixed Comorbidities' END"""


@reg.add(
    "p10_cohort_label",
    "patients outcomes",
    f"SELECT outcome_id, {COHORT} AS cohort_label FROM outcomes LEFT JOIN patients USING (patient_id)",
)
def _(v):
    people = v.patients.select("patient_id", "conditions")
    return v.outcomes.join(people, "patient_id", "left").select(
        "outcome_id", C.cohort_label("conditions", C.responded()).alias("cohort_label")
    )


HAS_AE = "coalesce(length(trim(adverse_events)) > 0, FALSE)"


@reg.add(
    "p11_has_adverse_event", "outcomes", f"SELECT outcome_id, {HAS_AE} AS has_ae FROM outcomes"
)
def _(v):
    return v.outcomes.select("outcome_id", C.has_adverse_event().alias("has_ae"))


@reg.add(
    "p12_normalize_gender",
    "patients",
    """SELECT patient_id, lower(gender) AS gender, CASE substr(gender, 1, 1) WHEN 'M' THEN 'male' ELSE 'female' END AS from_code
 FROM patients""",
)
def _(v):
    return v.patients.select(
        "patient_id",
        C.normalize_gender("gender").alias("gender"),
        C.normalize_gender(F.substring("gender", 1, 1)).alias("from_code"),
    )


@reg.add(
    "p13_age_at",
    "patients",
    """SELECT patient_id, cast(greatest(2024 - year(cast(birth_date AS DATE))
 - CASE WHEN 615 < month(cast(birth_date AS DATE)) * 100 + day(cast(birth_date AS DATE)) THEN 1 ELSE 0 END, 0) AS INT) AS age
 FROM patients""",
)
def _(v):
    as_of = F.lit("2024-06-15").cast("date")
    return v.patients.select(
        "patient_id", C.age_at("birth_date", F.lit(None).cast("string"), as_of).alias("age")
    )


@reg.add(
    "p14_require",
    "trials",
    "SELECT trial_id, min_age, max_age FROM trials WHERE min_age IS NOT NULL AND max_age IS NOT NULL",
)
def _(v):
    return require(v.trials, ["min_age", "max_age"]).select("trial_id", "min_age", "max_age")


@reg.add(
    "p15_lookup",
    "outcomes",
    "SELECT outcome_id, trial_id, response_status FROM outcomes WHERE patient_id = 'P0000010'",
)
def _(v):
    return R.lookup(v.outcomes, "patient_id", "P0000010").select(
        "outcome_id", "trial_id", "response_status"
    )


@reg.add(
    "p16_find_by_condition",
    "patients",
    f"""SELECT patient_id, external_id, age FROM patients WHERE list_contains({sql_list("conditions")}, 'COPD')
 ORDER BY patient_id LIMIT 100""",
)
def _(v):
    found = R.find_by_condition(v.patients, "COPD", C.parse_list("conditions"), "patient_id")
    return found.select("patient_id", "external_id", "age")


@reg.add(
    "p17_search_trials",
    "trials",
    """SELECT trial_id, title, phase, condition FROM trials WHERE phase = 'Phase 3'
 AND (contains(lower(title), 'kidney') OR contains(lower(trial_id), 'kidney') OR contains(lower(condition), 'kidney'))""",
)
def _(v):
    return R.search_trials(v.trials, "Phase 3", "Kidney").select(
        "trial_id", "title", "phase", "condition"
    )


@reg.add(
    "p18_filter_drug_class",
    "medications",
    "SELECT medication_id, drug_class FROM medications WHERE contains(lower(drug_class), 'inhibitor')",
)
def _(v):
    return R.filter_drug_class(v.medications, "Inhibitor").select("medication_id", "drug_class")


@reg.add(
    "p19_list_records",
    "trials",
    "SELECT trial_id, nct_id, title, status FROM trials ORDER BY trial_id LIMIT 100",
)
def _(v):
    return R.list_records(v.trials, "trial_id").select("trial_id", "nct_id", "title", "status")


@reg.add(
    "p20_response_midpoint",
    "outcomes",
    f"""SELECT outcome_id, t, {r6('value')} AS value FROM (
 SELECT outcome_id, 'Baseline' AS t, baseline_value AS value FROM outcomes
 UNION ALL SELECT outcome_id, 'Midpoint', baseline_value + (followup_value - baseline_value) / 2 FROM outcomes
 UNION ALL SELECT outcome_id, 'Final', followup_value FROM outcomes) x WHERE value IS NOT NULL""",
)
def _(v):
    from cohortlake.operators.outcomes import response_midpoint

    return response_midpoint(v.outcomes, digits=None)


@reg.add(
    "p21_investigational_only",
    "medications",
    "SELECT medication_id, medication_name FROM medications WHERE is_investigational",
)
def _(v):
    return R.investigational_only(v.medications).select("medication_id", "medication_name")


# --- joins ---------------------------------------------------------------------------


@reg.add(
    "j01_patient_outcomes_fact",
    "patients enrollments outcomes",
    f"""SELECT o.outcome_id, o.patient_id, o.trial_id, e.arm, e.enrollment_date, e.status, p.age, p.gender,
 p.comorbidity_count, p.medication_count, p.has_diabetes, cast(CASE WHEN {POSITIVE} THEN 1 ELSE 0 END AS INT) AS response_positive
 FROM outcomes o LEFT JOIN enrollments e ON o.patient_id = e.patient_id AND o.trial_id = e.trial_id
 LEFT JOIN (SELECT *, {LIST_COUNTS}, contains(lower(conditions), 'diabetes') AS has_diabetes FROM patients) p ON o.patient_id = p.patient_id""",
)
def _(v):
    fact = L.patient_outcomes_fact(v.outcomes, v.enrollments, v.patients)
    return fact.select(
        "outcome_id", "patient_id", "trial_id", "arm", "enrollment_date", "status", "age",
        "gender", "comorbidity_count", "medication_count", "has_diabetes", "response_positive",
    )


FIRST_MEDICATION = """first_med AS (
 SELECT patient_id, trial_id, medication_name, drug_class, dose FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id, trial_id ORDER BY start_date, medication_id) AS rn
  FROM medications WHERE is_investigational) x WHERE rn = 1)"""
FACT = f"""{FIRST_MEDICATION}, fact AS (
 SELECT o.*, p.gender, p.age, p.conditions, t.title, t.phase, t.condition, t.sponsor, m.medication_name, m.drug_class, m.dose
 FROM outcomes o LEFT JOIN patients p ON o.patient_id = p.patient_id LEFT JOIN trials t ON o.trial_id = t.trial_id
 LEFT JOIN first_med m ON o.patient_id = m.patient_id AND o.trial_id = m.trial_id)"""
FACT_VIEWS = "patients trials outcomes medications"


def fact(v):
    return L.patient_outcomes(v.outcomes, v.patients, v.trials, v.medications)


@reg.add(
    "j02_patient_outcomes",
    FACT_VIEWS,
    f"""WITH {FACT} SELECT outcome_id, patient_id, trial_id, gender, age, title, phase, sponsor, medication_name, drug_class,
 dose, {AGE_GROUP} AS age_group, contains(lower(conditions), 'diabetes') AS has_diabetes,
 contains(lower(conditions), 'hypertension') AS has_hypertension, contains(lower(conditions), 'obesity') AS has_obesity,
 {POSITIVE} AS responded FROM fact""",
)
def _(v):
    return fact(v).select(
        "outcome_id", "patient_id", "trial_id", "gender", "age", "title", "phase", "sponsor",
        "medication_name", "drug_class", "dose", "age_group", "has_diabetes", "has_hypertension",
        "has_obesity", "responded",
    )


@reg.add(
    "j03_outcomes_with_meds",
    "outcomes medications",
    """SELECT o.outcome_id, m.medication_name, m.drug_class FROM outcomes o
 LEFT JOIN medications m ON o.patient_id = m.patient_id AND o.trial_id = m.trial_id""",
)
def _(v):
    return L.outcomes_with_meds(v.outcomes, v.medications).select(
        "outcome_id", "medication_name", "drug_class"
    )


@reg.add(
    "j06_trial_title_join",
    FACT_VIEWS,
    """SELECT o.trial_id, count(*) AS outcomes, min(t.title) AS title FROM outcomes o
 LEFT JOIN trials t ON o.trial_id = t.trial_id GROUP BY 1""",
)
def _(v):
    counts = v.outcomes.groupBy("trial_id").agg(F.count(F.lit(1)).alias("outcomes"))
    titled = v.outcomes.select("trial_id", "outcome_id").join(
        v.trials.select("trial_id", "title"), "trial_id", "left"
    )
    return L.trial_title_join(counts, titled)


@reg.add(
    "j07_restrict_to",
    "patients outcomes",
    """SELECT outcome_id, patient_id, response_status FROM outcomes
 WHERE patient_id IN (SELECT patient_id FROM patients WHERE age >= 65)""",
)
def _(v):
    elderly = v.patients.where(F.col("age") >= 65)
    return R.restrict_to(v.outcomes, elderly).select("outcome_id", "patient_id", "response_status")


@reg.add(
    "j08_new_records_only",
    "patients lab_events",
    """SELECT external_id, patient_id FROM patients WHERE patient_id NOT IN (SELECT patient_id FROM lab_events)""",
)
def _(v):
    return R.new_records_only(v.patients, v.lab_events, "patient_id").select(
        "external_id", "patient_id"
    )


@reg.add(
    "j08_import_report",
    "patients lab_events",
    """SELECT count(*) AS total_parsed, count(CASE WHEN e.patient_id IS NULL THEN 1 END) AS created,
 count(e.patient_id) AS skipped_duplicate FROM patients p LEFT JOIN (SELECT DISTINCT patient_id FROM lab_events) e
 ON p.patient_id = e.patient_id""",
)
def _(v):
    return R.import_report(v.patients, v.lab_events, "patient_id")


@reg.add(
    "k05_apply_mutations",
    "trials enrollments",
    """WITH busy AS (SELECT trial_id, count(*) AS n FROM enrollments GROUP BY 1)
 SELECT t.trial_id, CASE WHEN b.n > 30 THEN 'Closed' ELSE t.status END AS status, t.title FROM trials t
 LEFT JOIN busy b ON t.trial_id = b.trial_id WHERE t.enrollment_target <> 100""",
)
def _(v):
    trials = v.trials.select("trial_id", "status", "title", "enrollment_target")
    busy = v.enrollments.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))
    closed = trials.join(busy.where("n > 30").select("trial_id"), "trial_id", "left_semi")
    upserts = closed.withColumn("status", F.lit("Closed"))
    deletes = trials.where(F.col("enrollment_target") == 100).select("trial_id")
    return R.apply_mutations(trials, upserts, deletes, "trial_id").drop("enrollment_target")


@reg.add(
    "u03_duplicate_ids",
    "medications",
    "SELECT count(*) - count(DISTINCT patient_id) AS duplicates FROM medications",
)
def _(v):
    return R.duplicate_ids(v.medications, "patient_id")


@reg.add(
    "u05_metric_rows",
    "outcomes",
    f"""SELECT 'outcomes' AS metric, {r6('count(*)')} AS value FROM outcomes
 UNION ALL SELECT 'avg_baseline', {r6('avg(baseline_value)')} FROM outcomes
 UNION ALL SELECT 'trials', {r6('count(DISTINCT trial_id)')} FROM outcomes""",
)
def _(v):
    wide = v.outcomes.agg(
        F.count(F.lit(1)).alias("outcomes"),
        F.avg("baseline_value").alias("avg_baseline"),
        F.countDistinct("trial_id").alias("trials"),
    )
    return R.metric_rows(wide)


@reg.add(
    "u06_distinct_sorted",
    "medications",
    """SELECT patient_id, array_to_string(list_sort(list(DISTINCT medication_name)), ';') AS names FROM medications GROUP BY 1""",
)
def _(v):
    names = R.distinct_sorted(v.medications, "patient_id", "medication_name", "names")
    return names.withColumn("names", F.array_join("names", ";"))


@reg.add("w01_first_medication", "medications", f"WITH {FIRST_MEDICATION} SELECT * FROM first_med")
def _(v):
    return L.first_medication(v.medications)


# --- silver and gold aggregates ----------------------------------------------------------


@reg.add(
    "a01_drug_effectiveness_silver",
    "outcomes medications",
    f"""SELECT m.medication_name, min(m.drug_class) AS drug_class, count(DISTINCT o.patient_id) AS patient_count,
 {r6('avg(o.change)')} AS mean_change, {r6(f'avg(CASE WHEN {POSITIVE} THEN 1.0 ELSE 0.0 END)')} AS response_rate,
 count(o.adverse_events) AS adverse_event_count FROM outcomes o JOIN medications m
 ON o.patient_id = m.patient_id AND o.trial_id = m.trial_id GROUP BY 1""",
)
def _(v):
    return L.drug_effectiveness_silver(v.outcomes, v.medications)


@reg.add(
    "a02_trial_summary",
    "trials enrollments outcomes",
    f"""SELECT o.trial_id, outcome_count, mean_change, response_rate, enrolled_count, title, phase, condition FROM (
 SELECT trial_id, count(outcome_id) AS outcome_count, {r6('avg(change)')} AS mean_change,
  {r6(f'avg(CASE WHEN {POSITIVE} THEN 1.0 ELSE 0.0 END)')} AS response_rate FROM outcomes GROUP BY 1) o
 LEFT JOIN (SELECT trial_id, count(patient_id) AS enrolled_count FROM enrollments GROUP BY 1) e ON o.trial_id = e.trial_id
 LEFT JOIN trials t ON o.trial_id = t.trial_id""",
)
def _(v):
    return L.trial_summary(v.outcomes, v.enrollments, v.trials)


@reg.add(
    "a03_population_kpis",
    "patients trials outcomes",
    f"""SELECT 'total_patients' AS metric, {r6('count(DISTINCT patient_id)')} AS value FROM patients
 UNION ALL SELECT 'total_trials', {r6('count(DISTINCT trial_id)')} FROM trials
 UNION ALL SELECT 'total_outcomes', {r6('count(*)')} FROM outcomes
 UNION ALL SELECT 'overall_response_rate', {r6(f'avg(CASE WHEN {POSITIVE} THEN 1.0 ELSE 0.0 END)')} FROM outcomes
 UNION ALL SELECT 'adverse_event_rate', {r6(f'avg(CASE WHEN {HAS_AE} THEN 1.0 ELSE 0.0 END)')} FROM outcomes
 UNION ALL SELECT 'avg_age', {r6('avg(age)')} FROM outcomes LEFT JOIN patients USING (patient_id)""",
)
def _(v):
    people = v.patients.select("patient_id", "age")
    joined = v.outcomes.join(people, "patient_id", "left")
    return L.population_kpis(joined, v.patients, v.trials, digits=False)


@reg.add(
    "a04_drug_effectiveness_gold",
    FACT_VIEWS,
    f"""WITH {FACT} SELECT medication_name, count(DISTINCT patient_id) AS total_patients,
 count(CASE WHEN {POSITIVE} THEN 1 END) AS positive_responses, {r6('avg(change)')} AS avg_change,
 {r6('avg(change_pct)')} AS avg_change_pct,
 {r6(f'count(CASE WHEN {POSITIVE} THEN 1 END) / count(DISTINCT patient_id)')} AS response_rate
 FROM fact WHERE medication_name IS NOT NULL GROUP BY 1""",
)
def _(v):
    return L.drug_effectiveness_gold(fact(v), digits=None)


@reg.add(
    "a05_trial_kpis",
    FACT_VIEWS,
    f"""WITH {FACT} SELECT trial_id, count(DISTINCT patient_id) AS total_enrolled,
 count(CASE WHEN {POSITIVE} THEN 1 END) AS positive_responses, {r6('avg(change)')} AS avg_outcome_change,
 {r6('avg(change_pct)')} AS avg_change_pct, min(title) AS title,
 {r6(f'count(CASE WHEN {POSITIVE} THEN 1 END) / count(DISTINCT patient_id)')} AS response_rate
 FROM fact GROUP BY 1""",
)
def _(v):
    return L.trial_kpis(fact(v), digits=None, trials=v.trials)


@reg.add(
    "a06_cohort_stats",
    FACT_VIEWS,
    f"""WITH {FACT} SELECT {COHORT} AS cohort_label, count(DISTINCT patient_id) AS cohort_size,
 count(CASE WHEN {POSITIVE} THEN 1 END) AS positive_responses, {r6('avg(age)')} AS avg_age,
 {r6('avg(change)')} AS avg_outcome_change,
 {r6(f'count(CASE WHEN {POSITIVE} THEN 1 END) / count(DISTINCT patient_id)')} AS positive_response_rate
 FROM fact GROUP BY 1""",
)
def _(v):
    return L.cohort_stats(fact(v), digits=False)
