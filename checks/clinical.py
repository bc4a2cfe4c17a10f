"""Checks of outcome, matching, similarity and text operators."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from checks.base import POSITIVE, Registry, r6, sql_list
from cohortlake.functions import columns as C
from cohortlake.functions import values as V
from cohortlake.operators import lakehouse as L
from cohortlake.operators import matching as M
from cohortlake.operators import outcomes as O
from cohortlake.operators import similarity as S

reg = Registry()

THRESHOLDS = """th(outcome_type, strong, moderate, minimal, direction) AS (VALUES ('HbA1c', 20.0, 10.0, 5.0, -1),
 ('tumor_size', 30.0, 15.0, 5.0, -1), ('pain_score', 50.0, 30.0, 10.0, -1), ('CD4_count', 30.0, 15.0, 5.0, 1))"""
EVALUATED = f"""{THRESHOLDS}, ev AS (SELECT *, CASE WHEN imp IS NULL THEN 'Unknown' WHEN imp >= strong THEN 'Strong Response'
  WHEN imp >= moderate THEN 'Moderate Response' WHEN imp >= minimal THEN 'Minimal Response' WHEN imp > 0 THEN 'No Response'
  ELSE 'Worsened' END AS evaluated_status FROM (
 SELECT o.*, coalesce(th.strong, 20.0) AS strong, coalesce(th.moderate, 10.0) AS moderate, coalesce(th.minimal, 5.0) AS minimal,
  coalesce(th.direction, -1) AS direction, CASE WHEN baseline_value = 0 THEN 0.0 ELSE followup_value - baseline_value END AS abs_change,
  CASE WHEN baseline_value = 0 THEN 0.0 ELSE coalesce(th.direction, -1) * ((followup_value - baseline_value) / abs(baseline_value) * 100) END AS imp
 FROM outcomes o LEFT JOIN th ON o.outcome_type = th.outcome_type) x)"""


@reg.add(
    "d01_relative_change",
    "outcomes",
    f"""WITH {EVALUATED} SELECT outcome_id, {r6('abs_change')} AS absolute_change, {r6('imp')} AS improvement_pct FROM ev""",
)
def _(v):
    return O.relative_change(v.outcomes).select("outcome_id", "absolute_change", "improvement_pct")


@reg.add(
    "d02_thresholds",
    "outcomes",
    f"""WITH {EVALUATED} SELECT outcome_type, count(*) AS outcomes, {r6('min(strong)')} AS strong, {r6('min(moderate)')} AS moderate,
 {r6('min(minimal)')} AS minimal, min(direction) AS direction FROM ev GROUP BY 1""",
)
def _(v):
    held = O.with_thresholds(v.outcomes)
    return held.groupBy("outcome_type").agg(
        F.count(F.lit(1)).alias("outcomes"),
        *[F.min(c).alias(c) for c in ("strong", "moderate", "minimal", "direction")],
    )


@reg.add(
    "d03_classify_response",
    "outcomes",
    f"""WITH {EVALUATED} SELECT outcome_type, evaluated_status, response_status, count(*) AS outcomes FROM ev GROUP BY 1, 2, 3""",
)
def _(v):
    return (
        O.evaluate_outcomes(v.outcomes)
        .groupBy("outcome_type", "evaluated_status", "response_status")
        .agg(F.count(F.lit(1)).alias("outcomes"))
    )


@reg.add(
    "d04_evaluate_outcomes",
    "outcomes",
    f"""WITH {EVALUATED} SELECT outcome_id, {r6('abs_change')} AS absolute_change, {r6('imp')} AS improvement_pct,
 evaluated_status FROM ev""",
)
def _(v):
    return O.evaluate_outcomes(v.outcomes, digits=False).select(
        "outcome_id", "absolute_change", "improvement_pct", "evaluated_status"
    )


def narrative_sql() -> str:
    """The narrative templates as SQL, on values that are tenths."""
    parts = {
        "type": "outcome_type",
        "direction": "CASE WHEN abs_change < 0 THEN 'decreased' ELSE 'increased' END",
        "baseline": "cast(baseline_value AS VARCHAR)",
        "followup": "CASE WHEN followup_value IS NULL THEN '0' ELSE cast(followup_value AS VARCHAR) END",
        "unit": "unit",
        "pct": "printf('%.1f', abs(coalesce(imp, 0)))",
    }

    def one(template: str) -> str:
        text = "'" + template.replace("'", "''") + "'"
        for name, expression in parts.items():
            text = text.replace("{" + name + "}", f"' || ({expression}) || '")
        return text

    cases = " ".join(
        f"WHEN evaluated_status = '{s}' THEN {one(t)}" for s, t in V.NARRATIVES.items()
    )
    return f"CASE {cases} END"


@reg.add(
    "d05_response_narrative",
    "outcomes",
    f"""WITH raw AS (SELECT * FROM outcomes), {EVALUATED.replace('FROM outcomes o', '''FROM (SELECT * REPLACE (
  round(baseline_value * 10) / 10 AS baseline_value, round(followup_value * 10) / 10 AS followup_value) FROM raw) o''')}
 SELECT outcome_id, {narrative_sql()} AS narrative FROM ev""",
)
def _(v):
    tenths = v.outcomes.withColumns(
        {c: F.round(F.col(c) * 10) / 10 for c in ("baseline_value", "followup_value")}
    )
    # One decimal of the percentage is printed, not rounded beforehand.
    return O.response_narrative(O.evaluate_outcomes(tenths, digits=False)).select(
        "outcome_id", "narrative"
    )


CASES = f"""{EVALUATED}, cases AS (SELECT ev.*, p.age, p.medications, {sql_list('p.conditions')} AS cl, {sql_list('p.medications')} AS ml
 FROM ev LEFT JOIN patients p ON ev.patient_id = p.patient_id)"""


def sql_factor(key: str, when: str, strength: str | None = None) -> str:
    f = V.FACTORS[key]
    return f"CASE WHEN {when} THEN struct_pack(s := {strength or f.strength}::DOUBLE, n := '{f.name}') END"


PRIOR = " OR ".join(f"contains(lower(medications), '{w}')" for w in V.FAILURE_WORDS)
RULES = [
    sql_factor("high_baseline", "coalesce(baseline_value, 0) > CASE WHEN outcome_type = 'HbA1c' THEN 8.5 ELSE 7.0 END"),
    sql_factor("prior_failure", PRIOR),
    sql_factor("comorbidity", "len(cl) > 3"),
    sql_factor("short_duration", "TRUE"),
    sql_factor("variability", "TRUE"),
    sql_factor("age", "age > 65"),
]
DELTA_PCT = "abs(followup_value - baseline_value) / (CASE WHEN baseline_value = 0 THEN 1 ELSE abs(baseline_value) END) * 100"
INSUFFICIENT = f"(direction * (followup_value - baseline_value) < 0 OR {DELTA_PCT} < minimal)"
DELTA = sql_factor(
    "delta", INSUFFICIENT, f"round(least(0.88, 0.5 + (minimal - {DELTA_PCT}) / 100), 2)"
)
ADHERENCE = [
    sql_factor("incomplete", "NOT treatment_completed"),
    sql_factor("adverse", f"treatment_completed AND len({sql_list('adverse_events')}) >= 2"),
]


def names(column: str):
    return F.array_join(F.transform(column, lambda f: f["name"]), ";")


@functools.cache
def factor_list(items: tuple[str, ...]) -> str:
    return f"list_filter([{', '.join(items)}], lambda f: f IS NOT NULL)"


def cases(v):
    return O.with_patient_lists(O.evaluate_outcomes(v.outcomes, digits=False), v.patients)


@reg.add(
    "d06_non_response_factors_for",
    "outcomes patients",
    f"""WITH {CASES} SELECT outcome_id, array_to_string(list_transform({factor_list(tuple(RULES))}, lambda f: f.n), ';') AS factors,
 'Identified in 1,250 similar patient records from the analytical dataset.' AS evidence FROM cases""",
)
def _(v):
    held = cases(v).withColumn("factors", O.rule_factors())
    evidence = F.array_join(F.array_distinct(F.transform("factors", lambda f: f["evidence"])), ";")
    return held.select("outcome_id", names("factors").alias("factors"), evidence.alias("evidence"))


@reg.add(
    "d07_biomarker_delta_factor",
    "outcomes",
    # The decimal of the shortest text is what Spark rounds.
    f"""WITH {EVALUATED} SELECT outcome_id, cast(round(cast(cast(least(0.88, 0.5 + (minimal - {DELTA_PCT}) / 100) AS VARCHAR)
  AS DECIMAL(38, 20)), 2) AS DOUBLE) AS strength FROM ev WHERE {INSUFFICIENT}""",
)
def _(v):
    held = O.evaluate_outcomes(v.outcomes)
    return held.select("outcome_id", F.explode(O.delta_factor()).alias("f")).select(
        "outcome_id", "f.strength"
    )


@reg.add(
    "d08_adherence_factor",
    "outcomes",
    f"""SELECT outcome_id, (f).n AS factor, {r6('(f).s')} AS strength FROM (
 SELECT outcome_id, unnest({factor_list(tuple(ADHERENCE))}) AS f FROM outcomes) x""",
)
def _(v):
    return v.outcomes.select("outcome_id", F.explode(O.adherence_factor()).alias("f")).select(
        "outcome_id", F.col("f.name").alias("factor"), "f.strength"
    )


ALL_FACTORS = factor_list((*RULES, DELTA, *ADHERENCE))


@reg.add(
    "d10_non_response_analysis",
    "outcomes patients",
    f"""WITH {CASES}, nr AS (SELECT *, row_number() OVER () AS rid FROM cases),
 fx AS (SELECT rid, outcome_id, unnest({ALL_FACTORS}) AS f, generate_subscripts({ALL_FACTORS}, 1) AS i FROM nr),
 rk AS (SELECT rid, outcome_id, (f).n AS name, (f).s AS s, row_number() OVER (PARTITION BY rid ORDER BY (f).s DESC, i) AS rn FROM fx)
 SELECT outcome_id, string_agg(name, ';' ORDER BY rn) FILTER (WHERE rn <= 6) AS factors, {r6('avg(s)')} AS overall_confidence
 FROM rk GROUP BY rid, outcome_id""",
)
def _(v):
    analysed = O.non_response_analysis(cases(v), digits=None)
    return analysed.select("outcome_id", names("factors").alias("factors"), "overall_confidence")


# --- one case per patient ------------------------------------------------------------

PRIMARY = f"""ch AS (SELECT patient_id, max_by(trial_id, (enrollment_date, trial_id)) AS trial_id FROM enrollments GROUP BY 1),
 raw AS (SELECT * FROM outcomes),
 po AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.patient_id ORDER BY outcome_id) AS rn FROM raw o
  JOIN ch ON o.patient_id = ch.patient_id AND o.trial_id = ch.trial_id) x WHERE rn = 1),
 pm AS (SELECT * FROM (SELECT m.patient_id, m.medication_name, m.drug_class, m.dose, m.route, m.duration_weeks,
  count(*) OVER (PARTITION BY m.patient_id) AS interventions,
  row_number() OVER (PARTITION BY m.patient_id ORDER BY start_date, medication_id) AS rn FROM medications m
  JOIN ch ON m.patient_id = ch.patient_id AND m.trial_id = ch.trial_id) x WHERE rn = 1),
 {EVALUATED.replace('FROM outcomes o', 'FROM po o')},
 pc AS (SELECT ev.patient_id || '/' || ev.trial_id AS case_id, ev.*, pm.medication_name, pm.drug_class, pm.dose, pm.route,
  pm.duration_weeks, pm.interventions, p.age, p.medications, {sql_list('p.conditions')} AS cl, {sql_list('p.medications')} AS ml
  FROM ev LEFT JOIN pm ON ev.patient_id = pm.patient_id LEFT JOIN patients p ON ev.patient_id = p.patient_id)"""
PRIMARY_VIEWS = "patients trials enrollments outcomes medications"


def primary(v):
    return O.primary_cases(v.patients, v.enrollments, v.outcomes, v.medications)


def live_sql(limit: str) -> str:
    return f"""{PRIMARY}, w AS (SELECT case_id, coalesce(drug_class, 'current treatment') AS cc,
  split_part(coalesce(drug_class, 'current treatment'), ' ', 1) AS avoided, unnest(conds) AS cond, generate_subscripts(conds, 1) AS pos
  FROM (SELECT *, CASE WHEN len(cl) > 0 THEN cl ELSE ['Type 2 Diabetes'] END AS conds FROM pc) x),
 alt AS (SELECT * FROM (SELECT v.cond, v.avoided, t.*, row_number() OVER (PARTITION BY v.cond, v.avoided ORDER BY trial_id) AS rn
  FROM (SELECT DISTINCT cond, avoided FROM w) v JOIN trials t ON contains(lower(t.condition), lower(v.cond))
  AND NOT contains(lower(t.drug_class), lower(v.avoided))) x WHERE rn <= {limit}),
 rate AS (SELECT trial_id, avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END) AS response_rate FROM raw GROUP BY 1)"""


@reg.add(
    "j10_alternative_trials",
    PRIMARY_VIEWS,
    f"WITH {live_sql('1000000000')} SELECT cond AS condition, avoided, count(*) AS trials, min(trial_id) AS first_trial FROM alt GROUP BY 1, 2",
)
def _(v):
    wanted = primary(v).select(
        F.explode("condition_list").alias("condition"),
        O.first_word(F.coalesce("drug_class", F.lit("current treatment"))).alias("avoided"),
    )
    none = primary(v).where(F.size("condition_list") == 0).select(
        F.lit("Type 2 Diabetes").alias("condition"),
        O.first_word(F.coalesce("drug_class", F.lit("current treatment"))).alias("avoided"),
    )
    found = O.alternative_trials(wanted.unionByName(none), v.trials, 1_000_000_000)
    return found.groupBy("condition", "avoided").agg(
        F.count(F.lit(1)).alias("trials"), F.min("trial_id").alias("first_trial")
    )


@reg.add(
    "w03_top_n_per_condition",
    PRIMARY_VIEWS,
    f"WITH {live_sql('4')} SELECT cond AS condition, avoided, trial_id, drug_class, phase FROM alt WHERE cond IN (SELECT unnest(cl) FROM pc)",
)
def _(v):
    wanted = primary(v).select(
        F.explode("condition_list").alias("condition"),
        O.first_word(F.coalesce("drug_class", F.lit("current treatment"))).alias("avoided"),
    )
    none = primary(v).where(F.size("condition_list") == 0).select(
        F.lit("Type 2 Diabetes").alias("condition"),
        O.first_word(F.coalesce("drug_class", F.lit("current treatment"))).alias("avoided"),
    )
    return O.alternative_trials(wanted.unionByName(none), v.trials).select(
        "condition", "avoided", "trial_id", "drug_class", "phase"
    )


PATHWAY_ROWS = " UNION ALL ".join(
    f"SELECT case_id, {i + 1} AS ordinal, '{p.category}' AS category, '{p.title}' AS title, "
    + "'" + p.description.replace("'", "''") + "' AS description, "
    + "'" + p.rationale.replace("'", "''")
    .replace("{response}", "' || evaluated_status || '")
    .replace("{drug_class}", "' || coalesce(drug_class, 'current treatment') || '")
    .replace("{dose}", "' || coalesce(dose, 'current dose') || '")
    .replace("{baseline}", "' || CASE WHEN coalesce(baseline_value, 0) <> 0 THEN trim(cast(baseline_value AS VARCHAR) || ' ' || coalesce(unit, '')) ELSE 'elevated' END || '")
    + f"' AS rationale, '{p.evidence_level}' AS evidence_level, 'template' AS source FROM pc"
    for i, p in enumerate(V.PATHWAYS)
)
LIVE_ROWS = """SELECT case_id, cast(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(response_rate, 0) DESC, pos, alt.trial_id) AS INT) AS ordinal,
 'Active Clinical Trial' AS category, title || ' (' || phase || ')' AS title, NULL AS description,
 'Alternative mechanism (' || drug_class || ') avoids previous ' || cc || ' pathway and offers targeted therapeutic action. ' AS rationale,
 CASE WHEN phase IN ('Phase 3', 'Phase 4') THEN 'High' ELSE 'Moderate' END AS evidence_level, 'trial' AS source
 FROM w JOIN alt ON w.cond = alt.cond AND w.avoided = alt.avoided LEFT JOIN rate ON alt.trial_id = rate.trial_id"""


def pathways(v):
    found = O.alternative_pathways(primary(v), v.trials, v.outcomes, digits=None)
    # The printed rate of a live trial is left to the rate column of a29.
    plain = F.regexp_replace("rationale", "Historical cohort response rate: .*$", "")
    return found.withColumn("rationale", plain)


@reg.add(
    "d11_alternative_pathways",
    PRIMARY_VIEWS,
    f"WITH {live_sql('4')} SELECT * EXCLUDE (description) FROM ({LIVE_ROWS}) x",
)
def _(v):
    return pathways(v).where(F.col("source") == "trial").select(
        "case_id", "ordinal", "category", "title", "rationale", "evidence_level", "source"
    )


@reg.add(
    "u02_pathways_union",
    PRIMARY_VIEWS,
    f"WITH {live_sql('4')} {LIVE_ROWS} UNION ALL {PATHWAY_ROWS}",
)
def _(v):
    found = pathways(v).withColumn("description", F.when(F.col("source") == "template", F.col("description")))
    return found.select(
        "case_id", "ordinal", "category", "title", "description", "rationale", "evidence_level", "source"
    )


def cohort_sql() -> str:
    flags = {
        "high_baseline": "coalesce(baseline_value, 0) > 8.0",
        "minimal_response": "evaluated_status IN ('Minimal Response', 'No Response', 'Worsened')",
        "moderate_response": "evaluated_status = 'Moderate Response'",
        "prior_treatment": "len(ml) > 2",
        "prior_failure": f"({PRIOR})",
        "multi_comorbidity": "len(cl) > 3",
        "completion": "treatment_completed",
        "drug_class_switch": "drug_class IS NOT NULL AND len(list_filter(ml[1:3], lambda m: NOT contains(lower(m), lower(drug_class)))) > 0",
        "renal_comorbidity": "len(list_filter(cl, lambda c: contains(lower(c), 'renal') OR contains(lower(c), 'kidney'))) > 0",
    }
    rows = []
    for i, t in enumerate(V.COHORT_TEMPLATES):
        hits = " + ".join(
            f"(CASE WHEN {flags[f]} THEN 1 ELSE 0 END)" for f in t.key_features if f in flags
        )
        rows.append(
            f"SELECT case_id, '{t.cohort_name}' AS cohort_name, ({hits}) * 1.0 / {len(t.key_features)} AS sim, {i} AS i FROM pc"
        )
    return " UNION ALL ".join(rows)


COHORTS = f"""co AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(sim, 2) DESC, i) AS rn FROM ({cohort_sql()}) x WHERE sim > 0.3),
 cs AS (SELECT case_id, string_agg(cohort_name || ':' || cast(1200 + cast(floor(sim * 3000) AS INT) AS VARCHAR), ';' ORDER BY rn) FILTER (WHERE rn <= 5) AS cohorts,
  max(cohort_name) FILTER (WHERE rn = 1) AS first FROM co GROUP BY 1)"""
PRIMARY_COHORT = """CASE WHEN evaluated_status IN ('Minimal Response', 'No Response') THEN 'Treatment-Resistant Research Cohort'
 WHEN evaluated_status = 'Moderate Response' THEN 'Moderate Responder Research Cohort'
 WHEN evaluated_status = 'Strong Response' THEN 'Strong Responder Research Cohort' ELSE coalesce(first, 'General Study Cohort') END"""


def cohort_text():
    return F.array_join(
        F.transform(
            "resembled_cohorts",
            lambda c: F.concat_ws(":", c["cohort_name"], c["cohort_size"].cast("string")),
        ),
        ";",
    )


@reg.add(
    "d12_cohort_resemblance",
    PRIMARY_VIEWS,
    f"""WITH {PRIMARY}, {COHORTS} SELECT pc.case_id, {PRIMARY_COHORT} AS primary_cohort, coalesce(cohorts, '') AS cohorts
 FROM pc LEFT JOIN cs ON pc.case_id = cs.case_id""",
)
def _(v):
    return O.cohort_resemblance(primary(v)).select(
        "case_id", "primary_cohort", cohort_text().alias("cohorts")
    )


@reg.add(
    "w04_top_factors_and_cohorts",
    PRIMARY_VIEWS,
    f"""WITH {PRIMARY}, {COHORTS}, fx AS (SELECT case_id, unnest({ALL_FACTORS}) AS f, generate_subscripts({ALL_FACTORS}, 1) AS i FROM pc),
 rk AS (SELECT case_id, (f).n AS name, row_number() OVER (PARTITION BY case_id ORDER BY (f).s DESC, i) AS rn FROM fx)
 SELECT pc.case_id, (SELECT string_agg(name, ';' ORDER BY rn) FROM rk WHERE rk.case_id = pc.case_id AND rn <= 3) AS factors,
 coalesce(first, '') AS cohort FROM pc LEFT JOIN cs ON pc.case_id = cs.case_id""",
)
def _(v):
    held = O.cohort_resemblance(O.non_response_analysis(primary(v), k=3), k=1)
    return held.select(
        "case_id",
        names("factors").alias("factors"),
        F.array_join(F.transform("resembled_cohorts", lambda c: c["cohort_name"]), ";").alias("cohort"),
    )


@reg.add(
    "d13_outcome_summary",
    PRIMARY_VIEWS,
    f"""WITH {PRIMARY}, {COHORTS} SELECT pc.patient_id, pc.trial_id, t.title AS trial_title, pc.outcome_id, evaluated_status,
 medication_name, pc.drug_class, dose, route, duration_weeks, interventions, {PRIMARY_COHORT} AS primary_cohort
 FROM pc LEFT JOIN cs ON pc.case_id = cs.case_id LEFT JOIN trials t ON pc.trial_id = t.trial_id""",
)
def _(v):
    summary = O.outcome_summary(v.patients, v.trials, v.enrollments, v.outcomes, v.medications)
    return summary.select(
        "patient_id", "trial_id", "trial_title", "outcome_id", "evaluated_status",
        "medication_name", "drug_class", "dose", "route", "duration_weeks", "interventions",
        "primary_cohort",
    )


TIMELINE = f"""SELECT patient_id, 'diag-' || cast(i - 1 AS VARCHAR) AS event_id, 'diagnosis' AS event_type, 'Diagnosis: ' || c AS title,
  cast(NULL AS DATE) AS date, cast(NULL AS VARCHAR) AS trial_id, cast(NULL AS DOUBLE) AS value
  FROM (SELECT patient_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT patient_id, {sql_list('conditions')} AS l FROM patients) a) b
 UNION ALL SELECT patient_id, 'med-' || cast(i - 1 AS VARCHAR), 'medication', 'Started: ' || c, NULL, NULL, NULL
  FROM (SELECT patient_id, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (SELECT patient_id, {sql_list('medications')} AS l FROM patients) a) b
 UNION ALL SELECT patient_id, 'obs-HbA1c', 'lab_test', 'Lab: HbA1c', NULL, NULL, {r6('hba1c')} FROM patients WHERE hba1c IS NOT NULL
 UNION ALL SELECT patient_id, 'obs-BMI', 'lab_test', 'Lab: BMI', NULL, NULL, {r6('bmi')} FROM patients WHERE bmi IS NOT NULL
 UNION ALL SELECT patient_id, 'enroll-' || enrollment_id, 'trial_enrollment', 'Trial Enrollment: ' || trial_id,
  cast(enrollment_date AS DATE), trial_id, NULL FROM enrollments
 UNION ALL SELECT patient_id, 'complete-' || enrollment_id, 'trial_completion', 'Trial Completed: ' || trial_id, NULL, trial_id, NULL
  FROM enrollments WHERE status = 'COMPLETED'"""


def labs(v):
    return M.observations_of(v.patients, {"HbA1c": "hba1c", "BMI": "bmi"})


def timeline(v):
    readings = labs(v).withColumns(
        {"unit": F.lit(None).cast("string"), "date": F.lit(None).cast("string")}
    )
    return O.patient_timeline(v.patients, v.enrollments, readings).select(
        "patient_id", "event_id", "event_type", "title", "date", "trial_id", "value"
    )


@reg.add("u01_patient_timeline", "patients enrollments", TIMELINE)
def _(v):
    return timeline(v)


@reg.add(
    "w11_timeline_order",
    "patients enrollments",
    f"""SELECT patient_id, event_id, event_type, title, date, trial_id FROM ({TIMELINE}) x WHERE patient_id = 'P0000010'
 ORDER BY date, event_id""",
)
def _(v):
    return O.timeline_order(timeline(v).where(F.col("patient_id") == "P0000010")).drop("value")


# --- matching ------------------------------------------------------------------------------

CRITERIA_TEXT = """CASE WHEN min_age IS NOT NULL THEN 'age>=' || cast(min_age AS VARCHAR) ELSE 'age>=18' END
 || CASE WHEN max_age IS NOT NULL THEN ';age<=' || cast(max_age AS VARCHAR) ELSE '' END || ';condition ' || condition
 || CASE WHEN gender <> 'ALL' THEN ';gender ' || gender ELSE '' END
 || CASE WHEN condition = 'Type 2 Diabetes' AND phase IN ('Phase 3', 'Phase 4') THEN ';lab>=7.5'
  WHEN condition = 'Type 2 Diabetes' AND phase = 'Phase 2' THEN ';lab>=7.0' ELSE '' END"""


@reg.add(
    "m01_synthesize_criteria",
    "trials",
    f"SELECT trial_id, {CRITERIA_TEXT} AS criteria FROM trials",
)
def _(v):
    from cohortlake.operators.records import trials_with_conditions

    listed = M.synthesize_criteria(trials_with_conditions(v.trials))
    number = F.transform(
        "eligibility_criteria",
        lambda c: F.when(
            c["criterion_type"].isin("condition", "gender"),
            F.concat_ws(" ", c["criterion_type"], c["name"]),
        ).otherwise(
            F.concat(
                c["criterion_type"],
                c["operator"],
                F.when(c["criterion_type"] == "age", c["value"].cast("int").cast("string")).otherwise(
                    c["value"].cast("string")
                ),
            )
        ),
    )
    return listed.select("trial_id", F.array_join(number, ";").alias("criteria"))


def pair_sql(where: str) -> str:
    """Brute force over all pairs."""
    limits = [
        ("t.min_age IS NOT NULL", "p.age >= t.min_age"),
        ("t.max_age IS NOT NULL", "p.age <= t.max_age"),
        ("t.gender <> 'ALL'", "p.gender = t.gender"),
        ("TRUE", "contains(lower(p.conditions), lower(t.condition))"),
    ]
    criteria = [
        ("TRUE", "p.age >= coalesce(t.min_age, 18)"),
        *limits[1:2],
        limits[3],
        limits[2],
    ]
    hard = [*limits, *criteria]
    lab = "(t.condition = 'Type 2 Diabetes' AND t.phase IN ('Phase 2', 'Phase 3', 'Phase 4'))"
    level = "CASE WHEN t.phase = 'Phase 2' THEN 7.0 ELSE 7.5 END"
    met = " + ".join(f"(CASE WHEN {a} AND {b} THEN 1 ELSE 0 END)" for a, b in hard)
    bad = " + ".join(f"(CASE WHEN {a} AND NOT ({b}) THEN 1 ELSE 0 END)" for a, b in hard)
    return f"""base AS (SELECT p.patient_id, t.trial_id, {met} + (CASE WHEN {lab} AND p.hba1c >= {level} THEN 1 ELSE 0 END) AS met,
  {bad} AS hard, (CASE WHEN {lab} AND p.hba1c < {level} THEN 1 ELSE 0 END) AS soft,
  (CASE WHEN {lab} AND p.hba1c IS NULL THEN 1 ELSE 0 END) AS missing FROM patients p CROSS JOIN trials t WHERE {where}),
 raws AS (SELECT *, hard + soft AS failed, greatest(0.0, least(100.0, met * 100.0 / (met + hard + soft) - 3 * missing)) AS raw FROM base),
 sc AS (SELECT patient_id, trial_id, met, failed, missing, {r6('round(CASE WHEN hard > 0 THEN least(raw, 30.0) ELSE raw END, 1)')} AS eligibility_score,
  CASE WHEN hard > 0 THEN 'Ineligible' WHEN failed > 0 AND raw >= 60 THEN 'Potentially Eligible' WHEN failed > 0 THEN 'Unlikely Eligible'
  WHEN missing > 0 THEN 'Potentially Eligible' ELSE 'Eligible' END AS status FROM raws)"""


def ranked_sql(min_score: float, limit: int) -> str:
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY eligibility_score DESC, trial_id) AS rank
 FROM sc WHERE eligibility_score >= {min_score}), mt AS (SELECT * FROM rk WHERE rank <= {limit})"""


FIELDS = ("patient_id", "trial_id", "met", "failed", "missing", "eligibility_score", "status")


@reg.add(
    "m04_match_patients",
    "patients trials",
    f"WITH {pair_sql('TRUE')}, {ranked_sql(31.0, 20)} SELECT {', '.join(FIELDS)}, cast(rank AS INT) AS rank FROM mt",
)
def _(v):
    return M.match_patients(v.patients, v.trials, 31.0, observations=labs(v)).select(*FIELDS, "rank")


@reg.add(
    "m04_match_patients_any_score",
    "patients trials",
    f"WITH {pair_sql('TRUE')}, {ranked_sql(0.0, 20)} SELECT {', '.join(FIELDS)}, cast(rank AS INT) AS rank FROM mt",
)
def _(v):
    return M.match_patients(v.patients, v.trials, observations=labs(v)).select(*FIELDS, "rank")


@reg.add(
    "m04_match_patient",
    "patients trials",
    f"""WITH {pair_sql("p.patient_id = 'P0000012'")} SELECT {', '.join(FIELDS)} FROM sc ORDER BY eligibility_score DESC, trial_id""",
)
def _(v):
    return M.match_patient(
        v.patients, v.trials, "P0000012", limit=None, observations=labs(v)
    ).select(*FIELDS)


@reg.add(
    "j09_candidate_pairs",
    "patients trials",
    """SELECT patient_id, cast(count(*) AS BIGINT) AS candidates FROM patients p JOIN trials t
  ON contains(lower(p.conditions), lower(t.condition)) AND p.age >= coalesce(t.min_age, 18)
  AND (t.max_age IS NULL OR p.age <= t.max_age) AND (t.gender = 'ALL' OR p.gender = t.gender) GROUP BY 1""",
)
def _(v):
    checks, lists, facts = M.match_inputs(v.patients, v.trials, labs(v))
    pairs = M.candidate_pairs(facts, lists).select("profile", "signature")
    trials = checks.groupBy("signature").agg(F.count(F.lit(1)).alias("trials"))
    per_profile = pairs.join(trials, "signature").groupBy("profile")
    return (
        facts.select("patient_id", "profile")
        .join(per_profile.agg(F.sum("trials").alias("candidates")), "profile")
        .select("patient_id", "candidates")
    )


@reg.add(
    "w02_rank_matches",
    "patients trials",
    f"""WITH {pair_sql('TRUE')}, {ranked_sql(90.0, 3)} SELECT patient_id, trial_id, eligibility_score, cast(rank AS INT) AS rank FROM mt""",
)
def _(v):
    found = M.match_patients(v.patients, v.trials, 90.0, 3, labs(v))
    return found.select("patient_id", "trial_id", "eligibility_score", "rank")


@reg.add(
    "m05_match_buckets",
    "patients trials",
    f"""WITH {pair_sql("p.patient_id = 'P0000012'")} SELECT patient_id, trial_id, eligibility_score, status, cast(rn AS INT) AS bucket_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY patient_id, status ORDER BY eligibility_score DESC, trial_id) AS rn FROM sc
 WHERE status <> 'Unlikely Eligible') x WHERE status <> 'Ineligible' OR rn <= 5""",
)
def _(v):
    found = M.match_patient(
        v.patients, v.trials, "P0000012", min_score=0.0, limit=None, observations=labs(v)
    )
    return M.match_buckets(found).select(
        "patient_id", "trial_id", "eligibility_score", "status", "bucket_rank"
    )


@reg.add(
    "m05_match_buckets_of_all",
    "patients trials",
    f"""WITH {pair_sql('TRUE')} SELECT patient_id, trial_id, eligibility_score, status, cast(row_number() OVER (
 PARTITION BY patient_id, status ORDER BY eligibility_score DESC, trial_id) AS INT) AS bucket_rank FROM sc
 WHERE status IN ('Eligible', 'Potentially Eligible')""",
)
def _(v):
    found = M.match_patients(v.patients, v.trials, min_score=None, limit=None, observations=labs(v))
    return M.match_buckets(found).select(
        "patient_id", "trial_id", "eligibility_score", "status", "bucket_rank"
    )


@reg.add(
    "m02_evaluate_criteria",
    "patients trials enrollments",
    """WITH pr AS (SELECT DISTINCT patient_id, trial_id FROM enrollments), x AS (SELECT pr.trial_id AS tid, p.*, t.min_age, t.max_age,
  t.gender AS tg, t.condition AS tc, t.phase FROM pr JOIN patients p ON pr.patient_id = p.patient_id JOIN trials t ON pr.trial_id = t.trial_id),
 c AS (SELECT patient_id, tid AS trial_id, 'age' AS criterion_type, age >= min_age AS ok FROM x WHERE min_age IS NOT NULL
  UNION ALL SELECT patient_id, tid, 'age', age <= max_age FROM x WHERE max_age IS NOT NULL
  UNION ALL SELECT patient_id, tid, 'age', age >= coalesce(min_age, 18) FROM x
  UNION ALL SELECT patient_id, tid, 'age', age <= max_age FROM x WHERE max_age IS NOT NULL
  UNION ALL SELECT patient_id, tid, 'gender', gender = tg FROM x WHERE tg <> 'ALL'
  UNION ALL SELECT patient_id, tid, 'gender', gender = tg FROM x WHERE tg <> 'ALL'
  UNION ALL SELECT patient_id, tid, 'condition', contains(conditions, tc) FROM x
  UNION ALL SELECT patient_id, tid, 'condition', contains(conditions, tc) FROM x
  UNION ALL SELECT patient_id, tid, 'lab', hba1c >= CASE WHEN phase = 'Phase 2' THEN 7.0 ELSE 7.5 END FROM x
   WHERE tc = 'Type 2 Diabetes' AND phase <> 'Phase 1')
 SELECT patient_id, trial_id, criterion_type, CASE WHEN ok IS NULL THEN 'missing' WHEN ok THEN 'met' ELSE 'failed' END AS status,
 count(*) AS checks FROM c GROUP BY 1, 2, 3, 4""",
)
def _(v):
    pairs = v.enrollments.select("patient_id", "trial_id").distinct()
    found = M.evaluate_criteria(pairs, v.patients, v.trials, labs(v))
    return found.groupBy("patient_id", "trial_id", "criterion_type", "status").agg(
        F.count(F.lit(1)).alias("checks")
    )


# --- similarity --------------------------------------------------------------------------------

FEATURES = f"""md AS (SELECT patient_id, count(*) AS n FROM medications GROUP BY 1),
 ft AS (SELECT p.patient_id, cast(coalesce(p.age, 50) AS DOUBLE) AS age, p.gender, list_transform({sql_list('p.conditions')}, lambda c: lower(c)) AS cl,
  coalesce(p.hba1c, (SELECT avg(hba1c) FROM patients)) AS hba1c, p.bmi,
  cast(coalesce(md.n, len({sql_list('p.conditions')})) AS DOUBLE) AS medication_count,
  CASE WHEN contains(lower(p.conditions), 'diab') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_diabetes,
  CASE WHEN contains(lower(p.conditions), 'hyper') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_hypertension,
  CASE WHEN contains(lower(p.conditions), 'obes') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_obesity
  FROM patients p LEFT JOIN md ON p.patient_id = md.patient_id)"""
SCALED = "sc AS (SELECT patient_id, age, gender, cl, " + ", ".join(
    f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS s_{c}"
    for c in S.FEATURES
) + " FROM ft)"
DISTANCE = "sqrt(" + " + ".join(f"power(a.s_{c} - q.s_{c}, 2)" for c in S.FEATURES) + ")"
QUERY_PATIENT = "P0000042"


def features(v):
    return S.patient_features(v.patients, v.medications)


@reg.add(
    "n01_patient_features",
    "patients medications",
    f"""WITH {FEATURES} SELECT patient_id, {', '.join(f'{r6(c)} AS {c}' for c in S.FEATURES)} FROM ft""",
)
def _(v):
    return features(v).select("patient_id", *S.FEATURES)


@reg.add(
    "n02_min_max_scale",
    "patients medications",
    f"""WITH {FEATURES}, {SCALED} SELECT patient_id, {', '.join(f's_{c}' for c in S.FEATURES).replace('s_', 's_')} FROM (
 SELECT patient_id, {', '.join(f'{r6("s_" + c)} AS s_{c}' for c in S.FEATURES)} FROM sc) x""",
)
def _(v):
    return S.min_max_scale(features(v)).select("patient_id", *[f"s_{c}" for c in S.FEATURES])


NEAREST = f"""nn AS (SELECT a.patient_id, a.age, a.cl, {DISTANCE} AS distance FROM sc a,
 (SELECT * FROM sc WHERE patient_id = '{QUERY_PATIENT}') q ORDER BY round({DISTANCE}, 9), a.patient_id LIMIT 30)"""


@reg.add(
    "n03_similar_patients",
    "patients medications",
    f"""WITH {FEATURES}, {SCALED}, {NEAREST} SELECT patient_id, {r6('age')} AS age, {r6('distance')} AS distance,
 {r6('greatest(0, 1 - distance / sqrt(7))')} AS similarity_score FROM nn""",
)
def _(v):
    return S.similar_patients(features(v), QUERY_PATIENT, digits=None).select(
        "patient_id", "age", "distance", "similarity_score"
    )


@reg.add(
    "w05_knn_top_k",
    "patients medications",
    f"""WITH {FEATURES}, {SCALED}, q AS (SELECT * FROM sc WHERE cast(substr(patient_id, 2) AS BIGINT) % 20 = 0),
 rk AS (SELECT q.patient_id AS query_id, a.patient_id, a.age, a.gender, {DISTANCE} AS distance,
  row_number() OVER (PARTITION BY q.patient_id ORDER BY round({DISTANCE}, 9), a.patient_id) AS rank FROM sc a CROSS JOIN q)
 SELECT query_id, patient_id, age, gender, cast(rank AS INT) AS rank, round(greatest(0, 1 - distance / sqrt(7)), 3) AS similarity_score
 FROM rk WHERE rank <= 60""",
)
def _(v):
    queries = v.patients.where(F.substring("patient_id", 2, 18).cast("bigint") % 20 == 0)
    found = S.similar_patients_of(features(v), queries, k=20)
    return found.select("query_id", "patient_id", "age", "gender", "rank", "similarity_score")


@reg.add(
    "w05_knn_of_every_20th",
    "patients medications",
    f"""WITH {FEATURES}, {SCALED}, q AS (SELECT * FROM sc WHERE cast(substr(patient_id, 2) AS BIGINT) % 20 = 0),
 rk AS (SELECT q.patient_id AS query_id, a.patient_id, {DISTANCE} AS distance,
  row_number() OVER (PARTITION BY q.patient_id ORDER BY round({DISTANCE}, 9), a.patient_id) AS rank FROM sc a CROSS JOIN q)
 SELECT query_id, patient_id, cast(rank AS INT) AS rank, {r6('distance')} AS distance FROM rk WHERE rank <= 30""",
)
def _(v):
    queries = v.patients.where(F.substring("patient_id", 2, 18).cast("bigint") % 20 == 0)
    return S.similar_patients_of(features(v), queries).select("query_id", "patient_id", "rank", "distance")


JACCARD = """jd AS (SELECT a.patient_id, a.age, 0.50 * (CASE WHEN len(list_distinct(list_concat(q.cl, a.cl))) = 0 THEN 0.5
  ELSE 1 - len(list_intersect(q.cl, a.cl)) * 1.0 / len(list_distinct(list_concat(q.cl, a.cl))) END)
  + 0.35 * least(abs(q.age - a.age) / 50.0, 1.0) + 0.15 * (CASE WHEN a.gender = q.gender THEN 0.0 ELSE 0.2 END) AS distance
 FROM ft a, (SELECT * FROM ft WHERE patient_id = 'P0000042') q)"""


@reg.add(
    "n04_similar_patients_jaccard",
    "patients medications",
    f"""WITH {FEATURES}, {JACCARD} SELECT patient_id, {r6('distance')} AS distance FROM jd ORDER BY round(distance, 9), patient_id LIMIT 30""",
)
def _(v):
    return S.similar_patients_jaccard(features(v), QUERY_PATIENT, digits=None).select(
        "patient_id", "distance"
    )


@reg.add(
    "n04_similar_patients_jaccard_of_every_20th",
    "patients medications",
    f"""WITH {FEATURES}, {JACCARD.replace("SELECT a.patient_id, a.age,", "SELECT q.patient_id AS query_id, a.patient_id, a.age,").replace(
    "patient_id = 'P0000042'", "cast(substr(patient_id, 2) AS BIGINT) % 20 = 0")},
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), patient_id) AS rank FROM jd)
 SELECT query_id, patient_id, cast(rank AS INT) AS rank, {r6('distance')} AS distance FROM rk WHERE rank <= 30""",
)
def _(v):
    queries = v.patients.where(F.substring("patient_id", 2, 18).cast("bigint") % 20 == 0)
    return S.similar_patients_jaccard_of(features(v), queries).select("query_id", "patient_id", "rank", "distance")


@reg.add(
    "u04_condition_distance",
    "patients medications",
    f"""WITH {FEATURES}, {JACCARD} SELECT patient_id, {r6('distance')} AS distance FROM jd""",
)
def _(v):
    held = features(v)
    target = (
        held.where(F.col("patient_id") == QUERY_PATIENT)
        .select(F.struct("age", "gender", "condition_list"))
        .scalar()
    )
    pairs = held.withColumn("_t", target)
    distance = (
        0.50 * S.condition_distance(F.col("_t.condition_list"), F.col("condition_list"))
        + 0.35 * F.least(F.abs(F.col("_t.age") - F.col("age")) / 50.0, F.lit(1.0))
        + 0.15 * F.when(F.col("gender") == F.col("_t.gender"), 0.0).otherwise(0.2)
    )
    return pairs.select("patient_id", distance.alias("distance"))


COHORT_VIEWS = "patients medications outcomes"


@reg.add(
    "a32_cohort_treatment_outcomes",
    COHORT_VIEWS,
    f"""WITH co AS (SELECT patient_id FROM patients WHERE contains(lower(conditions), 'copd'))
 SELECT medication_name, count(*) AS patients_count, {r6(f'avg(CASE WHEN {POSITIVE} THEN 100.0 ELSE 0.0 END)')} AS positive_response_rate,
 {r6('median(change_pct)')} AS median_change_pct FROM outcomes o JOIN medications m ON o.patient_id = m.patient_id
 WHERE o.patient_id IN (SELECT patient_id FROM co) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
)
def _(v):
    cohort = v.patients.where(C.has_word("conditions", "COPD"))
    return S.cohort_treatment_outcomes(cohort, v.outcomes, v.medications, digits=None)


@reg.add(
    "n05_similar_cohort_summary",
    COHORT_VIEWS,
    f"""WITH {FEATURES}, {SCALED}, {NEAREST}, cc AS (SELECT c, count(*) AS n FROM (SELECT unnest(cl) AS c FROM nn) x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)
 SELECT count(*) AS cohort_size, {r6('avg(age)')} AS avg_age, (SELECT string_agg(array_to_string(list_transform(regexp_extract_all(c, '[a-z]+|[^a-z]+'),
  lambda w: upper(w[1]) || w[2:]), ''), ' + ' ORDER BY n DESC, c) FROM cc) AS primary_condition,
 (SELECT {r6("avg(CASE WHEN response_status IN ('Minimal Response', 'No Response', 'Worsened') THEN 100.0 ELSE 0.0 END)")} FROM outcomes
  WHERE patient_id IN (SELECT patient_id FROM nn)) AS non_response_pct FROM nn""",
)
def _(v):
    cohort = S.similar_patients(features(v), QUERY_PATIENT)
    return S.similar_cohort_summary(cohort, v.outcomes, digits=None)


@reg.add(
    "l09_cohort_profiles",
    "patients trials outcomes medications",
    f"""SELECT label, count(*) AS size, {r6('avg(age)')} AS avg_age, {r6(f'avg(CASE WHEN {POSITIVE} THEN 1.0 ELSE 0.0 END)')} AS response_rate,
 {r6('avg(baseline_value)')} AS avg_baseline, {r6('avg(change_pct)')} AS avg_change_pct FROM (
 SELECT o.*, p.age, CASE WHEN contains(lower(conditions), 'diabetes') AND NOT ({POSITIVE}) THEN 'Treatment-Resistant Diabetic'
 WHEN contains(lower(conditions), 'diabetes') THEN 'Responsive Diabetic' WHEN contains(lower(conditions), 'hypertension') THEN 'Hypertension-Only'
 WHEN contains(lower(conditions), 'obesity') THEN 'Obesity-Only' ELSE 'Mixed Comorbidities' END AS label
 FROM outcomes o LEFT JOIN patients p ON o.patient_id = p.patient_id) x GROUP BY 1""",
)
def _(v):
    from cohortlake.plans.models import cohort_profiles

    fact = L.patient_outcomes(v.outcomes, v.patients, v.trials, v.medications)
    labelled = fact.withColumn("label", C.cohort_label("conditions", C.responded()))
    return cohort_profiles(labelled, "label", digits=False)
