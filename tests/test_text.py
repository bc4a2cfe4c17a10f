from __future__ import annotations

import re

import pytest

from cohortlake.functions import values as V
from cohortlake.operators import text as T


@pytest.fixture
def doc(spark):
    def make(text):
        return spark.createDataFrame([(1, text)], "doc_id long, text string")

    return make


def conditions(frame):
    rows = T.extract_conditions(frame).collect()
    return (
        {r.condition for r in rows if not r.negated}, {r.condition for r in rows if r.negated},
    )


def test_negated_conditions(doc):
    yes, no = conditions(
        doc(
            "\nExclusion Criteria:\n- No history of Heart Failure\n"
            "- No history of Chronic Kidney Disease\n\nPatient has Type 2 Diabetes.\n"
        )
    )
    # The line after a trigger line is negated too.
    assert no == {"Heart Failure", "Chronic Kidney Disease", "Type 2 Diabetes"} and yes == set()


def test_negation_reaches_one_line_only(doc):
    yes, no = conditions(
        doc("\nExclusion:\nNo history of:\nHeart Failure\nAsthma\n\nPatient has:\nHypertension\n")
    )
    assert no == {"Heart Failure"} and yes == {"Asthma", "Hypertension"}


def test_first_hit_per_pattern_group(doc):
    yes, _ = conditions(doc("COPD and asthma with HTN"))
    assert yes == {"Copd", "Htn"}


def test_dosing_schedules(doc):
    rows = T.extract_medications(
        doc("Metformin 1000 mg twice daily (BID). Atorvastatin 20 mg once daily. Drug 5 mg oral")
    ).orderBy("ordinal").collect()
    assert [(r.medication, r.dose, r.route_frequency) for r in rows] == [
        ("Metformin", "1000 mg", "Twice daily (BID)"),
        ("Atorvastatin", "20 mg", "Once daily"),
        ("Drug", "5 mg", "oral"),
    ]


def test_stop_words_and_missing_schedule(doc):
    rows = T.extract_medications(doc("Table 5 mg and Aspirin 81 mg; then weekly")).collect()
    assert [(r.medication, r.route_frequency) for r in rows] == [("and Aspirin", "Unspecified")]


def plain_doses(text):
    """Straight scan of a text for doses."""
    found = []
    for m in re.finditer(V.DOSE_PATTERN, text, re.IGNORECASE):
        clause = re.split(r"[.;]", text[m.end() : m.end() + V.DOSE_CONTEXT])[0].lower()
        frequency = m.group(3) or "Unspecified"
        for pattern, label in V.DOSING_FREQUENCIES:
            if re.search(pattern, clause, re.IGNORECASE):
                frequency = label
                break
        if m.group(1).strip().lower() not in V.DOSE_STOP_WORDS:
            found.append((m.group(1).strip(), m.group(2).strip(), frequency))
    return found


@pytest.mark.parametrize(
    "text",
    [
        "Aspirin 81 mg Aspirin 81 mg weekly", "X-9 2.5 mg/kg iv every 8 hours\nNext 3 units prn",
        "a" * 80 + " 5 mg qd", "Insulin glargine 10 IU\nsubcutaneous q.i.d. then Drug 1 g", "5 mg",
        "Drug 10 mg " + "z" * 49 + " weekly", "Foo 1 mcg tid; Bar 2 ml monthly. as needed",
    ],
)
def test_doses_equal_a_plain_scan(doc, text):
    rows = T.extract_medications(doc(text), None).orderBy("ordinal").collect()
    assert [(r.medication, r.dose, r.route_frequency) for r in rows] == plain_doses(text)


def test_labs(doc):
    rows = T.extract_labs(doc("HbA1c >= 7.5 %, eGFR: 60 mL/min; BMI 31")).orderBy("ordinal").collect()
    assert [(r.biomarker, r.operator, r.value, r.unit) for r in rows] == [
        ("HbA1c", ">=", ">= 7.5", "%"), ("eGFR", "", "60", "mL/min"), ("BMI", "", "31", ""),
    ]


def test_all_items_are_listed_unless_a_limit_is_given(doc):
    text = " ".join(f"BMI {i}" for i in range(20, 35))
    assert T.extract_labs(doc(text)).count() == 15
    assert T.extract_labs(doc(text), 10).count() == 10
    assert T.document_summary(doc(text)).first().labs == 15


PROTOCOL = """Title
Inclusion Criteria:
- Patients aged 18 to 75
- HbA1c >= 7.5 %
short
- Signed consent form
Exclusion criteria
- No known malignancy
- Age 0 is fine to see
"""


def test_criteria_sections(doc):
    rows = T.extract_criteria(doc(PROTOCOL)).orderBy("type", "ordinal").collect()
    inclusion = [r for r in rows if r.type == "inclusion"]
    assert [(r.criterion_type, r.operator, r.value, r.max_value) for r in inclusion] == [
        ("age", "between", "18", 75), ("lab", ">=", "7.5", None), ("condition", None, None, None),
    ]
    exclusion = [r for r in rows if r.type == "exclusion"]
    assert [(r.criterion_type, r.negated, r.required) for r in exclusion] == [
        ("exclusion", True, False), ("age", True, False),
    ]


def test_lines_before_a_header_have_no_section(doc):
    rows = {r.line: r.section for r in T.section_state(doc(PROTOCOL)).collect()}
    assert rows["Title"] is None and rows["Inclusion Criteria:"] is None
    assert rows["short"] == "inclusion" and rows["- No known malignancy"] == "exclusion"


def test_default_rules_without_sections(doc):
    frame = doc("Patient has Asthma. BMI >= 30 kg/m2. No history of\nGout and COPD")
    rows = T.default_criteria(frame).collect()
    assert {(r.criterion_type, r.name) for r in rows} == {("condition", "Asthma"), ("lab", "BMI")} or {
        (r.criterion_type, r.name) for r in rows
    } == {("lab", "BMI")}
    assert T.default_criteria(doc(PROTOCOL)).count() == 0


def test_empty_document(doc):
    row = T.document_summary(doc("")).first()
    assert (row.char_count, row.line_count, row.rules) == (0, 0, 0)
    assert T.document_lines(doc("\n \n")).count() == 0


@pytest.mark.parametrize(
    "question, category, expected",
    [
        ("What is the response rate for patients with diabetic and HbA1c > 8.0?", "dynamic_slice",
         dict(conditions=["type 2 diabetes"], min_hba1c=None)),
        ("Elderly patients on metformin in phase 3", "dynamic_slice",
         dict(drugs=["Metformin"], min_age=65, phase="Phase 3")),
        ("patients older than 70", "dynamic_slice", dict(min_age=70)),
        ("Why did they not respond?", "non_response", {}),
        ("Which drug class is best?", "medication_effectiveness", {}),
        ("dropout by phase", "trial_completion", {}),
        ("How many patients are there", "enrollment", {}),
        ("most common disease", "condition_breakdown", {}),
        ("hello", "general", {}),
        ("compare side effect reports", "dynamic_slice", dict(is_adverse=True, is_compare=True)),
    ],
)
def test_questions(spark, question, category, expected):
    row = T.tag_questions(spark.createDataFrame([(question,)], "text string")).first()
    assert row.category == category
    for name, value in expected.items():
        if value is not None:
            assert row[name] == value


def test_lab_bound_of_a_question(spark):
    row = T.tag_questions(
        spark.createDataFrame([("hba1c above 8.5 in severe cases",)], "text string")
    ).first()
    assert row.min_hba1c == 8.5


def alternatives(pattern):
    """The alternatives of a pattern as plain lower-case text."""
    body = pattern.removeprefix("(?:").removesuffix(")").replace(r"\s*", " ").lower()
    return body.split("|")


def test_every_condition_alternative_has_a_word():
    assert len(V.CONDITION_WORDS) == len(V.CONDITION_PATTERNS)
    for words, pattern in zip(V.CONDITION_WORDS, V.CONDITION_PATTERNS):
        for text in alternatives(pattern):
            assert any(w in text for w in words), text


def test_every_lab_name_has_a_word():
    names = V.LAB_PATTERN[1 : V.LAB_PATTERN.index(")")].replace(r"\s*", " ").lower().split("|")
    assert len(names) == 17
    for name in names:
        assert any(w in name for w in V.LAB_WORDS), name
