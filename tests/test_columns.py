from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import columns as C


@pytest.mark.parametrize(
    "age, bucket, group",
    [
        (0, "<18", None), (17, "<18", "<30"), (18, "18-30", "<30"), (30, "31-45", "<30"),
        (31, "31-45", "30-44"), (45, "46-60", "30-44"), (60, "61-75", "45-59"),
        (75, "75+", "60-74"), (76, "75+", "75+"), (200, None, None), (None, None, None),
    ],
)
def test_age_bins_are_closed_on_opposite_sides(one, age, bucket, group):
    value = F.lit(age).cast("int")
    assert one(b=C.age_bucket(value), g=C.age_group(value)) == {"b": bucket, "g": group}


@pytest.mark.parametrize(
    "text, parts",
    [
        ("a|b", ["a", "b"]), ("['a', 'b']", ["a", "b"]), (" a , b ", ["a", "b"]), ("", []),
        (None, []), ("||x", ["x"]), ('["a"]', ["a"]),
    ],
)
def test_parse_list(one, text, parts):
    assert one(x=C.parse_list(F.lit(text).cast("string")))["x"] == parts


def test_list_count_ignores_blanks(one):
    got = one(
        a=C.list_count(F.lit("a| |b")), b=C.list_count(F.lit("")),
        c=C.list_count(F.lit(None).cast("string")), d=C.polypharmacy(F.lit(5)),
    )
    assert got == {"a": 2, "b": 0, "c": 0, "d": True}


@pytest.mark.parametrize(
    "raw, label",
    [("M", "male"), ("f", "female"), ("", "unknown"), (None, "unknown"), ("Other ", "other")],
)
def test_normalize_gender(one, raw, label):
    assert one(g=C.normalize_gender(F.lit(raw).cast("string")))["g"] == label


@pytest.mark.parametrize(
    "birth, death, as_of, age",
    [
        ("1950-06-01", "2020-06-01", "2024-01-01", 70),
        ("1950-06-01", "2020-05-31", "2024-01-01", 69),
        ("2000-02-29", None, "2021-02-28", 20),
        ("2000-02-29T10:00", None, "2021-03-01", 21),
        ("2030-01-01", None, "2024-01-01", 0),
        ("not a date", None, "2024-01-01", None),
    ],
)
def test_age_at(one, birth, death, as_of, age):
    got = one(
        a=C.age_at(
            F.lit(birth), F.lit(death).cast("string"), F.lit(as_of).cast("date")
        )
    )
    assert got["a"] == age


def test_casts_give_null_instead_of_errors(one):
    got = one(
        a=C.to_long(F.lit("12")), b=C.to_long(F.lit("x")), c=C.to_long(F.lit("1.5")),
        d=C.to_double(F.lit(" 1.5 ")), e=C.to_double(F.lit("")), f=C.to_bool(F.lit("TRUE")),
        g=C.to_bool(F.lit("0")), h=C.to_bool(F.lit("yes")), i=C.to_date(F.lit("2024-13-01")),
    )
    assert list(got.values()) == [12, None, None, 1.5, None, True, False, None, None]
    whole = {"9007199254740993": 2**53 + 1, "-9223372036854775808": -(2**63), "9223372036854775808": None, "+7": 7, "12.0": 12, "1e3": 1000}
    assert list(one(**{f"c{i}": C.to_long(F.lit(t)) for i, t in enumerate(whole)}).values()) == list(whole.values())


@pytest.mark.parametrize(
    "text, expected",
    [("Nausea", True), ("  ", False), (None, False), ("[]", False), ("nan", False)],
)
def test_has_adverse_event(one, text, expected):
    assert one(x=C.has_adverse_event(F.lit(text).cast("string")))["x"] is expected


@pytest.mark.parametrize(
    "op, expected",
    [(">", False), (">=", True), ("<", False), ("<=", True), ("==", True), ("!=", False), ("~", False)],
)
def test_compare_takes_the_operator_from_data(one, op, expected):
    assert one(x=C.compare(F.lit(5.0), F.lit(op), F.lit(5.0)))["x"] is expected


@pytest.mark.parametrize(
    "kind, pct, label",
    [
        ("HbA1c", 20.0, "Strong Response"), ("HbA1c", 19.99, "Moderate Response"),
        ("HbA1c", 10.0, "Moderate Response"), ("HbA1c", 5.0, "Minimal Response"),
        ("HbA1c", 0.1, "No Response"), ("HbA1c", 0.0, "Worsened"), ("HbA1c", None, "Unknown"),
        ("pain_score", 30.0, "Moderate Response"), ("tumor_size", 29.0, "Moderate Response"),
        ("something else", 20.0, "Strong Response"),
    ],
)
def test_classify_response_boundaries(one, kind, pct, label):
    got = one(x=C.classify_response(F.lit(kind), F.lit(pct).cast("double")))
    assert got["x"] == label


def test_improvement_sign_and_zero_baseline(one):
    def pct(b, f, d):
        return C.improvement_pct(F.lit(b), F.lit(f), F.lit(d))

    got = one(a=pct(10.0, 8.0, -1), b=pct(10.0, 8.0, 1), c=pct(0.0, 8.0, -1), d=pct(-10.0, -8.0, 1))
    assert got == {"a": 20.0, "b": -20.0, "c": 0.0, "d": 20.0}


@pytest.mark.parametrize(
    "value, label",
    [
        (7.28, "Strong Response"), (8.19, "Moderate Response"), (8.9, "Minimal Response"),
        (9.1, "No Response"), (9.3, "Worsened"), (None, "Unknown"),
    ],
)
def test_classify_event(one, value, label):
    got = one(x=C.classify_event(F.lit("HbA1c"), F.lit(value).cast("double")))
    assert got["x"] == label


def test_other_biomarkers_are_unknown(one):
    assert one(x=C.classify_event(F.lit("LDL"), F.lit(5.0)))["x"] == "Unknown"


@pytest.mark.parametrize(
    "text, title",
    [
        ("end-stage renal disease", "End-Stage Renal Disease"), ("T2D", "T2D"), ("COPD", "Copd"),
        ("type 2  diabetes", "Type 2  Diabetes"),
    ],
)
def test_title_case(one, text, title):
    assert one(x=C.title_case(F.lit(text)))["x"] == title


def test_cohort_labels_are_ordered(one):
    def label(conditions, positive):
        return C.cohort_label(F.lit(conditions).cast("string"), F.lit(positive))

    got = one(
        a=label("Type 2 Diabetes|Obesity", False), b=label("type 2 diabetes", True),
        c=label("Hypertension|Obesity", True), d=label("Obesity", True), e=label(None, True),
    )
    assert list(got.values()) == [
        "Treatment-Resistant Diabetic", "Responsive Diabetic", "Hypertension-Only",
        "Obesity-Only", "Mixed Comorbidities",
    ]
