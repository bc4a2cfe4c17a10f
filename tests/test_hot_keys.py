"""Aggregates over tables in which one patient and one trial hold a third of the rows,
against plain pandas joins that do form every pair."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from cohortlake.functions import values as V
from cohortlake.operators import analytics as A
from cohortlake.operators import lakehouse as L
from cohortlake.operators import quality as Q

STATUSES = [*V.POSITIVE, *V.NON_RESPONDER, None]


def hot(rng, prefix, n):
    return f"{prefix}0" if rng.random() < 0.34 else f"{prefix}{rng.randrange(1, n)}"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(23)
    outcomes = pd.DataFrame(
        [
            dict(
                outcome_id=f"O{i}", patient_id=hot(rng, "P", 40), trial_id=hot(rng, "T", 12),
                response_status=rng.choice(STATUSES), baseline_value=rng.uniform(4, 15),
                change=rng.choice([None, round(rng.uniform(-9, 3), 2)]),
                adverse_events=rng.choice([None, "", "Nausea", "Headache|Fatigue", "Rash"]),
                treatment_completed=rng.random() < 0.7,
            )
            for i in range(900)
        ]
    )
    medications = pd.DataFrame(
        [
            dict(
                medication_id=f"M{i}", patient_id=hot(rng, "P", 40), trial_id=hot(rng, "T", 12),
                medication_name=rng.choice(["A", "B", "C", None]),
                drug_class=rng.choice(["GLP-1", "ACE", "  "]),
            )
            for i in range(600)
        ]
    )
    patients = pd.DataFrame(
        [dict(patient_id=f"P{i}", age=rng.randrange(20, 90)) for i in range(40)]
    )
    schemas = {
        "outcomes": "outcome_id string, patient_id string, trial_id string, response_status string, "
        "baseline_value double, change double, adverse_events string, treatment_completed boolean",
        "medications": "medication_id string, patient_id string, trial_id string, "
        "medication_name string, drug_class string",
        "patients": "patient_id string, age int",
    }
    plain = {"outcomes": outcomes, "medications": medications, "patients": patients}
    frames = {
        n: spark.createDataFrame(
            [tuple(None if pd.isna(x) else x for x in r) for r in plain[n].itertuples(index=False)],
            schemas[n],
        )
        for n in plain
    }
    return plain, frames


def positive(df):
    return df.response_status.isin(V.POSITIVE)


def has_event(df):
    return df.adverse_events.fillna("").str.strip() != ""


def test_pairs_by_patient(world):
    plain, frames = world
    pairs = plain["medications"].merge(plain["outcomes"], on="patient_id")
    pairs = pairs[pairs.drug_class.str.strip() != ""]
    found = A.medication_effectiveness(frames["medications"], frames["outcomes"], digits=False)
    rows = {r.drug_class: r for r in found.collect()}
    assert set(rows) == set(pairs.drug_class)
    for name, own in pairs.groupby("drug_class"):
        r = rows[name]
        assert r.sample_size == len(own)
        assert r.response_rate == pytest.approx(positive(own).mean() * 100)
        assert r.mean_change == pytest.approx(own.change.mean())
        assert r.completion_rate == pytest.approx(own.treatment_completed.mean() * 100)
        assert r.adverse_event_rate == pytest.approx(has_event(own).mean() * 100)
        counts = own[has_event(own)].adverse_events.value_counts()
        best = sorted((-n, e) for e, n in counts.items())[:2]
        assert [t.rsplit(" (", 1)[0] for t in r.common_adverse_events] == [e for _, e in best]


def test_pairs_by_patient_and_trial(world):
    plain, frames = world
    pairs = plain["outcomes"].merge(plain["medications"], on=["patient_id", "trial_id"])
    found = L.drug_effectiveness_silver(frames["outcomes"], frames["medications"]).collect()
    groups = dict(list(pairs.groupby("medication_name")))
    assert {r.medication_name for r in found} == set(groups)
    for r in found:
        own = groups[r.medication_name]
        assert r.patient_count == own.patient_id.nunique()
        assert r.mean_change == pytest.approx(own.change.mean())
        assert r.response_rate == pytest.approx(positive(own).mean())
        assert r.adverse_event_count == own.adverse_events.notna().sum()
    rates = [r.response_rate for r in found]
    assert rates == sorted(rates, reverse=True)


def test_distinct_pairs(world):
    plain, frames = world
    pairs = plain["outcomes"].merge(plain["medications"], on=["patient_id", "trial_id"])
    expected = len(pairs[["drug_class", "response_status"]].dropna().drop_duplicates())
    found = Q.drug_response_pairs(frames["outcomes"], frames["medications"]).first()
    assert found.distinct_pairs == expected


def test_factors(world):
    plain, frames = world
    o, m, p = plain["outcomes"], plain["medications"], plain["patients"]
    limit = o.baseline_value.quantile(0.75)
    many = m.groupby("patient_id").size()
    groups = {
        "High": o[o.baseline_value > limit],
        "Polypharmacy": o[o.patient_id.isin(many[many >= 3].index)],
        "Age": o[o.patient_id.isin(p[p.age >= 65].patient_id)],
    }
    found = Q.non_response_factors(frames["outcomes"], frames["medications"], frames["patients"])
    rows = {r.factor.split()[0]: r for r in found.collect()}
    for name, own in groups.items():
        assert rows[name].group_size == len(own)
        assert rows[name].patients_affected == (~positive(own)).sum()


def test_trial_medians_and_top_events(spark, world):
    plain, frames = world
    trials = spark.createDataFrame(
        [(f"T{i}", f"Trial {i}", "Phase 1") for i in range(14)],
        "trial_id string, title string, phase string",
    )
    enrollments = spark.createDataFrame(
        [(f"E{i}", f"P{i}", "T0", "Dropped_Out" if i % 4 == 0 else "COMPLETED") for i in range(20)],
        "enrollment_id string, patient_id string, trial_id string, status string",
    )
    found = A.trial_performance(trials, enrollments, frames["outcomes"], digits=False)
    rows = {r.trial_id: r for r in found.collect()}
    for name, own in plain["outcomes"].groupby("trial_id"):
        assert rows[name].median_change == pytest.approx(own.change.median())
        assert rows[name].adverse_events_count == has_event(own).sum()
    assert (rows["T0"].dropout_rate, rows["T0"].total_completed) == (25.0, 15)
    assert rows["T13"].total_enrolled == 0 and rows["T13"].median_change is None

    top = A.top_adverse_events(frames["outcomes"], 1, ("patient_id",), digits=None)
    own = plain["outcomes"][plain["outcomes"].patient_id == "P0"]
    counts = own[has_event(own)].adverse_events.value_counts()
    best = min((-n, e) for e, n in counts.items())
    row = top.where("patient_id = 'P0'").first()
    assert (row.event, row.occurrences) == (best[1], -best[0])
    assert row.prevalence_pct == pytest.approx(-best[0] / len(own) * 100)
