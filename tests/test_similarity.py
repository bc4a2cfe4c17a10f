from __future__ import annotations

import numpy as np
import pytest

from cohortlake.operators import similarity as S


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    names = np.array(["Type 2 Diabetes", "Hypertension", "Obesity", "Asthma"])
    rows = []
    for i in range(80):
        held = names[rng.random(4) < 0.4]
        rows.append(
            (f"P{i:03d}", int(rng.integers(18, 90)), "Male" if i % 2 else "female",
             "|".join(held), float(rng.integers(50, 120)) / 10 if i % 9 else None,
             float(rng.integers(200, 400)) / 10)
        )
    patients = spark.createDataFrame(
        rows, "patient_id string, age int, gender string, conditions string, hba1c double, bmi double"
    )
    meds = spark.createDataFrame(
        [(f"P{i:03d}", f"D{j % 3}") for i in range(60) for j in range(i % 5 + 1)],
        "patient_id string, medication_name string",
    )
    return S.patient_features(patients, meds), meds


def matrix(features):
    rows = features.orderBy("patient_id").collect()
    x = np.array([[r[c] for c in S.FEATURES] for r in rows])
    spread = x.max(0) - x.min(0)
    return [r.patient_id for r in rows], (x - x.min(0)) / np.where(spread == 0, 1, spread)


def test_nearest_patients(world):
    features, _ = world
    ids, x = matrix(features)
    target = ids.index("P007")
    distance = np.sqrt(((x - x[target]) ** 2).sum(1))
    rows = S.similar_patients(features, "P007", digits=None).collect()
    assert len(rows) == 30 and rows[0].patient_id == "P007"
    assert [r.distance for r in rows] == pytest.approx(sorted(distance)[:30])
    assert rows[5].similarity_score == pytest.approx(1 - rows[5].distance / np.sqrt(7))


def test_many_queries(world, spark):
    features, _ = world
    ids, x = matrix(features)
    queries = spark.createDataFrame([("P001",), ("P030",)], "patient_id string")
    rows = S.similar_patients_of(features, queries, k=11).collect()
    for query in ("P001", "P030"):
        distance = np.sqrt(((x - x[ids.index(query)]) ** 2).sum(1))
        got = sorted((r.rank, r.distance) for r in rows if r.query_id == query)
        assert [d for _, d in got] == pytest.approx(sorted(distance)[:33])


def test_last_bits_do_not_order_neighbours(spark):
    rows = [("q", "B", 0.3), ("q", "A", 0.1 + 0.2), ("q", "C", 0.2)]
    pairs = spark.createDataFrame(rows, "query_id string, patient_id string, distance double")
    got = S.knn_top_k(pairs, "query_id", 2).orderBy("rank").collect()
    assert [r.patient_id for r in got] == ["C", "A"]


def test_cells_change_nothing(world):
    features, _ = world
    columns = ("query_id", "patient_id", "rank", "distance")
    found = [
        sorted(S.similar_patients_of(features, features, k=3, bits=n).select(*columns).collect()) for n in (1, 3)
    ]
    assert found[0] == found[1] and len({r.query_id for r in found[0]}) == features.count()


def brute_nearest(x, targets, k):
    """Row numbers of the k nearest rows, ties to nine decimals by row number."""
    out = {}
    for t in targets:
        distance = np.round(np.sqrt(((x - x[t]) ** 2).sum(1)), 9)
        out[t] = [int(i) for i in np.lexsort((np.arange(len(x)), distance))[:k]]
    return out


@pytest.mark.parametrize("kind", ["even", "outlier", "crowded", "few"])
def test_nearest_points(spark, kind):
    rng = np.random.default_rng(8)
    x = np.c_[rng.random((600, 3)), rng.integers(0, 2, (600, 2))]
    if kind == "outlier":  # all but two rows lie in a thousandth of the range
        x[:, 0] /= 1000
        x[7, 0], x[8, 0] = 1.0, -5e6
    if kind == "crowded":  # two thirds of the rows are equal, and many tie
        x[:400] = x[0]
        x[400:, 0] = np.round(x[400:, 0], 1)
    if kind == "few":
        x = x[:9]
    columns = [f"c{i}" for i in range(5)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns))
    targets = list(range(0, len(x), 40))
    queries = points.where(points.id.isin(targets)).withColumnRenamed("id", "query_id")
    got = {}
    for r in S.nearest_points(points, queries, "id", columns, 12).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    want = brute_nearest(x, targets, 12)
    assert {q: [i for _, i in sorted(r)] for q, r in got.items()} == want


def test_most_pairs_are_never_formed(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.random((4000, 4))
    columns = [f"c{i}" for i in range(4)]
    points = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in columns))
    queries = points.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    formed = []
    top = S.knn_top_k
    monkeypatch.setattr(S, "knn_top_k", lambda pairs, *rest: formed.append(pairs.count()) or top(pairs, *rest))
    found = S.nearest_points(points, queries, "id", columns, 30)
    assert found.count() == 200 * 30 and formed[0] < 200 * 4000 / 10


def test_missing_lab_values(spark):
    patients = spark.createDataFrame(
        [("A", 40, "F", "", None), ("B", 50, "F", "", 8.0), ("C", None, "F", "a|b", 6.0)],
        "patient_id string, age int, gender string, conditions string, hba1c double",
    )
    meds = spark.createDataFrame([("A",), ("A",)], "patient_id string")
    got = {r.patient_id: r for r in S.patient_features(patients, meds).collect()}
    assert (got["A"].hba1c, got["A"].bmi, got["A"].medication_count) == (7.0, 0.0, 2.0)
    assert (got["C"].age, got["C"].medication_count) == (50.0, 2.0)
    zero = S.patient_features(patients, meds, impute="zero").where("patient_id = 'A'").first()
    assert zero.hba1c == 0.0


def test_first_baseline_stands_in_for_a_missing_lab(spark):
    patients = spark.createDataFrame(
        [("A", 40, "F", "")], "patient_id string, age int, gender string, conditions string"
    )
    outcomes = spark.createDataFrame(
        [("A", "HbA1c", "O2", "2024-02-01", 9.0), ("A", "HbA1c", "O1", "2024-01-01", 8.0), ("A", "PHQ-9", "O0", "2023-01-01", 3.0)],
        "patient_id string, outcome_type string, outcome_id string, measurement_date string, baseline_value double",
    )
    meds = spark.createDataFrame([], "patient_id string")
    assert S.patient_features(patients, meds, outcomes).first().hba1c == 8.0


def test_constant_features_scale_to_zero(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = S.min_max_scale(frame, ("a", "b")).orderBy("a").collect()
    assert [(r.s_a, r.s_b) for r in got] == [(0.0, 0.0), (1.0, 0.0)]


def test_jaccard(world):
    features, _ = world
    rows = S.similar_patients_jaccard(features, "P010").collect()
    assert len(rows) == 30 and rows[0].distance == 0.0 and rows[0].similarity_score == 1.0


@pytest.mark.parametrize("k", [3, 15])
def test_jaccard_of_many(spark, k):
    """Against all pairs: rare and common conditions, none at all, equal patients, null genders."""
    rng = np.random.default_rng(k)
    names = ["diabetes", "asthma", "gout", "copd", "obesity", "migraine", "lupus"]
    rows = []
    for i in range(400):
        own = [n for j, n in enumerate(names) if rng.random() < 0.5 / (j + 1)]
        rows.append((f"P{i:03d}", float(rng.integers(18, 90)), ["Male", "Female", None][int(rng.integers(0, 3))], own + own[:1]))
    rows += [(f"Q{i:03d}", 50.0, "Male", ["gout", "copd"]) for i in range(80)] + [("R1", 33.0, "Female", ["sarcoidosis"]), ("R2", 90.0, None, [])]
    features = spark.createDataFrame(rows, "patient_id string, age double, gender string, condition_list array<string>")
    targets = [r for r in rows if r[0] in ("Q007", "R1", "R2") or r[0][0] == "P" and int(r[0][1:]) % 20 == 0]
    queries = spark.createDataFrame([(t[0],) for t in targets] + [(targets[0][0],), ("nobody",)], "patient_id string")
    got = {}
    for r in S.similar_patients_jaccard_of(features, queries, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.patient_id, round(r.distance, 9)))
    assert set(got) == {t[0] for t in targets}
    for q, age, gender, own in targets:
        all_ = []
        for i, a, g, c in rows:
            union = set(own) | set(c)
            conditions = 1 - len(set(own) & set(c)) / len(union) if union else 0.5
            same = g == gender and g is not None
            all_.append((round(0.5 * conditions + 0.35 * min(abs(a - age) / 50, 1) + 0.15 * (0 if same else 0.2), 9), i))
        want = [(n, i, d) for n, (d, i) in enumerate(sorted(all_)[: S.neighbour_count(k)], 1)]
        assert sorted(got[q]) == want, q


def test_cohort_outcomes_equal_a_join(spark, world):
    features, meds = world
    rng = np.random.default_rng(5)
    rows = [
        (f"P{int(rng.integers(0, 60)):03d}", f"O{i}",
         ["Strong Response", "Worsened"][int(rng.integers(0, 2))], float(rng.integers(-40, 10)))
        for i in range(400)
    ]
    outcomes = spark.createDataFrame(
        rows, "patient_id string, outcome_id string, response_status string, change_pct double"
    )
    cohort = S.similar_patients(features, "P007")
    found = S.cohort_treatment_outcomes(cohort, outcomes, meds, k=None, digits=None).collect()
    pairs = outcomes.join(cohort, "patient_id", "left_semi").join(meds, "patient_id").toPandas()
    assert len(found) == pairs.medication_name.nunique() > 0
    for r in found:
        own = pairs[pairs.medication_name == r.medication_name]
        assert r.patients_count == len(own)
        assert r.median_change_pct == pytest.approx(own.change_pct.median())
        assert r.positive_response_rate == pytest.approx(
            (own.response_status == "Strong Response").mean() * 100
        )
    summary = S.similar_cohort_summary(cohort, outcomes).first()
    assert summary.cohort_size == 30 and 0 <= summary.non_response_pct <= 100
