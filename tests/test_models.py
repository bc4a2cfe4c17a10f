from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.plans import models as P


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(2)
    rows = []
    for i in range(600):
        baseline = rng.uniform(6, 12)
        good = baseline > 9 or rng.random() < 0.1
        rows.append(
            (
                f"O{i}", baseline if i % 50 else None, rng.randrange(20, 90), rng.random() < 0.5,
                rng.random() < 0.5, rng.random() < 0.3, rng.random() < 0.8,
                rng.choice(["Type 2 Diabetes", "A|B", ""]), rng.choice(["Male", "Female"]),
                rng.choice(["Phase 2", "Phase 3"]), rng.choice(["X", "Y", None]),
                "Strong Response" if good else "Worsened", rng.uniform(-30, 5),
            )
        )
    return spark.createDataFrame(
        rows,
        "outcome_id string, baseline_value double, age int, has_diabetes boolean, "
        "has_hypertension boolean, has_obesity boolean, treatment_completed boolean, "
        "conditions string, gender string, phase string, drug_class string, "
        "response_status string, change_pct double",
    ).cache()


@pytest.fixture(scope="module")
def features(fact):
    return P.response_features(fact)


@pytest.fixture(scope="module")
def trained(features):
    return P.train_response_model(features, trees=8)


def test_features_have_no_nulls(features):
    nulls = features.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features.columns])
    assert set(nulls.first()) == {0}
    assert {r.num_conditions for r in features.collect()} == {1.0, 2.0}


def test_codes_are_sorted_and_unseen_is_zero(spark, features):
    codes = P.category_codes(features)
    got = {(r.column, r.value): r.code for r in codes.collect()}
    assert got["drug_class", "Unknown"] == 0 and got["drug_class", "X"] == 1
    assert got["gender", "Female"] == 0 and got["gender", "Male"] == 1
    odd = features.limit(1).withColumn("phase", F.lit("Phase 9"))
    assert P.encode_categories(odd, codes).first().phase == 0.0


def test_split_is_repeatable_and_stratified(features):
    train, test = P.stratified_split(features)
    ids = [{r.outcome_id for r in side.collect()} for side in (train, test)]
    assert ids[0].isdisjoint(ids[1]) and len(ids[0]) + len(ids[1]) == features.count()
    assert {r.outcome_id for r in P.stratified_split(features.repartition(3))[1].collect()} == ids[1]
    for label, n in features.groupBy("label").count().collect():
        assert train.where(F.col("label") == label).count() == int(n * 0.8 + 0.5)


def test_split_of_few_and_unlabelled_rows(spark):
    rows = [(f"o{i}", None if i < 7 else 1.0) for i in range(8)]
    train, test = P.stratified_split(spark.createDataFrame(rows, "outcome_id string, label double"))
    assert sorted((r.label or 0.0) for r in train.collect()) == [0.0] * 6 + [1.0] and test.count() == 1
    empty = spark.createDataFrame([], "outcome_id string, label double")
    assert [side.count() for side in P.stratified_split(empty)] == [0, 0]


def test_shapley_values_of_small_trees():
    """Against all orders of the features, with the trees walked node by node."""
    rng = random.Random(1)

    class Stats:
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

    class Node:
        def __init__(self, depth, rows):
            self.rows, self.depth = rows, depth if rows > 1 else 0
            self.value = rng.gauss(0, 1)
            if self.depth:
                self.f, self.t, cut = rng.randrange(3), rng.random(), rng.randrange(1, rows)
                self.kids = Node(depth - 1, cut), Node(depth - 1, rows - cut)

        def subtreeDepth(self):
            return self.depth

        def prediction(self):
            return self.value

        def impurityStats(self):
            return Stats(self.rows)

        def split(self):
            return self

        def featureIndex(self):
            return self.f

        def threshold(self):
            return self.t

        def leftChild(self):
            return self.kids[0]

        def rightChild(self):
            return self.kids[1]

    def value(node, x, known):
        if not node.depth:
            return node.value
        a, b = node.kids
        if node.f in known:
            return value(a if x[node.f] <= node.t else b, x, known)
        return (a.rows * value(a, x, known) + b.rows * value(b, x, known)) / node.rows

    for _ in range(6):
        root = Node(4, 100)
        x = np.array([[rng.random() for _ in range(3)] for _ in range(8)])
        got, base = P.shapley_values(P.tree_leaves(root, 1.0), x)
        assert base == pytest.approx(value(root, x[0], set()))
        for row, parts in zip(x, got):
            want = np.zeros(3)
            for order in itertools.permutations(range(3)):
                for i, f in enumerate(order):
                    gain = value(root, row, set(order[: i + 1])) - value(root, row, set(order[:i]))
                    want[f] += gain / 6
            assert parts == pytest.approx(want, abs=1e-12)


def test_importances_stand_in(spark, trained, features):
    weights = P.feature_importances(trained, spark)
    row = P.importance_attributions(features, weights).first()
    assert row.method == "global_feature_importance_fallback" and row.base_value is None
    top = weights.first()
    assert row[f"c_{top.feature}"] == pytest.approx(top.importance)


def test_attributions_add_up(trained, features):
    assert P.additive_gap(trained, features).first().gap < 1e-9
    rows = P.ranked_contributions(P.attribute_scores(trained, features)).take(5)
    for r in rows:
        sizes = [abs(c.value) for c in r.contributions]
        assert sizes == sorted(sizes, reverse=True) and len(sizes) == 10


def test_scores_and_metrics(spark, trained, features):
    rows = P.score_responses(trained, features, digits=False).collect()
    for r in rows:
        label = "Strong Response" if r.probability >= 0.7 else (
            "Moderate Response" if r.probability >= 0.45 else "Minimal/No Response"
        )
        assert r.predicted_response == label
        assert r.confidence == pytest.approx(abs(r.probability - 0.5) * 2)
    metrics = {r.metric: r.value for r in P.evaluate_classifier(trained, features).collect()}
    assert metrics["roc_auc"] > 0.85 and metrics["accuracy"] > 0.85
    weights = P.feature_importances(trained, spark).collect()
    assert weights[0].feature == "baseline_value"
    assert sum(w.importance for w in weights) == pytest.approx(1.0)


def test_model_survives_saving(spark, trained, features, tmp_path):
    trained.save(str(tmp_path / "m"))
    loaded = P.ResponseModel.load(spark, str(tmp_path / "m"))
    a = {r.outcome_id: r.probability for r in P.score_responses(trained, features).collect()}
    b = {r.outcome_id: r.probability for r in P.score_responses(loaded, features).collect()}
    assert a == b


def test_cohorts(fact):
    features = P.cohort_features(fact)
    model = P.train_cohorts(features, restarts=2)
    assigned = P.assign_cohort(model, features)
    profiles = P.named_profiles(P.cohort_profiles(assigned)).orderBy("cluster").collect()
    assert sum(p["size"] for p in profiles) == fact.count()
    assert [p.cohort_id for p in profiles] == [f"C{i:03d}" for i in range(1, len(profiles) + 1)]
    rates = [p.response_rate for p in profiles]
    assert rates == sorted(rates)
    scores = [r.similarity_score for r in assigned.collect()]
    assert all(0 < s <= 1 for s in scores)
    quality = {r.metric: r.value for r in P.clustering_quality(model, features).collect()}
    assert -1 <= quality["silhouette"] <= 1 and quality["inertia"] > 0


def test_shapley_tables_over_groups_of_leaves(monkeypatch):
    """Summed tables give what the leaves give one by one, whatever a table may hold, and the
    leaves' effects are worked out once, not for each batch."""
    rng = random.Random(5)
    leaves = []
    for _ in range(60):
        features = rng.sample(range(4), rng.randrange(0, 4))
        low = [rng.choice([-np.inf, 0.1, 0.2, 0.3]) for _ in features]
        high = [rng.choice([np.inf, 0.4, 0.6, 0.7]) for _ in features]
        share = [rng.random() for _ in features]
        leaves.append(P.Leaf(rng.gauss(0, 1), tuple(features), tuple(low), tuple(high), tuple(share)))
    x = np.random.default_rng(2).random((500, 4))
    x[:8] = [[0.1] * 4, [0.2] * 4, [0.3] * 4, [0.4] * 4, [0.7] * 4, [np.nan] * 4, [np.inf] * 4, [-np.inf] * 4]
    want = np.zeros(x.shape)
    for leaf in leaves:
        for j, row in enumerate(x):
            held = sum((lo < row[f] <= hi) << i for i, (f, lo, hi) in enumerate(zip(leaf.features, leaf.low, leaf.high)))
            want[j, list(leaf.features)] += leaf.shapley()[held]
    effects = [leaf.shapley() for leaf in leaves]
    monkeypatch.delattr(P.Leaf, "shapley")
    for cells in (1, 50, 5000):
        monkeypatch.setattr(P.ShapleyTables, "CELLS", cells)
        tables = P.ShapleyTables(leaves, effects, 4)
        for rows in (x, x[:3], x[:0]):
            got, base = tables.values(rows)
            assert np.allclose(got, want[: len(rows)], atol=1e-12)
            assert base == pytest.approx(sum(leaf.expected() for leaf in leaves))


def test_rows_do_not_move_by_a_column_of_few_values(spark, features):
    """Joined by shuffle, the rows of a gender or of a label would all be read by one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        codes = P.category_codes(features)
        encoded = P.encode_categories(features, codes)
        sides = P.stratified_split(features)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (encoded, *sides)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)


def test_cohorts_are_fitted_on_plain_vectors(fact, monkeypatch):
    """Neither the columns of a cache nor the fact itself is read again in every step."""
    seen, fit = [], P.KMeans.fit

    def watched(self, data):
        plan = data._jdf.queryExecution().optimizedPlan().toString()
        seen.append((data.is_cached, "Join" in plan or "UDF" in plan))
        return fit(self, data)

    monkeypatch.setattr(P.KMeans, "fit", watched)
    P.train_cohorts(P.cohort_features(fact), restarts=2)
    assert seen == [(False, False)] * 2


def test_trees_are_those_of_mllib(spark, features):
    """With all rows and columns in every tree nothing is drawn, and the trees are the same."""
    encoded = P.encode_categories(features, P.category_codes(features))
    params = P.GBTClassifier(
        maxIter=6, maxDepth=4, stepSize=0.08, subsamplingRate=1.0, featureSubsetStrategy="1.0", maxBins=8
    )
    vectors = P.VectorAssembler(inputCols=list(P.RESPONSE_FEATURES), outputCol="features").transform(encoded)
    want = params.fit(vectors.coalesce(1))
    got = P.boosting.fit(encoded, P.RESPONSE_FEATURES, params)
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    rows = [
        [r.p for r in model.transform(vectors).select(P.vector_to_array("probability")[1].alias("p")).collect()]
        for model in (got, want)
    ]
    assert np.allclose(*rows)


def test_training_does_not_depend_on_the_layout(features, monkeypatch):
    """Equal rows are counted, and the trees are grown on the counts, whatever moved before."""
    sizes = []
    drawn = P.boosting.boosted_trees

    def watched(chunks, *args):
        sizes.append(chunks.map(lambda c: (len(c.margin), int(sum(n.sum() for n in c.counts)))).collect())
        return drawn(chunks, *args)

    monkeypatch.setattr(P.boosting, "boosted_trees", watched)
    twice = features.unionByName(features.withColumn("outcome_id", F.concat("outcome_id", F.lit("b"))))
    a, b = (P.train_response_model(df, trees=3).model for df in (twice, twice.repartition(7)))
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    [(cells, rows)] = sizes[0]
    assert sizes[0] == sizes[1] and rows == 960 and cells < 600


def test_split_of_repeated_keys(spark):
    """Copies of the key at which the share ends lie on both sides, none is lost."""
    rows = [("same", 1.0, i) for i in range(10)] + [(f"o{i}", 0.0, i) for i in range(10)] + [(None, None, 1)] * 10
    df = spark.createDataFrame(rows, "outcome_id string, label double, v int")
    train, test = P.stratified_split(df)
    assert sorted(str(r.label) for r in train.collect()) == ["0.0"] * 8 + ["1.0"] * 8 + ["None"] * 8
    assert sorted(map(str, train.unionByName(test).collect())) == sorted(map(str, df.collect()))
    again = P.stratified_split(df.repartition(3))[0]
    assert sorted(map(str, again.collect())) == sorted(map(str, train.collect()))


def test_split_leaves_rows_where_they_are(spark, features):
    for side in P.stratified_split(features):
        assert "Exchange hashpartitioning" not in side._jdf.queryExecution().executedPlan().toString()


def test_tables_of_attributions_are_built_once(spark, trained, features, monkeypatch):
    built, add = [], P.ShapleyTables.__init__
    monkeypatch.setattr(P.ShapleyTables, "__init__", lambda self, *a: (built.append(1), add(self, *a))[1])
    rows = P.attribute_scores(trained, features.repartition(3)).collect()
    assert len(rows) == 600 and len(built) == 1


def test_steps_of_kmeans_are_those_of_mllib(spark, fact):
    """From the same start, all restarts at once come to MLlib's centres and costs."""
    features = P.cohort_features(fact)
    x = np.array([[r[c] for c in P.COHORT_FEATURES] for r in features.collect()])
    mean, factor = x.mean(axis=0), 1 / x.std(axis=0, ddof=1)
    points = P.clustering.Points(P.clustering.packed_points(features, P.COHORT_FEATURES, mean, factor), 7)
    scaled = spark.createDataFrame([(P.Vectors.dense(r),) for r in (x - mean) * factor], ["features"])
    starts = [P.KMeans(k=5, seed=s, maxIter=0).fit(scaled).clusterCenters() for s in (1, 2, 3)]
    centres, costs = points.settle([np.array(s) for s in starts], 20, 1e-4)
    for s, found, cost in zip((1, 2, 3), centres, costs):
        want = P.KMeans(k=5, seed=s).fit(scaled)
        assert np.allclose(found, want.clusterCenters()) and cost == pytest.approx(want.summary.trainingCost)


def test_starts_of_kmeans(fact):
    """Candidates are points, about 2 k a round, and every point counts for its nearest one."""
    features = P.cohort_features(fact)
    points = P.clustering.Points(P.clustering.packed_points(features, P.COHORT_FEATURES, np.zeros(7), np.ones(7)), 7)
    candidates, weights = points.starts([1, 2, 3], 5)
    own = {tuple(r[c] for c in P.COHORT_FEATURES) for r in features.collect()}
    for c, w in zip(candidates, weights):
        assert 5 < len(c) < 60 and w.sum() == 600 and {tuple(r) for r in c} <= own
    assert len({c.tobytes() for c in candidates}) == 3


def test_clusters_of_few_points(spark):
    rows = [(f"o{i}", 50.0 + i % 3, 1.0, 0.0, 0.0, 0.0, 0.0, float(i % 3 == 2)) for i in range(9)]
    features = spark.createDataFrame(rows, ["outcome_id", *P.COHORT_FEATURES])
    model = P.train_cohorts(features, restarts=2)
    assert len(model.clusters.clusterCenters()) <= 3 and model.inertia == pytest.approx(0.0, abs=1e-9)
