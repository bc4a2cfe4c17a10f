"""Response and cohort models with MLlib."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    ClusteringEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import values as V
from cohortlake.operators.skew import sequence_numbers, when_small
from cohortlake.plans import boosting, clustering
from cohortlake.plans.leaves import Leaf, ShapleyTables
from cohortlake.session import settled

# Features and training parameters.
CATEGORIES = ("gender", "phase", "drug_class")
RESPONSE_FEATURES = (
    "baseline_value", "age", "has_diabetes", "has_hypertension", "has_obesity",
    "treatment_completed", "num_conditions", "gender", "phase", "drug_class",
)
COHORT_FEATURES = (
    "age", "baseline_value", "change_pct", "has_diabetes", "has_hypertension", "has_obesity",
    "responded",
)
TREES, DEPTH, STEP, SUBSAMPLE, COLUMN_SAMPLE, SEED = 100, 4, 0.08, 0.8, "0.8", 42
TRAIN_SHARE = 0.8
CLUSTERS, RESTARTS = 5, 10
STRONG_FROM, MODERATE_FROM = 0.70, 0.45


# --- response features --------------------------------------------------------------


def response_features(fact: DataFrame) -> DataFrame:
    """Numeric and text features and the label of every row of the silver fact."""

    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False)).cast("double").alias(c)

    conditions = F.coalesce("conditions", F.lit(""))
    return fact.select(
        "outcome_id",
        F.coalesce(F.col("baseline_value").cast("double"), F.lit(0.0)).alias("baseline_value"),
        F.coalesce(F.col("age").cast("double"), F.lit(50.0)).alias("age"),
        *[flag(c) for c in ("has_diabetes", "has_hypertension", "has_obesity")],
        F.coalesce("treatment_completed", F.lit(True)).cast("double").alias("treatment_completed"),
        F.size(F.split(conditions, r"\|")).cast("double").alias("num_conditions"),
        *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in CATEGORIES],
        # The fact's own flag, if it has one, is narrower than the status it was made of.
        (F.col("responded") if "responded" in fact.columns else C.responded()).cast("double").alias("label"),
    )


def category_codes(features: DataFrame, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Sorted code per category value, as (column, value, code).

    The values are made distinct first, so the ranking sees only the vocabulary.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    distinct = features.select(F.inline(pairs)).distinct()
    window = Window.partitionBy("column").orderBy("value")
    return distinct.withColumn("code", F.row_number().over(window) - 1)


def encode_categories(
    features: DataFrame, codes: DataFrame, columns: tuple[str, ...] = CATEGORIES
) -> DataFrame:
    """Category columns replaced by their codes; an unseen or null value becomes 0.

    A left join per column, whatever the number of values: a small vocabulary is
    broadcast by its counted rows, as moving the rows by a column of two values would make
    two tasks of them; a large one is shuffled.
    """
    order = features.columns
    codes = settled(codes)
    for c in columns:
        own = when_small(
            codes.where(F.col("column") == c).select(
                F.col("value").alias(f"_{c}"), F.col("code").cast("double").alias("_code")
            )
        )
        joined = features.join(own, F.col(c) == F.col(f"_{c}"), "left").drop(c, f"_{c}")
        features = joined.withColumn(c, F.coalesce("_code", F.lit(0.0))).drop("_code")
    return features.select(*order)


def stratified_split(
    df: DataFrame, label: str = "label", key: str = "outcome_id", share: float = TRAIN_SHARE
) -> tuple[DataFrame, DataFrame]:
    """A training and a held-out side that a rerun repeats exactly.

    Of every label (null is one too) the rows with the least hashes of their key train:
    ``share`` of them, rounded to a whole row.  Rows stay where they are: a label's rows are
    counted by the upper bits of the hash, then by key where the share ends.  ``df`` is read
    for each of the two counts and for either side, so store it first if it is costly.
    """
    drawn = F.xxhash64(F.lit(SEED), F.col(key)).alias("_drawn")
    rows = df.select(F.col(label).alias("_label"), drawn, F.col(key).alias("_key"))

    def ends(counts: DataFrame, order: str, wanted: Column) -> DataFrame:
        """The place of every label's order at which the rows up to it reach those wanted."""
        of_label = Window.partitionBy("_label")
        placed = counts.withColumns(
            {
                "_upto": F.sum("_n").over(of_label.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)),
                "_all": F.sum("_n").over(of_label),
            }
        ).withColumn("_wanted", wanted)
        return placed.where((F.col("_upto") - F.col("_n") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_upto")))

    bucket = F.shiftright("_drawn", 48)
    by_bucket = rows.groupBy("_label", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    buckets = when_small(
        ends(by_bucket, "_bucket", F.floor(F.col("_all") * share + 0.5)).select(
            F.col("_label").alias("_l"), "_bucket", (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_left")
        )
    )
    near = rows.join(buckets, F.col("_label").eqNullSafe(F.col("_l")) & (bucket == F.col("_bucket")))
    by_key = near.groupBy("_label", "_left", F.struct("_drawn", "_key").alias("_spot")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = when_small(
        ends(by_key, "_spot", F.col("_left")).select(
            F.col("_label").alias("_l"), F.col("_spot").alias("_end"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_taken"), F.col("_n").alias("_equal")
        )
    )
    # Labels of which nothing trains have no end.
    placed = df.withColumn("_spot", F.struct(drawn, F.col(key).alias("_key"))).join(
        cuts, F.col(label).eqNullSafe(F.col("_l")), "left"
    )
    trains = F.coalesce(F.col("_spot") <= F.col("_end"), F.lit(False))
    if cuts.where(F.col("_taken") < F.col("_equal")).isEmpty():
        return placed.where(trains).select(*df.columns), placed.where(~trains).select(*df.columns)
    # Of rows with the key at which the share ends, the first ones by their columns train.
    tied = F.coalesce((F.col("_spot") == F.col("_end")) & (F.col("_taken") < F.col("_equal")), F.lit(False))
    numbered = sequence_numbers(placed.where(tied).select(*df.columns, "_taken"), "_rank", [F.col(key).isNull()], [label])
    parts = [numbered.where(F.col("_rank") <= F.col("_taken")), numbered.where(F.col("_rank") > F.col("_taken"))]
    sides = [placed.where(~tied & trains), placed.where(~tied & ~trains)]
    return tuple(a.select(*df.columns).unionByName(b.select(*df.columns)) for a, b in zip(sides, parts))


# --- response model -----------------------------------------------------------------------


@dataclass
class ResponseModel:
    model: GBTClassificationModel
    codes: DataFrame

    def vectors(self, features: DataFrame) -> DataFrame:
        encoded = encode_categories(features, self.codes)
        assembler = VectorAssembler(inputCols=list(RESPONSE_FEATURES), outputCol="features")
        return assembler.transform(encoded)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/trees")
        self.codes.coalesce(1).write.mode("overwrite").parquet(f"{path}/codes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ResponseModel:
        return ResponseModel(
            GBTClassificationModel.load(f"{path}/trees"), spark.read.parquet(f"{path}/codes")
        )


def train_response_model(features: DataFrame, trees: int = TREES) -> ResponseModel:
    """Gradient-boosted trees on the training side of the stratified split.

    The rows are binned and counted once; boosting then reads the counted cells only.
    """
    codes = settled(category_codes(features))
    train, _ = stratified_split(features)
    params = GBTClassifier(
        maxIter=trees,
        maxDepth=DEPTH,
        stepSize=STEP,
        subsamplingRate=SUBSAMPLE,
        featureSubsetStrategy=COLUMN_SAMPLE,
        seed=SEED,
    )
    return ResponseModel(boosting.fit(encode_categories(train, codes), RESPONSE_FEATURES, params), codes)


def evaluate_classifier(trained: ResponseModel, features: DataFrame) -> DataFrame:
    """Accuracy, ROC-AUC and per-class scores on the held-out side, as (metric, value)."""
    _, held_out = stratified_split(features)
    scored = trained.model.transform(trained.vectors(held_out)).select(
        "label", "prediction", "rawPrediction", "probability"
    )
    scored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        multi = MulticlassClassificationEvaluator()
        rows = [
            ("accuracy", multi.setMetricName("accuracy").evaluate(scored)),
            ("roc_auc", BinaryClassificationEvaluator().evaluate(scored)),
        ]
        for label in (0.0, 1.0):
            multi.setMetricLabel(label)
            for name, metric in (
                ("precision", "precisionByLabel"),
                ("recall", "recallByLabel"),
                ("f1", "fMeasureByLabel"),
            ):
                value = multi.setMetricName(metric).evaluate(scored)
                rows.append((f"{name}_{int(label)}", value))
    finally:
        scored.unpersist()
    return held_out.sparkSession.createDataFrame(rows, "metric string, value double")


def feature_importances(trained: ResponseModel, spark: SparkSession) -> DataFrame:
    weights = trained.model.featureImportances.toArray()
    rows = [(n, float(w)) for n, w in zip(RESPONSE_FEATURES, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def score_responses(
    trained: ResponseModel, features: DataFrame, digits: bool = True
) -> DataFrame:
    """Probability, predicted class and confidence of every row."""
    three, two = (3, 2) if digits else (None, None)
    probability = vector_to_array("probability")[1]
    scored = trained.model.transform(trained.vectors(features)).select(
        "outcome_id", probability.alias("p")
    )
    return scored.select(
        "outcome_id",
        C.rounded(F.col("p"), three).alias("probability"),
        F.when(F.col("p") >= STRONG_FROM, V.STRONG)
        .when(F.col("p") >= MODERATE_FROM, V.MODERATE)
        .otherwise("Minimal/No Response")
        .alias("predicted_response"),
        C.rounded(F.abs(F.col("p") - 0.5) * 2, two).alias("confidence"),
    )


# --- attribution -----------------------------------------------------------------------------


def tree_leaves(root, weight: float) -> list[Leaf]:
    """The leaves of a fitted tree; a saved model keeps the row counts of its nodes."""
    found: list[Leaf] = []

    def visit(node, path: dict[int, tuple[float, float, float]]) -> None:
        if node.subtreeDepth() == 0:
            limits = list(zip(*path.values())) or [(), (), ()]
            found.append(Leaf(weight * node.prediction(), tuple(path), *(tuple(x) for x in limits)))
            return
        split, rows = node.split(), node.impurityStats().count()
        f, t = split.featureIndex(), split.threshold()
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        left, right = node.leftChild(), node.rightChild()
        visit(left, path | {f: (low, min(high, t), share * left.impurityStats().count() / rows)})
        visit(right, path | {f: (max(low, t), high, share * right.impurityStats().count() / rows)})

    visit(root, {})
    return found


def shapley_values(leaves: list[Leaf], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact contributions of each feature to the summed leaf values of every row, and the
    value expected without any feature."""
    return ShapleyTables(leaves, [leaf.shapley() for leaf in leaves], x.shape[1]).values(x)


def attribute_scores(trained: ResponseModel, features: DataFrame) -> DataFrame:
    """Shapley value of each feature for the log-odds of every row, along the trees' paths.

    ``base_value`` plus the contributions is ``raw_score``, the model's log-odds.  The
    trees are a few thousand numbers, whose tables are built once and sent to all tasks; rows
    stream through in Arrow batches.  ``method`` tells the values from those of
    ``importance_attributions``.
    """
    model = trained.model
    # The classifier's log-odds are twice its margin.
    leaves = [
        leaf
        for t, w in zip(model.trees, model.treeWeights)
        for leaf in tree_leaves(t._call_java("rootNode"), 2.0 * w)
    ]
    names = list(RESPONSE_FEATURES)
    tables = ShapleyTables(leaves, [leaf.shapley() for leaf in leaves], len(names))
    sent = features.sparkSession.sparkContext.broadcast(tables)

    def attribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
            parts, base = tables.values(x)
            found = [np.full(len(x), base), base + parts.sum(axis=1), *parts.T]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in found]],
                names=["outcome_id", "base_value", "raw_score", *[f"c_{n}" for n in names]],
            )

    schema = "outcome_id string, base_value double, raw_score double, " + ", ".join(
        f"c_{n} double" for n in names
    )
    encoded = encode_categories(features, trained.codes).select("outcome_id", *names)
    return encoded.mapInArrow(attribute, schema).withColumn("method", F.lit(V.SHAPLEY_METHOD))


def importance_attributions(features: DataFrame, importances: DataFrame) -> DataFrame:
    """The stand-in where only the global importances of a model are at hand: the same ones
    for every row, with no base value and no score."""
    held = importances.groupBy().pivot("feature", list(RESPONSE_FEATURES)).agg(F.first("importance"))
    scalars = held.agg(F.struct(*[F.first(n).alias(n) for n in RESPONSE_FEATURES])).scalar()
    none = F.lit(None).cast("double")
    return features.withColumn("_w", scalars).select(
        "outcome_id",
        none.alias("base_value"),
        none.alias("raw_score"),
        *[F.coalesce(F.col(f"_w.{n}"), F.lit(0.0)).alias(f"c_{n}") for n in RESPONSE_FEATURES],
        F.lit(V.IMPORTANCE_METHOD).alias("method"),
    )


def contribution_map(attributed: DataFrame) -> DataFrame:
    """Contributions as a map of feature to value, for ``attribution_factors``."""
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"c_{n}").alias("value"))
            for n in RESPONSE_FEATURES
        ]
    )
    return attributed.select(
        "outcome_id", "base_value", "raw_score", F.map_from_entries(entries).alias("contributions")
    )


def ranked_contributions(attributed: DataFrame) -> DataFrame:
    """Feature and value pairs of every row, the largest effect first."""
    entries = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"c_{n}"))).alias("o"),
                F.lit(n).alias("feature"),
                F.col(f"c_{n}").alias("value"),
            )
            for n in RESPONSE_FEATURES
        ]
    )
    return attributed.select(
        "outcome_id",
        F.transform(F.array_sort(entries), lambda e: e.dropFields("o")).alias("contributions"),
    )


def additive_gap(trained: ResponseModel, features: DataFrame) -> DataFrame:
    """One row: the largest gap between the attribution sums and the model's log-odds."""
    scored = trained.model.transform(trained.vectors(features)).select(
        "outcome_id", vector_to_array("rawPrediction")[1].alias("margin")
    )
    joined = attribute_scores(trained, features).join(scored, "outcome_id")
    return joined.agg(F.max(F.abs(F.col("raw_score") - 2 * F.col("margin"))).alias("gap"))


# --- cohorts ------------------------------------------------------------------------------------


def cohort_features(fact: DataFrame) -> DataFrame:
    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    return fact.select(
        "outcome_id",
        F.coalesce(F.col("age").cast("double"), F.lit(50.0)).alias("age"),
        F.coalesce("baseline_value", F.lit(0.0)).alias("baseline_value"),
        F.coalesce("change_pct", F.lit(0.0)).alias("change_pct"),
        *[
            flag(F.col(c)).alias(c)
            for c in ("has_diabetes", "has_hypertension", "has_obesity")
        ],
        flag(C.responded()).alias("responded"),
        "response_status",
    )


@dataclass
class CohortModel:
    """Scaler and clusters; ``order[i]`` is the number given to raw cluster i, ``inertia`` the
    cost of the points in the last step."""

    scaler: PipelineModel
    clusters: KMeansModel
    order: list[int]
    inertia: float = math.nan

    def scaled(self, features: DataFrame) -> DataFrame:
        return self.scaler.transform(features)

    def label(self, raw: Column) -> Column:
        return F.array(*[F.lit(i) for i in self.order])[raw]


def train_cohorts(features: DataFrame, restarts: int = RESTARTS) -> CohortModel:
    """The best of several k-means runs on standardised features.

    The runs share every pass over the points.  Clusters are numbered by response rate, then
    size, so numbers do not depend on the random start.
    """
    from pyspark.ml import Pipeline

    spark = features.sparkSession
    assembler = VectorAssembler(inputCols=list(COHORT_FEATURES), outputCol="raw_features")
    scaler = StandardScaler(
        withMean=True, withStd=True, inputCol="raw_features", outputCol="features"
    )
    scaling = Pipeline(stages=[assembler, scaler]).fit(features)
    fitted = scaling.stages[-1]
    mean, deviation = fitted.mean.toArray(), fitted.std.toArray()
    factor = np.divide(1.0, deviation, out=np.zeros(len(mean)), where=deviation != 0)
    points = clustering.Points(
        clustering.packed_points(features, COHORT_FEATURES, mean, factor), len(mean)
    )
    params = [KMeans(k=CLUSTERS, seed=SEED + i, featuresCol="features") for i in range(restarts)]
    try:
        starts = []
        for own, candidates, weights in zip(params, *points.starts([p.getSeed() for p in params], CLUSTERS)):
            if len(candidates) > CLUSTERS:
                rows = [(Vectors.dense(c), float(w)) for c, w in zip(candidates, weights) if w]
                near = settled(spark.createDataFrame(rows, ["features", "weight"]).coalesce(1))
                model = own.copy({own.weightCol: "weight"}).fit(near)
                candidates = np.array(model.clusterCenters())
            starts.append(candidates)
        centres, costs = points.settle(starts, params[0].getMaxIter(), params[0].getTol())
    finally:
        points.packed.unpersist()
    best = int(costs.argmin())
    clusters = kmeans_model(spark, params[best], centres[best])
    # One row per cluster.
    stats = (
        clusters.transform(scaling.transform(features))
        .groupBy("prediction")
        .agg(F.avg("responded").alias("rate"), F.count(F.lit(1)).alias("size"))
        .collect()
    )
    ranked = sorted(stats, key=lambda r: (round(r["rate"], 9), r["size"]))
    order = [0] * len(clusters.clusterCenters())
    for number, row in enumerate(ranked):
        order[row["prediction"]] = number
    return CohortModel(scaling, clusters, order, float(costs[best]))


def kmeans_model(spark: SparkSession, params: KMeans, centres: np.ndarray) -> KMeansModel:
    """MLlib's model of the given centres."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    vectors = jvm.org.apache.spark.mllib.linalg
    held = gateway.new_array(vectors.Vector, len(centres))
    for i, centre in enumerate(centres):
        values = gateway.new_array(jvm.double, len(centre))
        for j, value in enumerate(centre):
            values[j] = float(value)
        held[i] = vectors.DenseVector(values)
    inner = jvm.org.apache.spark.mllib.clustering.KMeansModel(held)
    model = jvm.org.apache.spark.ml.clustering.KMeansModel(params.uid, inner)
    return params._copyValues(KMeansModel(model))


def assign_cohort(
    model: CohortModel, features: DataFrame, digits: int | None = 2
) -> DataFrame:
    """Nearest cohort of every row and the similarity to its centre."""
    placed = model.clusters.transform(model.scaled(features))
    centres = F.array(
        *[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusters.clusterCenters()]
    )
    squared = F.aggregate(
        F.zip_with(
            vector_to_array("features"),
            centres[F.col("prediction")],
            lambda a, b: (a - b) * (a - b),
        ),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    label = model.label(F.col("prediction"))
    return placed.withColumns(
        {
            "cluster": label,
            "similarity_score": C.rounded(F.exp(-F.sqrt(squared) / 3.0), digits),
        }
    ).drop("features", "raw_features", "prediction")


def cohort_profiles(labelled: DataFrame, label: str = "cluster", digits: bool = True) -> DataFrame:
    """Size and means per label."""
    one, two, four = (1, 2, 4) if digits else (None, None, None)
    return labelled.groupBy(label).agg(
        F.count(F.lit(1)).alias("size"),
        C.rounded(F.avg(F.col("age").cast("double")), one).alias("avg_age"),
        C.rounded(F.avg(C.responded().cast("double")), four).alias("response_rate"),
        C.rounded(F.avg("baseline_value"), two).alias("avg_baseline"),
        C.rounded(F.avg("change_pct"), two).alias("avg_change_pct"),
    )


def named_profiles(profiles: DataFrame) -> DataFrame:
    """Cohort ids and names of numbered clusters."""
    names = F.array(*[F.lit(n) for n in V.CLUSTER_NAMES])
    return profiles.withColumns(
        {
            "cohort_id": F.format_string("C%03d", F.col("cluster") + 1),
            "name": F.try_element_at(names, F.col("cluster") + 1),
        }
    )


def clustering_quality(model: CohortModel, features: DataFrame) -> DataFrame:
    """Silhouette and inertia as (metric, value)."""
    placed = model.clusters.transform(model.scaled(features)).select("features", "prediction")
    silhouette = ClusteringEvaluator().evaluate(placed)
    return features.sparkSession.createDataFrame(
        [("silhouette", float(silhouette)), ("inertia", model.inertia)], "metric string, value double"
    )
