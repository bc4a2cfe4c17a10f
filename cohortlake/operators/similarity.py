"""Similar patients and their cohort's treatment results."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions import columns as C
from cohortlake.functions import values as V
from cohortlake.operators.analytics import percent
from cohortlake.operators.records import restrict_to
from cohortlake.operators.skew import exact_quantile
from cohortlake.session import settled

FEATURES = (
    "age", "hba1c", "bmi", "medication_count", "has_diabetes", "has_hypertension", "has_obesity",
)

# Points of a cell on the finest level, about.
CELL_POINTS = 8
# Tasks over which the sets of a common condition are dealt out.
SALTS = 8


def patient_features(
    patients: DataFrame,
    medications: DataFrame,
    outcomes: DataFrame | None = None,
    impute: str = "mean",
) -> DataFrame:
    """Seven numeric features and the lower-case condition list of every patient.

    HbA1c comes from the patient row, else from the first HbA1c baseline.  A missing
    lab value is the mean over patients, or zero with ``impute="zero"``.
    """
    drugs = medications.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_drugs"))
    joined = patients.join(drugs, "patient_id", "left")
    has_lab = "hba1c" in patients.columns
    lab = F.col("hba1c").cast("double") if has_lab else F.lit(None).cast("double")
    if outcomes is not None:
        first = (
            outcomes.where(F.col("outcome_type") == "HbA1c")
            .groupBy("patient_id")
            .agg(
                F.min_by("baseline_value", F.struct("measurement_date", "outcome_id")).alias(
                    "_first"
                )
            )
        )
        joined = joined.join(first, "patient_id", "left")
        lab = F.coalesce(lab, F.col("_first"))
    bmi = F.col("bmi").cast("double") if "bmi" in patients.columns else F.lit(None).cast("double")
    listed = F.transform(C.parse_list("conditions"), F.lower)
    base = joined.select(
        "patient_id",
        F.coalesce(F.col("age").cast("double"), F.lit(50.0)).alias("age"),
        F.initcap("gender").alias("gender"),
        listed.alias("condition_list"),
        lab.alias("hba1c"),
        bmi.alias("bmi"),
        F.coalesce("_drugs", F.size(listed)).cast("double").alias("medication_count"),
        *[c.cast("double").alias(n) for n, c in C.condition_flags("conditions", True).items()],
    )
    if impute == "zero":
        return base.fillna(0.0, ["hba1c", "bmi"])
    means = patients if outcomes is None else base
    available = [c for c in ("hba1c", "bmi") if c in means.columns]
    scalars = means.agg(F.struct(*[F.avg(c).alias(c) for c in available]).alias("m")) if available else None
    filled = {
        c: F.coalesce(c, scalars.scalar()[c] if c in available else F.lit(None), F.lit(0.0))
        for c in ("hba1c", "bmi")
    }
    return base.withColumns(filled)


def min_max_scale(features: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Features scaled to 0..1 over the whole frame; a constant feature becomes 0."""
    ranges = features.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns],
            *[F.max(c).alias(f"hi_{c}") for c in columns],
        ).alias("r")
    )
    held = features.withColumn("_r", ranges.scalar())

    def scaled(c: str) -> Column:
        low, high = F.col(f"_r.lo_{c}"), F.col(f"_r.hi_{c}")
        return F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))

    return held.withColumns({f"s_{c}": scaled(c) for c in columns}).drop("_r")


def _distance(target: Column, columns: tuple[str, ...]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.pow(F.col(f"s_{c}") - target[f"s_{c}"], F.lit(2.0))
    return F.sqrt(total)


def similarity_score(distance: Column, dimensions: int, digits: int | None = 3) -> Column:
    return C.rounded(F.greatest(F.lit(0.0), 1 - distance / math.sqrt(dimensions)), digits)


def neighbour_count(k: int) -> int:
    return max(3 * k, 30)


def similar_patients(
    features: DataFrame, patient_id: str, k: int = 10, digits: int | None = 3
) -> DataFrame:
    """Nearest patients of one patient, itself included, nearest first.

    The query patient is one scalar; candidates are one pass with a top-n that keeps
    n rows per task.
    """
    scaled = min_max_scale(features)
    names = [f"s_{c}" for c in FEATURES]
    target = scaled.where(F.col("patient_id") == patient_id).select(F.struct(*names)).scalar()
    nearest = (
        scaled.withColumn("_t", target)
        .withColumn("distance", _distance(F.col("_t"), FEATURES))
        .orderBy("distance", "patient_id")
        .limit(neighbour_count(k))
    )
    return nearest.select(
        "patient_id", "age", "gender", "condition_list", "distance",
        similarity_score(F.col("distance"), len(FEATURES), digits).alias("similarity_score"),
    )


def knn_top_k(pairs: DataFrame, query: str, k: int, key: str = "patient_id") -> DataFrame:
    """The k nearest candidates of every query; each task keeps k rows a query.

    Distances that agree to nine decimals are equal: the last bits of a sum depend on its order.
    """
    window = Window.partitionBy(query).orderBy(F.round("distance", 9), key)
    return pairs.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def feature_cells(points: DataFrame, columns: Sequence[str], bits: int) -> DataFrame:
    """``points`` with ``_cell``: for each column the number of cut points that lie below the
    value, in ``bits`` bits.  The cut points are approximate quantiles, so outliers do not
    thin out the cells; the first bits of all columns name a coarser cell."""
    parts = 1 << bits
    cuts = points.agg(
        F.struct(
            *[F.percentile_approx(c, [i / parts for i in range(1, parts)], 20 * parts).alias(c) for c in columns]
        ).alias("cuts")
    )
    held = points.withColumn("_cuts", cuts.scalar())

    def number(c: str) -> Column:
        return F.size(F.filter(F.col("_cuts")[c], lambda cut: cut < F.col(c)))

    return held.withColumn("_cell", F.array(*map(number, columns))).drop("_cuts")


def _coarser(bits: int) -> Column:
    """The name of the cell of the first levels, ``bits`` bits finer cells are left out."""
    return F.transform("_cell", lambda n: F.shiftright(n, bits))


def _box_distance(target: Column, columns: Sequence[str], farthest: bool) -> Column:
    """The distance of a point to the nearest or farthest place of a box."""
    total = F.lit(0.0)
    for c in columns:
        below, above = F.col(f"lo_{c}") - target[c], target[c] - F.col(f"hi_{c}")
        if farthest:
            apart = F.greatest(F.abs(below), F.abs(above))
        else:
            apart = F.greatest(below, above, F.lit(0.0))
        total = total + apart * apart
    return F.sqrt(total)


def cell_levels(points: DataFrame, columns: Sequence[str], bits: int) -> list[DataFrame]:
    """For every level, from the coarsest: ``_parent, _node, _count`` and the least and
    greatest value of each column over the points of the cell.  Coarser cells are summed up
    from finer ones."""
    ends = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]
    sums = [F.sum("_count").alias("_count"), *ends]
    first = points.withColumns({"_count": F.lit(1), **{f"{n}_{c}": F.col(c) for c in columns for n in ("lo", "hi")}})
    cells = settled(first.groupBy("_cell").agg(*sums))
    out = []
    for left in range(bits - 1, -1, -1):
        nodes = cells.withColumns({"_parent": _coarser(left + 1), "_node": _coarser(left)})
        out.append(nodes.groupBy("_parent", "_node").agg(*sums))
    return out


def _still_near(seen: DataFrame, k: int) -> DataFrame:
    """The nodes (``query_id, _count, _near, _far``) that may hold one of a query's k nearest
    points, with ``_bound``: the farthest places of the nearest nodes that together hold k."""
    by_query = Window.partitionBy("query_id")
    nearer = by_query.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)
    enough = F.when(F.sum("_count").over(nearer) >= k, F.col("_far"))
    bound = F.coalesce(F.min("_enough").over(by_query), F.lit(float("inf")))
    held = seen.withColumn("_enough", enough).withColumn("_bound", bound).drop("_enough")
    # Distances are rounded, and neighbours that agree to nine decimals are equal.
    return held.where(F.col("_near") <= F.col("_bound") + 2e-9)


def nearest_points(
    points: DataFrame, queries: DataFrame, key: str, columns: Sequence[str], k: int, bits: int | None = None,
    about: int = CELL_POINTS,
) -> DataFrame:
    """``query_id, rank, distance`` and the columns of ``points``: the k nearest points of every query.

    ``queries`` has ``query_id`` and the same numeric ``columns``.  Cells are taken apart
    level by level for all queries at once: among the cells that are left to a query, the
    farthest places of the nearest ones that together hold k points bound the distance
    of the k-th neighbour, and cells whose nearest place is beyond go.  Only points of the
    last cells meet the query.  Of points that are equal in all columns no more than k, by
    ``key``, take part, so crowded places cost no more.  Distances that agree to nine
    decimals are equal and ordered by ``key``.
    """
    if bits is None:
        # Some four columns split the points evenly, the others only in two.
        bits = max(1, min(8, math.ceil(math.log2(max(2, points.count() / about)) / 4)))
    equal = Window.partitionBy(*columns).orderBy(key)
    kept = points.withColumn("_equal", F.row_number().over(equal)).where(F.col("_equal") <= k).drop("_equal")
    kept = settled(feature_cells(kept, columns, bits))
    target = F.struct(*columns).alias("_t")
    left = queries.select("query_id", target, F.array(*[F.lit(0) for _ in columns]).alias("_parent"))
    for nodes in cell_levels(kept, columns, bits):
        seen = left.join(nodes, "_parent").select(
            "query_id", "_t", "_node", "_count",
            _box_distance(F.col("_t"), columns, False).alias("_near"),
            _box_distance(F.col("_t"), columns, True).alias("_far"),
        )
        left = settled(_still_near(seen, k).select("query_id", "_t", F.col("_node").alias("_parent")))
    pairs = left.join(kept.withColumnRenamed("_cell", "_parent"), "_parent").drop("_parent")
    total = F.lit(0.0)
    for c in columns:
        total = total + F.pow(F.col(c) - F.col("_t")[c], F.lit(2.0))
    pairs = pairs.withColumn("distance", F.sqrt(total)).drop("_t")
    return knn_top_k(pairs, "query_id", k, key)


def similar_patients_of(
    features: DataFrame, queries: DataFrame, k: int = 10, bits: int | None = None
) -> DataFrame:
    """Nearest patients of every patient of a set (a frame of patient_id), themselves included.

    One join for all queries over cells of the scaled features, see ``nearest_points``.
    Patients that are not in ``features`` are left out; the set may name one twice.
    """
    names = [f"s_{c}" for c in FEATURES]
    scaled = settled(min_max_scale(features).select("patient_id", "age", "gender", "condition_list", *names))
    wanted = restrict_to(scaled, queries.select("patient_id")).select(F.col("patient_id").alias("query_id"), *names)
    found = nearest_points(scaled, wanted, "patient_id", names, neighbour_count(k), bits)
    return found.select(
        "query_id", "patient_id", "age", "gender", "condition_list", "distance", "rank",
        similarity_score(F.col("distance"), len(FEATURES)).alias("similarity_score"),
    )


def condition_distance(a: Column, b: Column) -> Column:
    """One minus the Jaccard similarity of two condition sets; 0.5 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.5).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def similar_patients_jaccard(
    features: DataFrame, patient_id: str, k: int = 10, digits: int | None = 3
) -> DataFrame:
    """Nearest patients by conditions, age and gender, for data without lab values."""
    target = (
        features.where(F.col("patient_id") == patient_id)
        .select(F.struct("age", "gender", "condition_list"))
        .scalar()
    )
    held = features.withColumn("_t", target)
    age = F.least(F.abs(F.col("_t.age") - F.col("age")) / 50.0, F.lit(1.0))
    gender = F.when(F.col("gender") == F.col("_t.gender"), 0.0).otherwise(0.2)
    conditions = condition_distance(F.col("_t.condition_list"), F.col("condition_list"))
    distance = 0.50 * conditions + 0.35 * age + 0.15 * gender
    return (
        held.withColumn("distance", distance)
        .orderBy("distance", "patient_id")
        .limit(neighbour_count(k))
        .select(
            "patient_id", "age", "gender", "condition_list", "distance",
            C.rounded(F.greatest(F.lit(0.0), 1.0 - F.col("distance")), digits).alias(
                "similarity_score"
            ),
        )
    )


def _profile_distance(conditions: Column, age: Column, gender: Column) -> Column:
    """From the distance of two condition sets, years between the ages, and equal gender."""
    apart = F.when(F.coalesce(gender, F.lit(False)), 0.0).otherwise(0.2)
    return 0.50 * conditions + 0.35 * F.least(age / 50.0, F.lit(1.0)) + 0.15 * apart


def _sharing_sets(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of condition sets (``_asked, _set``) that are equal or have a condition in
    common, from lists of the sets by condition.  A common condition's sets are dealt out
    over several tasks."""
    blank = F.array(F.lit(""))

    def terms(c: str) -> Column:
        return F.explode(F.when(F.size(c) == 0, blank).otherwise(F.col(c)))

    dealt = sets.select("_set", terms("_set").alias("_term")).withColumn(
        "_salt", F.pmod(F.xxhash64("_set"), F.lit(SALTS)).cast("int")
    )
    copies = asked.select("_asked", terms("_asked").alias("_term")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return copies.join(dealt, ["_term", "_salt"]).select("_asked", "_set").distinct()


def similar_patients_jaccard_of(features: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Nearest patients by conditions, age and gender of every patient of a set (a frame of
    patient_id), themselves included: ``query_id, rank, distance, similarity_score`` and the
    neighbour's columns.

    A set-similarity join.  Query patients meet the condition sets that share a condition
    with theirs; how old the patients of a set are bounds how near they can be, and sets that
    cannot hold one of the nearest go.  What is left is taken apart by gender and ten years
    of age, and only then patients meet.  Sets without a common condition are at least 0.5
    away: only queries that have not enough nearer patients look at them.  Of patients alike
    in conditions, age and gender, as many as are asked for take part, by id.
    """
    wanted = neighbour_count(k)
    people = features.select(
        "patient_id", "age", "gender", "condition_list", F.array_sort(F.array_distinct("condition_list")).alias("_set")
    )
    alike = Window.partitionBy("_set", "age", "gender").orderBy("patient_id")
    asked = restrict_to(people, queries.select("patient_id")).select(
        F.col("patient_id").alias("query_id"), F.struct("age", "gender").alias("_t"), F.col("_set").alias("_asked")
    )
    asked = settled(asked)
    kept = people.withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= wanted).drop("_n")
    kept = settled(kept.withColumn("_band", F.floor(F.col("age") / 10)))
    ends = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_count").alias("_count")]
    first = kept.withColumns({"_lo": F.col("age"), "_hi": F.col("age"), "_count": F.lit(1).cast("bigint")})
    nodes = settled(first.groupBy("_set", "gender", "_band").agg(*ends))
    sets = settled(nodes.groupBy("_set").agg(*ends))

    def placed(pairs: DataFrame, gender_known: bool) -> DataFrame:
        """Pairs of a query and a node with the least and greatest distance of its patients."""
        t = F.col("_t")
        nearest = F.greatest(F.col("_lo") - t["age"], t["age"] - F.col("_hi"), F.lit(0.0))
        farthest = F.greatest(F.abs(t["age"] - F.col("_lo")), F.abs(t["age"] - F.col("_hi")))
        same = t["gender"] == F.col("gender") if gender_known else F.lit(True)
        other = t["gender"] == F.col("gender") if gender_known else F.lit(False)
        return pairs.withColumns(
            {
                "_near": _profile_distance(F.col("_apart"), nearest, same),
                "_far": _profile_distance(F.col("_apart"), farthest, other),
            }
        )

    apart = condition_distance(F.col("_asked"), F.col("_set")).alias("_apart")
    pairs = _sharing_sets(asked.select("_asked").distinct(), sets).select("_asked", "_set", apart)
    near_sets = placed(asked.join(pairs, "_asked").join(sets, "_set"), False)
    left = settled(_still_near(near_sets, wanted).select("query_id", "_t", "_asked", "_set", "_apart", "_bound"))
    # Who is as near as patients without a common condition may be looks at all sets.
    enough = left.where(F.col("_bound") < 0.5 - 2e-9).select("query_id").distinct()
    short = settled(asked.join(enough, "query_id", "left_anti"))
    if not short.isEmpty():
        salt = F.pmod(F.xxhash64("_set"), F.lit(SALTS)).cast("int")
        copies = short.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        every = copies.join(sets.withColumn("_salt", salt), "_salt").drop("_salt").withColumn("_apart", apart)
        every = _still_near(placed(every, False), wanted).select(*left.columns)
        left = settled(left.join(enough, "query_id", "left_semi").unionByName(every))
    near_nodes = placed(left.drop("_bound").join(nodes, "_set"), True)
    left = settled(
        _still_near(near_nodes, wanted).select(
            "query_id", "_t", "_apart", "_set", F.coalesce("gender", F.lit("")).alias("_gender"), "_band"
        )
    )
    members = kept.withColumn("_gender", F.coalesce("gender", F.lit("")))
    found = left.join(members, ["_set", "_gender", "_band"])
    years = F.abs(F.col("_t.age") - F.col("age"))
    found = found.withColumn(
        "distance", _profile_distance(F.col("_apart"), years, F.col("gender") == F.col("_t.gender"))
    )
    return knn_top_k(found, "query_id", wanted).select(
        "query_id", "patient_id", "age", "gender", "condition_list", "distance", "rank",
        C.rounded(F.greatest(F.lit(0.0), 1.0 - F.col("distance")), 3).alias("similarity_score"),
    )


def cohort_treatment_outcomes(
    cohort: DataFrame,
    outcomes: DataFrame,
    medications: DataFrame,
    k: int | None = 5,
    digits: int | None = 1,
) -> DataFrame:
    """Per medication within a cohort: pairs, positive rate, exact median change.

    Outcomes and medications meet on the patient alone.  Medications are counted per
    patient, outcomes per patient and value, so the many-to-many pairs become weights.
    """
    drugs = (
        restrict_to(medications, cohort)
        .where(~C.blank("medication_name"))
        .groupBy("patient_id", "medication_name")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    results = (
        restrict_to(outcomes, cohort)
        .groupBy("patient_id", "change_pct")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(C.responded()).alias("_pos"))
    )
    pairs = drugs.join(results, "patient_id").select(
        "medication_name",
        "change_pct",
        (F.col("_m") * F.col("_n")).alias("_pairs"),
        (F.col("_m") * F.col("_pos")).alias("_positive"),
    )
    medians = exact_quantile(
        pairs, ["medication_name"], "change_pct", 0.5, "median_change_pct", weight="_pairs"
    )
    rated = pairs.groupBy("medication_name").agg(
        F.sum("_pairs").alias("patients_count"),
        percent(F.sum("_positive"), F.sum("_pairs"), digits).alias("positive_response_rate"),
    )
    ordered = (
        rated.join(medians, "medication_name", "left")
        .withColumn("median_change_pct", C.rounded(F.col("median_change_pct"), digits))
        .orderBy(F.desc("patients_count"), "medication_name")
    )
    return ordered if k is None else ordered.limit(k)


def similar_cohort_summary(
    cohort: DataFrame, outcomes: DataFrame, digits: int | None = 1
) -> DataFrame:
    """One row: size, mean age, two commonest conditions, share of weak responses."""
    counted = (
        cohort.select(F.explode("condition_list").alias("condition"))
        .groupBy("condition")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "condition")
        .limit(2)
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "condition")))
    names = F.transform(ranked, lambda c: C.title_case(c["condition"]))
    main = counted.agg(F.array_join(names, " + ").alias("main")).scalar()
    weak = (
        restrict_to(outcomes, cohort)
        .agg(
            percent(
                F.count_if(F.col("response_status").isin(*V.NON_RESPONDER)),
                F.count(F.lit(1)),
                digits,
            ).alias("weak")
        )
        .scalar()
    )
    return cohort.agg(
        F.count(F.lit(1)).alias("cohort_size"), C.rounded(F.avg("age"), digits).alias("avg_age")
    ).withColumns({"primary_condition": main, "non_response_pct": weak})
