from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake.operators import skew


def hot_rows(n=3000, seed=7):
    """A third of the rows under one key, many equal values, some nulls."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        value = rng.choice([None, -1.5, 0.0, 3.25, rng.uniform(-1e6, 1e6), rng.gauss(0, 1)])
        rows.append((key, value, rng.randrange(1, 4)))
    return rows


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_quantile_per_key(spark, q):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v double, w int")
    got = {r.k: r.q for r in skew.exact_quantile(df, ["k"], "v", q, "q").collect()}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key and r[1] is not None]
        assert got[key] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_exact_quantile_without_keys_and_with_weights(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, v double, w int")
    plain = [r[1] for r in rows if r[1] is not None]
    repeated = [r[1] for r in rows if r[1] is not None for _ in range(r[2])]
    assert skew.exact_quantile(df, [], "v", 0.5, "q").first().q == pytest.approx(np.median(plain))
    weighted = skew.exact_quantile(df, [], "v", 0.5, "q", weight="w").first().q
    assert weighted == pytest.approx(np.median(repeated))


def test_exact_quantile_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    assert skew.exact_quantile(df, ["k"], "v", 0.5, "q").count() == 0


def test_sparse_unique_ids(spark):
    ids = [i * 1_000_000 for i in range(20)] + [7]
    df = spark.createDataFrame([(i, f"x{i}") for i in ids], "id long, t string")
    for rows in (65_536, 4, 1):
        numbered = skew.sequence_numbers(df, "n", ["id"], unique=True, rows=rows)
        assert numbered.columns == ["id", "t", "n"]
        assert [(r.n, r.id) for r in numbered.orderBy("n").collect()] == list(enumerate(sorted(ids), 1))
    grouped = df.withColumn("g", df.id % 3)
    numbered = skew.sequence_numbers(grouped, "n", ["id"], ["g"], unique=True, rows=5)
    for g in range(3):
        own = sorted(i for i in ids if i % 3 == g)
        assert {r.id: r.n for r in numbered.where(f"g = {g}").collect()} == {x: i + 1 for i, x in enumerate(own)}


@pytest.mark.parametrize("kind", ["one far id", "powers", "one day"])
def test_ranges_are_about_equally_long(spark, kind):
    """Neither a far id nor ids of every scale nor a day with all rows crowd a range."""
    far = F.when(F.col("id") == 0, F.lit(10**17)).otherwise(F.col("id"))
    value = {"one far id": far, "powers": F.pow(F.lit(1.0005), F.col("id")), "one day": F.md5(F.col("id").cast("string"))}
    df = spark.range(40_000).repartition(4).select(value[kind].alias("v"))
    placed = skew._in_ranges(df, ["v"], 12_000)
    sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 10_000
    order = [r.v for r in placed.orderBy("_range", "_place").collect()]
    assert order == sorted(order)


def test_nothing_to_number(spark):
    df = spark.createDataFrame([], "g string, id long")
    for unique in (True, False):
        assert skew.sequence_numbers(df, "n", ["id"], ["g"], unique=unique).collect() == []


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 1.0])
def test_exact_quantile_equals_percentile(spark, q):
    inf, nan = float("inf"), float("nan")
    groups = {
        "nan": [1.0, 2.0, nan],
        "ends": [-inf, 1.0, 2.0, inf, inf],
        "tiny": [i * 1e-9 for i in range(2000)],
        "near": [6 + i * 1e-4 for i in range(3000)],
        "huge": [-1.7e308, 1.7e308, 5.0, 0.0],
        "same": [3.0] * 50,
        "lows": [-inf] * 3 + [nan] * 2,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in skew.exact_quantile(df, ["k"], "v", q, "q").collect()}
    df.createOrReplaceTempView("quantile_rows")
    want = {r.k: r.p for r in spark.sql(f"SELECT k, percentile(v, {q}) AS p FROM quantile_rows GROUP BY k").collect()}
    for k in groups:
        assert got[k] == pytest.approx(want[k], rel=1e-12, nan_ok=True), k
    bare = skew.exact_quantile(df.where("k = 'near'"), [], "v", q, "q").first().q
    assert bare == pytest.approx(want["near"], rel=1e-12)
    assert skew.exact_quantile(df.where("false"), [], "v", q, "q").first().q is None


@pytest.mark.parametrize("rows", [50, 400])
def test_exact_quantile_by_ranges(spark, rows):
    """Values of two far scales, in many ranges, some of which hold the ends of several keys."""
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.choice([rng.random(), 1e9 * rng.random(), 1e17, -1e300])) for i in range(4000)]
    df = spark.createDataFrame(data, "k string, v double")
    for q in (0.1, 0.5, 0.9):
        got = {r.k: r.q for r in skew.exact_quantile(df, ["k"], "v", q, "q", rows=rows).collect()}
        for key in got:
            assert got[key] == pytest.approx(np.quantile([v for k, v in data if k == key], q), rel=1e-9), (key, q)
    counts = df.groupBy("k", "v").count()
    sizes = [r["count"] for r in skew._in_ranges(counts, ["k", "v"], 800).groupBy("_range").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_null_key_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r.k: r.q for r in skew.exact_quantile(df, ["k"], "v", 0.5, "q").collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_sequence_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", i) for i in rng.sample(range(100_000), 2000)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(7)
    numbered = skew.sequence_numbers(df, "n", order=["id"], groups=["g"], start=1001, rows=500)
    got = {(r.g, r.id): r.n for r in numbered.collect()}
    for group in {g for g, _ in rows}:
        ids = sorted(i for g, i in rows if g == group)
        assert [got[group, i] for i in ids] == list(range(1001, 1001 + len(ids)))


def test_sequence_numbers_without_groups(spark):
    df = spark.range(500).repartition(5)
    numbered = skew.sequence_numbers(df, "n", order=[F.col("id") * 2], rows=100)
    assert all(r.n == r.id + 1 for r in numbered.collect())


def test_copies_get_numbers_of_their_own(spark):
    rows = [("g", 1)] * 700 + [("g", 2)] * 3 + [("g", 5)] + [("h", 1)] * 2
    df = spark.createDataFrame(rows, "g string, id long").repartition(3)
    placed = []
    in_ranges = skew._in_ranges

    def watched(*args):
        placed.append(in_ranges(*args))
        return placed[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(skew, "_in_ranges", watched)
        numbered = skew.sequence_numbers(df, "n", order=["id"], groups=["g"], piece=10, rows=20).collect()
    assert sorted((r.g, r.n, r.id) for r in numbered) == [
        *[("g", n, i) for n, i in enumerate(sorted(i for g, i in rows if g == "g"), 1)], ("h", 1, 1), ("h", 2, 1)
    ]
    # The 700 copies lie in several ranges.
    assert placed[0].where("id = 1").select("_range").distinct().count() > 1


def test_contains_join_equals_brute_force(spark):
    texts = ["Type 2 Diabetes", "diabetes", "Renal", "x", "", "Chronic Kidney Disease", "ab"]
    parts = ["diab", "KIDNEY", "x", "al", "zzz", "type 2 diabetes mellitus", "e"]
    left = spark.createDataFrame([(t,) for t in texts], "t string")
    right = spark.createDataFrame([(p,) for p in parts], "p string")
    got = {(r.t, r.p) for r in skew.contains_join(left, "t", right, "p").collect()}
    assert got == {(t, p) for t in texts for p in parts if p.lower() in t.lower()}


def test_contains_join_has_no_cross_join(spark):
    left = spark.createDataFrame([("abc",)], "t string")
    right = spark.createDataFrame([("b",)], "p string")
    plan = skew.contains_join(left, "t", right, "p")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_order_columns_are_not_kept(spark):
    """What only the order needed is neither written to the shared folder nor read again."""
    df = spark.range(50).select("id", (F.col("id") % 3).alias("g"))
    placed, in_ranges = [], skew._in_ranges
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(skew, "_in_ranges", lambda *args: placed.append(in_ranges(*args)) or placed[-1])
        numbered = [skew.sequence_numbers(df, "n", [F.md5(F.lit("x")), -F.col("id")], ["g"], unique=u) for u in (True, False)]
    for frame, result in zip(placed, numbered):
        assert not [c for c in frame.columns if c.startswith("_o")]
        assert {r.id: r.n for r in result.collect()} == {i: len(range(i, 50, 3)) for i in range(50)}
