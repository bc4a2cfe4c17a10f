"""Exact operators that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import col
from cohortlake.session import settled

# Copies of one row that one task writes out at a time.
COPIES_PER_PIECE = 10_000
# Rows of a range that is numbered by one task, about, and at the very most.
ROWS_PER_RANGE, MOST_ROWS = 65_536, 4_000_000
# A side of a join with at most so many short rows is sent to all tasks.
SMALL_ROWS = 100_000


def when_small(df: DataFrame) -> DataFrame:
    """The frame settled, and marked for broadcast if it has at most ``SMALL_ROWS`` rows.

    For joins on a key with few values: moved by such a key, most rows would meet in a few
    tasks.  With more rows the join stays as Spark plans it.
    """
    df = settled(df)
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    name: str,
    weight: str | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantile of ``value`` per key, one row per key.

    ``percentile`` merges every distinct value of a group in one task.  Here equal values
    are counted by (key, value), and the counts move once, to ranges of key and value that
    are about equally long however the values are spread.  The counts of a key's ranges
    show which ones hold the wanted ranks; only the values of those are added up one by one.
    Infinite values and NaN are ordered as by ``percentile`` (NaN last).  ``weight`` counts
    a row that many times; rows without a positive one count nothing.
    """
    keys = list(keys)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(n.alias("_n"))
        .where(F.col("_n") > 0)
    )
    placed = _in_ranges(counts, [*keys, "_v"], rows or ROWS_PER_RANGE)
    sums = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    of_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns(
        {
            "_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)),
            "_position": (F.sum("_sum").over(of_key) - 1) * F.lit(q),
        }
    )

    def holds(rank: Column, before: str, size: str) -> Column:
        return (F.col(before) <= rank) & (rank < F.col(before) + F.col(size))

    low, high = F.floor("_position"), F.ceil("_position")
    wanted = sums.where(holds(low, "_before", "_sum") | holds(high, "_before", "_sum")).drop("_sum")
    inside = _null_safe_join(placed, wanted, [*keys, "_range"])
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(in_range), F.lit(0)))
    ends = inside.groupBy(*keys).agg(
        F.max(F.when(holds(low, "_start", "_n"), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(high, "_start", "_n"), F.col("_v"))).alias("_b"),
        F.max(F.col("_position") - low).alias("_part"),
    )
    between = F.when(
        F.col("_a").eqNullSafe(F.col("_b")) | (F.col("_part") == 0), F.col("_a")
    ).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b"))
    return ends.select(*keys, between.alias(name))


def _null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _in_ranges(df: DataFrame, keys: Sequence[str], rows: int, spent: Sequence[str] = ()) -> DataFrame:
    """``df`` in ranges of the keys of about ``rows`` rows, whose ends Spark takes from a
    sample of the keys: ``_range`` and ``_place``, the row's place in it (from 0).

    Written to the shared folder, so that a lost executor does not change places, without
    the ``spent`` columns, which only the order needed.
    """
    df = df.persist()  # read three times: counted, sampled, moved
    try:
        n = df.count()
        most = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / MOST_ROWS))
        ranges = max(1, min(math.ceil(n / rows), most))
        ordered = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        # The upper bits are the range, the lower 33 count its rows.
        kept = settled(ordered.drop(*spent).withColumn("_at", F.monotonically_increasing_id()))
    finally:
        df.unpersist()
    return kept.withColumns(
        {"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_at")


def sequence_numbers(
    df: DataFrame,
    name: str,
    order: Sequence[Column | str],
    groups: Sequence[str] = (),
    start: int = 1,
    piece: int = COPIES_PER_PIECE,
    unique: bool = False,
    rows: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Gap-free numbers in ``order``, per group, without sorting a group in one task.

    Rows move once, to ranges of the order that are about equally long, whatever the values
    (see ``_in_ranges``); a range's numbers begin where the counts of the earlier ones end.

    With ``unique`` no two rows of a group are equal in ``order``.  Else equal rows are
    counted first and written out again at the end, in pieces of at most ``piece`` copies
    that may lie in several ranges, so that a row with very many copies is spread too.
    """
    groups = list(groups)
    marks = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(marks, [col(o) for o in order])))
    keys = [*groups, *marks]
    if unique:
        sized = keyed.withColumn("_size", F.lit(1).cast("long"))
    else:
        copies = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_copies"))
        pieces = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / piece).cast("int"))
        left = F.col("_copies") - F.col("_piece").cast("long") * piece
        sized = copies.withColumn("_piece", F.explode(pieces)).withColumn(
            "_size", F.least(F.lit(piece).cast("long"), left)
        ).drop("_copies")
        # Rows that differ in other columns only may stand in any order.
        keys = [*keys, *[c for c in df.columns if c not in groups], "_piece"]
    placed = _in_ranges(sized, keys, rows, marks)
    sizes = placed.groupBy("_range").agg(F.sum("_size").alias("_total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    # A row per range: the rows stay where they are.
    placed = placed.join(F.broadcast(starts), "_range")
    if not unique:
        within = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_place", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    numbered = placed.withColumn("_first", F.col("_before") + F.col("_place"))
    if groups:
        heads = when_small(numbered.groupBy(*groups).agg(F.min("_first").alias("_head")))
        numbered = _null_safe_join(numbered, heads, groups).withColumn("_first", F.col("_first") - F.col("_head"))
    first = F.col("_first") + start
    if not unique:
        first = F.explode(F.sequence(first, first + F.col("_size") - 1))
    return numbered.withColumn(name, first).select(*df.columns, name)


def contains_join(
    left: DataFrame, text: str, right: DataFrame, fragment: str, ignore_case: bool = True
) -> DataFrame:
    """Pairs whose ``text`` contains ``fragment``, as an equi-join.

    The first three characters of a fragment are one of the three-character pieces
    of any text that contains it, so those pieces are the join key and the full
    test only runs on the hits.  Meant for vocabularies of distinct strings.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    t, f = fold(F.col(text)), fold(F.col(fragment))
    starts = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    pieces = F.array_distinct(
        F.flatten(
            F.transform(
                starts, lambda i: F.array(*[F.substring(t, i, F.lit(size)) for size in (1, 2, 3)])
            )
        )
    )
    keyed_left = left.withColumn("_piece", F.explode(pieces))
    keyed_right = right.where(F.length(F.col(fragment)) > 0).withColumn(
        "_piece", F.substring(f, 1, 3)
    )
    return keyed_left.join(keyed_right, "_piece").where(t.contains(f)).drop("_piece")
