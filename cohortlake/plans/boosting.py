"""Gradient-boosted trees on counted cells of binned features.

A tree sees a row only through the bins of its features (32 at most), so rows that share
all bins and the label are one cell and a count: never more cells than rows, and far fewer
where features have few bins.  Of a cell's rows a tree draws a binomial number, which is
what drawing each row comes to.  Loss, candidate splits, impurity, column sample and the
fitted model are those of ``GBTClassifier``; only its random draws are others, and they
depend on the rows alone, not on how they are laid out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.plans.cells import Cells, Tree, split_candidates

# Cells that one task holds, about, and trees after which the margins are worked out again
# from all trees, so that a lost executor costs no more than these.
CELLS_PER_TASK, TREES_PER_RESTART = 262_144, 10


# --- cells -------------------------------------------------------------------------------


def sampled_splits(data: DataFrame, features: Sequence[str], key: str, bins: int, seed: int) -> list[np.ndarray]:
    """Candidate splits of every feature, from about as many rows as MLlib samples for them."""
    wanted, n = max(bins * bins, 10_000), data.count()
    if n > wanted:
        drawn = F.pmod(F.xxhash64(F.lit(seed), key, *features[:2]), F.lit(1 << 30))
        data = data.where(drawn < math.ceil(wanted / n * (1 << 30)))
    rows = data.select(*features).toPandas()
    return [split_candidates(rows[f].to_numpy(float), bins) for f in features]


def counted_cells(data: DataFrame, features: Sequence[str], label: str, splits: list[np.ndarray]) -> DataFrame:
    """(cell, rows, positive): the bins of all features as one number, with their rows."""
    names, sizes = [*features, label], [len(s) + 1 for s in splits]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for i, (ends, size) in enumerate(zip(splits, sizes)):
                cell = cell * size + np.searchsorted(ends, batch.column(i).to_numpy(zero_copy_only=False))
            y = batch.column(len(sizes)).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError(f"{label} must be 0 or 1")
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(y.astype(np.int64))], names=["cell", "positive"])

    rows = data.select(*[F.col(c).cast("double") for c in names]).mapInArrow(binned, "cell long, positive long")
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("positive").alias("positive"))


def cell_chunks(cells: DataFrame, sizes: Sequence[int]) -> RDD:
    """Chunks of cells, the same ones however the cells were laid out."""
    n = cells.count()

    def packed(part: int, batches: Iterator[bytes]) -> Iterator[Cells]:
        held = [np.frombuffer(b, np.int64).reshape(3, -1) for b in batches]
        if held:
            cell, rows, positive = (both := np.concatenate(held, axis=1))[:, np.argsort(both[0])]
            yield Cells(np.array(np.unravel_index(cell, sizes), np.uint8), (rows - positive, positive))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([columns.tobytes()], pa.binary())], names=["chunk"])

    dealt = cells.repartition(max(1, math.ceil(n / CELLS_PER_TASK)), "cell")
    chunks = dealt.mapInArrow(flat, "chunk binary").rdd.map(lambda r: bytes(r.chunk))
    return chunks.mapPartitionsWithIndex(packed)


# --- trees -------------------------------------------------------------------------------


# --- trees -------------------------------------------------------------------------------


def boosted_trees(chunks: RDD, sizes: Sequence[int], params: GBTClassifier) -> list[Tree]:
    """Trees one after the other; a level of a tree is one pass over the cells."""
    count, depth, step, share = params.getMaxIter(), params.getMaxDepth(), params.getStepSize(), params.getSubsamplingRate()
    seed, width = params.getSeed(), max(sizes)
    columns = math.ceil(float(params.getFeatureSubsetStrategy()) * len(sizes))
    weights = [1.0] + [step] * (count - 1)
    spark_context, trees, state, older = chunks.context, [], chunks, None
    for t in range(count):
        restart = t % TREES_PER_RESTART == 0
        added = spark_context.broadcast([*zip(trees, weights)] if restart else [(trees[-1], weights[t - 1])])
        state = (chunks if restart else state).mapPartitionsWithIndex(
            lambda part, it, added=added, t=t: (c.drawn(added.value, t == 0, share, [seed, t, part]) for c in it),
            preservesPartitioning=True,
        )
        state.persist(StorageLevel.MEMORY_AND_DISK)
        tree, rng, opened = Tree(depth), np.random.default_rng([seed, t]), [0]
        for level in range(depth):
            sent = spark_context.broadcast(tree)
            sums = state.map(lambda c, sent=sent, level=level: c.sums(sent.value, level, width)).fold(0.0, np.add)
            sent.unpersist()
            if level == 0:
                if older is not None:
                    older.unpersist()
                if np.ndim(sums) == 0:
                    raise ValueError("no rows to train on")
                tree.note(0, sums[0, 0].sum(axis=0))
            opened = [
                child
                for node in opened
                for child in tree.grow(node, sums[node - (1 << level) + 1], np.sort(rng.permutation(len(sizes))[:columns]))
            ]
            if not opened:
                break
        trees.append(tree)
        older = state
    if older is not None:
        older.unpersist()
    return trees


def java_node(spark: SparkSession, tree: Tree, splits: list[np.ndarray], node: int = 0):
    """The node and all below it as MLlib has them."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    trees = jvm.org.apache.spark.ml.tree
    rows, total, square = (float(x) for x in tree.stats[node])
    stats = gateway.new_array(jvm.double, 3)
    stats[0], stats[1], stats[2] = rows, total, square
    held = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(stats, round(rows))
    impurity = (square - total * total / rows) / rows if rows else 0.0
    value = float(tree.value[node])
    if not tree.split[node]:
        return trees.LeafNode(value, impurity, held)
    f = int(tree.feature[node])
    split = trees.ContinuousSplit(f, float(splits[f][tree.bin[node]]))
    below = [java_node(spark, tree, splits, 2 * node + i) for i in (1, 2)]
    return trees.InternalNode(value, impurity, float(tree.gain[node]), *below, split, held)


def fit(data: DataFrame, features: Sequence[str], params: GBTClassifier, key: str = "outcome_id") -> GBTClassificationModel:
    """The model of ``params`` fitted to number columns and a label of 0 or 1."""
    spark, bins = data.sparkSession, params.getMaxBins()
    splits = sampled_splits(data, features, key, bins, params.getSeed())
    sizes = [len(s) + 1 for s in splits]
    cells = counted_cells(data, features, params.getLabelCol(), splits).persist(StorageLevel.MEMORY_AND_DISK)
    chunks = cell_chunks(cells, sizes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = boosted_trees(chunks, sizes, params)
    finally:
        chunks.unpersist()
        cells.unpersist()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    found, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i, tree in enumerate(trees):
        found[i] = kind(java_node(spark, tree, splits), len(sizes))
        weights[i] = params.getStepSize() if i else 1.0
    model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(params.uid, found, weights, len(sizes), 2)
    return params._copyValues(GBTClassificationModel(model))
