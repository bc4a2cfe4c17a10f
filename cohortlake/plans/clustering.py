"""K-means of several restarts at once: every pass over the points serves all of them.

Starts (``k-means||``), steps and convergence are those of MLlib's ``KMeans``, which reads and
caches its points anew for each fit; here they are packed once as plain arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

# Points worked on at a time, and the rounds of sampling at the start.
BLOCK, START_STEPS = 1024, 2


def packed_points(df: DataFrame, columns: Sequence[str], mean: np.ndarray, factor: np.ndarray) -> RDD:
    """The columns as standardised points, an array of plain numbers for each Arrow batch, kept."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([((x - mean) * factor).tobytes()], pa.binary())], names=["x"])

    packed = df.select(*columns).mapInArrow(pack, "x binary").rdd.map(lambda r: bytes(r.x))
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (restart, centre, point); absent centres (NaN) are infinitely far."""
    flat = centres.reshape(-1, centres.shape[-1])
    norms = np.einsum("ij,ij->i", flat, flat)
    found = np.nan_to_num(flat) @ (-2.0 * x.T) + np.einsum("ij,ij->i", x, x) + np.where(np.isnan(norms), np.inf, norms)[:, None]
    return np.maximum(found, 0.0, out=found).reshape(*centres.shape[:2], len(x))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of and squared distance to the nearest centre, by (restart, point)."""
    far = squared(x, centres)
    best, at = far[:, 0].copy(), np.zeros((len(far), len(x)), np.int32)
    for j in range(1, far.shape[1]):
        np.copyto(at, j, where=far[:, j] < best)
        np.minimum(best, far[:, j], out=best)
    return at, best


def step_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """By restart and centre: the sum of the points, their number and their cost."""
    restarts, k, width = centres.shape
    at, cost = nearest(x, centres)
    own = (at[:, None, :] == np.arange(k)[None, :, None]).astype(float)
    out = np.empty((restarts, k, width + 2))
    out[:, :, :width] = (own.reshape(restarts * k, -1) @ x).reshape(restarts, k, width)
    out[:, :, width] = own.sum(axis=2)
    out[:, :, width + 1] = np.einsum("rkn,rn->rk", own, cost)
    return out


def stacked(candidates: Sequence[np.ndarray]) -> np.ndarray:
    """Lists of centres as one array, absent ones NaN."""
    most = max(len(c) for c in candidates)
    return np.stack([np.pad(c, ((0, most - len(c)), (0, 0)), constant_values=np.nan) for c in candidates])


class Points:
    """Packed points and the passes over them."""

    def __init__(self, packed: RDD, width: int):
        self.packed, self.width = packed, width

    def each(self, work: Callable, centres: np.ndarray | None = None) -> RDD:
        """``work(block, centres, random)`` for every block of points."""
        width, sent = self.width, self.packed.context.broadcast(centres)

        def run(part: int, chunks: Iterator[bytes]) -> Iterator:
            for n, chunk in enumerate(chunks):
                x = np.frombuffer(chunk).reshape(-1, width)
                for i in range(0, len(x), BLOCK):
                    yield work(x[i : i + BLOCK], sent.value, [part, n, i])

        return self.packed.mapPartitionsWithIndex(run)

    def total(self, work: Callable, centres: np.ndarray | None = None):
        def added(found: Iterator) -> Iterator:
            out = None
            for one in found:
                out = one if out is None else out + one
            if out is not None:
                yield out

        return sum(self.each(work, centres).mapPartitions(added).collect())

    def starts(self, seeds: Sequence[int], k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Candidate centres of every restart and the number of points nearest to each."""
        n = self.total(lambda x, _, __: len(x))
        if not n:
            raise ValueError("no rows to cluster")

        def first(x, _, place):
            # The least of uniform draws is a uniform choice.
            found = []
            for seed in seeds:
                drawn = np.random.default_rng([seed, *place]).random(len(x))
                found.append((drawn.min(), x[drawn.argmin()].copy()))
            return found

        ones = self.each(first).reduce(lambda a, b: [min(u, v, key=lambda z: z[0]) for u, v in zip(a, b)])
        candidates = [x[None, :] for _, x in ones]
        for step in range(START_STEPS):
            so_far = stacked(candidates)
            costs = self.total(lambda x, c, _: nearest(x, c)[1].sum(axis=1), so_far)

            def chosen(x, c, place, costs=costs, step=step):
                far = nearest(x, c)[1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    chance = np.nan_to_num(2.0 * k * far / costs[:, None])
                return [
                    x[np.random.default_rng([seed, step + 1, *place]).random(len(x)) < p] for seed, p in zip(seeds, chance)
                ]

            found = self.each(chosen, so_far).collect()
            candidates = [
                np.unique(np.concatenate([own, *[block[r] for block in found]]), axis=0) for r, own in enumerate(candidates)
            ]

        def counts(x, c, _):
            at, _ = nearest(x, c)
            return np.stack([np.bincount(a, minlength=c.shape[1]) for a in at])

        weights = self.total(counts, stacked(candidates))
        return candidates, [w[: len(c)] for w, c in zip(weights, candidates)]

    def settle(self, starts: Sequence[np.ndarray], steps: int, tolerance: float) -> tuple[list[np.ndarray], np.ndarray]:
        """Centres and costs of every restart; a cost is that of the last step, as MLlib has it."""
        centres, costs = [c.copy() for c in starts], np.full(len(starts), np.inf)
        moving = list(range(len(starts)))
        for _ in range(steps):
            if not moving:
                break
            sums = self.total(lambda x, c, _: step_sums(x, c), stacked([centres[r] for r in moving]))
            still = []
            for r, found in zip(moving, sums):
                found = found[: len(centres[r])]
                rows = found[:, self.width]
                held = rows > 0
                moved = centres[r].copy()
                moved[held] = found[held, : self.width] / rows[held, None]
                if (np.square(moved - centres[r]).sum(axis=1) > tolerance**2).any():
                    still.append(r)
                centres[r], costs[r] = moved, found[:, self.width + 1].sum()
            moving = still
        return centres, costs

