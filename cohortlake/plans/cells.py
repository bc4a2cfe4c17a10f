"""Cells of binned features and the trees grown on them: what workers need, without MLlib."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def split_candidates(values: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between a feature's values: all, or about equally many rows apart."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2.0
    if len(between) < bins:
        return between
    stride, below = len(values) / bins, np.cumsum(counts)
    splits, target = [], stride
    for i in range(len(between)):
        # The next value would lead further away from the wanted number of rows.
        if abs(below[i] - target) < abs(below[i + 1] - target):
            splits.append(between[i])
            target += stride
    return np.array(splits)


class Cells:
    """A chunk of cells: the bin of each feature, the rows of either label, the margin."""

    def __init__(self, bins: np.ndarray, counts: tuple[np.ndarray, np.ndarray]):
        self.bins, self.counts = bins, counts
        self.margin, self.stats = np.zeros(bins.shape[1]), ()

    def places(self, tree: Tree, level: int) -> np.ndarray:
        """The node of a level that each cell comes to."""
        at, each = np.zeros(self.bins.shape[1], np.int64), np.arange(self.bins.shape[1])
        for _ in range(level):
            at = 2 * at + 1 + (self.bins[tree.feature[at], each] > tree.bin[at])
        return at

    def drawn(self, trees: Sequence[tuple[Tree, float]], first: bool, share: float, seed: list[int]) -> Cells:
        """The cells for the next tree: margins with ``trees`` added, and rows drawn anew."""
        new, rng = Cells(self.bins, self.counts), np.random.default_rng(seed)
        new.margin = self.margin + sum(w * tree.value[self.places(tree, tree.depth)] for tree, w in trees)
        stats = np.zeros((3, len(new.margin)))
        for rows, y in zip(self.counts, (-1.0, 1.0)):
            # The first tree fits the labels, the others what the gradient of the log loss asks for.
            residual = np.full(len(rows), y) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * new.margin))
            taken = rng.binomial(rows, share)
            stats += taken * np.array([np.ones(len(rows)), residual, residual**2])
        new.stats = tuple(stats)
        return new

    def sums(self, tree: Tree, level: int, width: int) -> np.ndarray:
        """Rows, sum and sum of squares by node of a level, feature and bin."""
        nodes = 1 << level
        at = (self.places(tree, level) - (nodes - 1)) * width
        out = np.zeros((nodes, len(self.bins), width, 3))
        for f, bins in enumerate(self.bins):
            place = at + bins
            for i, stat in enumerate(self.stats):
                out[:, f, :, i] = np.bincount(place, stat, nodes * width).reshape(nodes, width)
        return out


class Tree:
    """Arrays over the nodes of a complete tree; what comes to a leaf goes on to the left."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.depth = depth
        self.feature, self.bin = np.zeros(size, np.int64), np.full(size, 255)
        self.gain, self.split = np.zeros(size), np.zeros(size, bool)
        self.value, self.stats = np.zeros(size), np.zeros((size, 3))

    def note(self, node: int, stats: np.ndarray) -> None:
        value = stats[1] / stats[0] if stats[0] else 0.0
        while node < len(self.value):
            self.value[node], self.stats[node] = value, stats
            node = 2 * node + 1

    def grow(self, node: int, sums: np.ndarray, columns: np.ndarray) -> list[int]:
        """Splits a node where that gains most; gives its children, none for a leaf."""
        rows, total, _ = self.stats[node]
        for f in columns:
            left = np.cumsum(sums[f], axis=0)[:-1]
            n, s = left[:, 0], left[:, 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (s**2 / n + (total - s) ** 2 / (rows - n) - total**2 / rows) / rows
            gain = np.where((n >= 1) & (rows - n >= 1), gain, 0.0)
            if len(gain) and gain.max() > self.gain[node]:
                i = int(gain.argmax())
                self.gain[node], self.feature[node], self.bin[node] = gain[i], f, i
                best = left[i]
        if self.gain[node] <= 0:
            return []
        self.split[node] = True
        self.note(2 * node + 1, best)
        self.note(2 * node + 2, self.stats[node] - best)
        return [2 * node + 1, 2 * node + 2]
