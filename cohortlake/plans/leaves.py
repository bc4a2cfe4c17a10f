"""Leaves of trees and tables of their contributions: what workers need, without MLlib."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    """A leaf with the splits on its path, by feature: the interval (low, high] a row's value
    must lie in, and the share of training rows that go the path's way at those splits."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]

    def shapley(self) -> np.ndarray:
        """Contribution of each feature for every pattern of held conditions (a bit each).

        The value of a set of known features is the leaf's, times its held conditions for
        the known ones and its shares for the others; a feature's contribution is its mean
        gain over all orders.  Paths are short, so all sets are taken.
        """
        m = len(self.features)
        table = np.zeros((1 << m, m))
        for pattern in range(1 << m):
            held = [float(pattern >> j & 1) for j in range(m)]
            for i in range(m):
                others = [j for j in range(m) if j != i]
                for size in range(m):
                    weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                    for known in itertools.combinations(others, size):
                        part = math.prod(held[j] if j in known else self.share[j] for j in others)
                        table[pattern, i] += weight * part * (held[i] - self.share[i])
        return self.value * table

    def expected(self) -> float:
        return self.value * math.prod(self.share)


class ShapleyTables:
    """The contributions of leaves as tables over cells between their limits.

    Whether a row holds a leaf's conditions depends only on which limits each feature lies
    between.  Neighbouring leaves are summed up to one table as long as it has at most
    ``CELLS`` cells, so a row costs one look-up for such a group instead of one for a leaf.
    ``effects`` are the leaves' ``shapley()``, worked out once.
    """

    CELLS = 2048

    def __init__(self, leaves: list[Leaf], effects: list[np.ndarray], width: int):
        self.base, self.groups = sum((leaf.expected() for leaf in leaves), 0.0), []
        cuts = [set() for _ in range(width)]
        for leaf in leaves:
            for f, low, high in zip(leaf.features, leaf.low, leaf.high):
                cuts[f] |= {t for t in (low, high) if math.isfinite(t)}
        self.cuts = [np.array(sorted(c)) for c in cuts]
        group: list[int] = []
        limits: dict[int, set[float]] = {}
        for i, leaf in enumerate(leaves):
            if not leaf.features:
                continue
            grown = {f: set(c) for f, c in limits.items()}
            for f, low, high in zip(leaf.features, leaf.low, leaf.high):
                grown.setdefault(f, set()).update(t for t in (low, high) if math.isfinite(t))
            if group and math.prod(len(c) + 2 for c in grown.values()) > self.CELLS:
                self._add([leaves[j] for j in group], [effects[j] for j in group], limits, width)
                group = []
                own = zip(leaf.features, leaf.low, leaf.high)
                grown = {f: {t for t in (low, high) if math.isfinite(t)} for f, low, high in own}
            group, limits = [*group, i], grown
        if group:
            self._add([leaves[j] for j in group], [effects[j] for j in group], limits, width)

    def _add(self, leaves: list[Leaf], effects: list[np.ndarray], limits: dict[int, set[float]], width: int) -> None:
        ends = {f: np.array(sorted(limits[f])) for f in sorted(limits)}
        # A cell of a feature lies up to its limit, the last but one above all; the last one
        # holds values that no condition holds for (NaN).
        sizes = [len(e) + 2 for e in ends.values()]
        cells = dict(zip(ends, np.unravel_index(np.arange(math.prod(sizes)), sizes)))
        table = np.zeros((math.prod(sizes), width))
        for leaf, effect in zip(leaves, effects):
            pattern = np.zeros(len(table), np.int64)
            for j, (f, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                top, bottom = np.r_[ends[f], math.inf, -math.inf], np.r_[-math.inf, ends[f], -math.inf]
                held = (bottom >= low) & (top <= high) & (np.arange(len(top)) < len(top) - 1)
                pattern |= held[cells[f]].astype(np.int64) << j
            table[:, list(leaf.features)] += effect[pattern]
        # From the cell between all limits of a feature to its share of the place in the table.
        steps = np.r_[np.cumprod(sizes[::-1])[::-1][1:], 1].astype(np.int64)
        places = {
            f: np.r_[np.searchsorted(e, np.r_[self.cuts[f], math.inf]), len(e) + 1].astype(np.int64) * step
            for (f, e), step in zip(ends.items(), steps)
        }
        self.groups.append((places, table))

    def values(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        out = np.zeros(x.shape)
        cell = {}
        for f, cuts in enumerate(self.cuts):
            none = np.isnan(x[:, f]) | (x[:, f] == -math.inf)
            cell[f] = np.where(none, len(cuts) + 1, np.searchsorted(cuts, x[:, f]))
        for places, table in self.groups:
            out += table[sum(places[f][cell[f]] for f in places)]
        return out, self.base
