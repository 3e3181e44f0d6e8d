"""Gradient-boosted trees with logistic loss over binned features, in numpy: grown from sums over the examples, which may
be anywhere, and small enough to travel with every task."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

BINS = 32
QUANTILES = np.linspace(0, 1, BINS)[1:-1]
UNITS = 2.0**20  # of one in the sums over examples, which are exact up to 2**33 examples


@dataclass
class Boosted:
    """``trees``: per tree and inner node (feature, bin), children at 2i + 1 and 2i + 2, and the leaves' values."""

    edges: list[np.ndarray]
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def _leaf(self, binned: np.ndarray, features: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, features[node]] > cuts[node])
        return node - (2**self.depth - 1)

    def margin_of(self, binned: np.ndarray) -> np.ndarray:
        total = np.full(len(binned), self.base)
        for features, cuts, leaves in self.trees:
            total += leaves[self._leaf(binned, features, cuts)]
        return total

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.margin_of(self.binned(x))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class Cells:
    """Examples that share bins and label, counted: the trees see no more of them than that."""

    binned: np.ndarray
    y: np.ndarray
    n: np.ndarray
    _known: int = 0
    _margin: np.ndarray | None = None

    def sums(self, model: Boosted, features: np.ndarray, cuts: np.ndarray, level: int) -> np.ndarray:
        """Slope and curve of the loss, summed per node of a level of the tree in the making, feature and bin. They are
        whole units, so the order of additions does not show."""
        if self._margin is None:
            self._margin = np.full(len(self.y), model.base)
        for own, at, leaves in model.trees[self._known :]:
            self._margin += leaves[model._leaf(self.binned, own, at)]
        self._known = len(model.trees)
        p = 1 / (1 + np.exp(-self._margin))
        weights = [self.n * np.rint(w * UNITS) for w in (self.y - p, p * (1 - p))]
        node, rows = np.zeros(len(self.y), np.int64), np.arange(len(self.y))
        for _ in range(level):
            node = 2 * node + 1 + (self.binned[rows, features[node]] > cuts[node])
        node -= 2**level - 1
        width, count = BINS + 1, 2**level
        return np.stack([
            np.stack([np.bincount(node * width + self.binned[:, j], w, count * width).reshape(count, width) for j in range(self.binned.shape[1])], axis=1)
            for w in weights
        ])


#: (model, features, cuts, level) → what ``Cells.sums`` gives over all examples, wherever they are
Sums = Callable[[Boosted, np.ndarray, np.ndarray, int], np.ndarray]


def grow(edges: list[np.ndarray], share: float, sums: Sums, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Newton boosting, level by level, best histogram split per node, from sums over the examples only."""
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    model = Boosted(edges, float(np.log(share / (1 - share))), depth=depth)
    for _ in range(rounds):
        features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            g, h = sums(model, features, cuts, level).cumsum(axis=3) / UNITS
            gain = g**2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
            cut = gain.argmax(axis=2)
            top = np.take_along_axis(gain, cut[..., None], axis=2)[..., 0]
            j = top.argmax(axis=1)
            better = np.flatnonzero(top[np.arange(count), j] > 1e-6)
            features[first + better], cuts[first + better] = j[better], cut[better, j[better]]
        slope, curve = sums(model, features, cuts, depth)[:, :, 0].sum(axis=2) / UNITS
        model.trees.append((features, cuts, rate * slope / (curve + ridge)))
    return model


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Boosted:
    """Trees from examples in memory."""
    edges = [np.unique(np.quantile(x[:, j], QUANTILES)) for j in range(x.shape[1])]
    cells = Cells(Boosted(edges).binned(x), y, np.ones(len(y)))
    return grow(edges, y.mean(), cells.sums, rounds, depth, rate, ridge)


Block = tuple[float, float, float]  # positives, rows, lowest probability


def pooled(blocks: Iterable[Block]) -> list[Block]:
    """Blocks by rising probability, pooled until their shares of positives rise, too (isotonic). Pooling parts of them
    first changes nothing; n rows leave n to the power of 2/3 blocks at most, as their shares differ."""
    kept: list[Block] = []
    for positives, rows, low in blocks:
        while kept and kept[-1][0] * rows >= positives * kept[-1][1]:
            before, n, low = kept.pop()
            positives, rows = positives + before, rows + n
        kept.append((positives, rows, low))
    return kept


def threshold_of(blocks: Iterable[Block], precision: float) -> float:
    """``least_threshold`` from blocks by rising probability."""
    good = [low for positives, rows, low in pooled(blocks) if positives + 1 >= precision * (rows + 1) and positives >= precision * rows]
    return min(good, default=1.1)


def least_threshold(probability: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the calibrated (isotonic) share of positives stays at ``precision`` or
    more; above 1 if there is none. Rows of equal probability stand or fall together."""
    p, place = np.unique(probability, return_inverse=True)
    rows, positives = np.bincount(place, minlength=len(p)), np.bincount(place, y, minlength=len(p))
    return threshold_of(zip(positives.tolist(), rows.tolist(), p.tolist()), precision)
