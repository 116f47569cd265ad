"""Binary gradient boosting on histograms, grown leaf by leaf, in numpy; with isotonic calibration.

A model is fitted inside one grouped-map task, so all models of all folds are fitted at the same time. FIT_ROWS bounds a task's rows.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Rows that one model is fitted on at most (documented sample by a hash of the row's key beyond that); bins of a feature.
FIT_ROWS, BINS = 500_000, 64


class Booster:
    """Additive trees on logistic loss; missing values go to a bin of their own at the low end."""

    def __init__(self, trees: int = 400, rate: float = 0.04, leaves: int = 47, least: int = 20, l2: float = 0.2):
        self.trees, self.rate, self.leaves, self.least, self.l2 = trees, rate, leaves, least, l2

    def _bin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.int64)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, 1 + np.searchsorted(edges, x[:, j], "right"))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Booster:
        self.edges = []
        for j in range(x.shape[1]):
            v = np.unique(x[~np.isnan(x[:, j]), j])
            self.edges.append((v[1:] + v[:-1]) / 2 if len(v) <= BINS - 2 else np.unique(np.quantile(v, np.linspace(0, 1, BINS - 1)[1:-1])))
        b = self._bin(x)
        self.size = x.shape[1] * BINS
        flat = b + np.arange(x.shape[1]) * BINS
        p = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.start, self.grown, self.gain = float(np.log(p / (1 - p))), [], np.zeros(x.shape[1])
        z = np.full(len(y), self.start)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-z))
            tree, value = self._tree(flat, weight * (q - y), np.maximum(weight * q * (1 - q), 1e-12))
            if len(tree) == 1:
                break
            self.grown.append(tree)
            z += value
        return self

    def _sums(self, flat: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        at = flat[rows].ravel()
        k = flat.shape[1]
        return tuple(np.bincount(at, np.repeat(v, k) if v is not None else None, self.size).reshape(k, BINS) for v in (g[rows], h[rows], None))

    def _best(self, sums: tuple[np.ndarray, ...]) -> tuple[float, int, int]:
        g, h, n = (np.cumsum(s, axis=1) for s in sums)
        tg, th, tn = g[:, -1:], h[:, -1:], n[:, -1:]
        ok = (n >= self.least) & (tn - n >= self.least)
        gain = g**2 / (h + self.l2) + (tg - g) ** 2 / (th - h + self.l2) - tg**2 / (th + self.l2)
        gain = np.where(ok, gain, -1.0)
        j, k = np.unravel_index(np.argmax(gain), gain.shape)
        return float(gain[j, k]), int(j), int(k)

    def _tree(self, flat: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray]:
        """Nodes (feature, bin, left, right) or a leaf's value; and each row's value."""
        rows = np.arange(len(g))
        sums = self._sums(flat, g, h, rows)
        nodes: list = [None]
        heap, held, n_leaves = [], {0: (rows, sums)}, 1

        def offer(i: int) -> None:
            gain, j, k = self._best(held[i][1])
            if gain > 1e-9:
                heapq.heappush(heap, (-gain, i, j, k))

        offer(0)
        while heap and n_leaves < self.leaves:
            gain, i, j, k = heapq.heappop(heap)
            rows, sums = held.pop(i)
            left = flat[rows, j] - j * BINS <= k
            a, b = rows[left], rows[~left]
            small = self._sums(flat, g, h, a if len(a) <= len(b) else b)
            large = tuple(t - s for t, s in zip(sums, small, strict=True))
            nodes[i] = (j, k, len(nodes), len(nodes) + 1)
            self.gain[j] -= gain
            for r, s in ((a, small if len(a) <= len(b) else large), (b, large if len(a) <= len(b) else small)):
                held[len(nodes)] = (r, s)
                nodes.append(None)
                offer(len(nodes) - 1)
            n_leaves += 1
        value = np.zeros(len(g))
        for i, (rows, _) in held.items():
            nodes[i] = float(-self.rate * g[rows].sum() / (h[rows].sum() + self.l2))
            value[rows] = nodes[i]
        return nodes, value

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, z = self._bin(x), np.full(len(x), self.start)
        for tree in self.grown:
            todo = [(0, np.arange(len(x)))]
            while todo:
                i, rows = todo.pop()
                if isinstance(tree[i], float):
                    z[rows] += tree[i]
                else:
                    j, k, left, right = tree[i]
                    low = b[rows, j] <= k
                    todo += [(left, rows[low]), (right, rows[~low])]
        return 1 / (1 + np.exp(-z))


class Isotonic:
    """Non-decreasing least-squares fit; between its points values are interpolated, beyond them clipped."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        self.x, at = np.unique(x, return_inverse=True)
        weight = np.bincount(at).astype(float)
        mean = np.bincount(at, y) / weight
        blocks: list[list[float]] = []
        for m, w in zip(mean, weight, strict=True):
            blocks.append([m, w, 1])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m2, w2, n2 = blocks.pop()
                m1, w1, n1 = blocks[-1]
                blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
        self.y = np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)
