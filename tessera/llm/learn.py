"""Small models, trained in numpy on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on at most, and bytes of their texts; the rows with the smallest hashes of doc_id.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, keep_fold: bool, limit: int = SAMPLE, most: int = SAMPLE_BYTES) -> DataFrame:
    """(text, y, part) of a bounded sample of labelled documents outside the held-out fold; part is 0 to 99 by hash.

    The fold is crc32 of doc_id as text, modulo `folds`; keep_fold says whether `fold` itself is the held-out one (True)
    or not. Rows with a null doc_id or label are left out; of repeated labels the largest counts. The sample has up to
    `limit` doc_ids and ends before the texts exceed `most` bytes, so a model's memory is bounded whatever texts are like.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where((remainder != fold) if keep_fold else (remainder == fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    few = F.broadcast(known.select("doc_id", "y", "h"))  # at most `limit` rows
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).join(few, "doc_id")
    sizes = rows.groupBy("h").agg(F.sum(F.octet_length("text")).alias("n"))
    within = F.sum("n").over(Window.orderBy("h"))  # at most `limit` rows
    sizes = F.broadcast(sizes.withColumn("n", within).where(F.col("n") <= most).select("h"))
    return rows.join(sizes, "h").select("text", "y", F.pmod("h", F.lit(100)).cast("int").alias("part"))


class Trees:
    """Gradient-boosted trees for log loss, on histograms of quantile bins; levels are grown in full."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 15):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.grown = float(np.log(share / (1 - share))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                feature, cut = np.full(2**level, -1), np.zeros(2**level, np.int64)
                gain = np.full(2**level, 1e-6)
                for j in range(x.shape[1]):
                    slot = node * self.bins + binned[:, j]
                    shape = (2**level, self.bins)
                    gs, hs, ns = (np.bincount(slot, w, 2**level * self.bins).reshape(shape).cumsum(axis=1) for w in (g, h, None))
                    score = lambda a, b: a * a / (b + self.ridge)
                    better = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                    better[(ns < self.least) | (ns[:, -1:] - ns < self.least)] = 0
                    at = better.argmax(axis=1)
                    top = better[np.arange(2**level), at]
                    won = top > gain
                    feature[won], cut[won], gain[won] = j, at[won], top[won]
                splits.append((feature, cut))
                node = node * 2 + self._right(binned, node, feature, cut)
            n = 2**self.depth
            value = -self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.ridge)
            self.grown.append((splits, value))
            raw += value[node]
        return self

    def _binned(self, x):
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)

    @staticmethod
    def _right(binned, node, feature, cut):
        f = feature[node]
        return ((f >= 0) & (binned[np.arange(len(node)), np.maximum(f, 0)] > cut[node])).astype(np.int64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        for splits, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, cut in splits:
                node = node * 2 + self._right(binned, node, feature, cut)
            out += value[node]
        return out


class Isotonic:
    """Least-squares increasing fit by pooling adjacent violators; between the pools it is linear."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        pools: list[list[float]] = []  # total of y, rows, total of x
        values, inverse = np.unique(x, return_inverse=True)
        sums, counts = np.bincount(inverse, y, len(values)), np.bincount(inverse, minlength=len(values))
        for v, s, n in zip(values, sums, counts, strict=True):
            pools.append([s, n, v * n])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        # one row of each class stands in every pool's place, so that no score is quite 0 or 1
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([(p[0] + 0.01) / (p[1] + 0.02) for p in pools])
        self.y = np.maximum.accumulate(self.y)
        return self

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def dual_descent(rows: list[np.ndarray], weights: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Weights of a linear hinge-loss model (L2 penalty, cost by row) by dual coordinate descent.

    Row i has the features rows[i], each with the value weights[feature]. y is -1 or 1. The last feature is the bias.
    """
    w = np.zeros(len(weights))
    values = [weights[r] for r in rows]
    diagonal = np.array([float(v @ v) for v in values])
    alpha, order = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if not diagonal[i]:
                continue
            g = y[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g / diagonal[i], 0.0), cost[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                moved = max(moved, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a * margin + b))) by Newton's steps, halved until the loss falls."""
    scale = float(np.abs(margin).mean()) or 1.0
    m = margin / scale
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(w):
        z = w[0] * m + w[1]
        return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * w[0] ** 2)

    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] * m + w[1], -30, 30)))
        g = np.array([((p - target) * m).sum() + 1e-3 * w[0], (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        step, least = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > least and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])
