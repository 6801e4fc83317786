"""Small learners for the classifiers: boosted trees, isotonic calibration, logistic regression.

They are fitted on the driver from a bounded sample of feature rows, and are a few kilobytes each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.session import named


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class BoostedTrees:
    """Gradient boosting of trees of one depth for the logistic loss, on binned features, with Newton
    steps. Deterministic. Without both classes it predicts the share of ones."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, l2: float = 1.0, least: float = 2.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.l2, self.least, self.bins = rounds, depth, rate, l2, least, bins
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        share = (weight @ y + 0.5) / (weight.sum() + 1) if len(y) else 0.5
        self.base, self.trees = float(np.log(share / (1 - share))), []
        if len(y) < 4 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
        width, raw = self.bins + 1, np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(raw)
            g, h = weight * (p - y), weight * p * (1 - p)
            node, feature, threshold = np.zeros(len(y), np.int64), [], []
            for level in range(self.depth):
                n = 1 << level
                best, choice = np.full(n, 1e-6), [(0, np.inf, width)] * n
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    at = node * width + binned[:, f]
                    gs = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    hs = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    cut = gain[:, : len(cuts[f])].argmax(1)
                    for i in np.flatnonzero(gain[np.arange(n), cut] > best):
                        best[i], choice[i] = gain[i, cut[i]], (f, float(cuts[f][cut[i]]), int(cut[i]))
                feature += [c[0] for c in choice]
                threshold += [c[1] for c in choice]
                fs, bs = np.array([c[0] for c in choice]), np.array([c[2] for c in choice])
                node = 2 * node + (binned[np.arange(len(y)), fs[node]] > bs[node])
            n = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.l2)
            raw += leaf[node]
            self.trees.append((np.array(feature), np.array(threshold), leaf))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = 2 * node + (x[rows, feature[at]] > threshold[at])
            out += leaf[node]
        return out


class Isotonic:
    """Pool-adjacent-violators, read with linear interpolation."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, count, first score, last score
        for s, v in zip(score[order].tolist(), y[order].tolist()):
            blocks.append([v, 1, s, s])
            while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
                a = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
        # half an example of either class at each end keeps probabilities off 0 and 1
        level = [(b[0] + 0.5 * (i == len(blocks) - 1 and b[0] > 0)) / (b[1] + 0.5) if i in (0, len(blocks) - 1) else b[0] / b[1] for i, b in enumerate(blocks)]
        self.x = np.array([p for b in blocks for p in (b[2], b[3])]) if blocks else np.array([0.0])
        self.y = np.maximum.accumulate(np.array([v for v in level for _ in range(2)])) if blocks else np.array([0.5])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


class Logistic:
    """Logistic regression of few features by Newton's method."""

    def __init__(self, l2: float = 1.0):
        self.l2 = l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = np.column_stack([np.ones(len(x)), x])
        self.w = np.zeros(x.shape[1])
        penalty = np.diag([1e-3] + [self.l2] * (x.shape[1] - 1))
        for _ in range(30):
            p = sigmoid(x @ self.w)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ self.w)
            self.w -= step
            if np.abs(step).max() < 1e-8:
                break
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([np.ones(len(x)), x]) @ self.w)


def held_out(doc_id):
    """Rows whose label is never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, columns: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` documents with a label to learn from, as ``id``, ``label``, ``fold`` and
    ``columns`` of ``docs`` as strings ``c0``, ``c1`` and so on: those whose ids hash lowest, so reruns
    agree. An id with several labels has the largest; null labels and ids don't count; of rows with the
    same id the first by text counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    # `chosen` has as many rows as the sample's bound.
    rows = strings(docs, columns, id_col).join(F.broadcast(chosen), "id")
    row = F.struct(*[f"c{i}" for i in range(len(columns))])
    once = rows.groupBy("id", "label").agg(F.min(row).alias("row")).select("id", "label", "row.*")
    return once.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int"))


def strings(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """``id, c0, c1, ...``: columns of any names, as strings."""
    return docs.select(named(id_col).cast("long").alias("id"), *[named(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])


def outside(docs: DataFrame, sample: list[int], columns: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """All documents but those of a labelled sample, given by its ids, as ``id`` and ``columns``."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i,) for i in sample], "id long")
    # As many rows as the sample's bound, so no text is shuffled.
    return strings(docs, columns, id_col).join(F.broadcast(known), "id", "left_anti")
