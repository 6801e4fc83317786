"""Quality classifier by co-training two views of a document.

The text view has what the words are like: variety, repetition, lengths, symbols, capitals. The
metadata view has what a crawler records about a page without reading it: its language, its source's
bucket, its length, and how it is laid out in lines. Each view trains boosted trees on the labelled
sample. Over ``ROUNDS`` rounds each scores all unlabelled documents and labels those it is most sure of,
``PICKS`` of either class, for the other. Each view's scores are then calibrated on labelled documents that its trees did not see, and a
logistic regression over the calibrated views scores all documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.learn import BoostedTrees, Isotonic, Logistic, held_out, labelled_sample, outside, sigmoid, strings
from sparkveil.session import forget, materialize, ship, sliced

#: Labelled documents that the model learns from, at most.
SAMPLE = 6000
ROUNDS = 3
#: Unlabelled documents with different features that a view labels for the other in a round, of either
#: class, and how sure it must be.
PICKS, SURE = 300, 0.9
LANGUAGES = ("en", "fr", "de", "es")
SOURCE_BUCKETS = 8
TEXT, META = 18, 8 + len(LANGUAGES) + SOURCE_BUCKETS


def text_view(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, words = max(1, len(data)), data.lower().split()
    n, counts = max(1, len(words)), Counter(words)
    caps, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    triples = max(1, len(words) - 2)
    distinct = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else triples
    lines = [x for x in data.split(b"\n") if x]
    ends = int(hist[33] + hist[46] + hist[63])
    return [
        math.log1p(len(words)), len(counts) / n, len(counts) / math.sqrt(n), distinct / triples,
        (counts.most_common(1)[0][1] / n) if counts else 0.0, len(data) / n, sum(1 for w in counts if len(w) <= 3) / max(1, len(counts)),
        caps / max(1, caps + lower), int(hist[33]) / n, int(hist[35:39].sum() + hist[42] + hist[64]) / n, int(hist[124]) / n,
        int(hist[44]) / n, ends / n, int(hist[48:58].sum()) / size, int(hist[128:].sum()) / size,
        len(set(lines)) / max(1, len(lines)), n / max(1, ends), int(hist[40:42].sum() + hist[60] + hist[62] + hist[91:94].sum() + hist[123] + hist[125:127].sum()) / n,
    ]


def meta_view(text: str, lang: str | None, source: str | None) -> list[float]:
    lines = text.split("\n")
    lengths = np.array([len(x) for x in lines], float)
    base = [math.log1p(len(text)), math.log1p(len(lines)), float(lengths.mean()), float(lengths.max()), float(lengths.std()), float((lengths == 0).mean()), float(np.median(lengths)), len(text.encode("utf-8", "surrogatepass")) / max(1, len(text))]
    bucket = zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % SOURCE_BUCKETS
    return base + [float(lang == x) for x in LANGUAGES] + [float(bucket == i) for i in range(SOURCE_BUCKETS)]


def _features(texts: list, langs: list, sources: list) -> np.ndarray:
    """The features of both views, the text's first."""
    rows = [text_view(t or "") + meta_view(t or "", a, b) for t, a, b in zip(texts, langs, sources)]
    return np.array(rows, float).reshape(-1, TEXT + META)


def _views(rows: DataFrame, keys: str) -> DataFrame:
    """The columns ``keys`` and ``x``, the features of the rows' c0 (text), c1 and c2."""
    names = [k.split()[0] for k in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            k = len(names)
            x = _features(*(batch.column(k + i).to_pylist() for i in range(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(list(x), pa.list_(pa.float64()))], [*names, "x"])

    return rows.select(*names, "c0", "c1", "c2").mapInArrow(run, f"{keys}, x array<double>")


class QualityModel:
    """Two views, their calibrations and the combination."""

    def __init__(self, trees: list[BoostedTrees], calibrations: list[Isotonic], combination: Logistic):
        self.trees, self.calibrations, self.combination = trees, calibrations, combination

    def views(self, x: np.ndarray) -> np.ndarray:
        parts = (x[:, :TEXT], x[:, TEXT:])
        return np.stack([c(t.raw(p)) for t, c, p in zip(self.trees, self.calibrations, parts)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.combination(_logits(self.views(x)))


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.01, 0.99)
    return np.log(p / (1 - p))


#: The most confident rows of a pool, for a view and a class: keys of equal features, and the features.
Picks = Callable[[list[BoostedTrees]], dict[tuple[int, int], list[tuple[int, np.ndarray]]]]


def confident(pool: DataFrame, trees: list[BoostedTrees], picks: int = PICKS) -> dict[tuple[int, int], list[tuple[int, np.ndarray]]]:
    """For each view and class the ``picks`` rows of ``pool`` (same, x) with different features whose
    view is surest, at least ``SURE``. A task keeps that many for itself, so four lists of ``picks``
    rows come to the driver and no more than that from any task is written."""
    parts = (slice(0, TEXT), slice(TEXT, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, tuple[float, list[float]]]] = {(v, c): {} for v in (0, 1) for c in (0, 1)}
        for batch in sliced(batches):
            same = batch.column(0).to_pylist()
            x = np.asarray(batch.column(1).flatten()).reshape(-1, TEXT + META)
            for view in (0, 1):
                p = sigmoid(trees[view].raw(x[:, parts[view]]))
                for label in (0, 1):
                    sure, held = p if label else 1 - p, best[view, label]
                    for i in np.argsort(-sure, kind="stable")[: 4 * picks].tolist():
                        if sure[i] >= SURE:
                            held[same[i]] = (float(sure[i]), x[i].tolist())
                    if len(held) > picks:
                        best[view, label] = dict(sorted(held.items(), key=lambda h: (-h[1][0], h[0]))[:picks])
        rows = [(v, c, k, s, x) for (v, c), held in best.items() for k, (s, x) in held.items()]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["view", "label", "same", "sure", "x"])

    made = pool.select("same", "x").mapInArrow(run, "view int, label int, same long, sure double, x array<double>")
    made = materialize(made.dropDuplicates(["view", "label", "same"]), "quality-picks")
    found = {}
    for view in (0, 1):
        for label in (0, 1):
            rows = made.where((F.col("view") == view) & (F.col("label") == label)).orderBy(F.desc("sure"), "same").limit(picks).collect()
            found[view, label] = [(r["same"], np.array(r["x"])) for r in rows]
    forget(made)
    return found


def co_train(x: np.ndarray, y: np.ndarray, picks: Picks | None, rounds: int = ROUNDS) -> QualityModel:
    """Train on labelled rows ``x, y``; ``picks`` gives the unlabelled rows that trees are surest of.
    Every fourth labelled row is kept for the calibration and the combination."""
    parts, extra = (slice(0, TEXT), slice(TEXT, None)), ({}, {})
    keep = np.arange(len(y)) % 4 == 3
    fit_x, fit_y = x[~keep], y[~keep]

    def train(view: int) -> BoostedTrees:
        more = [extra[view][k] for k in sorted(extra[view])]
        features = np.concatenate([fit_x[:, parts[view]], np.array([m[1][parts[view]] for m in more]).reshape(len(more), -1)]) if more else fit_x[:, parts[view]]
        weight = np.concatenate([np.ones(len(fit_y)), np.full(len(more), 0.3)])
        return BoostedTrees(rounds=50).fit(features, np.concatenate([fit_y, [m[0] for m in more]]), weight)

    trees = [train(0), train(1)]
    for _ in range(rounds if picks else 0):
        found = picks(trees)
        for (view, label), rows in found.items():  # a view without a sure opinion gives none
            for key, row in rows:
                extra[1 - view].setdefault(key, (float(label), row))
        trees = [train(0), train(1)]
    held_x, held_y = (x[keep], y[keep]) if keep.any() else (x, y)
    calibrations = [Isotonic().fit(trees[v].raw(held_x[:, parts[v]]), held_y) for v in (0, 1)]
    model = QualityModel(trees, calibrations, Logistic(l2=0.1))
    model.combination.fit(_logits(model.views(held_x)), held_y)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, rounds: int = ROUNDS) -> QualityModel:
    """Learn from at most ``most`` labelled documents, none held out, and from all other documents as
    unlabelled ones, whose features are written once and scored in each round."""
    ship(docs.sparkSession)
    columns = (text_col, "lang", "source")
    known = _views(labelled_sample(docs, labels, "quality", most, columns, id_col), "id long, label int")
    own = sorted(known.collect(), key=lambda r: r["id"])  # `most` rows of numbers at most
    if not own:  # nothing to learn: every score is one half
        none = np.zeros(0)
        neutral = QualityModel([BoostedTrees(), BoostedTrees()], [Isotonic().fit(none, none), Isotonic().fit(none, none)], Logistic())
        neutral.combination.w = np.zeros(3)
        return neutral
    pool = picks = None
    if rounds:
        pool = _views(outside(docs, [r["id"] for r in own], columns, id_col), "id long").select(F.xxhash64("x").alias("same"), "x")
        pool = materialize(pool, "quality-pool")
        picks = lambda trees: confident(pool, trees)
    x = np.array([r["x"] for r in own], float).reshape(-1, TEXT + META)
    model = co_train(x, np.array([r["label"] for r in own], float), picks, rounds)
    if pool is not None:
        forget(pool)
    return model


def _score_rows(batch: pa.RecordBatch, at: int, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    views = model.views(_features(*(batch.column(at + i).to_pylist() for i in range(3))))
    return model.combination(_logits(views)), views


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score`` (of good quality), ``predicted`` and the
    calibrated ``text_score`` and ``meta_score``.

    Defined cases: a null text counts as empty, a null language or source as unknown; a text of any
    length is read whole, as lists of its words and lines; without labels every score is 0.5; repeated
    rows are returned as often as they came; an empty table gives an empty result; columns other than
    lang and source are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p, views = _score_rows(batch, 1, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(views[:, 0]), pa.array(views[:, 1])], ["id", "score", "text_score", "meta_score"])

    scored = strings(docs, (text_col, "lang", "source"), id_col).mapInArrow(run, "id long, score double, text_score double, meta_score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_score", "meta_score")


def good_documents(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns, of any names,
    without a join: the texts pass through the scoring task. Cases are those of ``score``."""
    ship(docs.sparkSession)
    names = docs.columns
    packed = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            p, _ = _score_rows(batch, len(names), model)
            kept = batch.filter(pa.array(p >= threshold))
            yield pa.RecordBatch.from_arrays(kept.columns[:-3], schema=pa.schema(list(kept.schema)[:-3]))

    seen = [F.col(f"c{names.index(c)}").cast("string").alias(f"_{i}") for i, c in enumerate((text_col, "lang", "source"))]
    return packed.select("*", *seen).mapInArrow(run, packed.schema).toDF(*names)
