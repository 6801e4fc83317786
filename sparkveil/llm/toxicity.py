"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (published insults, and words and word beginnings learned
from the labelled sample), nearness of its hits to second-person words, capitals, punctuation and
obfuscation rates. Words are compared as they are and with look-alike characters undone.

The lexicon is learned from document frequencies in the sample, in two halves: a training document's
features use the half without it, so that the trees see lexicon hits as new documents will have them.
The calibration is fitted on scores of documents that the scoring trees had not seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.learn import BoostedTrees, Isotonic, held_out, labelled_sample, sigmoid, strings
from sparkveil.session import forget, materialize, ship, sliced

#: Documents with a label that the model learns from, at most.
SAMPLE = 8000
#: Terms that the learned lexicon has, at most.
LEXICON = 400
#: A published insult vocabulary of four languages, as a start; the sample adds to it.
INSULTS = frozenset(
    "idiot moron loser scum stupid trash pathetic worthless disgusting clown dumb fool jerk imbecile filth vermin hate kill "
    "idiote imbécile connard salaud ordure débile nul dégoûtant raclure "
    "trottel dummkopf abschaum arschloch versager widerlich dreck blöd "
    "idiota imbécil estúpido estúpida basura escoria asqueroso patético".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti tuyo usted ustedes vosotros".split())
#: Look-alike characters and the letters they stand for.
LOOK_ALIKES = str.maketrans("01345789@$!|+€", "oieastbgasiite")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…¿¡"
_INNER = re.compile(r"[^\w]|_")
_MIXED = re.compile(r"[^\W\d_][0-9@$!*|+._-]+[^\W\d_]")
_REPEAT = re.compile(r"(\w)\1{3,}")
PREFIXES = (4, 5, 6, 7)
FEATURES = 26


def word_forms(word: str) -> tuple[str, str]:
    """A lower-cased word without outer punctuation, and with look-alikes and inner marks undone."""
    plain = word.strip(_EDGE)
    return plain, _INNER.sub("", word.strip(",.;:()\"'").translate(LOOK_ALIKES))


def terms_of(text: str) -> set[str]:
    """The distinct terms of a text: its words, and the beginnings of words, marked by a caret."""
    out = set()
    for word in set(text.lower().split()):
        plain = word.strip(_EDGE)
        if 3 <= len(plain) <= 30:
            out.add(plain)
            for n in PREFIXES:
                if len(plain) > n:
                    out.add("^" + plain[:n])
    return out


def term_counts(sample: DataFrame) -> DataFrame:
    """``term, n00, n01, n10, n11``: in how many documents of fold i and label j each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for label, fold, text in zip(*(c.to_pylist() for c in batch.columns)):
                for t in terms_of(text or ""):
                    counts.setdefault(t, [0, 0, 0, 0])[2 * fold + label] += 1
            rows = [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(4))]
            yield pa.RecordBatch.from_arrays(rows, ["term", "n00", "n01", "n10", "n11"])

    rows = sample.select(F.col("label").cast("int"), "fold", F.col("c0").alias("text"))
    made = rows.mapInArrow(run, "term string, n00 long, n01 long, n10 long, n11 long")
    return made.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n00", "n01", "n10", "n11")])


def learn_lexicon(counts: DataFrame, zeros: str, ones: str, clean: int, toxic: int) -> dict[str, float]:
    """Terms that occur in far more toxic documents (column ``ones``) than their share, with a weight:
    the log odds, shrunk for terms with little evidence (G² of the two counts). The ``LEXICON`` terms
    with most evidence."""
    if not clean or not toxic:
        return {}
    share, n0, n1 = toxic / (clean + toxic), F.col(zeros), F.col(ones)
    n = n0 + n1
    g2 = 2 * (n1 * F.ln(n1 / (n * share)) + F.when(n0 > 0, n0 * F.ln(n0 / (n * (1 - share)))).otherwise(0.0))
    odds = F.ln((n1 + 0.5) / (toxic + 1)) - F.ln((n0 + 0.5) / (clean + 1))
    found = counts.where((n1 >= 2) & (n1 / n > share)).select("term", g2.alias("g2"), odds.alias("odds")).where("g2 >= 8 and odds >= 1")
    return {r["term"]: r["odds"] * math.tanh(r["g2"] / 20) for r in found.orderBy(F.desc("g2"), "term").limit(LEXICON).collect()}


class ToxicFeatures:
    """Dense features of texts under a lexicon. Remembers words it has met, up to a bound."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        self.lexicon, self.most, self.seen = lexicon, most, {}

    def _word(self, word: str) -> tuple[float, float, float, float, float] | None:
        """Insult, learned word, learned beginning, look-alike hit, mixed spelling; None: nothing."""
        plain, undone = word_forms(word)
        lexicon = self.lexicon
        direct = plain in INSULTS
        undone_hit = undone != plain and (undone in INSULTS or lexicon.get(undone, 0) >= 1)
        learned = lexicon.get(plain, 0.0)
        begin = max((lexicon.get("^" + plain[:n], 0.0) for n in PREFIXES if len(plain) > n), default=0.0)
        mixed = _MIXED.search(plain) is not None
        found = (float(direct), learned, begin, float(undone_hit), float(mixed))
        return found if any(found) else None

    def row(self, text: str) -> list[float]:
        data = text.encode("utf-8", "surrogatepass")
        hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        n_bytes, words = max(1, len(data)), text.lower().split()
        n = max(1, len(words))
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, hits = self.seen, []
        counts = Counter(words)
        insults = learned = begins = undone = mixed = strong = 0.0
        top_word = top_begin = weight = 0.0
        for word, k in counts.items():
            if word in seen:
                found = seen[word]
            else:
                found = seen[word] = self._word(word)
            if found is None:
                continue
            insults += k * found[0]
            learned += k * (found[1] > 0)
            begins += k * (found[2] > 0)
            undone += k * found[3]
            mixed += k * found[4]
            top_word, top_begin = max(top_word, found[1]), max(top_begin, found[2])
            score = max(found[1], found[2], 2 * found[0], 2 * found[3])
            weight += k * score
            if score >= 1.5:
                strong += k
                hits.append(word)
        near = 0
        if hits:
            targets = set(hits)
            at = [i for i, w in enumerate(words) if w in targets]
            for i in at:
                near += any(w.strip(_EDGE) in SECOND_PERSON for w in words[max(0, i - 5) : i + 6])
        second = sum(counts.get(w, 0) for w in SECOND_PERSON)
        caps, lower = hist[65:91].sum(), hist[97:123].sum()
        marks = hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()
        repeats = len(_REPEAT.findall(text)) if text else 0
        return [
            math.log1p(len(words)), insults, insults / n, learned, learned / n, begins, begins / n, undone, undone / n, mixed / n,
            strong, strong / n, float(len(hits)), top_word, top_begin, weight, weight / n,
            float(near), near / n, second / n, caps / max(1, caps + lower), marks / n_bytes,
            hist[33] / n_bytes, (hist[35:39].sum() + hist[42] + hist[64]) / n_bytes, hist[48:58].sum() / n_bytes, repeats / n,
        ]

    def rows(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.row(t or "") for t in texts], float).reshape(-1, FEATURES)


class ToxicModel:
    """Lexicon, trees and calibration; small enough to travel with each task."""

    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def __call__(self, features: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(features)
        # steps of the calibration are ties; the trees' order decides inside them
        return np.clip(0.98 * self.calibration(raw) + 0.02 * sigmoid(raw), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> ToxicModel:
    """Learn from at most ``most`` labelled documents, none of which is held out."""
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, "toxic", most, (text_col,), id_col), "toxic-sample")
    sizes = {(r["fold"], r["label"]): r["n"] for r in sample.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = ([sizes.get((f, k), 0) for f in (0, 1)] for k in (1, 0))
    terms = materialize(term_counts(sample).withColumns({"n0": F.col("n00") + F.col("n10"), "n1": F.col("n01") + F.col("n11")}), "toxic-terms")
    of = [learn_lexicon(terms, f"n{f}0", f"n{f}1", clean[f], toxic[f]) for f in (0, 1)]
    whole = learn_lexicon(terms, "n0", "n1", sum(clean), sum(toxic))
    forget(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = [ToxicFeatures(of[1]), ToxicFeatures(of[0])]  # the other half's lexicon
        for batch in sliced(batches):
            folds, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            rows = [makers[f].row(t or "") for f, t in zip(folds, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "fold", "x"])

    rows = sample.select("id", "label", "fold", F.col("c0").alias("text")).mapInArrow(run, "id long, label int, fold int, x array<double>")
    data = sorted(rows.collect(), key=lambda r: r["id"])  # SAMPLE rows of numbers at most
    forget(sample)
    x = np.array([r["x"] for r in data], float).reshape(-1, FEATURES)
    y, fold = np.array([r["label"] for r in data], float), np.array([r["fold"] for r in data], int)
    unseen = np.zeros(len(y))
    for f in (0, 1):
        unseen[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return ToxicModel(whole, BoostedTrees().fit(x, y), Isotonic().fit(unseen, y))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Defined cases: a null text counts as empty; a text of any length is read whole, as a list of its
    words; without labels of both classes the score is the share of toxic labels (0.5 if there are
    none); repeated rows are returned as often as they came; an
    empty table gives an empty result; other columns are ignored, so no label reaches a score.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = ToxicFeatures(model.lexicon)
        for batch in sliced(batches):
            p = model(maker.rows(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    scored = strings(docs, (text_col,), id_col).mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
