"""Co-training's pool, and the lexicon, against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import quality, toxicity
from sparkveil.llm.learn import BoostedTrees, sigmoid


def test_confident_rows_against_a_sort(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, quality.TEXT + quality.META)).round(3)
    x[:500] = x[500:1000]  # equal features count once
    trees = [BoostedTrees(rounds=30).fit(x[:, s], (x[:, s][:, 0] + 0.3 * x[:, s][:, 1] > 0).astype(float)) for s in (slice(0, quality.TEXT), slice(quality.TEXT, None))]
    pool = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5).select(F.xxhash64("x").alias("same"), "x")
    found = quality.confident(pool, trees, picks=40)
    for view, part in ((0, slice(0, quality.TEXT)), (1, slice(quality.TEXT, None))):
        p = sigmoid(trees[view].raw(x[500:, part]))
        for label in (0, 1):
            sure = p if label else 1 - p
            best = np.sort(sure[sure >= quality.SURE])[::-1][:40]
            got = sigmoid(trees[view].raw(np.array([r for _, r in found[view, label]])[:, part])) if len(best) else np.empty(0)
            assert np.allclose(np.sort(got if label else 1 - got)[::-1], best) and len({k for k, _ in found[view, label]}) == len(best)


def test_lexicon_against_a_plain_version(spark):
    rng = np.random.default_rng(6)
    counts = [(f"t{i}", int(rng.integers(0, 30)), int(rng.integers(0, 30))) for i in range(600)]
    clean, toxic = 300, 100
    share, found = toxic / (clean + toxic), []
    for term, n0, n1 in counts:
        n = n0 + n1
        if n1 < 2 or n1 / n <= share:
            continue
        g2 = 2 * (n1 * math.log(n1 / (n * share)) + (n0 * math.log(n0 / (n * (1 - share))) if n0 else 0))
        odds = math.log((n1 + 0.5) / (toxic + 1)) - math.log((n0 + 0.5) / (clean + 1))
        if g2 >= 8 and odds >= 1:
            found.append((-g2, term, odds * math.tanh(g2 / 20)))
    got = toxicity.learn_lexicon(spark.createDataFrame(counts, "term string, n0 long, n1 long"), "n0", "n1", clean, toxic)
    want = {t: w for _, t, w in sorted(found)[: toxicity.LEXICON]}
    assert set(got) == set(want) and all(abs(got[t] - want[t]) < 1e-9 for t in want)
    assert toxicity.learn_lexicon(spark.createDataFrame(counts, "term string, n0 long, n1 long"), "n0", "n1", 0, 5) == {}
