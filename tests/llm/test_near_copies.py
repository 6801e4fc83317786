"""The near-copy stage against a brute-force comparison of all pairs."""

import random

import pytest

import corpus_pipeline
from sparkveil.llm import near_copies
from sparkveil.session import table

STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(texts):
    """The ids that stay of {id: text}: the least of each component of pairs at 0.8 or more."""
    sets, root = {d: brute_shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 5 * low >= 4 * high and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in ids if find(d) == d]


def families(seed=5):
    """Texts of 60 to 200 words; each has copies with one to four words changed, and copies of those."""
    rnd, texts = random.Random(seed), []
    for _ in range(25):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 200))]
        texts.append(words)
        for _ in range(6):
            words = list(rnd.choice(texts[-3:]))
            for _ in range(rnd.randrange(1, 5)):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(5000)}"
            texts.append(words)
    return dict(enumerate(" ".join(w) for w in texts))


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_stage_on_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = STAGE(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == brute_kept(texts)


@pytest.mark.parametrize("cap", [3, 4096])
def test_changed_words(spark, cap):
    texts = families()
    kept = brute_kept(texts)
    assert 30 < len(kept) < len(texts) - 30
    assert sorted(r.doc_id for r in near_copies.one_of_each(frame(spark, texts), cap=cap).collect()) == kept


def test_threshold_is_exact(spark):
    words = [f"a{i}" for i in range(40)]
    # 36 shingles; dropping the last words leaves 29 of 36 (above 0.8) and 28 of 36 (below)
    texts = {1: " ".join(words), 2: " ".join(words[:33]), 3: " ".join(f"b{i}" for i in range(40)), 4: " ".join(f"b{i}" for i in range(32))}
    assert brute_kept(texts) == [1, 3, 4]
    assert sorted(r.doc_id for r in near_copies.one_of_each(frame(spark, texts)).collect()) == [1, 3, 4]
