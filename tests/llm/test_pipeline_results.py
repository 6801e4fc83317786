"""What the stages of the pipeline drop, and run() against brute force behind the quality stage."""

import corpus_pipeline
from sparkveil.session import table
from test_near_copies import brute_kept


def test_quality_rejects_bad_documents(spark):
    sf = "/root/testdata/sf0.1"  # the size that the held-out tests use; sf0.01 has 58 bad labels, of which 51 are rejected
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    docs = table(spark, sf, "documents")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf).select("doc_id").collect()}
    bad = [r.doc_id for r in docs.select("doc_id").collect() if labels.get(r.doc_id) == 0]
    assert bad and sum(d not in kept for d in bad) >= 0.97 * len(bad)


def test_run_against_brute_force(spark, sf):
    good = corpus_pipeline.good_quality(spark, table(spark, sf, "documents"), sf).collect()
    best = {}
    for r in good:
        key, rank = b"".join((r.text or "").encode().split()), (-len(r.text or ""), r.doc_id)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    left = {r.doc_id: r.text for _, r in best.values()}
    kept = set(brute_kept(left))
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    # the mix takes 1.5 times the words, at most two passes of a document
    assert out <= kept and len(out) >= 0.75 * len(kept)
