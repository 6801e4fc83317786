"""Each registered query against its SQL or against a brute-force version on the small tables."""

import base64
import hashlib
import os
import zlib
from fractions import Fraction

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from sparkveil.llm import queries as Q
from sparkveil.session import table


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in table(spark, sf, "documents").collect()}


def rows(spark, sf, name):
    return Q.QUERIES[name](spark, sf).collect()


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf}/{t}'")
    df = Q.QUERIES[name](spark, sf)
    cur = con.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == sorted(str(list(r)) for r in cur.fetchall())


def test_mix(spark, sf, docs):
    out = rows(spark, sf, "op2_source_mix")
    assert out == rows(spark, sf, "op2_source_mix") and len(out) == len(docs)
    size = {d: len((r.text or "").encode().split()) for d, r in docs.items()}
    sources = sorted({r.source for r in docs.values()})
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    of = {s: sum(size[d] for d, r in docs.items() if r.source == s) for s in sources}
    # targets by repeated sharing
    target, open_, left = {}, set(sources), Fraction(3, 2) * sum(of.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * of[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = Fraction(2 * of[s])
            open_.remove(s)
            left -= target[s]
    taken = dict.fromkeys(sources, 0)
    for r in out:
        s = docs[r.doc_id].source
        assert (r["size"], r["source_size"]) == (size[r.doc_id], of[s]) and 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(float(target[s]))
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in sources)


def test_token_counts(spark, sf, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in rows(spark, sf, "op3_token_counts"):
        text = docs[r.doc_id].text or ""
        n = len(tok.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_media(spark, sf, docs):
    out = rows(spark, sf, "op4_media_columns")
    assert len(out) == len(docs)
    for r in out:
        data = (docs[r.doc_id].text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > len(payload)
        # the payload is the file's last box: every eighth of its blocks is a keyframe
        n, at = len(payload) // 576, r.media_bytes - len(payload)
        ranges = [(at + 576 * i, 576) for i in range(0, n, 8)]
        packed = zlib.crc32(b"".join(a.to_bytes(8, "big") + b.to_bytes(8, "big") for a, b in ranges))
        assert r.keyframes == ",".join(f"{a}+{b}" for a, b in ranges) and (r.n_keyframes, r.keyframe_bytes) == (len(ranges), 576 * len(ranges))
        assert r.feature == f"codec=raw;timescale=8000;duration={len(payload)};samples={n};keyframes={len(ranges)};first={at}+576;last={ranges[-1][0]}+576;ranges_crc32={packed}"
        assert r.codec == "raw " and r.duration_s == len(payload) / 8000
    stored = {}
    for r in out:
        assert stored.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes)) == (r.media_sha256, r.media_bytes)
    assert len({m for m, _ in stored.values()}) == len(stored)


def test_bpe(spark, sf, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, sf, "op6_byte_bpe"):
        text = docs[r.doc_id].text or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def brute_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf, docs):
    fp = {d: brute_simhash(r.text) for d, r in docs.items()}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf, "op10_simhash")}
    assert out == {d: (f"{fp[d]:016x}", find(d)) for d in ids}


def _accuracy(spark, dir_, name, label):
    labels = {r.doc_id: r[label] for r in table(spark, dir_, "labels").collect()}
    out = Q.QUERIES[name](spark, dir_).collect()
    held = [r for r in out if r.held_out and labels.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and all(0 <= r["score"] <= 1 for r in out)
    pairs = [(r["score"], labels[r.doc_id]) for r in held]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    return auc, sum(r.predicted == labels[r.doc_id] for r in held) / len(held), out


def test_toxicity_held_out(spark):
    auc, accuracy, out = _accuracy(spark, "/root/testdata/sf0.1", "op8_toxicity", "toxic")
    assert auc > 0.95 and accuracy > 0.97
    assert all(r.predicted == (r["score"] >= 0.3) for r in out)


def test_quality_held_out(spark):
    auc, accuracy, _ = _accuracy(spark, "/root/testdata/sf0.1", "op9_quality", "quality")
    assert auc > 0.97 and accuracy > 0.97


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of it on its own input."""
    docs = table(spark, sf, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow())
        after = docs.collect()
        if name != "encode":
            assert docs.columns == columns
        ids = sorted(r.doc_id for r in after)
        if name == "quality":
            assert sum(labels.get(r.doc_id) == 1 for r in after) >= 0.97 * sum(labels.get(r.doc_id) == 1 for r in before)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = b"".join((r.text or "").encode().split())
                if key not in best or (-len(r.text or ""), r.doc_id) < best[key]:
                    best[key] = (-len(r.text or ""), r.doc_id)
            assert ids == sorted(d for _, d in best.values())
        elif name == "near_dedup":
            fps = {r.doc_id: brute_simhash(r.text) for r in after}
            pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
            assert not pairs and set(ids) <= {r.doc_id for r in before}
        elif name == "source_mix":
            sizes = {r.doc_id: len(r.text.encode().split()) for r in before}
            taken = sum(len(r.text.encode().split()) for r in after)
            assert abs(taken - 1.5 * sum(sizes.values())) <= 40 * 21
            texts = {r.doc_id: r.text for r in before}
            assert all(" ".join(r.text.split()) in " ".join(texts[r.doc_id].split()) for r in after)
        else:
            assert len(after) == len(before) and sorted(r.decoded_sha256 for r in after) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before)
