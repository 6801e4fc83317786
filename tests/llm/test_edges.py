"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import struct
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import byte_bpe, exact_dedup, media_boxes, near_copies, quality, secret_scan, simhash, source_mix, token_cache, toxicity, url_filter
from sparkveil.llm.components import connected_components
from sparkveil.llm.learn import BoostedTrees, Isotonic
from sparkveil.session import shared_path

ROWS = [(1, "a b", "s", "en"), (2, " ab", "s", "en"), (2, " ab", "s", "en"), (None, None, None, None), (None, "", "t", None), (7, "x " * 50_000, "t", "de"), (8, "a b", None, "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    for name in ("id", "fp", "key", "label", "row", "rules", "target", "size", "_norm", "_h", "root", "digest", "score", "start", "value", "a.b", "_gone", "_gone_key", "_row_id", "_row_key", "_key", "c0", "c1", "_0", "_text", "_t", "`x"):
        df = df.withColumn(name, F.lit(0))
    return df


def runs(spark):
    cache = shared_path(spark, "test-cache")
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rules = url_filter.rules_table(spark, [("b", "/", "block")])
    return {
        "exact": exact_dedup.exact_dedup,
        "mix": lambda d: source_mix.mix_sources(d, source_mix.cycle_weights()),
        "tokens": lambda d: token_cache.token_counts(d, P.path("byte_bpe_50k.json"), cache),
        "media": media_boxes.stored_digests,
        "files": lambda d: media_boxes.media_columns(d, "text", "doc_id"),
        "secrets": secret_scan.scan_secrets,
        "bpe": lambda d: byte_bpe.encoded_digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "ids": lambda d: byte_bpe.encode_column(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "urls": lambda d: url_filter.judge_urls(d, rules, "doc_id", "text"),
        "simhash": simhash.near_dedup,
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, none)),
        "quality": lambda d: quality.score(d, quality.fit(d, none)),
        "good": lambda d: quality.good_documents(d, quality.fit(d, none)),
        # the next ones leave rows out
        "drop": exact_dedup.drop_copies,
        "mixed": lambda d: source_mix.mixed_documents(d, source_mix.cycle_weights()),
        "near": simhash.one_of_each,
        "near_copies": near_copies.one_of_each,
    }


@pytest.mark.parametrize("name", ["exact", "mix", "tokens", "media", "files", "secrets", "bpe", "ids", "urls", "simhash", "toxicity", "quality", "good"])
def test_every_row_comes_back(spark, odd, name):
    f = runs(spark)[name]
    assert f(odd).count() == len(ROWS)
    assert f(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "ids"), [("drop", ["1", "7", "None"]), ("near", ["1", "2", "7", "None"]), ("near_copies", ["1", "2", "7", "None"]), ("good", ["1", "2", "2", "7", "8", "None", "None"])])
def test_whole_rows_pass_through(spark, odd, name, ids):
    f = runs(spark)[name]
    out = f(odd)
    assert out.columns == odd.columns and [x.dataType for x in out.schema] == [x.dataType for x in odd.schema]
    assert sorted(str(r.doc_id) for r in out.collect()) == ids
    assert f(odd.limit(0)).count() == 0 and f(odd.limit(0)).columns == odd.columns


def test_mixed_rows_pass_through(spark, odd):
    out = runs(spark)["mixed"](odd)
    assert out.columns == odd.columns and {r.doc_id for r in out.collect()} <= {1, 2, 7, 8}
    assert runs(spark)["mixed"](odd.limit(0)).count() == 0


def test_labels_reach_the_classifiers_by_id(spark, odd):
    """Repeated and null ids, and texts of any kind, among the labelled rows."""
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 0), (7, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score(odd, toxicity.fit(odd, known)), quality.score(odd, quality.fit(odd, known))):
        assert out.count() == len(ROWS) and all(0 <= r["score"] <= 1 for r in out.collect())


def test_exact_dedup_ties(odd):
    out = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect())
    assert out == sorted([("1", 1, 4, True), ("2", 1, 4, False), ("2", 1, 4, False), ("8", 1, 4, False), ("7", 7, 1, True), ("None", None, 2, True), ("None", None, 2, False)])
    assert exact_dedup.drop_copies(odd).count() == 3 and exact_dedup.drop_copies(odd).columns == odd.columns


def test_exact_dedup_tells_colliding_hashes_apart(spark):
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    out = exact_dedup.exact_dedup(df, hash_bits=4).collect()
    assert len({r.keep_id for r in out}) == 50 and all(r.group_size == 4 and r.keep_id == r.doc_id % 50 for r in out)


def test_near_dedup_parts_lose_no_link(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for k in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << k
            fps.add(x)
    arr = np.array(sorted(fps), np.uint64)
    signed = arr.view(np.int64).tolist()
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 3
    label = np.arange(len(arr))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    groups = {}
    for fp, g in zip(signed, label.tolist()):
        groups.setdefault(g, []).append(fp)
    want = {fp: min(m) for m in groups.values() for fp in m}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for cap in (4096, 5):
        roots = {r.node: r.root for r in connected_components(simhash.near_links(df, cap)).collect()}
        assert {x: roots.get(x, x) for x in signed} == want


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (None, 3), (201, 200), (200, 201)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 61)} | {201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_of_long_texts_is_chunked_exactly(monkeypatch):
    text = " ".join(f"w{i % 997}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_water_filling_and_seats():
    t = source_mix.water_fill({"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}, 210)
    assert t["a"] == 20 and t["b"] + t["c"] == 190 and t["c"] == 2 * t["b"]
    votes = {"a": 340, "b": 280, "c": 160, "d": 60, "e": 0}
    won = source_mix.sainte_lague(votes, 15)
    heap = sorted(((-v / (2 * k + 1), i, s) for i, (s, v) in enumerate(votes.items()) if v for k in range(15)))[:15]
    assert won == {s: sum(h[2] == s for h in heap) for s in votes}
    assert source_mix.sainte_lague({"a": 0}, 3) == {"a": 0} and source_mix.sainte_lague({}, 3) == {}


def test_mix_shards_follow_the_source_quota(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 40), "big" if i % 3 else "small") for i in range(3000)], "doc_id long, text string, source string")
    out = source_mix.mix_sources(df, {"big": 1, "small": 3}, shard_words=2000)
    for r in out.groupBy("source", "target").agg(F.sum("taken").alias("t"), F.countDistinct("passes").alias("p")).collect():
        assert abs(r["t"] - r["target"]) <= 0.01 * r["target"]
    pieces = source_mix.mixed_documents(df, {"big": 1, "small": 3}, shard_words=2000)
    assert pieces.select(F.sum(source_mix.word_count(F.col("text")))).first()[0] == out.select(F.sum("taken")).first()[0]


def test_shard_quotas_sum_to_the_source(spark):
    rng = random.Random(4)
    words = {s: [rng.choice([0, rng.randrange(1000)]) for _ in range(n)] for s, n in (("a", 1), ("b", 7), (None, 50))}
    blocks = {"a": 3, "b": 101, None: 777}
    totals = spark.createDataFrame([(s, i, w, blocks[s]) for s, ws in words.items() for i, w in enumerate(ws)], "source string, shard long, _all long, _quota long")
    whole = {(r.source, r.shard): r["_quota"] for r in source_mix.shard_quotas(totals, 50).collect()}
    for s, ws in words.items():  # one branch: largest remainders
        base = [w * blocks[s] // max(1, sum(ws)) for w in ws]
        order = sorted(range(len(ws)), key=lambda i: (-(ws[i] * blocks[s] % max(1, sum(ws))), i))
        for i in order[: blocks[s] - sum(base) if sum(ws) else 0]:
            base[i] += 1
        assert [whole[s, i] for i in range(len(ws))] == base
    tree = {(r.source, r.shard): r["_quota"] for r in source_mix.shard_quotas(totals, 50, fan=4).collect()}
    for s, ws in words.items():
        assert sum(q for (k, _), q in tree.items() if k == s) == (blocks[s] if sum(ws) else 0)
        assert all(abs(tree[s, i] - w * blocks[s] / max(1, sum(ws))) <= 3 for i, w in enumerate(ws))


def test_taken_by_brute_force(spark):
    """The layout of shards and rings, from the hashes, in plain Python."""
    rng = random.Random(6)
    rows = [(i if i % 50 else 7, " ".join(["w"] * rng.choice([0, 1, 30, 200])) + " " * (i % 3), rng.choice(["x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = source_mix.mix_sources(df, {"x": 2, "y": 1}, shard_words=2000)
    hashed = df.withColumns({"h": F.xxhash64(F.lit(42), "doc_id"), "o": F.xxhash64(F.lit(42), F.lit("order"), "doc_id"), "t": F.xxhash64(F.lit(42), F.lit("text"), "text")}).collect()
    size = lambda r: len(r.text.split())
    sizes = {s: sum(size(r) for r in hashed if r.source == s) for s in "xy"}
    budget = Fraction(3, 2) * sum(sizes.values())
    targets = source_mix.water_fill(sizes, {"x": 2, "y": 1}, budget)
    blocks = source_mix.sainte_lague(targets, round(budget / 16))
    want = []
    for s in "xy":
        n = max(1, -(-sizes[s] // 2000))
        parts = [sorted((r for r in hashed if r.source == s and r.h % n == i), key=lambda r: (r.o, r.doc_id, size(r), r.t)) for i in range(n)]
        words = [sum(map(size, part)) for part in parts]
        quota = [w * blocks[s] // sizes[s] for w in words]
        for i in sorted(range(n), key=lambda i: (-(words[i] * blocks[s] % sizes[s]), i))[: blocks[s] - sum(quota)]:
            quota[i] += 1
        for i, part in enumerate(parts):
            k = -(-words[i] // 16)
            first = spark.sql(f"select pmod(xxhash64(42, '{s}', {i}L), {max(1, k)}) as b").first().b * 16
            passes, rest = divmod(min(quota[i], 2 * k), k) if k else (0, 0)
            chosen = {(first + j) % (16 * k) for j in range(16 * rest)}
            at = 0
            for r in part:
                want.append((r.doc_id, size(r), passes * size(r) + sum(p in chosen for p in range(at, at + size(r)))))
                at += size(r)
    assert sorted((r.doc_id, r["size"], r["taken"]) for r in out.collect()) == sorted(want)


def test_token_cache_encodes_only_misses(spark, monkeypatch):
    path, cache = P.path("word_bpe_49k.json"), shared_path(spark, "cache")
    df = spark.createDataFrame([(1, "Hello there"), (2, "Hello there"), (3, "other <|endoftext|>")], "doc_id long, text string")
    first = {r.doc_id: r.n_tokens for r in token_cache.token_counts(df, path, cache).collect()}
    assert spark.read.parquet(cache).count() == 2
    more = df.union(spark.createDataFrame([(4, "new text")], df.schema))
    second = {r.doc_id: r.n_tokens for r in token_cache.token_counts(more, path, cache).collect()}
    assert spark.read.parquet(cache).count() == 3 and {k: second[k] for k in first} == first
    token_cache.token_counts(df, P.path("piece_bpe_32k.model"), cache).collect()  # another tokenizer, other counts
    assert spark.read.parquet(cache).count() == 5
    assert {r.doc_id: r.n_tokens for r in token_cache.token_counts(df.limit(1), path, cache).collect()} == {1: first[1]}
    assert spark.read.parquet(cache).count() == 5


def test_perfect_hash_is_minimal_and_exact():
    keys = [bytes([a, b]) for a in range(60) for b in range(60)]
    h = byte_bpe.PerfectHash(keys)
    assert sorted(h.get(k) for k in keys) == list(range(len(keys))) and all(h.get(k) == i for i, k in enumerate(keys))
    assert h.get(b"zzz") == -1 and h.get(b"") == -1 and byte_bpe.PerfectHash([]).get(b"a") == -1


def test_media_boxes_round_trip_and_damage():
    data = media_boxes.write_media(media_boxes.padded(b"q" * 5000), key_every=3)
    (track,) = media_boxes.read_media(data)
    assert media_boxes.payload_of(data, track)[:5000] == b"q" * 5000 and len(track.samples) == 9 and len(track.keyframes) == 3
    assert (track.codec, track.handler, track.duration) == ("raw ", "soun", 9 * 576)
    assert media_boxes.read_media(b"") == []
    for bad in (data[:100], data[:700], struct.pack(">I4s", 99, b"moov")):
        with pytest.raises(media_boxes.BadMedia):
            media_boxes.read_media(bad)


def test_media_boxes_other_tables():
    box, full = media_boxes._box, media_boxes._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">III", 1, 5, 10)), full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), full(b"stz2", bytes([0, 0, 0, 8]), struct.pack(">I", 5), bytes([1, 2, 3, 4, 5])), full(b"co64", struct.pack(">I4Q", 4, 0, 10, 20, 30)))
    wide = struct.pack(">I4sQ", 1, b"moov", 16 + len(box(b"trak", box(b"mdia", box(b"minf", stbl))))) + box(b"trak", box(b"mdia", box(b"minf", stbl)))
    (track,) = media_boxes.read_media(wide + struct.pack(">I4s", 0, b"mdat") + bytes(50))
    assert track.samples == [(0, 1), (1, 2), (10, 3), (20, 4), (30, 5)] and track.keyframes == track.samples and track.duration == 50


def two_tracks(fragmented=True):
    """Sound first, then pictures; the pictures go on in two fragments."""
    box, full = media_boxes._box, media_boxes._full

    def trak(number, handler, codec, sizes, offset):
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), full(b"stts", struct.pack(">III", 1, len(sizes), 10)), full(b"stsc", struct.pack(">IIII", 1, 1, len(sizes), 1)), full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)), full(b"stco", struct.pack(">II", 1, offset)))
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIII", 0, 0, 1000, 10 * len(sizes), 0)), full(b"hdlr", bytes(4), handler, bytes(12)), box(b"minf", stbl))
        return box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, number)), mdia)

    def moov(at):
        mvex = box(b"mvex", full(b"trex", struct.pack(">5I", 2, 1, 20, 7, media_boxes._NOT_SYNC)))
        return box(b"moov", trak(1, b"soun", b"mp4a", [3, 4], at), trak(2, b"vide", b"avc1", [5], at + 7), mvex)

    head = moov(len(moov(0)) + 8) + box(b"mdat", bytes(12))
    if not fragmented:
        return head
    # the first fragment follows its own start, the second states where its bytes are and their sizes
    first = lambda n: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 2), flags=0x20000), full(b"trun", struct.pack(">IiI", 2, n, 0), flags=0x5)))
    one = first(len(first(0)) + 8) + box(b"mdat", bytes(14))
    base = len(head) + len(one)
    second = box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQ", 2, base), flags=0x1), full(b"trun", struct.pack(">I4I", 2, 9, media_boxes._NOT_SYNC, 11, 0), flags=0x600)))
    return head + one + second + box(b"mdat", bytes(20)), base, len(one)


def test_media_tracks_and_fragments(spark):
    data, base, one = two_tracks()
    sound, pictures = media_boxes.read_media(data)
    assert (sound.handler, sound.codec, len(sound.samples), sound.duration) == ("soun", "mp4a", 2, 20)
    start = base - 14
    assert pictures.samples[1:] == [(start, 7), (start + 7, 7), (base, 9), (base + 9, 11)]
    assert pictures.keyframes == [pictures.samples[0], (start, 7), (base + 9, 11)] and pictures.duration == 10 + 4 * 20
    with pytest.raises(media_boxes.BadMedia):
        media_boxes.read_media(data[: base + 4])
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(two_tracks(False)))], "id long, c binary")
    out = {r.id: r for r in media_boxes.media_columns(df, "c", "id").collect()}
    assert (out[1].codec, out[1].n_samples) == ("avc1", 5) and [t.handler for t in out[1].tracks] == ["soun", "vide"]
    assert (out[2].codec, out[2].n_samples, out[2].error) == ("avc1", 1, None)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, bytearray(media_boxes.write_media(bytes(1152)))), (2, None), (3, bytearray(b"junk"))], "id long, c binary")
    out = {r.id: r for r in media_boxes.media_columns(df, "c", "id").collect()}
    assert out[1].codec == "raw " and len(out[1].keyframes) == 1 and out[1].error is None
    assert out[2].error == "no track" and out[3].codec is None and out[3].error


def test_trigram_queries():
    q = secret_scan.trigram_query
    assert q("[0-9]+") is True and q("ab") is True and q("(?:abc)?x") is True
    assert q("abcd") == ("and", ("abc", "bcd"))
    assert secret_scan.holds(q("foo(?:bar|baz)"), {"foo", "oob", "oba", "baz"}.__contains__) and not secret_scan.holds(q("foo(?:bar|baz)"), {"foo"}.__contains__)


def test_url_filter_by_brute_force(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "net", "org", "ex"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 3))), "".join("/" + label() for _ in range(rng.randint(0, 2)))): rng.choice(["allow", "block"]) for _ in range(60)}
    urls = ["".join([rng.choice(["http://", "HTTPS://", "", "x://"]), ".".join(label().upper() for _ in range(rng.randint(1, 4))), "".join("/" + label() for _ in range(rng.randint(0, 3))), rng.choice(["", "?q=/a", "#/b"])]) for _ in range(400)] + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, [(h, p, v) for (h, p), v in rules.items()]), blocks=4).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        assert got[i] == ((best[2], best[3]) if best else (None, "allow")), url


def test_hosts_of_very_many_labels(spark):
    long = "a." * 100_000 + "net"
    pages = spark.createDataFrame([(1, f"http://{long}/x"), (2, "http://" + "b" * 200_000 + "/x"), (3, None), (3, None), (4, "http:///net")], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rules_table(spark, [("net", "/", "block"), ("a.net", "/y", "block")])).collect()}
    assert out == {1: ("net/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow")}


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(odd.limit(0), model).count() == 0
    view = quality.fit(odd, none)
    assert [r["score"] for r in quality.score(odd, view).collect()] == [0.5] * len(ROWS)
    assert quality.good_documents(odd, view).columns == odd.columns and quality.good_documents(odd, view).count() == len(ROWS)


def test_learners():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.7).astype(float)
    raw = BoostedTrees().fit(x[:300], y[:300]).raw(x[300:])
    assert ((raw > 0) == y[300:]).mean() > 0.85
    iso = Isotonic().fit(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    p = iso(np.array([0.0, 0.25, 0.9]))
    assert (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1
