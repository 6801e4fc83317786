"""Near copies: the links of ``simhash`` and MinHash bands propose, shingle sets decide.

A text's shingles are those of ``simhash``, of ``width`` words; here they are a set of 64-bit hashes.
Texts with the same set are one class, and classes are linked at a Jaccard similarity of 0.8 or more.

Proposals: equal fingerprints of these shingles, and the links of ``simhash`` between them (pigeonring
filtering at 3 of 64 bits), are one family of keys. They hold the closest copies only: at 0.8 two
fingerprints differ in 10 bits on average, and no choice of equal bytes selects at such a radius. So 160 minima of
the set under as many orders, in 32 bands of 5, give 32 more keys. Two sets of similarity s share a
band with a probability of 1 - (1 - s^5)^32: 0.999997 at 0.8, more above, 0.08 at 0.3.

Decisions: the classes of a key meet in one task with their sets, are compared shingle by shingle in
whole numbers, and give a spanning forest, never all pairs of a group. Of keys with the same members
one is compared. A key with over ``cap`` hashes is cut into cells:

1. Of the keys of ``simhash`` and the first bands, each part of a key is compared in itself. The
   parts differ from key to key, so that a large group of copies grows together.
2. Of all keys whose members are still in different components, the part of the largest component is
   compared with all others, and these with each other, so no link that a key offers is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkveil.llm import simhash
from sparkveil.llm.components import connected_components, one_row_each, row_key
from sparkveil.session import forget, materialize, ship, sliced

WIDTH = 5
#: Similarity of at least 4/5.
OVER, UNDER = 4, 5
BANDS, ROWS = 32, 5
#: The keys of the first step: those of ``simhash``, and the bands before this one.
FIRST = 6
#: Hashes of one cell's sets, 4 MB, as far as more than two of its classes are concerned.
CAP = 1 << 19
_SEED = 42
_ORDERS = np.random.default_rng(_SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The sorted distinct hashes of a text's shingles, and the fingerprint of all of them."""
    parts, counts, total = [], np.zeros(64, np.int64), 0
    for hashes in simhash.shingle_hashes(text, width, _SEED):
        counts += simhash.bit_counts(hashes)
        total += len(hashes) // 8
        parts.append(np.unique(np.frombuffer(hashes, np.uint64)))
    found = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
    return found, simhash.majority(counts, total)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A set's keys, none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * _ORDERS).min(axis=0), out=least)
    data, size = least.tobytes(), 8 * ROWS
    keys = [xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, key, node, proof, n, fp, bands`` for every row: its class is ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [sketch(x.as_py(), width) for x in batch.column(2)]
            node, proof = ([xxhash.xxh64_intdigest(s.tobytes(), seed) for s, _ in made] for seed in (0, 1))
            n = pa.array([len(s) for s, _ in made], pa.int64())
            bands = pa.array([band_keys(s) for s, _ in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(node), _signed(proof), n, _signed([f for _, f in made]), bands], ["id", "key", "node", "proof", "n", "fp", "bands"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, key string, node long, proof long, n long, fp long, bands array<long>")


def _sets(df: DataFrame, wanted: DataFrame, text_col: str, width: int) -> DataFrame:
    """``node, hashes`` (binary) of the classes in ``wanted`` (node, key of one of its texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [sketch(x.as_py(), width)[0].tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    texts = df.select(row_key(F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(wanted, "key").select("node", "text")
    return found.mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def _similar(common, a, b):
    """common / union of at least OVER / UNDER, in whole numbers."""
    return common * (OVER + UNDER) >= (a + b) * OVER


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what the links among these classes connect; members of one root are
    connected already."""
    if len(nodes) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True)) if roots[0] != roots[1] else 0
        return [(nodes[0], nodes[1])] if common and _similar(common, len(sets[0]), len(sets[1])) else []
    todo: dict[int, list[int]] = {}
    for i, r in enumerate(roots):
        todo.setdefault(r, []).append(i)
    if len(todo) < 2:
        return []
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.split(flat, np.cumsum(size)[:-1])
    flag, links = np.zeros(len(names), bool), []
    for start in sorted(todo, key=lambda r: (int(size[todo[r]].sum()), r)):
        front = todo.pop(start, [])
        rest = np.array([i for part in todo.values() for i in part], np.int64)
        words = np.concatenate([held[i] for i in rest]) if front and len(rest) else None
        while front and len(rest):
            x = front.pop()
            flag[held[x]] = True
            common = np.add.reduceat(flag[words], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            flag[held[x]] = False
            hits = rest[_similar(common, size[x], size[rest])]
            for i in hits.tolist():
                if roots[i] in todo:
                    links.append((nodes[x], nodes[i]))
                    front += todo.pop(roots[i])
            if len(hits):
                rest = np.array([i for part in todo.values() for i in part], np.int64)
                words = np.concatenate([held[i] for i in rest]) if len(rest) else None
    return links


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``cell, node, root, hashes`` sorted by cell in; links out."""
    cell, held = None, ([], [], [])

    def out(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        cells, nodes, roots = (batch.column(i).to_pylist() for i in range(3))
        for c, node, root, data in zip(cells, nodes, roots, batch.column(3)):
            if c != cell:
                yield from out(forest(*held) if len(held[0]) > 1 else [])
                cell, held = c, ([], [], [])
            for part, x in zip(held, (node, root, np.frombuffer(data.as_buffer(), np.uint64).copy())):
                part.append(x)
    yield from out(forest(*held) if len(held[0]) > 1 else [])


def _links(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of the cells' rows (cell, node, root)."""
    rows = cells.join(sets, "node").select("cell", "node", "root", "hashes")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_cells, "a long, b long").distinct()


def _parts(mass: Column, members: Column, cap: int) -> Column:
    return F.greatest(F.lit(1), F.least(members, F.ceil(mass / F.lit(cap)))).cast("int")


def _inside(rows: DataFrame, cap: int) -> DataFrame:
    """``cell, node, root`` of the first step: each part of a key by itself."""
    part = F.pmod(F.xxhash64("key", "node"), _parts(F.col("mass"), F.col("members"), cap))
    return rows.where(F.col("band") < FIRST).select(F.xxhash64("key", part).alias("cell"), "node", F.col("node").alias("root"))


def _open_keys(rows: DataFrame, cap: int) -> DataFrame:
    """``key, big, a, o``: the keys to compare in the second step, the largest component of each, and
    the parts of its members and of all others."""
    left = rows.where((F.col("band") >= FIRST) | (_parts(F.col("mass"), F.col("members"), cap) > 1))
    by_root = left.groupBy("key", "root").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("members"))
    rank = F.struct("mass", "root")
    found = by_root.groupBy("key").agg(
        F.count(F.lit(1)).alias("roots"), F.max_by("root", rank).alias("big"), F.max("mass").alias("mass"), F.max_by("members", rank).alias("members"), F.sum("mass").alias("all_mass"), F.sum("members").alias("all_members")
    )
    others = _parts(F.col("all_mass") - F.col("mass"), F.col("all_members") - F.col("members"), cap)
    return found.where("roots > 1").select("key", "big", _parts(F.col("mass"), F.col("members"), cap).alias("a"), others.alias("o"))


def _across(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``cell, node, root`` of the second step: (0, part of the largest component, part of the others)
    and (1, part, other part of the others)."""
    is_big = F.col("root") == F.col("big")
    joined = rows.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("key", "node"), F.when(is_big, F.col("a")).otherwise(F.col("o"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    own = F.col("own")
    of_big = F.transform(upto("o"), lambda q: cell(0, own, q))
    of_other = F.concat(F.transform(upto("a"), lambda i: cell(0, i, own)), F.transform(F.filter(upto("o"), lambda q: q != own), lambda q: cell(1, F.least(q, own), F.greatest(q, own))))
    cells = joined.select("key", "node", "root", F.explode(F.when(is_big, of_big).otherwise(of_other)).alias("c"))
    return cells.select(F.xxhash64("key", "c.kind", "c.lo", "c.hi").alias("cell"), "node", "root")


def _keys(classes: DataFrame) -> DataFrame:
    """``key, node, n, band, mass, members`` of the keys that classes share, one for each set of
    members, written. Band 0 are equal fingerprints, and links of ``simhash`` between a class of either."""
    worded = classes.where("n > 0")
    own = worded.select("node", "n", F.posexplode(F.concat(F.array(F.xxhash64(F.lit("fp"), "fp")), "bands")).alias("band", "key"))
    of = materialize(worded.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", "x.node", "x.n"), "near-fingerprints")
    links = simhash.near_links(of.select("fp")).select(F.xxhash64(F.lit("link"), "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("fp"))
    keyed = own.unionByName(links.join(of, "fp").select("node", "n", F.lit(0).alias("band"), "key"))
    who = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"who{i}") for i in (1, 2)]
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("band").alias("band"), F.sum("n").alias("mass"), *who).where("members > 1")
    chosen = shared.groupBy("members", "mass", "who1", "who2").agg(F.min(F.struct("band", "key")).alias("k")).select("k.key", "k.band", "mass", "members")
    rows = materialize(keyed.drop("band").join(chosen, "key"), "near-keys")
    forget(of)
    return rows


def _roots(df: DataFrame, sketches: DataFrame, text_col: str, width: int, cap: int) -> DataFrame:
    """``node, root`` of the classes that are linked to a smaller one."""
    classes = sketches.groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high"), F.min("key").alias("text"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialize(classes, "near-classes")
    if not classes.where("low != high").isEmpty():
        raise ValueError("different shingle sets share a hash")
    rows = _keys(classes)
    wanted = rows.select("node").distinct().join(classes.select("node", F.col("text").alias("key")), "node")
    sets = materialize(_sets(df, wanted, text_col, width), "near-sets")
    found = connected_components(_links(_inside(rows, cap), sets))
    left = _with_roots(rows, found)
    keys = materialize(_open_keys(left, cap), "near-open")
    if not keys.isEmpty():
        found = connected_components(found.toDF("a", "b").unionByName(_links(_across(left, keys), sets)))
    forget(classes, rows, sets, keys)
    return found


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def labelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cap: int = CAP) -> DataFrame:
    """``id, key, root`` for every row: rows with the same root are one component."""
    ship(df.sparkSession)
    sketches = materialize(_sketches(df, id_col, text_col, width), "near-sketches")
    return _with_roots(sketches.select("id", "key", "node"), _roots(df, sketches, text_col, width, cap)).select("id", "key", "root")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cap: int = CAP) -> DataFrame:
    """The rows of ``df`` without those whose component has a row that ranks before them, see
    ``components.one_row_each``.

    Defined cases: a null text counts as empty; texts without words are near copies of each other and
    of nothing else; a text of any length is read whole, a chunk at a time; of equal rows one stays; an
    empty table gives an empty result; columns may have any names.
    """
    return one_row_each(df, labelled(df, id_col, text_col, width, cap), id_col, text_col)
