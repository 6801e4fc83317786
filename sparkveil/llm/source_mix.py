"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources share the budget by weight; a target stops at ``max_passes`` times its source
   and the excess is shared again by weight until none is above (water filling over sources).
2. Blocks of ``block_words`` words go to sources by highest quotients target / (2k + 1).
3. Inside a source the documents fall by a seeded hash into shards of about ``shard_words`` words.
   The source's blocks are shared out among its shards in whole numbers by largest remainders, down a
   tree of ``FAN`` branches, so that the quotas of any branch sum to its own and no sort is over more
   than ``FAN`` rows.
4. A shard lays its documents out in seeded order, takes whole passes while its quota covers all of
   its blocks, and the rest as consecutive blocks on a ring from a seeded block. As the order of
   documents is random, so are the blocks, and all but a few documents are taken whole.

Only one row per source (the weights are given per source) comes to the driver. The words are dealt
by (source, shard), so a source with a third of all rows is as many shards as its size asks for, and
no task grows with the corpus.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkveil.session import materialize

WORD_SPACE = " \t\n\u000b\u000c\r"
#: The most sources a mix may name: each has a weight of its own, which somebody has to state.
MAX_SOURCES = 100_000
#: Branches of the tree of a source's shards.
FAN = 1024


def word_count(text: Column) -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    bare = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD_SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def water_fill(sizes: dict, weights: dict, budget: Fraction, max_passes: int = 2) -> dict:
    """The target of each source."""
    caps = {s: Fraction(max_passes * n) for s, n in sizes.items()}
    targets, open_, left = {}, dict(caps), Fraction(budget)
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s, cap in open_.items() if share * weights[s] >= cap]
        if not full:
            return targets | {s: share * weights[s] for s in open_}
        for s in full:
            targets[s] = open_.pop(s)
            left -= targets[s]
    return targets


def sainte_lague(votes: dict, seats: int) -> dict:
    """Seats by highest quotient votes / (2k + 1); of equal quotients the earlier key wins.

    Starts from round(votes / divisor), itself the result for its own number of seats, and gives or
    takes single seats from there, at most half as many as there are parties.
    """
    total = sum(votes.values())
    if not total or seats <= 0:
        return dict.fromkeys(votes, 0)
    won = {s: int(Fraction(v) * seats / total + Fraction(1, 2)) for s, v in votes.items()}
    order = {s: i for i, s in enumerate(votes)}
    missing = seats - sum(won.values())
    if missing > 0:
        heap = [(-Fraction(v) / (2 * won[s] + 1), order[s], s) for s, v in votes.items()]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i, s = heap[0]
            won[s] += 1
            heapq.heapreplace(heap, (-Fraction(votes[s]) / (2 * won[s] + 1), i, s))
    elif missing < 0:
        heap = [(Fraction(v) / (2 * won[s] - 1), -order[s], s) for s, v in votes.items() if won[s]]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i, s = heapq.heappop(heap)
            won[s] -= 1
            if won[s]:
                heapq.heappush(heap, (Fraction(votes[s]) / (2 * won[s] - 1), i, s))
    return won


def cycle_weights(cycle: tuple = (3, 1, 2)) -> Callable[[list], dict]:
    """Weights for sources in code point order, null last, repeating the given ones."""
    return lambda sources: {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}


def shard_quotas(totals: DataFrame, shards: int, fan: int = FAN) -> DataFrame:
    """``source, shard, _all, _quota``: the blocks of each source (``_quota`` of its rows) shared out
    among its shards in proportion to their words (``_all``), in whole numbers that sum to them.

    A source's shards, ``shards`` at most, are the leaves of a tree in which each branch has ``fan``
    at most; the branch's quota goes to these by largest remainders, of ties to the lower number.
    """
    rows = totals
    for step in range(math.ceil(math.log(max(shards, 2), fan) - 1e-9) - 1, -1, -1):
        below, above = fan**step, fan ** (step + 1)
        rows = rows.withColumn("_node", F.expr(f"shard div {below}")).withColumn("_up", F.expr(f"shard div {above}"))
        nodes = rows.groupBy("source", "_up", "_node").agg(F.sum("_all").cast("decimal(38,0)").alias("_w"), F.first("_quota").alias("_given"))
        branch = Window.partitionBy("source", "_up")
        nodes = nodes.withColumn("_sum", F.sum("_w").over(branch).cast("decimal(38,0)"))
        share = F.expr("if(_sum = 0, 0BD, _w * _given)").cast("decimal(38,0)")
        nodes = nodes.withColumn("_share", share).withColumn("_base", F.expr("if(_sum = 0, 0L, _share div _sum)").cast("long")).withColumn("_rest", F.expr("if(_sum = 0, 0BD, _share % _sum)"))
        left = F.col("_given") - F.sum("_base").over(branch)
        rank = F.row_number().over(branch.orderBy(F.desc("_rest"), "_node"))
        nodes = nodes.withColumn("_won", F.col("_base") + ((rank <= left) & (F.col("_sum") > 0)).cast("long"))
        nodes = nodes.select(F.col("source").alias("_s"), F.col("_node").alias("_n"), "_won")
        rows = rows.join(nodes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_node") == F.col("_n"))).select("source", "shard", "_all", F.col("_won").alias("_quota"))
    return rows


def mix_sources(
    df: DataFrame,
    weights: dict | Callable[[list], dict],
    ratio: Fraction = Fraction(3, 2),
    max_passes: int = 2,
    block_words: int = 16,
    shard_words: int = 1 << 17,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_row: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken, passes, spans``.

    ``taken`` is ``passes * size`` plus the words of ``spans``, pieces [from, to) of the document's
    words. ``weights`` maps each source, or all sources in order, to a weight above 0. Reruns agree.

    Defined cases: a null or wordless text has size 0 and nothing is taken of it; null is a source
    of its own, last in order; a source without words has target 0; a text of any length is counted
    whole; rows that agree in id and size are laid out by their texts; repeated rows are documents of
    their own; an empty table gives an empty result; other columns are ignored, or with ``with_row``
    the whole input row travels along as ``row``.
    """
    spark, names = df.sparkSession, df.columns
    packed = df.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text, source = (F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col))
    columns = [doc_id.alias("doc_id"), source.cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.lit("text"), text.cast("string")).alias("_text")]
    # Words are counted once, into a table without texts; only ``with_row`` reads the texts again.
    sized = materialize(packed.select(*columns), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    found = {r["source"]: r["n"] for r in sorted(sizes, key=lambda r: (r["source"] is None, r["source"] or ""))}
    given = weights(list(found)) if callable(weights) else weights
    budget = Fraction(ratio) * sum(found.values())
    targets = water_fill(found, given, budget, max_passes)
    blocks = sainte_lague({s: targets[s] for s in found}, round(budget / block_words))
    plan = spark.createDataFrame([(s, n, float(targets[s]), blocks[s], max(1, -(-n // shard_words))) for s, n in found.items()], "plan_source string, source_size long, target double, source_blocks long, shards long")

    def sharded(rows: DataFrame) -> DataFrame:
        # One row for each source, of which there are MAX_SOURCES at most.
        rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
        return rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("shards")))

    totals = sharded(sized).groupBy("source", "shard").agg(F.sum("size").alias("_all"), F.first("source_blocks").alias("_quota"))
    most = max((n for n in found.values()), default=0)
    quotas = materialize(shard_quotas(totals, max(1, -(-most // shard_words))), "mix-quotas").select(F.col("source").alias("_s"), F.col("shard").alias("_n"), "_quota")
    rows = sharded(packed.select(*columns, F.struct(*packed.columns).alias("row")) if with_row else sized)
    rows = rows.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_n")))
    shard = Window.partitionBy("source", "shard")
    order = shard.orderBy("_h", "doc_id", "size", "_text")
    rows = (
        rows.withColumn("_h", F.xxhash64(F.lit(seed), F.lit("order"), F.col("doc_id")))
        .withColumn("_hi", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_all", F.sum("size").over(shard))
        .withColumn("_lo", F.col("_hi") - F.col("size"))
        .withColumn("_blocks", F.expr(f"(_all + {block_words - 1}) div {block_words}"))
        .withColumn("_quota", F.least(F.col("_quota"), max_passes * F.col("_blocks")))
        .withColumn("passes", F.expr("if(_blocks = 0, 0, _quota div _blocks)"))
        .withColumn("_from", F.expr("if(_blocks = 0, 0, pmod(xxhash64(" + str(seed) + f", source, shard), _blocks) * {block_words})"))
        .withColumn("_to", F.expr(f"if(_blocks = 0, 0, _from + (_quota % _blocks) * {block_words})"))
        .withColumn("_ring", F.col("_blocks") * block_words)
    )
    first = F.struct(F.greatest("_lo", "_from").alias("a"), F.least("_hi", "_to").alias("b"))
    second = F.struct(F.col("_lo").alias("a"), F.least(F.col("_hi"), F.col("_to") - F.col("_ring")).alias("b"))
    spans = F.transform(F.filter(F.array(first, second), lambda s: s["b"] > s["a"]), lambda s: F.struct((s["a"] - F.col("_lo")).cast("long").alias("from"), (s["b"] - F.col("_lo")).cast("long").alias("to")))
    rows = rows.withColumn("spans", spans)
    part = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), F.col("passes").cast("long").alias("passes"), "spans", *(["row"] if with_row else []))


def mixed_documents(df: DataFrame, weights, text_col: str = "text", **kw) -> DataFrame:
    """The documents that the mix consists of, one row for each pass or piece, with all columns of
    ``df``, of any names. A piece of a document is its words with single spaces between them; a
    document without words has none. Other cases are those of ``mix_sources``."""
    names = df.columns
    mixed = mix_sources(df, weights, text_col=text_col, with_row=True, **kw)
    text = F.coalesce(F.col(f"row.c{names.index(text_col)}").cast("string"), F.lit(""))
    words = F.split(F.btrim(text, F.lit(WORD_SPACE)), r"[\x20\x09-\x0D]+")
    whole = F.array_repeat(text, F.col("passes").cast("int"))
    pieces = F.transform("spans", lambda s: F.when((s["from"] == 0) & (s["to"] == F.col("size")), text).otherwise(F.array_join(F.slice(words, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")), " ")))
    rows = mixed.where("size > 0").select("row", F.explode(F.concat(whole, pieces)).alias("_text"))
    return rows.select(*[F.col("_text") if n == text_col else F.char_length("_text").cast("long") if n == "n_chars" else F.col(f"row.c{i}") for i, n in enumerate(names)]).toDF(*names)
