"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash, and each epoch is a
permutation of its blocks. The mix takes whole epochs and, of the last one, the
first blocks and the documents after them that still fit, so each source has an
exact quota of blocks.
The quotas of all sources are split among the output shards by a tree: a node
hands its left half a multivariate-hypergeometric draw of its quotas, the rest
goes right, down to single shards. Each shard then takes the next blocks of
each source in permuted order, so blocks are disjoint, and orders its
documents by a hash.

The tree is seeded by node, so a shard's quotas can be computed anywhere, again
and alike: each task walks from the root to its own shards. What the driver
holds is one row per source, like the weights themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adspark.llm.text import n_words, stored
from adspark.operators.ordering import running_sum_blocked

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Words and documents that a block holds on average, and blocks that a shard holds.
BLOCK_WORDS = 1 << 16
BLOCK_DOCS = 1 << 12
SHARD_BLOCKS = 64
SEED = 17
SHUFFLE_ROUNDS = 24
#: Blocks of a source that one task looks at to fill the words left after the last whole block.
TAIL_BLOCKS = 8
MAX_BROADCAST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], total: float, max_epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of ``total`` by weight, each at most ``max_epochs`` times its size.

    What a full source cannot take is shared again among the others by weight,
    until none is above. A weight of zero takes nothing.
    """
    out, free, rest = [0.0] * len(sizes), {i for i, w in enumerate(weights) if w > 0}, float(total)
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit > max_epochs * sizes[i]]
        for i in full:
            out[i] = float(max_epochs * sizes[i])
        if not full:
            for i in free:
                out[i] = weights[i] * unit
            break
        free -= set(full)
        rest -= sum(out[i] for i in full)
    return out


def split_quota(quotas: np.ndarray, n_shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source that a shard takes, and those that shards before it take."""
    quotas, before = np.asarray(quotas, np.int64), np.zeros(len(quotas), np.int64)
    lo, hi = 0, n_shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(quotas.sum())
        want = total * (mid - lo) // (hi - lo)
        left = _hypergeometric(np.random.default_rng([seed, lo, hi]), quotas, want)
        if shard < mid:
            quotas, hi = left, mid
        else:
            before, quotas, lo = before + left, quotas - left, mid
    return quotas, before


def _hypergeometric(rng: np.random.Generator, quotas: np.ndarray, want: int) -> np.ndarray:
    """A multivariate-hypergeometric draw, source by source."""
    out, rest = np.zeros_like(quotas), int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        out[i] = k = int(rng.hypergeometric(q, rest, want)) if q and want else 0
        want -= k
    return out


def _permuted(block: Column, n: Column, epoch: Column) -> Column:
    """Place of a block in an epoch: a permutation of 0 to n - 1 of its own for each epoch and n.

    A swap-or-not shuffle: each round pairs every place with its mirror image
    about a drawn point, and a hash of the pair decides whether the two swap.
    Every round is a bijection for any n, and a task needs no table of places.
    """
    def swap(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, epoch, F.lit(SEED), n), n) - at, n)
        return F.when(F.pmod(F.xxhash64(r, F.greatest(at, mirror), epoch, F.lit(SEED)), F.lit(2)) == 1, mirror).otherwise(at)
    return F.aggregate(F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS)), block.cast("long"), swap)


@dataclass
class Mix:
    """sources: source, source_size, target. sizes: doc_id, source, text_hash, size of each document.

    draws: one row per document and copy that the mix takes, with its epoch,
    shard and ``place``, the order within the shard.
    """

    sources: DataFrame
    sizes: DataFrame
    draws: DataFrame


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, block_words: int = BLOCK_WORDS,
        block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS) -> Mix:
    """Plan the mix (see ``Mix``); ``mixed`` gives the documents themselves.

    Sources in code point order, null last, get ``weights`` in turn, again and
    again. Sizes are words; targets share ``share`` of all words. Documents of
    a source that share id and text are drawn together. Of the last epoch the
    blocks are taken whole as long as they fit; then come, in permuted order to
    its end, the documents that still fit, so what a source misses of its
    target is less than its smallest document left over. A source without words
    takes nothing; texts that are null or empty have size 0; an empty table
    has no sources. Other columns are ignored. A copy count never exceeds
    ``max_epochs``.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"),
                        F.xxhash64("text").alias("text_hash"), n_words("text").alias("size"))
    sized = stored(sized, "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in rows]
    goal = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(rows))], share * sum(sizes), max_epochs)
    blocks = [max(1, -(-s // block_words), -(-r.docs // block_docs)) for r, s in zip(rows, sizes)]
    whole = [min(max_epochs, math.floor(g / s + 1e-12)) if s else 0 for g, s in zip(goal, sizes)]
    rest = [max(0, round(g - e * s)) if e < max_epochs else 0 for g, e, s in zip(goal, whole, sizes)]
    plan = spark.createDataFrame([(i, r.source, s, float(g), n, e, x) for i, (r, s, g, n, e, x) in enumerate(zip(rows, sizes, goal, blocks, whole, rest))],
                                 "no int, source string, source_size long, target double, n_blocks long, whole int, rest long")
    if len(rows) <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = sized.join(plan, sized.source.eqNullSafe(plan.source)).select(
        "doc_id", sized.source, "text_hash", "size", "no", "n_blocks", "whole", "rest",
        F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(SEED)), F.col("n_blocks")).alias("block"))

    # The epoch taken in part: words up to each block in permuted order.
    part = joined.where("rest > 0").withColumn("rank", _permuted(F.col("block"), F.col("n_blocks"), F.col("whole")))
    totals = part.groupBy("no", "rank", "rest").agg(F.sum("size").cast("double").alias("words"))
    upto = stored(running_sum_blocked(totals, ["no"], "rank", "words", 1 << 12, "upto"), "blocks")
    cut = upto.where(F.col("upto") > F.col("rest")).groupBy("no").agg(
        F.min_by(F.struct("rank", (F.col("rest") - F.col("upto") + F.col("words")).cast("long").alias("left")), "rank").alias("cut"))
    cut = cut.select(F.col("no"), F.col("cut.rank").alias("cut_rank"), F.col("cut.left").alias("left"))
    cuts = stored(cut, "cuts")  # one row per source at most
    part = part.join(cuts.select("no", "cut_rank"), "no", "left")
    inside = part.where(F.col("cut_rank").isNull() | (F.col("rank") < F.col("cut_rank")))
    units = part.where(F.col("rank") >= F.col("cut_rank")).groupBy("no", "rank", "doc_id", "text_hash").agg(F.sum("size").alias("size"))
    fits = _fitting(units.where("size > 0"), cuts.select("no", "left"))
    fits = fits.select(F.col("no").alias("f_no"), F.col("doc_id").alias("f_doc"), F.col("text_hash").alias("f_hash"))
    edge = part.where(F.col("rank") >= F.col("cut_rank")).join(fits, (F.col("no") == F.col("f_no")) & F.col("doc_id").eqNullSafe(F.col("f_doc")) & (F.col("text_hash") == F.col("f_hash")), "left_semi")
    edge = edge.withColumn("rank", F.col("cut_rank"))  # they share the place of the block that did not fit
    last = inside.unionByName(edge).select("no", "doc_id", "source", "text_hash", "size", "n_blocks", F.col("whole").alias("epoch"), "rank")
    first = joined.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    first = first.withColumn("rank", _permuted(F.col("block"), F.col("n_blocks"), F.col("epoch")))
    drawn = first.select(*last.columns).unionByName(last)

    # Quotas in blocks: whole epochs, then those before the cut and the cut block.
    cut_rank = {r["no"]: r["cut_rank"] for r in cuts.collect()}
    quotas = [e * n + ((cut_rank[i] + 1 if i in cut_rank else n) if x else 0) for i, (e, n, x) in enumerate(zip(whole, blocks, rest))]
    shares = _shares(spark, quotas, max(1, -(-sum(quotas) // shard_blocks)))
    at = F.col("epoch") * F.col("n_blocks") + F.col("rank")
    draws = drawn.withColumn("at", at).join(shares, ["no", "at"]).select(
        "doc_id", "source", "text_hash", "size", "epoch", "shard", F.xxhash64("doc_id", "text_hash", "epoch", "shard").alias("place"))
    return Mix(plan.select("source", "source_size", "target"), sized, draws)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, a row per copy, gathered by shard and shuffled within it.

    Returns the columns of ``docs``; see ``mix`` for ``how`` and the edge cases.
    """
    keys = ["doc_id", "source", "text_hash"]
    # A document is drawn once per epoch at most; identical rows are drawn alike.
    draws = mix(docs, **how).draws.groupBy(*keys).agg(F.collect_set(F.struct("epoch", "shard", "place")).alias("copies"))
    draws = draws.select(*[F.col(k).alias(f"d_{k}") for k in keys], "copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").alias("source"), F.xxhash64("text").alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("d_doc_id")) & F.col("source").eqNullSafe(F.col("d_source")) & (F.col("text_hash") == F.col("d_text_hash"))
    copies = rows.join(draws, same).select("row", F.explode("copies").alias("copy")).select("row", "copy.*")
    return copies.repartition("shard").sortWithinPartitions("shard", "place").select("row.*")


def _fitting(units: DataFrame, left: DataFrame) -> DataFrame:
    """(no, doc_id, text_hash): of each source's ``units``, in order, those that fit in the words that are ``left``.

    A round looks at the units that fit by themselves in the next
    ``TAIL_BLOCKS`` blocks that have any: the first always fits, and one that
    is passed over never fits later, for what is left only shrinks. Rounds go
    on until nothing fits; mostly one or two, since a round fills what its
    documents can fill. A task holds a few blocks of one source.
    """
    order = [F.col("rank"), F.col("h"), F.col("doc_id"), F.col("text_hash")]
    units = stored(units.withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(SEED))), "tail")
    left = left.withColumn("after", F.lit(-1).cast("long"))
    fields = "no int, doc_id string, text_hash long, size long, rank long, h long, taken boolean, left long"

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        rest, taken = int(rows["left"].iloc[0]), []
        for size in rows["size"].tolist():
            taken.append(size <= rest)
            rest -= size if taken[-1] else 0
        return rows.assign(taken=taken, left=rest)[["no", "doc_id", "text_hash", "size", "rank", "h", "taken", "left"]]

    found = []
    while True:
        fit = units.join(left, "no").where((F.col("size") <= F.col("left")) & (F.col("rank") > F.col("after")))
        ranks = fit.select("no", "rank").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("no").orderBy("rank")))
        ranks = stored(ranks.where(F.col("nth") <= TAIL_BLOCKS).select("no", "rank"), "tail-blocks")
        near = fit.join(ranks, ["no", "rank"]).withColumn("n", F.row_number().over(Window.partitionBy("no").orderBy(*order)))
        # Ids as text, since pandas would turn ids beside a null into floats.
        looked = near.select("no", F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "size", F.col("rank").cast("long").alias("rank"), "h", "left", "n")
        seen = stored(looked.groupBy("no").applyInPandas(choose, fields), "tail-taken").withColumn("doc_id", F.col("doc_id").cast("long"))
        if seen.limit(1).count() == 0:
            break
        found.append(seen.where("taken").select("no", "doc_id", "text_hash"))
        left = stored(seen.groupBy("no").agg(F.first("left").alias("left"), F.max("rank").alias("after")), "tail-left")
    return reduce(DataFrame.unionByName, found) if found else units.select("no", "doc_id", "text_hash").limit(0)


def _shares(spark: SparkSession, quotas: list[int], n_shards: int) -> DataFrame:
    """(no, at, shard) of every block in the mix: one row per block."""

    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                mine, before = split_quota(quotas, n_shards, shard)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (
                    (np.full(len(mine), shard), pa.int64()), (np.arange(len(mine)), pa.int32()), (before, pa.int64()), (mine, pa.int64()))],
                    names=["shard", "no", "start", "n"])

    quota = spark.range(n_shards).mapInArrow(run, "shard long, no int, start long, n long").where("n > 0")
    return quota.select("shard", "no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at"))
