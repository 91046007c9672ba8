"""Hard negatives by exact integer products of anchors and candidates.

Vectors are quantised to integers and cut into blocks of rows. Every pair of an
anchor block and a candidate block is one cell: a task multiplies the two
matrices with Strassen's recursion on int64 (odd sizes padded with zeros, so
additions are exact and so is every score), and keeps, per anchor, a heap of
the best few. Heaps of cells merge into heaps of anchors.

Two passes go over the cells. The first keeps the best rows of an anchor's own
label, its positives. Each positive's score opens a window below it, and the
second pass keeps the best rows of other labels in each window.

Anchors are a stated set, matched with all rows in blocks; the cells' number is
(anchor blocks) x (candidate blocks), and each block is sent once per cell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.llm.text import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LOW / HIGH of the positive's.
LOW, HIGH = 80, 100
#: Numbers that a block of anchors and one of candidates hold at most.
ANCHOR_VALUES, CANDIDATE_VALUES = 1 << 20, 1 << 22
#: Rows of a block that are multiplied at once, and the side below which the recursion ends.
ANCHOR_TILE, CANDIDATE_TILE, LEAF = 256, 4096, 24
#: Squared length from which a quantised row's scores might not fit (by Cauchy and Schwarz).
MAX_SQUARE = float(1 << 55)
NOTHING = -(1 << 62)


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's seven products; a side of odd size gets a row or column of zeros."""
    n, k, m = *a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a, b = (np.pad(x, [(0, side % 2) for side in x.shape]) if x.shape[0] % 2 or x.shape[1] % 2 else x for x in (a, b))
    (h, i), j = (side // 2 for side in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3 = product(a11 + a22, b11 + b22, leaf), product(a21 + a22, b11, leaf), product(a11, b12 - b22, leaf)
    p4, p5 = product(a22, b21 - b11, leaf), product(a11 + a12, b22, leaf)
    p6, p7 = product(a21 - a11, b11 + b12, leaf), product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * j), np.int64)
    np.add(p1, p4, out=out[:h, :j])
    out[:h, :j] += p7 - p5
    np.add(p3, p5, out=out[:h, j:])
    np.add(p2, p4, out=out[h:, :j])
    np.add(p1, p3, out=out[h:, j:])
    out[h:, j:] += p6 - p2
    return out[:n, :m]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the ``k`` best of each row, ties to the smaller id; ``ids`` ascend, ``NOTHING`` is no score."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k] if scores.size else scores
        row, col = np.nonzero((scores >= np.maximum(least, NOTHING + 1)))
    else:
        row, col = np.nonzero(scores > NOTHING)
    value = scores[row, col]
    order = np.lexsort((col, -value, row))
    row, col, value = row[order], col[order], value[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
    keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
    return row[keep], ids[col[keep]], value[keep]


@dataclass
class Block:
    """Rows of a block in ascending order of id."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(table: pa.Table, dims: int) -> "Block":
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids)
        column = table["vector"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        sizes = np.asarray(column.value_lengths(), np.int64)
        vectors = np.zeros((len(ids), dims), np.int64)
        vectors[np.arange(dims)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return Block(ids[order], table["label"].to_numpy()[order], vectors[order])


def positives_of(anchors: Block, rows: Block, k: int) -> list[tuple[np.ndarray, ...]]:
    """(anchor, positive, score): per anchor the ``k`` best rows of its own label, itself left out."""
    out = []
    for label in np.intersect1d(anchors.labels, rows.labels):
        mine, theirs = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
        columns = rows.vectors[theirs].T
        for a in range(0, len(mine), ANCHOR_TILE):
            at = mine[a:a + ANCHOR_TILE]
            for c in range(0, len(theirs), CANDIDATE_TILE):
                ids = rows.ids[theirs[c:c + CANDIDATE_TILE]]
                scores = product(anchors.vectors[at], columns[:, c:c + CANDIDATE_TILE])
                scores[anchors.ids[at][:, None] == ids[None, :]] = NOTHING
                row, found, score = best(scores, ids, k)
                out.append((anchors.ids[at][row], found, score))
    return out


def negatives_of(anchors: Block, rows: Block, windows: tuple[np.ndarray, ...], k: int, low: int = LOW, high: int = HIGH) -> list[tuple[np.ndarray, ...]]:
    """(anchor, positive, positive's score, negative, score): per window the ``k`` best rows of other labels.

    ``windows`` are (anchor, positive, score), in ascending order of the anchor.
    """
    anchor, positive, top = windows
    first = np.searchsorted(anchor, anchors.ids)
    held = np.searchsorted(anchor, anchors.ids, side="right") - first
    columns, out = rows.vectors.T, []
    for a in range(0, len(anchors.ids), ANCHOR_TILE):
        at = np.arange(a, min(a + ANCHOR_TILE, len(anchors.ids)))
        for c in range(0, len(rows.ids), CANDIDATE_TILE):
            ids = rows.ids[c:c + CANDIDATE_TILE]
            scores = product(anchors.vectors[at], columns[:, c:c + CANDIDATE_TILE])
            scores[anchors.labels[at][:, None] == rows.labels[None, c:c + CANDIDATE_TILE]] = NOTHING
            for j in range(int(held[at].max(initial=0))):
                has = at[held[at] > j]
                w = first[has] + j
                # low * positive <= high * score <= high * positive, in integers.
                least, most = -(-low * top[w] // high), top[w]
                near = scores[has - a]
                row, found, score = best(np.where((near >= least[:, None]) & (near <= most[:, None]), near, NOTHING), ids, k)
                out.append((anchor[w][row], positive[w][row], top[w][row], found, score))
    return out


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, components floor(scale * x) as long.

    Rows without an id, label or vector, with a null or non-finite component,
    or so long that scores would not fit in a long take no part. Of rows that
    share a vec_id the least (label, vector) counts, so repeated rows count
    once.
    """
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double"))
    square = lambda column: F.aggregate(column, F.lit(0.0), lambda s, v: s + v * v)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    fits = whole.where(square("x") < MAX_SQUARE).select("vec_id", "label", F.transform("x", lambda v: v.cast("long")).alias("vector"))
    return fits.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _cut(rows: DataFrame, n: int, name: str) -> DataFrame:
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))


def _each(name: str, n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: int = SCALE, anchor_values: int = ANCHOR_VALUES, candidate_values: int = CANDIDATE_VALUES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on
    vec_id and label. An anchor's positives are its ``positives`` best other
    rows of its label; each one's negatives are the ``negatives`` best rows of
    other labels whose score is at most the positive's and at least ``low`` /
    ``high`` of it. Scores are integer inner products, higher first, ties to
    the smaller vec_id. Fewer rows give fewer results, never an error.

    Which rows take part is said in ``quantised``. A shorter vector counts as
    filled up with zeros. Other columns are ignored; an empty table, no anchor
    or no row of another label gives no rows.
    """
    table = stored(quantised(rows, scale), "vectors")
    spark = rows.sparkSession
    anchors = table.where(is_anchor)
    n, n_anchors, dims = table.agg(F.count("*"), F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dims, cores = max(dims, 1), spark.sparkContext.defaultParallelism
    # Blocks are bounded; small tables are cut finer, so that all cores have a cell.
    n_a = max(1, -(-n_anchors * dims // anchor_values))
    n_c = max(1, -(-n * dims // candidate_values), min(2 * cores // n_a, -(-n // 1024)))
    left = _cut(anchors, n_a, "ablock").select("*", _each("cblock", n_c))
    # Named anew, for the two sides of a cell come from one table.
    right = _cut(table, n_c, "cblock").select(*[F.col(c).alias(c) for c in ("vec_id", "label", "vector", "cblock")], _each("ablock", n_a))
    cell = ["ablock", "cblock"]
    ids = lambda found, *names: pa.table([pa.array(np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64), pa.int64())
                                          for i in range(len(names))], names=list(names))

    def near(key, a: pa.Table, c: pa.Table) -> pa.Table:
        found = positives_of(Block.of(a, dims), Block.of(c, dims), positives) if len(a) and len(c) else []
        return ids(found, "anchor_id", "positive_id", "score")

    def order(score: str, other: str, *by: str):
        return Window.partitionBy(*by).orderBy(F.desc(score), other)

    heaps = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(near, "anchor_id long, positive_id long, score long")
    merged = heaps.withColumn("place", F.row_number().over(order("score", "positive_id", "anchor_id"))).where(F.col("place") <= positives)
    windows = stored(merged.select("anchor_id", "positive_id", "score"), "positives")
    per_anchor = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "score"))).alias("windows"))
    left = _cut(anchors.join(per_anchor, "vec_id"), n_a, "ablock").select("*", _each("cblock", n_c))

    def hard(key, a: pa.Table, c: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        if not len(a) or not len(c):
            return ids([], *names)
        own = [(x, w["positive_id"], w["score"]) for x, ws in sorted(zip(a["vec_id"].to_pylist(), a["windows"].to_pylist())) for w in ws]
        return ids(negatives_of(Block.of(a, dims), Block.of(c, dims), tuple(np.array(own, np.int64).T), negatives, low, high), *names)

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(
        hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(order("negative_score", "negative_id", "anchor_id", "positive_id"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
