"""Skew-safe ranking and running sums (two-level prefix sums).

A window ``partition by g order by k`` puts a whole group in one task; when
one group holds a third of all rows that task holds a third of the data.
Here the order key is cut into blocks: (1) count or sum per (group, block),
a small table; (2) a window over blocks of each group gives the block offset;
(3) the fine window runs per (group, block), which spreads a hot group over
many tasks. The result equals the single window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adspark.session import staged


def ranked_within(df: DataFrame, by: list[str], order_u: Column, tiebreak: str,
                  n_blocks: int, max_rank: int | None = None, rank_col: str = "_rank") -> DataFrame:
    """1-based rank within ``by`` ordered by (order_u, tiebreak); order_u must lie in [0, 1).

    ``n_blocks`` cuts [0, 1); callers take it from the number of rows (``blocks_for``).
    ``max_rank`` drops rows of blocks that start past the cap before the fine
    window, so a sample of n per group never sorts the whole group.
    """
    d = (df.withColumn("_ou", order_u)
           .withColumn("_blk", F.least(F.floor(F.col("_ou") * n_blocks), F.lit(n_blocks - 1)).cast("int")))
    cnt = d.groupBy(*by, "_blk").agg(F.count(F.lit(1)).alias("_bn"))
    wo = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("_off", F.coalesce(F.sum("_bn").over(wo), F.lit(0))).drop("_bn")
    if max_rank is not None:
        off = off.where(F.col("_off") < max_rank)
    j = d.join(off, [*by, "_blk"], "inner")
    wf = Window.partitionBy(*by, "_blk").orderBy("_ou", tiebreak)
    out = j.withColumn(rank_col, F.col("_off") + F.row_number().over(wf))
    if max_rank is not None:
        out = out.where(F.col(rank_col) <= max_rank)
    return out.drop("_ou", "_blk", "_off")


def range_blocks(df: DataFrame, order: list[Column], rows_per_block: int = 1_000_000, block_col: str = "_b") -> DataFrame:
    """Cut rows into consecutive ranges of ``order``, about ``rows_per_block`` each; ``_b`` numbers them.

    The number of blocks grows with the rows, and the cuts follow the data
    (Spark's sampled range bounds), so neither a hot group nor values crowded
    in a narrow range end up in one block. Rows that tie in ``order`` share a
    block. The rows are written once, which tells their number; where they fit
    one block that is all, else the cut rows are written again, which keeps the
    numbers fixed.
    """
    df = staged(df, "rows")
    n = max(1, -(-df.count() // rows_per_block))
    if n == 1:
        return df.withColumn(block_col, F.lit(0))
    return staged(df.repartitionByRange(n, *order).withColumn(block_col, F.spark_partition_id()), "blocks")


def blocks_for(n_rows: int, rows_per_block: int = 100_000) -> int:
    """Blocks that hold about ``rows_per_block`` rows each."""
    return max(1, -(-n_rows // rows_per_block))


def running_sum_ranged(df: DataFrame, order: list[str], value_col: str, rows_per_block: int = 1_000_000, out_col: str = "_cum") -> DataFrame:
    """Running sum (inclusive) of ``value_col`` over all rows in ``order``, whose blocks follow the data (``range_blocks``).

    ``order`` must be unique. Sums run per block; the offsets are a window over one row per block.
    """
    cut = range_blocks(df, [F.col(c) for c in order], rows_per_block)
    tot = cut.groupBy("_b").agg(F.sum(value_col).alias("_bs"))
    off = tot.select("_b", F.coalesce(F.sum("_bs").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"))
    own = Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("_in", F.sum(value_col).over(own))
    return inside.join(off, "_b").withColumn(out_col, F.col("_off") + F.col("_in")).drop("_b", "_in", "_off")


def running_sum_blocked(df: DataFrame, by: list[str], order_col: str, value_col: str,
                        block_size: int, out_col: str = "_cum", inclusive: bool = True) -> DataFrame:
    """Running sum of ``value_col`` within ``by`` ordered by an integer ``order_col``.

    Blocks are ``floor(order_col / block_size)``; order values must be unique
    within a group (ids). The fine window runs per (group, block), the block
    totals are a second read of ``df``: hand in a written or persisted table
    where its rows are costly.
    """
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_size)).cast("bigint"))
    wf = Window.partitionBy(*by, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    w1 = d.withColumn("_in", F.coalesce(F.sum(value_col).over(wf), F.lit(0.0)))
    tot = w1.groupBy(*by, "_blk").agg(F.sum(value_col).alias("_bs"))
    wo = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_bs").over(wo), F.lit(0.0))).drop("_bs")
    j = w1.join(off, [*by, "_blk"], "inner")
    cum = F.col("_off") + F.col("_in")
    if not inclusive:
        cum = cum - F.coalesce(F.col(value_col), F.lit(0.0))
    return j.withColumn(out_col, cum).drop("_blk", "_off", "_in")


#: Tasks that ``spread`` makes of each partition of the scan, or of each core where there are more.
SPREAD = 4


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over equal tasks, more of them the more partitions the scan has.

    CPU-heavy per-row work (scoring every candidate of every impression)
    should not run in a handful of tasks because of how the files were written.
    The number of scan partitions does not tell: a file is cut by bytes, but a
    row group is read by one task, so a scan of many partitions may have all
    its rows in one of them.
    """
    if df.isStreaming:
        return df
    return df.repartition(min_partitions or SPREAD * max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
