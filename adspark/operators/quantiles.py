"""Exact quantiles without holding a group in one task.

``percentile`` keeps every value of a group in one aggregation buffer: with a
campaign holding a third of all rows that is one task with a third of the
data. Here the work is:

1. count rows per (group, distinct value) - partial aggregation, so a value
   repeated a billion times is one row after the map side;
2. cut all (group, value) rows into consecutive ranges that follow the data,
   so a hot group spans many blocks and a small one shares a block;
3. two-level cumulative counts over the distinct values (totals per group and
   block, block offsets, then a window per (group, block));
4. per group and probability, pick the values at ranks floor(p(n-1)) and
   ceil(p(n-1)) and interpolate linearly (the "continuous" definition).

The result equals the exact percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.operators.ordering import range_blocks


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: dict[str, float],
                    rows_per_block: int = 1_000_000) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability).

    ``group_cols`` must be non-empty (add a constant column for one global group).
    """
    if not group_cols:
        raise ValueError("exact_quantiles needs at least one group column")
    v = F.col(value_col).cast("double")
    vals = (df.where(v.isNotNull()).groupBy(*group_cols, v.alias("_v"))
            .agg(F.count(F.lit(1)).alias("_c")))
    j = range_blocks(vals, [F.col(c) for c in (*group_cols, "_v")], rows_per_block)
    tot = j.groupBy(*group_cols, "_b").agg(F.sum("_c").alias("_bc"))
    wg = Window.partitionBy(*group_cols)
    wo = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group_cols, "_b", F.coalesce(F.sum("_bc").over(wo), F.lit(0)).alias("_off"), F.sum("_bc").over(wg).alias("_n"))
    wf = Window.partitionBy(*group_cols, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group_cols]
    cum = j.withColumn("_in", F.coalesce(F.sum("_c").over(wf), F.lit(0))).alias("l").join(
        off.alias("r"), [*same, F.col("l._b") == F.col("r._b")])
    cum = cum.select(*[F.col(f"l.{c}").alias(c) for c in group_cols], "_v", "_n", (F.col("_off") + F.col("_in")).alias("_before"),
                     (F.col("_off") + F.col("_in") + F.col("_c")).alias("_upto"))
    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((F.col("_before") <= lo) & (lo < F.col("_upto")), F.col("_v"))).alias(f"{name}__lo"))
        aggs.append(F.max(F.when((F.col("_before") <= hi) & (hi < F.col("_upto")), F.col("_v"))).alias(f"{name}__hi"))
        aggs.append(F.first(pos - lo).alias(f"{name}__f"))
    picked = cum.groupBy(*group_cols).agg(*aggs)
    outs = [(F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__f")).alias(n) for n in probs]
    return picked.select(*group_cols, *outs)
