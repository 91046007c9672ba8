"""Aggregations and data profiling.

Every profile is one pass with partial (map-side) aggregation; per-column
profiles read all columns in one ``agg`` and are turned into long form with
``unpivot`` (no per-column jobs, no driver loops over data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.operators.quantiles import exact_quantiles


def campaign_conversion_rate(labelled: DataFrame, key: str = "campaign_id",
                             flag: str = "conversion_flag") -> DataFrame:
    """Impressions, conversions and conversion rate per campaign (A1)."""
    return (labelled.groupBy(key)
            .agg(F.count(F.lit(1)).alias("impressions"),
                 F.sum(F.col(flag).cast("bigint")).alias("conversions"),
                 F.avg(F.col(flag).cast("double")).alias("conv_rate")))


def rank_campaigns(rates: DataFrame, by: str = "conv_rate", key: str = "campaign_id") -> DataFrame:
    """Rank by a measure descending, ties by id ascending (A2).

    The window has no partition spec, but it runs over the per-campaign table
    (one row per campaign, bounded by the campaign count), never over facts.
    """
    w = Window.orderBy(F.col(by).desc(), F.col(key).asc())
    return rates.withColumn("rank", F.row_number().over(w).cast("bigint"))


def count_pos_neg(df: DataFrame, flag: str = "conversion_flag") -> DataFrame:
    """Total rows, positives and negatives."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(flag) == 1).alias("n_pos"),
                  F.count_if(F.col(flag) != 1).alias("n_neg"))


def pos_weight(df: DataFrame, flag: str = "conversion_flag") -> DataFrame:
    """Class-imbalance weight neg/pos; 1.0 when there are no positives (A4)."""
    c = count_pos_neg(df, flag)
    return c.select("n_pos", "n_neg",
                    F.when(F.col("n_pos") == 0, F.lit(1.0))
                    .otherwise(F.col("n_neg").cast("double") / F.col("n_pos")).alias("pos_weight"))


def split_label_rate(df: DataFrame, split: str = "split", flag: str = "conversion_flag") -> DataFrame:
    """Row count and label rate per split (A5)."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.avg(F.col(flag).cast("double")).alias("label_rate"))


def missing_counts(df: DataFrame, columns: list[str] | None = None, nonzero_only: bool = True) -> DataFrame:
    """Null count and percentage per column, largest first."""
    cols = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [
        F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = df.agg(*aggs)
    long = wide.unpivot("__n", cols, "column", "n_missing")
    out = long.select("column", "n_missing",
                      (F.col("n_missing") * 100.0 / F.greatest(F.col("__n"), F.lit(1))).alias("pct_missing"))
    if nonzero_only:
        out = out.where(F.col("n_missing") > 0)
    return out


def distinct_profile(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Distinct count per column, exact by default."""
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    wide = df.agg(*[fn(F.col(c)).cast("bigint").alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "n_distinct")


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per numeric column.

    Long form (column, value) first; moments in one grouped pass, quartiles
    with the skew-safe exact quantile operator.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("kv")
    ).select("kv.*")
    mom = long.groupBy("column").agg(
        F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"))
    qs = exact_quantiles(long, ["column"], "x", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return mom.join(qs, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, top, freq per categorical column; ties -> smallest value (A10).

    Long form first (one row per (column, value) after a grouped count), so a
    column with many distinct values never lands in one task as a list.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("kv")).select("kv.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (counts.groupBy("column")
            .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                 F.min_by(F.col("value"), F.struct(F.negative(F.col("n")), F.col("value"))).alias("top"),
                 F.max("n").alias("freq")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value of a column."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, n_bins: int) -> DataFrame:
    """Equal-width histogram of [lo, hi], hi in the last bin; values outside go to bins 0 and n_bins+1."""
    b = F.expr(f"width_bucket(CAST({column} AS DOUBLE), CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), {n_bins})")
    b = F.when(F.col(column) == hi, F.lit(n_bins)).otherwise(b)
    return (df.where(F.col(column).isNotNull()).select(b.cast("bigint").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Contingency table row x col with the column levels fixed up front."""
    return df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1))).fillna(0, subset=values)


def latency_summary(lat: DataFrame, dim: str, value: str = "latency_s") -> DataFrame:
    """Count, mean and exact median of latency per dimension."""
    base = lat.groupBy(dim).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_s"),
                                F.min(value).alias("min_s"), F.max(value).alias("max_s"))
    med = exact_quantiles(lat, [dim], value, {"median_s": 0.5})
    return base.join(med, dim, "left")


def feature_counts(df: DataFrame, cat_prefix: str = "cat_", num_prefix: str = "num_") -> DataFrame:
    """Feature roles by column-name prefix, as a one-row DataFrame.

    Reads only the schema; the row count comes from a pruned ``count``.
    """
    n_cat = sum(1 for c in df.columns if c.startswith(cat_prefix))
    n_num = sum(1 for c in df.columns if c.startswith(num_prefix))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n_cat).cast("bigint").alias("n_cat"), F.lit(n_num).cast("bigint").alias("n_num"), "n_rows")
