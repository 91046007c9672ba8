"""Policy analytics over auction logs (L1-L6) and run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.operators.quantiles import exact_quantiles
from adspark.session import materialize


#: Periods of a comparison: a hundred years of days.
MAX_PERIODS = 36_525


def _won(c):
    return F.when(F.col("win"), c).otherwise(F.lit(0.0))


def policy_comparison(logs: DataFrame) -> DataFrame:
    """Per policy: impressions, wins, spend, expected conversions, value uplift, CPA (L1, L3, L4)."""
    return (logs.groupBy("policy")
            .agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("win")).alias("wins"),
                 F.sum(_won(F.col("market_price"))).alias("spend"),
                 F.sum(_won(F.col("pconv"))).alias("expected_conversions"),
                 F.sum(_won(F.col("expected_value") - F.col("market_price"))).alias("revenue_uplift"))
            .withColumn("cpa", F.when(F.col("expected_conversions") == 0, F.lit(None))
                        .otherwise(F.col("spend") / F.col("expected_conversions"))))


def _per_period(logs: DataFrame, time_col: str) -> DataFrame:
    """Spend and expected conversions of every policy in every period that any policy has.

    The grid is policies x periods, a small table made from the totals; a
    policy without a row in a period spent nothing in it.
    """
    per = (logs.groupBy("policy", time_col)
           .agg(F.sum(_won(F.col("market_price"))).alias("spend"),
                F.sum(_won(F.col("pconv"))).alias("conv")))
    per = materialize(per)  # one row per policy and period: the facts are read once
    periods = sorted(r[0] for r in per.select(time_col).distinct().limit(MAX_PERIODS + 1).collect())
    if len(periods) > MAX_PERIODS:
        raise ValueError(f"more than {MAX_PERIODS} periods: use longer ones")
    grid = per.select("policy").distinct().select("policy", F.explode(F.array(*map(F.lit, periods))).alias(time_col))
    return grid.join(per, ["policy", time_col], "left").fillna(0.0, ["spend", "conv"])


def _marginal(rows: DataFrame, time_col: str, spend0: str, conv0: str) -> DataFrame:
    d_conv, d_spend = F.col("conv") - F.col(conv0), F.col("spend") - F.col(spend0)
    return rows.select("policy", time_col, d_spend.alias("delta_spend"), d_conv.alias("delta_conv"),
                       F.when(d_conv == 0, F.lit(None)).otherwise(d_spend / d_conv).alias("marginal_cpa"))


def marginal_cpa(logs: DataFrame, baseline: str, time_col: str = "day") -> DataFrame:
    """Delta spend / delta expected conversions against a baseline policy, per period (L2).

    Every period that any policy has gets a row per policy: one in which only
    the baseline spent counts as a saving.
    """
    per = _per_period(logs, time_col)
    base = per.where(F.col("policy") == baseline).select(time_col, F.col("spend").alias("_s0"), F.col("conv").alias("_c0"))
    return _marginal(per.where(F.col("policy") != baseline).join(base, time_col), time_col, "_s0", "_c0")


def marginal_cpa_window(logs: DataFrame, time_col: str = "day") -> DataFrame:
    """Delta spend / delta expected conversions of each policy from one period to the next (L2, tumbling windows)."""
    w = Window.partitionBy("policy").orderBy(time_col)
    per = (_per_period(logs, time_col).withColumn("_s0", F.lag("spend").over(w)).withColumn("_c0", F.lag("conv").over(w))
           .where(F.col("_s0").isNotNull()))
    return _marginal(per, time_col, "_s0", "_c0")


def pacing_error(log: DataFrame, budgets: DataFrame, n_periods: int, time_col: str = "day") -> DataFrame:
    """|actual cumulative spend - planned| / planned per campaign and period.

    Planned spend is budget * (period index + 1) / n_periods (a linear plan,
    our definition). Periods are 0-based integers. Every campaign has a row in
    every period: one that never spent has error 1.
    """
    per = log.groupBy("campaign_id", time_col).agg(F.sum(_won(F.col("market_price"))).alias("spend"))
    grid = budgets.select("campaign_id", "budget", F.explode(F.sequence(F.lit(0), F.lit(int(n_periods) - 1))).alias(time_col))
    w = Window.partitionBy("campaign_id").orderBy(time_col).rowsBetween(Window.unboundedPreceding, 0)
    cum = grid.join(per, ["campaign_id", time_col], "left").fillna(0.0, ["spend"]).withColumn("cum_spend", F.sum("spend").over(w))
    planned = F.col("budget") * (F.col(time_col) + 1) / F.lit(float(n_periods))
    return cum.select("campaign_id", time_col, "cum_spend", planned.alias("planned"),
                      (F.abs(F.col("cum_spend") - planned) / planned).alias("pacing_error"))


def auction_summary(log: DataFrame) -> DataFrame:
    """Per campaign: impressions, wins, win rate, spend, median and p90 price."""
    base = (log.groupBy("campaign_id")
            .agg(F.count(F.lit(1)).alias("impressions"), F.count_if(F.col("win")).alias("wins"),
                 F.avg(F.col("win").cast("double")).alias("win_rate"),
                 F.sum(_won(F.col("market_price"))).alias("spend")))
    qs = exact_quantiles(log, ["campaign_id"], "market_price", {"median_price": 0.5, "p90_price": 0.9})
    return base.join(qs, "campaign_id", "left")


def run_summary(log: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Run totals: processed, wins, spend, utility, expected conversions, remaining budget.

    One pass over the log makes a row per campaign; the totals come from those.
    """
    gain = _won(F.col("expected_value") - F.col("market_price"))
    per = materialize(log.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("win")).alias("wins"), F.sum(_won(F.col("market_price"))).alias("spend"),
        F.sum(gain).alias("total_utility"), F.sum(_won(F.col("pconv"))).alias("expected_conversions")))
    left = campaigns.select("campaign_id", "budget").join(per.select("campaign_id", "spend"), "campaign_id", "left") \
        .select((F.col("budget") - F.coalesce(F.col("spend"), F.lit(0.0))).alias("remaining"))
    rem = left.agg(F.sum("remaining").alias("total_remaining"), F.avg("remaining").alias("avg_remaining"),
                   F.count_if(F.col("remaining") <= 0).alias("exhausted_campaigns")).first()  # one row
    tot = per.agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("processed"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"), F.sum("spend").alias("spend"),
                  F.sum("total_utility").alias("total_utility"), F.sum("expected_conversions").alias("expected_conversions"),
                  F.count("campaign_id").alias("campaigns_touched"))
    return tot.select("*", F.lit(rem["total_remaining"]).cast("double").alias("total_remaining"),
                      F.lit(rem["avg_remaining"]).cast("double").alias("avg_remaining"),
                      F.lit(rem["exhausted_campaigns"]).cast("bigint").alias("exhausted_campaigns"))
