"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver tables (through the fixture views) and runs the
library operator over the whole table. Computed doubles are rounded to 9
decimals in the final projection only, so that the SQL oracle (which sums in
another order) compares equal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adspark.operators import label as L
from adspark.operators import profile as A
from adspark.operators import sketch as SK
from adspark.session import materialize, shared_path, staged
from adspark.sources import fixtures as FX

QUERIES: dict = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rd(c, digits: int = 9):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def imps(spark: SparkSession, sf: str) -> DataFrame:
    return FX.ad_impressions(spark, sf)


def convs(spark: SparkSession, sf: str) -> DataFrame:
    return FX.ad_conversions(spark, sf)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_impressions(imps(spark, sf), convs(spark, sf))


LABEL_COLS = ["event_id", "campaign_id", "unique_id", "conv_event_id", "goal_name", "conversion_flag",
              "n_conversions", "impression_hour", "impression_dayofweek"]


@register("label_impressions")
def q_label_impressions(spark, sf):
    return labelled(spark, sf).select(*LABEL_COLS)


@register("label_key_filter")
def q_label_key_filter(spark, sf):
    """The label join in the form for conversions too many to broadcast: a Bloom filter of their keys."""
    return L.label_dedup(imps(spark, sf), convs(spark, sf), broadcast_keys=0).select(*LABEL_COLS)


@register("goal_key_filter")
def q_goal_key_filter(spark, sf):
    return L.label_with_goal(imps(spark, sf), convs(spark, sf), broadcast_keys=0).select(
        "event_id", "conv_event_id", "goal_name", "conversion_flag", "n_conversions")


@register("campaign_conversion_rate")
def q_campaign_conversion_rate(spark, sf):
    r = A.campaign_conversion_rate(labelled(spark, sf))
    return r.select("campaign_id", "impressions", "conversions", rd("conv_rate").alias("conv_rate"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Label -> campaign rates -> campaign parameters -> best campaign per impression -> auction summary."""
    return QUERIES["auction_summary"](spark, sf)


# --------------------------------------------------------------------------
# Shared derived tables
# --------------------------------------------------------------------------
from adspark.operators import clean as C  # noqa: E402
from adspark.operators import features as FE  # noqa: E402
from adspark.operators import sampling as P  # noqa: E402
from adspark.operators import useragent as UA  # noqa: E402


def cleaned(spark, sf):
    """Labelled impressions with user-agent fields (the reference's 'cleaned' stage)."""
    return UA.ua_enrich(labelled(spark, sf))


def split_cleaned(spark, sf):
    return P.hash_split(cleaned(spark, sf))


def fitted(spark, sf):
    """(split rows, encoder, scaler) with transforms fitted on the train split.

    The cleaned rows are a stage of their own, written once as Parquet: fits
    and scores read it, not the label join.
    """
    rows = staged(split_cleaned(spark, sf), "cleaned")
    train = rows.where(F.col("split") == "train")
    enc = materialize(FE.fit_ordinal_encoder(train))
    sc = materialize(FE.fit_scaler(FE.numeric_features(train)))
    return rows, enc, sc


# --------------------------------------------------------------------------
# Cleaning and filters
# --------------------------------------------------------------------------
@register("drop_prefix")
def q_drop_prefix(spark, sf):
    df = imps(spark, sf).withColumn("aip_segment", F.lit(None).cast("string")) \
        .withColumn("aip_score", F.lit(None).cast("double"))
    return C.drop_prefix(df, "aip").select("event_id", "campaign_id", "unique_id", "cnxn_type", "dma")


@register("fill_missing")
def q_fill_missing(spark, sf):
    df = labelled(spark, sf).select("event_id", "conv_event_id", "cnxn_type", "dma", "prizm_premier_code",
                                    "goal_name", "user_agent")
    return C.fill_missing(df, {"cnxn_type": "Unknown", "goal_name": "No Goal Name", "dma": -1,
                               "prizm_premier_code": "-1", "user_agent": ""})


@register("enforce_schema")
def q_enforce_schema(spark, sf):
    df = labelled(spark, sf).select("event_id", "conv_event_id", "campaign_id", "dma", "conversion_flag",
                                    "impression_hour", "impression_dayofweek")
    return C.enforce_schema(df, {"campaign_id": "bigint", "dma": "smallint", "conversion_flag": "tinyint",
                                 "impression_hour": "tinyint", "impression_dayofweek": "tinyint"})


@register("coerce_timestamp")
def q_coerce_timestamp(spark, sf):
    ev = FX.load(spark, sf, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("garbage")).otherwise(F.col("ts").cast("string"))
    parsed = C.coerce_timestamps(ev.select("event_id", text.alias("ts_text")), ["ts_text"])
    # Wall-clock epoch, independent of the session time zone.
    epoch0 = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return parsed.select("event_id", F.col("ts_text").isNull().alias("is_null"),
                         F.timestamp_diff("MICROSECOND", epoch0, F.col("ts_text").cast("timestamp_ntz")).alias("epoch_us"))


@register("time_features")
def q_time_features(spark, sf):
    df = imps(spark, sf).withColumnRenamed("dttm_utc", "impression_dttm_utc")
    return C.time_features(df).select("event_id", "impression_hour", "impression_dayofweek")


@register("limit_impressions")
def q_limit_impressions(spark, sf):
    return C.limit_impressions(imps(spark, sf), 100).select("event_id", "campaign_id", "unique_id")


@register("scan_filter_campaign")
def q_scan_filter_campaign(spark, sf):
    return C.filter_eq(imps(spark, sf), "campaign_id", 42).select("event_id", "campaign_id", "unique_id")


# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
@register("label_dedup")
def q_label_dedup(spark, sf):
    return L.label_dedup(imps(spark, sf), convs(spark, sf)).select(
        "event_id", "conv_event_id", "conversion_flag", "n_conversions")


@register("label_with_goal")
def q_label_with_goal(spark, sf):
    return L.label_with_goal(imps(spark, sf), convs(spark, sf)).select(
        "event_id", "conv_event_id", "goal_name", "conversion_flag", "n_conversions")


@register("label_by_time_key")
def q_label_by_time_key(spark, sf):
    return L.label_by_time_key(imps(spark, sf), convs(spark, sf)).select(
        "event_id", "conv_event_id", "conversion_flag", "n_conversions")


def clicks(spark, sf):
    """Conversions that have an impression, with that impression's time and placement (``imp_click_*``)."""
    seen = L.conversion_latency(imps(spark, sf), convs(spark, sf)).select("event_id", "conv_event_id")
    of = imps(spark, sf).select("event_id", F.col("dttm_utc").alias("imp_click_dttm_utc"), F.col("placement_id").alias("imp_click_placement_id"))
    return convs(spark, sf).join(seen, "conv_event_id").join(of, "event_id").drop("event_id")


@register("label_by_click")
def q_label_by_click(spark, sf):
    return L.label_by_click(imps(spark, sf), clicks(spark, sf)).select("event_id", "conv_event_id", "conversion_flag", "n_conversions")


@register("device_type_lookup")
def q_device_type_lookup(spark, sf):
    lk = FX.device_types(spark)
    i = L.device_type_lookup(imps(spark, sf), lk).select("event_id", "device_type", "device_type_full")
    c = L.device_type_lookup(convs(spark, sf), lk, code_col="conv_device_type").select(
        F.col("conv_event_id").alias("event_id"), F.col("conv_device_type").alias("device_type"),
        "device_type_full")
    return i.unionByName(c)


@register("conversion_latency")
def q_conversion_latency(spark, sf):
    lat = L.conversion_latency(imps(spark, sf), convs(spark, sf))
    lat = L.device_type_lookup(lat, FX.device_types(spark))
    s = A.latency_summary(lat, "device_type_full")
    return s.select("device_type_full", "n", rd("mean_s", 3).alias("mean_s"), rd("median_s", 3).alias("median_s"),
                    rd("min_s", 3).alias("min_s"), rd("max_s", 3).alias("max_s"))


@register("orders_returns_label")
def q_orders_returns_label(spark, sf):
    """The larger label join of FIXTURES.md: orders left join returned lineitems."""
    o = FX.load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = FX.load(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left")
    return j.select("o_orderkey", "l_linenumber", F.col("l_orderkey").isNotNull().cast("tinyint").alias("returned"))


# --------------------------------------------------------------------------
# Aggregation and profiling
# --------------------------------------------------------------------------
@register("rank_campaigns")
def q_rank_campaigns(spark, sf):
    r = A.rank_campaigns(A.campaign_conversion_rate(labelled(spark, sf)))
    return r.select("campaign_id", "impressions", "conversions", rd("conv_rate").alias("conv_rate"), "rank")


@register("count_pos_neg")
def q_count_pos_neg(spark, sf):
    return A.count_pos_neg(labelled(spark, sf))


@register("pos_weight")
def q_pos_weight(spark, sf):
    return A.pos_weight(labelled(spark, sf)).select("n_pos", "n_neg", rd("pos_weight").alias("pos_weight"))


@register("split_label_rate")
def q_split_label_rate(spark, sf):
    s = A.split_label_rate(P.hash_split(labelled(spark, sf)))
    return s.select("split", "n_rows", rd("label_rate").alias("label_rate"))


PROFILE_COLS = ["cnxn_type", "dma", "country", "prizm_premier_code", "device_type", "user_agent", "goal_name",
                "conv_event_id"]


@register("missing_counts")
def q_missing_counts(spark, sf):
    m = A.missing_counts(labelled(spark, sf), PROFILE_COLS)
    return m.select("column", "n_missing", rd("pct_missing").alias("pct_missing"))


@register("distinct_profile")
def q_distinct_profile(spark, sf):
    return A.distinct_profile(labelled(spark, sf), ["campaign_id", "unique_id", "cnxn_type", "dma", "country",
                                                    "prizm_premier_code", "device_type", "user_agent"])


@register("describe_numeric")
def q_describe_numeric(spark, sf):
    d = A.describe_numeric(imps(spark, sf), ["value", "dma", "campaign_id"])
    return d.select("column", *[rd(c, 6).alias(c) for c in ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]])


@register("describe_categorical")
def q_describe_categorical(spark, sf):
    return A.describe_categorical(labelled(spark, sf), ["cnxn_type", "country", "prizm_premier_code",
                                                        "device_type", "goal_name"])


@register("crosstab_goal")
def q_crosstab_goal(spark, sf):
    c = L.device_type_lookup(convs(spark, sf), FX.device_types(spark), code_col="conv_device_type")
    return A.crosstab(c, "device_type_full", "goal_name", FX.GOAL_NAMES)


@register("value_counts")
def q_value_counts(spark, sf):
    return A.value_counts(imps(spark, sf), "cnxn_type")


def daily_sketches(spark, sf):
    days = imps(spark, sf).withColumn("day", F.to_date("dttm_utc"))
    return SK.profile_sketches(days, ["campaign_id", "day"], ["unique_id", "user_agent"], ["value"])


@register("sketch_profile")
def q_sketch_profile(spark, sf):
    """Per campaign, from its days' sketches: counts, and whether the estimates lie within their error bounds."""
    est = SK.estimates(SK.merge_sketches(staged(daily_sketches(spark, sf), "sketches"), ["campaign_id"]), ["campaign_id"], {"p50": 0.5, "p90": 0.9})
    facts = imps(spark, sf).select("campaign_id", "unique_id", "user_agent", "value").join(est, "campaign_id")
    share = lambda q: F.count_if(F.col("value") <= F.col(q)) / F.count("value")
    below = lambda q: F.count_if(F.col("value") < F.col(q)) / F.count("value")
    near = lambda est, exact: F.abs(est - exact) <= F.greatest(0.05 * exact, F.lit(0.5))
    held = facts.groupBy("campaign_id").agg(
        F.first("n_rows").alias("n_rows"), F.first("value_n").alias("value_n"), F.first("value_min").alias("value_min"), F.first("value_max").alias("value_max"),
        near(F.first("unique_id_distinct"), F.count_distinct("unique_id")).alias("users_near"),
        near(F.first("user_agent_distinct"), F.count_distinct("user_agent")).alias("agents_near"),
        ((below("value_p50") <= 0.52) & (share("value_p50") >= 0.48)).alias("p50_near"), ((below("value_p90") <= 0.92) & (share("value_p90") >= 0.88)).alias("p90_near"))
    return held.select("campaign_id", "n_rows", "value_n", rd("value_min").alias("value_min"), rd("value_max").alias("value_max"), "users_near", "agents_near", "p50_near", "p90_near")


@register("histogram")
def q_histogram(spark, sf):
    return A.histogram(imps(spark, sf), "value", 0.0, 100.0, 20)


# --------------------------------------------------------------------------
# Splits and sampling
# --------------------------------------------------------------------------
@register("hash_split")
def q_hash_split(spark, sf):
    return P.hash_split(labelled(spark, sf)).select("event_id", "conv_event_id", "split")


@register("stratified_split")
def q_stratified_split(spark, sf):
    d = L.label_dedup(imps(spark, sf), convs(spark, sf))
    return P.stratified_split(d).select("event_id", "conversion_flag", "split")


@register("sample_per_campaign")
def q_sample_per_campaign(spark, sf):
    return P.sample_per_group(imps(spark, sf), 10).select("event_id", "campaign_id")


@register("ratio_sample")
def q_ratio_sample(spark, sf):
    d = L.label_dedup(imps(spark, sf), convs(spark, sf))
    return P.ratio_sample(d, k=2.0).select("event_id", "conversion_flag")


@register("ratio_sample_replace")
def q_ratio_sample_replace(spark, sf):
    d = L.label_dedup(imps(spark, sf), convs(spark, sf))
    return P.ratio_sample(d, k=2.0, replace=True).select("event_id", "conversion_flag", "copy_id")


@register("ratio_sample_exact")
def q_ratio_sample_exact(spark, sf):
    d = L.label_dedup(imps(spark, sf), convs(spark, sf)).select("event_id", "conversion_flag")
    return P.ratio_sample_exact(d, k=2.0).select("draw_id", "event_id", "conversion_flag")


@register("shuffled_order")
def q_shuffled_order(spark, sf):
    return P.shuffled_order(imps(spark, sf)).select("event_id", "imp_id")


@register("assign_users")
def q_assign_users(spark, sf):
    return P.assign_users(imps(spark, sf), 1000).select("event_id", "user_id")


# --------------------------------------------------------------------------
# User agents and features
# --------------------------------------------------------------------------
@register("ua_enrich")
def q_ua_enrich(spark, sf):
    return UA.ua_enrich(imps(spark, sf)).select("event_id", *UA.UA_FIELDS)


@register("ua_enrich_distinct")
def q_ua_enrich_distinct(spark, sf):
    return UA.ua_enrich(imps(spark, sf), method="distinct").select("event_id", *UA.UA_FIELDS)


@register("ua_distinct")
def q_ua_distinct(spark, sf):
    return UA.distinct_user_agents(imps(spark, sf))


@register("numeric_features")
def q_numeric_features(spark, sf):
    n = FE.numeric_features(cleaned(spark, sf))
    return n.select("event_id", "conv_event_id", *FE.BOOLEAN_FEATURES,
                    *[rd(c).alias(c) for c in ["hour_sin", "hour_cos", "day_sin", "day_cos"]])


@register("fit_ordinal_encoder")
def q_fit_ordinal_encoder(spark, sf):
    _, enc, _ = fitted(spark, sf)
    return enc


@register("category_sizes")
def q_category_sizes(spark, sf):
    _, enc, _ = fitted(spark, sf)
    return FE.category_sizes(enc)


@register("ordinal_encode")
def q_ordinal_encode(spark, sf):
    rows, enc, _ = fitted(spark, sf)
    return FE.ordinal_encode(rows, enc).select("event_id", "conv_event_id", "split", *FE.CATEGORICAL_FEATURES)


@register("ordinal_encode_reserve")
def q_ordinal_encode_reserve(spark, sf):
    rows, enc, _ = fitted(spark, sf)
    return FE.ordinal_encode(rows, enc, unknown="reserve").select("event_id", "conv_event_id", "split",
                                                                  *FE.CATEGORICAL_FEATURES)


@register("fit_scaler")
def q_fit_scaler(spark, sf):
    _, _, sc = fitted(spark, sf)
    return sc.select("feature", rd("mean").alias("mean"), rd("scale").alias("scale"))


@register("scale_features")
def q_scale_features(spark, sf):
    rows, _, sc = fitted(spark, sf)
    s = FE.scale_features(FE.numeric_features(rows), sc, out_type="double")
    return s.select("event_id", "conv_event_id", *[rd(c, 6).alias(c) for c in FE.NUMERIC_FEATURES])


@register("processed_features")
def q_processed_features(spark, sf):
    rows, enc, sc = fitted(spark, sf)
    p = FE.processed_features(rows, enc, sc, keep=["event_id", "conv_event_id", "split"])
    return p.select("event_id", "conv_event_id", "split", *[f"cat_{i}" for i in range(9)],
                    *[rd(F.col(f"num_{i}").cast("double"), 4).alias(f"num_{i}") for i in range(8)],
                    "conversion_flag")


@register("feature_vectors")
def q_feature_vectors(spark, sf):
    rows, enc, sc = fitted(spark, sf)
    p = FE.processed_features(rows, enc, sc, keep=["event_id", "conv_event_id"])
    v = FE.feature_vectors(p, keep=["event_id", "conv_event_id"])
    return v.select("event_id", "conv_event_id",
                    F.array_join(F.transform("cat", lambda x: x.cast("string")), ",").alias("cat_text"),
                    F.size("num").alias("n_num"), "label")


@register("feature_counts")
def q_feature_counts(spark, sf):
    rows, enc, sc = fitted(spark, sf)
    return A.feature_counts(FE.processed_features(rows, enc, sc))


@register("one_hot")
def q_one_hot(spark, sf):
    rows, enc, _ = fitted(spark, sf)
    oh = FE.one_hot(rows, enc, "cnxn_type")
    return oh.select("event_id", "conv_event_id", *[c for c in oh.columns if c.startswith("cnxn_type_")])


@register("one_hot_sparse")
def q_one_hot_sparse(spark, sf):
    rows, enc, _ = fitted(spark, sf)
    v = FE.one_hot_sparse(rows, enc)
    return v.select("event_id", "conv_event_id", F.col("onehot.size").alias("n_levels"), F.array_join(F.transform("onehot.indices", lambda i: i.cast("string")), ",").alias("indices"),
                    F.size("onehot.values").cast("bigint").alias("n_known"))


# --------------------------------------------------------------------------
# Campaigns, candidates, auction
# --------------------------------------------------------------------------
from adspark.functions.hashing import u as _u  # noqa: E402
from adspark.operators import allocate as AL  # noqa: E402
from adspark.operators import candidates as CA  # noqa: E402
from adspark.operators import metrics as M  # noqa: E402
from adspark.operators import policy as PO  # noqa: E402

BETA = 0.9
TAU = 3
BUDGET = 1000.0


def campaigns(spark, sf, budget: float = BUDGET):
    return CA.campaign_params(A.campaign_conversion_rate(labelled(spark, sf)), budget=budget)


def auction_imps(spark, sf):
    """Impressions in stream order: imp_id = event_id, user = unique_id."""
    return imps(spark, sf).select(F.col("event_id").alias("imp_id"), F.col("unique_id").alias("user_id"),
                                  F.col("campaign_id").cast("string").alias("imp_campaign_id_sampled_from"),
                                  "dttm_utc")


def stateless_log(spark, sf, predictor="random", budget: float = BUDGET):
    camps = CA.collect_campaigns(campaigns(spark, sf, budget))
    return AL.stateless_auction(auction_imps(spark, sf), camps, predictor=predictor, beta=BETA)


def outcomes(spark, sf, camps=None):
    """The log without its running budget, and with the impressions' time: one pass, no shuffle."""
    camps = camps if camps is not None else campaigns(spark, sf)
    return AL.decisions(auction_imps(spark, sf), CA.collect_campaigns(camps), beta=BETA)


LOG_DOUBLES = ["campaign_value_per_conv", "expected_value", "bid", "market_price", "pconv", "utility",
               "budget_remaining", "chosen_score"]


def rounded_log(log):
    return log.select(*[rd(c).alias(c) if c in LOG_DOUBLES else F.col(c) for c in AL.LOG_COLUMNS])


@register("campaign_params")
def q_campaign_params(spark, sf):
    c = campaigns(spark, sf)
    return c.select("campaign_id", "ordinal", rd("true_conv_rate").alias("true_conv_rate"),
                    rd("value_per_conv").alias("value_per_conv"), rd("target_cpa").alias("target_cpa"), "budget")


def candidate_rows(best):
    """A row per entry of ``top``. The outer form: the other one adds a filter on ``top``, which scores every pair again."""
    rows = best.select("imp_id", F.posexplode_outer("top").alias("rank", "c")).where(F.col("rank").isNotNull())
    return rows.select("imp_id", F.col("rank").cast("bigint").alias("rank"), "c.campaign_id", rd("c.pconv").alias("pconv"), rd("c.score").alias("score"))


@register("candidate_scores")
def q_candidate_scores(spark, sf):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    return candidate_rows(CA.top_candidates(auction_imps(spark, sf).drop("dttm_utc"), CA.candidate_array(camps), 3))


@register("candidate_diagnostics")
def q_candidate_diagnostics(spark, sf):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    stats = CA.candidate_statistics(auction_imps(spark, sf).drop("dttm_utc"), CA.candidate_array(camps))
    return stats.select("campaign_id", "impressions", "budget", *[rd(c).alias(c) for c in (
        "mean_pconv", "max_pconv", "mean_score", "max_score", "value_per_conv", "true_conv_rate")])


CAMPAIGN_BLOCK = 16  # small, so that the driver's hundred campaigns make several blocks


@register("candidate_scores_pruned")
def q_candidate_scores_pruned(spark, sf):
    """candidate_scores in the form for campaign tables of any length."""
    return candidate_rows(CA.top_candidates_pruned(auction_imps(spark, sf).drop("dttm_utc"), campaigns(spark, sf), 3, block=CAMPAIGN_BLOCK))


@register("best_campaign_pruned")
def q_best_campaign_pruned(spark, sf):
    b = CA.best_campaign_pruned(auction_imps(spark, sf), campaigns(spark, sf), predictor="random", beta=BETA, block=CAMPAIGN_BLOCK)
    return b.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("chosen_score").alias("chosen_score"),
                    "eligible_campaigns")


@register("candidate_diagnostics_blocked")
def q_candidate_diagnostics_blocked(spark, sf):
    stats = CA.candidate_statistics_blocked(auction_imps(spark, sf).drop("dttm_utc"), campaigns(spark, sf), block=CAMPAIGN_BLOCK)
    return stats.select("campaign_id", "impressions", "budget", *[rd(c).alias(c) for c in (
        "mean_pconv", "max_pconv", "mean_score", "max_score", "value_per_conv", "true_conv_rate")])


def _best(spark, sf, predictor):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    return CA.best_campaign(auction_imps(spark, sf), CA.candidate_array(CA.best_first(camps)), predictor=predictor, beta=BETA)


@register("best_campaign")
def q_best_campaign(spark, sf):
    b = _best(spark, sf, "random")
    return b.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("chosen_score").alias("chosen_score"),
                    "eligible_campaigns")


@register("policy_heuristic")
def q_policy_heuristic(spark, sf):
    b = _best(spark, sf, "heuristic")
    return b.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("pconv").alias("pconv"),
                    rd("chosen_score").alias("chosen_score"))


@register("policy_random")
def q_policy_random(spark, sf):
    b = _best(spark, sf, "random")
    return b.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("pconv").alias("pconv"),
                    rd("chosen_score").alias("chosen_score"))


@register("bid_price")
def q_bid_price(spark, sf):
    b = _best(spark, sf, "random")
    return b.select("imp_id", rd("expected_value").alias("expected_value"), rd("bid").alias("bid"))


@register("market_outcome")
def q_market_outcome(spark, sf):
    b = _best(spark, sf, "random")
    ln = CA.market_price(F.col("bid"), F.col("imp_id"), "lognormal")
    return b.select("imp_id", rd("market_price").alias("market_price"), "win",
                    rd(ln).alias("lognormal_price"), (F.col("bid") > ln).alias("lognormal_win"))


@register("auction_log")
def q_auction_log(spark, sf):
    return rounded_log(stateless_log(spark, sf))


@register("frequency_cap")
def q_frequency_cap(spark, sf):
    capped = AL.frequency_cap(outcomes(spark, sf), TAU)
    return capped.select("imp_id", "user_id", "campaign_id", "win_no")


@register("budget_pacing")
def q_budget_pacing(spark, sf):
    camps = materialize(campaigns(spark, sf))
    paced = AL.budget_pacing(outcomes(spark, sf, camps), camps, block_size=1000)
    return paced.select("imp_id", "campaign_id", rd("spent_before").alias("spent_before"),
                        rd("budget_remaining").alias("budget_remaining"))


@register("eligible_campaigns")
def q_eligible_campaigns(spark, sf):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    ai = auction_imps(spark, sf)
    first = AL.stateless_auction(ai, camps, predictor="random", beta=BETA)
    return AL.eligible_counts(ai, camps, first, TAU, block_size=1000)


@register("allocation_replay")
def q_allocation_replay(spark, sf):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    log = AL.allocation_replay(auction_imps(spark, sf), camps, predictor="random", beta=BETA, tau=TAU)
    return rounded_log(log)


@register("run_summary")
def q_run_summary(spark, sf):
    camps = materialize(campaigns(spark, sf))
    s = PO.run_summary(outcomes(spark, sf, camps), camps)
    return s.select("processed", "wins", rd("spend").alias("spend"), rd("total_utility").alias("total_utility"),
                    rd("expected_conversions").alias("expected_conversions"), "campaigns_touched",
                    rd("total_remaining").alias("total_remaining"), rd("avg_remaining").alias("avg_remaining"),
                    "exhausted_campaigns")


# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------
def scored(spark, sf, digits: int | None = 2):
    """Labelled rows with a score mixing the campaign rate and a keyed uniform (2 digits: ties; None: as it is)."""
    lab = labelled(spark, sf)
    rates = A.campaign_conversion_rate(lab).select("campaign_id", "conv_rate")
    s = F.least(F.greatest(F.lit(0.5) * F.col("conv_rate") + F.lit(0.5) * _u("score", F.col("event_id")),
                           F.lit(0.0)), F.lit(1.0))
    s = s if digits is None else F.round(s, digits)
    return (lab.join(rates, "campaign_id").select("event_id", "campaign_id", s.alias("score"),
                                                 F.col("conversion_flag").cast("int").alias("label")))


@register("roc_auc")
def q_roc_auc(spark, sf):
    return M.roc_auc(scored(spark, sf, None)).select(rd("roc_auc").alias("roc_auc"))


@register("average_precision")
def q_average_precision(spark, sf):
    return M.average_precision(scored(spark, sf, None)).select(rd("average_precision").alias("average_precision"))


@register("log_loss")
def q_log_loss(spark, sf):
    return M.log_loss(scored(spark, sf)).select(rd("log_loss").alias("log_loss"))


@register("weighted_log_loss")
def q_weighted_log_loss(spark, sf):
    s = scored(spark, sf)
    w = A.pos_weight(s, "label").first()["pos_weight"]
    return M.log_loss(s, pos_weight=w).select(rd("weighted_log_loss").alias("weighted_log_loss"))


@register("threshold_metrics")
def q_threshold_metrics(spark, sf):
    t = M.threshold_metrics(scored(spark, sf))
    return t.select("threshold", "n", *[rd(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return M.confusion_counts(scored(spark, sf))


@register("classification_report")
def q_classification_report(spark, sf):
    r = M.classification_report(scored(spark, sf))
    return r.select("class", *[rd(c).alias(c) for c in ["precision", "recall", "f1", "support"]])


@register("calibration_error")
def q_calibration_error(spark, sf):
    return M.calibration_error(scored(spark, sf)).select(rd("ece").alias("ece"))


@register("reliability_table")
def q_reliability_table(spark, sf):
    r = M.reliability_table(scored(spark, sf))
    return r.select("bin", "n", rd("avg_score").alias("avg_score"), rd("avg_label").alias("avg_label"))


@register("roc_auc_binned")
def q_roc_auc_binned(spark, sf):
    return M.roc_auc_binned(scored(spark, sf)).select(rd("roc_auc_binned").alias("roc_auc_binned"))


@register("best_run")
def q_best_run(spark, sf):
    s = P.hash_split(scored(spark, sf))
    p = F.least(F.greatest(F.col("score").cast("double"), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    y = F.col("label").cast("double")
    per = s.groupBy(F.col("split").alias("run")).agg(
        F.avg(-(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("val_loss"))
    return M.best_run(per).select("best_run", rd("best_loss").alias("best_loss"))


# --------------------------------------------------------------------------
# Policy analytics
# --------------------------------------------------------------------------
def with_week(spark, sf, log):
    """Adds ``day``: the 0-based week of the impression's time, which the log carries."""
    d0 = imps(spark, sf).agg(F.min(F.to_date("dttm_utc")).alias("d0")).first()["d0"]
    return log.withColumn("day", F.floor(F.datediff(F.to_date("dttm_utc"), F.lit(d0)) / 7).cast("int"))


def model_candidates(spark, sf):
    """(impressions with their side of the logit, campaigns with theirs) of the fitted linear model."""
    _, w, b, enc = linear_model(spark, sf)
    camps = CA.collect_campaigns(campaigns(spark, sf))
    cw = MO.campaign_weights(enc, w, [c["campaign_id"] for c in camps])
    for c in camps:
        c["cand_weight"] = cw[c["campaign_id"]]
    imp = MO.linear_logit(impression_codes(spark, sf, enc), w, b, range(1, 9), out="imp_logit").select(
        F.col("event_id").alias("imp_id"), F.col("unique_id").alias("user_id"),
        F.col("campaign_id").cast("string").alias("imp_campaign_id_sampled_from"),
        F.col("impression_dttm_utc").alias("dttm_utc"), "imp_logit")
    return imp, camps


def policy_logs(spark, sf):
    """Decisions of the three policies: constant CPM on a random campaign, value only, the fitted model."""
    imp, camps = model_candidates(spark, sf)
    kinds = {"random": "cpm", "heuristic": "heuristic", "model": "model"}
    return AL.decisions_by_policy(imp, camps, kinds, beta=BETA, imp_logit="imp_logit")


@register("policy_comparison")
def q_policy_comparison(spark, sf):
    c = PO.policy_comparison(policy_logs(spark, sf))
    return c.select("policy", "impressions", "wins", *[rd(x).alias(x) for x in
                                                       ["spend", "expected_conversions", "revenue_uplift", "cpa"]])


@register("marginal_cpa")
def q_marginal_cpa(spark, sf):
    m = PO.marginal_cpa(with_week(spark, sf, policy_logs(spark, sf)), "random")
    return m.select("policy", "day", *[rd(x).alias(x) for x in ["delta_spend", "delta_conv", "marginal_cpa"]])


@register("marginal_cpa_window")
def q_marginal_cpa_window(spark, sf):
    m = PO.marginal_cpa_window(with_week(spark, sf, policy_logs(spark, sf)))
    return m.select("policy", "day", *[rd(x).alias(x) for x in ["delta_spend", "delta_conv", "marginal_cpa"]])


@register("pacing_error")
def q_pacing_error(spark, sf):
    camps = materialize(campaigns(spark, sf))
    log = with_week(spark, sf, outcomes(spark, sf, camps))
    n = log.agg(F.max("day")).first()[0] + 1
    p = PO.pacing_error(log, camps, n)
    return p.select("campaign_id", "day", *[rd(x).alias(x) for x in ["cum_spend", "planned", "pacing_error"]])


@register("auction_summary")
def q_auction_summary(spark, sf):
    log = outcomes(spark, sf).select("campaign_id", "win", "market_price")
    s = PO.auction_summary(staged(log, "prices"))  # read for the totals and for the quantiles
    return s.select("campaign_id", "impressions", "wins",
                    *[rd(x).alias(x) for x in ["win_rate", "spend", "median_price", "p90_price"]])


# --------------------------------------------------------------------------
# Sources, sinks, layout
# --------------------------------------------------------------------------
from adspark.operators import model as MO  # noqa: E402
from adspark.sources import io as IO  # noqa: E402
from adspark.streaming import streams as ST  # noqa: E402


def partitioned_impressions(spark, sf):
    """Impressions written Hive-style by campaign (the reference's raw layout): (path, schema)."""
    path = shared_path(spark, "impressions")
    df = imps(spark, sf).withColumn("dte", F.to_date("dttm_utc"))
    IO.write_partitioned(df, path, ["campaign_id"])
    return path, df.schema


@register("scan_partition_pruned")
def q_scan_partition_pruned(spark, sf):
    path, schema = partitioned_impressions(spark, sf)
    return IO.read_parquet(spark, path, schema=schema, columns=["event_id", "campaign_id", "unique_id", "cnxn_type"],
                           where=F.col("campaign_id").isin(7, 42, 77) & (F.col("cnxn_type") == "Cellular"))


@register("list_campaigns")
def q_list_campaigns(spark, sf):
    path, schema = partitioned_impressions(spark, sf)
    return IO.list_partitions(spark, path, "campaign_id", schema)


@register("write_read_roundtrip")
def q_write_read_roundtrip(spark, sf):
    lab = labelled(spark, sf).select("event_id", "campaign_id", "conv_event_id", "goal_name", "conversion_flag")
    pq, csv = shared_path(spark, "labelled"), shared_path(spark, "labelled-csv")
    IO.write_partitioned(lab, pq, ["campaign_id"])
    IO.write_csv(spark.read.parquet(pq), csv)
    back = IO.read_csv(spark, csv, "event_id long, conv_event_id long, goal_name string, conversion_flag tinyint, "
                                   "campaign_id long")
    return back.select("event_id", "campaign_id", "conv_event_id", "goal_name", "conversion_flag")


@register("compact_files")
def q_compact_files(spark, sf):
    path = shared_path(spark, "compacted")
    IO.compact(imps(spark, sf), path, "campaign_id", "event_id", max_records_per_file=5)
    per_file = IO.file_row_counts(spark, path, "campaign_id")
    return per_file.groupBy("campaign_id").agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 5).alias("within_limit"))


@register("scan_file_subset")
def q_scan_file_subset(spark, sf):
    path = shared_path(spark, "chunks")
    for chunk in range(4):  # a file set per chunk, named by its folder
        imps(spark, sf).where(F.col("event_id") % 4 == chunk).write.parquet(f"{path}/chunk{chunk}")
    return IO.read_file_subset(spark, f"{path}/*", r"/chunk[02]/").select("event_id", "campaign_id")


@register("auction_log_sink")
def q_auction_log_sink(spark, sf):
    path = shared_path(spark, "auction-log")
    log = staged(stateless_log(spark, sf), "log")
    halves = {f"part{r}": log.where(F.col("imp_id") % 2 == r) for r in range(2)}
    for name in ("part0", "part1", "part0"):  # the last one is a retry, and adds nothing
        IO.append_committed(halves[name], path, name)
    return rounded_log(IO.read_committed(spark, path))


@register("footer_counts")
def q_footer_counts(spark, sf):
    """Rows and bounds of the events from the file footers."""
    return IO.footer_counts(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"])


@register("preprocessor_roundtrip")
def q_preprocessor_roundtrip(spark, sf):
    _, enc, sc = fitted(spark, sf)
    pe, ps = shared_path(spark, "encoder"), shared_path(spark, "scaler")
    enc.write.parquet(pe)
    sc.write.parquet(ps)
    return spark.read.parquet(pe).select("feature", "category", "code")


# --------------------------------------------------------------------------
# Models and plug-ins
# --------------------------------------------------------------------------
def processed_split(spark, sf, fit=None):
    rows, enc, sc = fit or fitted(spark, sf)
    return FE.processed_features(rows, enc, sc, keep=["event_id", "conv_event_id", "split"])


def linear_model(spark, sf):
    """(processed rows, weights, bias, encoder); every transform is fitted once."""
    fit = fitted(spark, sf)
    p = processed_split(spark, sf, fit)
    w, b = MO.fit_log_odds(p.where(F.col("split") == "train"))
    return p, materialize(w), b, fit[1]


@register("score_linear")
def q_score_linear(spark, sf):
    p, w, b, _ = linear_model(spark, sf)
    s = MO.score_linear(p, w, b, keep=["event_id", "conv_event_id"])
    return s.select("event_id", "conv_event_id", rd("score").alias("score"))


@register("score_plugin")
def q_score_plugin(spark, sf):
    p, w, b, _ = linear_model(spark, sf)
    # The plug-in gets the weights as columns, joined by feature whatever their number.
    weighted = MO.join_weights(p, w, range(9)).select("event_id", "conv_event_id", *[f"w_{i}" for i in range(9)])

    def predict(pdf):
        logit = np.full(len(pdf), b)
        for i in range(9):
            logit += pdf[f"w_{i}"].to_numpy()
        return pd.DataFrame({"event_id": pdf["event_id"], "conv_event_id": pdf["conv_event_id"],
                             "score": np.round(1.0 / (1.0 + np.exp(-logit)), 9)})
    return MO.score_plugin(weighted, predict, "event_id long, conv_event_id long, score double")


@register("apply_batches")
def q_apply_batches(spark, sf):
    rows, _, sc = fitted(spark, sf)
    params = FE.scaler_params(sc)
    cols = FE.NUMERIC_FEATURES

    def scale(pdf):
        out = pd.DataFrame({"event_id": pdf["event_id"], "conv_event_id": pdf["conv_event_id"]})
        for c in cols:
            m, s = params[c]
            out[c] = ((pdf[c].astype("float64") - m) / s).round(6)
        return out
    schema = "event_id long, conv_event_id long, " + ", ".join(f"{c} double" for c in cols)
    return FE.apply_batches(FE.numeric_features(rows).select("event_id", "conv_event_id", *cols), scale, schema)


@register("fit_score_logistic")
def q_fit_score_logistic(spark, sf):
    p = processed_split(spark, sf)
    s = MO.fit_score_logistic(p.where(F.col("split") == "train"), p)
    return s.select("event_id", "conv_event_id", "split", rd("score", 6).alias("score"))


@register("fit_score_fm")
def q_fit_score_fm(spark, sf):
    p = processed_split(spark, sf)
    s = MO.fit_score_fm(p.where(F.col("split") == "train"), p, max_iter=20)
    return s.select("event_id", "conv_event_id", "split", rd("score", 6).alias("score"))


@register("model_quality")
def q_model_quality(spark, sf):
    """The three models on the rows they were fitted on: rows, positives, scores within 0 and 1, ranking better than chance."""
    p, w, b, _ = linear_model(spark, sf)
    train = staged(p.where(F.col("split") == "train"), "train")
    models = {"log_odds": MO.score_linear(train, w, b, keep=["conversion_flag"]), "logistic": MO.fit_score_logistic(train, train),
              "factors": MO.fit_score_fm(train, train, max_iter=20)}
    out = None
    for name, scores in models.items():
        scores = staged(scores.select(F.lit(name).alias("model"), "score", F.col("conversion_flag").cast("int").alias("label")), name)
        facts = scores.groupBy("model").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_pos"), F.min(F.col("score").between(0, 1)).alias("in_range"))
        area = M.roc_auc_binned(scores).select(F.lit(name).alias("model"), (F.col("roc_auc_binned") > 0.5).alias("above_chance"))
        row = facts.join(area, "model").select("model", "n_rows", "n_pos", "in_range", "above_chance")
        out = row if out is None else out.unionByName(row)
    return out


# --------------------------------------------------------------------------
# Streaming
# --------------------------------------------------------------------------
@register("stream_features")
def q_stream_features(spark, sf):
    _, enc, _ = fitted(spark, sf)
    src = ST.event_stream(spark, f"{sf}/events.parquet")
    imp = FX.impressions_from_events(src).withColumnRenamed("dttm_utc", "impression_dttm_utc")
    feats = UA.ua_enrich(C.time_features(imp), method="inline")
    coded = FE.ordinal_encode(feats, enc, out_prefix="cat_")
    out = coded.select("event_id", "impression_hour", "impression_dayofweek", "ua_browser", "ua_is_mobile",
                       *[f"cat_{i}" for i in range(9)])
    return spark.read.parquet(ST.drain(out, name="features"))


def timed_log(spark, sf):
    """The outcomes with their impressions' time as TIMESTAMP."""
    log = outcomes(spark, sf).withColumn("ts", F.col("dttm_utc").cast("timestamp"))
    return log.select("imp_id", "user_id", "campaign_id", "win", "market_price", "pconv", "ts")


@register("stream_frequency_cap")
def q_stream_frequency_cap(spark, sf):
    return spark.read.parquet(ST.drain_ranges(timed_log(spark, sf), "imp_id", 4, name="cap",
                                              build=lambda src: ST.stream_frequency_cap(src.where(F.col("win")), TAU)))


@register("stream_windowed_cpa")
def q_stream_windowed_cpa(spark, sf):
    out = shared_path(spark, "windowed")
    ST.drain_ranges(timed_log(spark, sf), "imp_id", 4, ST.windowed_spend, "windowed", output_mode="update",
                    foreach_batch=ST.write_updates(out))
    r = ST.latest_updates(spark, out)
    return r.select(F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"), "wins",
                    *[rd(c).alias(c) for c in ("spend", "conv", "cpa")])


def attributed(spark, sf, finish: bool):
    rows = ST.attribution_rows(FX.ad_impressions(spark, sf), FX.ad_conversions(spark, sf))
    out, state = shared_path(spark, "attribution"), shared_path(spark, "attribution-state")
    ST.drain_ranges(rows, "us", 4, lambda src: src, "attribution", foreach_batch=ST.stream_attribution(out, state))
    if finish:
        ST.finish_attribution(spark, out, state)
    return spark.read.parquet(out).select("event_id", "conv_event_id", rd("latency_s", 3).alias("latency_s"))


@register("stream_attribution")
def q_stream_attribution(spark, sf):
    return attributed(spark, sf, finish=False)


@register("stream_attribution_finished")
def q_stream_attribution_finished(spark, sf):
    """stream_attribution at the end of its input: nothing stays open."""
    return attributed(spark, sf, finish=True)


@register("stream_join_attribution")
def q_stream_join_attribution(spark, sf):
    """Conversions that the stream-stream join gave an impression."""
    source = ST.event_stream(spark, f"{sf}/events.parquet")
    pairs = ST.drain(ST.join_attribution(FX.impressions_from_events(source), FX.conversions_from_events(source)), name="joined")
    matched = spark.read.parquet(pairs).where(F.col("event_id").isNotNull())
    return ST.latest_impression(matched).select("event_id", "conv_event_id", rd("latency_s", 3).alias("latency_s"))


@register("stream_allocation")
def q_stream_allocation(spark, sf):
    camps = CA.collect_campaigns(campaigns(spark, sf))
    ai = auction_imps(spark, sf).drop("dttm_utc")
    out, state = shared_path(spark, "alloc-log"), shared_path(spark, "alloc-state")
    ST.drain_ranges(ai, "imp_id", 3, lambda src: src, "alloc", foreach_batch=ST.stream_allocation(
        camps, out, state, predictor="random", beta=BETA, tau=TAU))
    return rounded_log(spark.read.parquet(out).drop("batch_id"))


# --------------------------------------------------------------------------
# Counterfactual features (F12), model predictor in the auction (B4), CSV lookup
# --------------------------------------------------------------------------
def campaign_codes(enc, camps):
    """campaign_id -> encoded code (unseen -> 0, collide), read for the campaigns of the list alone."""
    ids = [str(c["campaign_id"]) for c in camps]
    rows = enc.where((F.col("feature") == "campaign_id") & F.col("category").isin(ids)).select("category", "code").collect()
    code_of = {r["category"]: r["code"] for r in rows}
    return {c["campaign_id"]: int(code_of.get(str(c["campaign_id"]), 0)) for c in camps}


@register("counterfactual_features")
def q_counterfactual_features(spark, sf):
    p, w, b, enc = linear_model(spark, sf)
    camps = CA.collect_campaigns(campaigns(spark, sf))
    cw = MO.campaign_weights(enc, w, [c["campaign_id"] for c in camps])
    for c in camps:
        c["cand_weight"] = cw[c["campaign_id"]]
    imp = MO.linear_logit(p, w, b, range(1, 9), out="imp_logit")
    best = FE.counterfactual_features(
        imp, camps, campaign_codes(enc, camps),
        score=lambda c: CA.score_expr(CA.pconv_expr("model", None, c, F.col("imp_logit")), c), keep=["event_id", "conv_event_id"])
    return best.select("event_id", "conv_event_id", F.col("candidate_campaign_id").alias("campaign_id"),
                       rd("candidate_score").alias("score"), *[f"cat_{i}" for i in range(9)])


def impression_codes(spark, sf, enc):
    """One row per impression with the nine encoded features (no label needed)."""
    i = imps(spark, sf).withColumnRenamed("dttm_utc", "impression_dttm_utc")
    return FE.ordinal_encode(UA.ua_enrich(C.time_features(i)), enc, out_prefix="cat_")


@register("policy_model")
def q_policy_model(spark, sf):
    imp, camps = model_candidates(spark, sf)
    best = CA.best_campaign(imp, CA.candidate_array(camps), predictor="model", beta=BETA, imp_logit="imp_logit")
    return best.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("pconv").alias("pconv"),
                       rd("chosen_score").alias("chosen_score"))


FM_FACTORS = 8


def factor_candidates(spark, sf):
    """(impressions, campaigns) prepared for the predictor "factors": a factorization machine fitted on the train split."""
    fit = fitted(spark, sf)
    p = processed_split(spark, sf, fit)
    model = MO.fit_factors(p.where(F.col("split") == "train"), factor_size=FM_FACTORS, max_iter=20)
    camps = CA.collect_campaigns(campaigns(spark, sf))
    codes = campaign_codes(fit[1], camps)
    for c in camps:
        c["cand_weight"], c["cand_factors"] = model.level(0, codes[c["campaign_id"]])
    rows = imps(spark, sf).withColumnRenamed("dttm_utc", "impression_dttm_utc").withColumn("conversion_flag", F.lit(0))
    rows = FE.processed_features(UA.ua_enrich(C.time_features(rows)), fit[1], fit[2], keep=["event_id"])
    return MO.factor_side(rows, model, range(1, 9)).withColumnRenamed("event_id", "imp_id"), camps


@register("policy_factors")
def q_policy_factors(spark, sf):
    imp, camps = factor_candidates(spark, sf)
    best = CA.best_campaign(imp.select("imp_id", "imp_logit", "imp_vector"), CA.candidate_array(camps), predictor="factors", beta=BETA,
                            imp_logit="imp_logit", imp_vector="imp_vector")
    return best.select("imp_id", F.col("campaign_id_chosen").alias("campaign_id"), rd("pconv").alias("pconv"), rd("chosen_score").alias("chosen_score"))


@register("device_lookup_csv")
def q_device_lookup_csv(spark, sf):
    path = shared_path(spark, "device-types-csv")
    IO.write_csv(FX.device_types(spark).coalesce(1), path)
    lk = IO.read_csv(spark, path, "short string, full_name string")
    return L.device_type_lookup(imps(spark, sf), lk).select("event_id", "device_type", "device_type_full")
