"""Planted-answer fixtures with hand-computed results."""

import math

from pyspark.sql import functions as F

from adspark.operators import allocate as AL
from adspark.operators import candidates as CA
from adspark.operators import clean as C
from adspark.operators import features as FE
from adspark.operators import label as L
from adspark.operators import metrics as M
from adspark.operators import profile as A


def _imp(spark, rows):
    return spark.createDataFrame(rows, "campaign_id long, unique_id long, event_id long, dttm_utc timestamp")


def _conv(spark, rows):
    return spark.createDataFrame(rows, "imp_click_campaign_id long, imp_click_unique_id long, conv_event_id long, "
                                       "conv_dttm_utc timestamp, goal_name string")


def test_fan_out_and_missing(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1, 10)
    imp = _imp(spark, [(1, 5, 100, t), (2, 6, 101, t)])
    conv = _conv(spark, [(1, 5, 900, t, "lead"), (1, 5, 901, t, "lead")])
    out = L.label_impressions(imp, conv, fan_out=True).orderBy("event_id", "conv_event_id").collect()
    assert [(r.event_id, r.conversion_flag) for r in out] == [(100, 1), (100, 1), (101, 0)]
    assert out[0].impression_dayofweek == 0  # 2024-01-01 is a Monday
    d = L.label_dedup(imp, conv).orderBy("event_id").collect()
    assert [(r.event_id, r.conv_event_id, r.n_conversions) for r in d] == [(100, 900, 2), (101, None, 0)]


def test_garbage_timestamp_is_null(spark):
    df = spark.createDataFrame([("garbage",), ("2024-01-01 00:00:00",)], "t string")
    r = C.coerce_timestamps(df, ["t"]).collect()
    assert r[0].t is None and r[1].t is not None


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (4.0, 7.0), (5.0, 7.0)], "x double, k double")
    p = FE.scaler_params(FE.fit_scaler(df, ["x", "k"]))
    assert p["x"][0] == 3.0 and abs(p["x"][1] - 1.5811388300841898) < 1e-12
    assert p["k"] == (7.0, 1.0)
    scaled = FE.scale_features(df, p, ["k"], out_type="double").collect()
    assert all(r.k == 0.0 for r in scaled)


def test_encoder_unknown_collide_and_reserve(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("c",)], "country string")
    enc = FE.fit_ordinal_encoder(fit, ["country"])
    codes = {r.category: r.code for r in enc.collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}
    apply = spark.createDataFrame([("zz",), ("a",)], "country string")
    col = FE.ordinal_encode(apply, enc, ["country"]).collect()
    assert [r.country for r in col] == [0, 0]
    res = FE.ordinal_encode(apply, enc, ["country"], unknown="reserve").collect()
    assert [r.country for r in res] == [0, 1]


def _counts_df(spark, tn, fp, fn, tp):
    n = tn + fp + fn + tp
    i = F.col("id")
    label = F.when(i < fn + tp, F.lit(1)).otherwise(F.lit(0))
    score = (F.when(i < fn, F.lit(0.1)).when(i < fn + tp, F.lit(0.9))
             .when(i < fn + tp + fp, F.lit(0.9)).otherwise(F.lit(0.1)))
    return spark.range(n).select(score.alias("score"), label.alias("label"))


def test_baseline_confusion_counts(spark):
    df = _counts_df(spark, 509935, 62756, 923, 3256)
    r = M.threshold_metrics(df).first()
    assert round(r.precision, 4) == 0.0493 and round(r.recall, 4) == 0.7791 and round(r.accuracy, 4) == 0.8896
    assert round(r.f1, 4) == 0.0928
    w = A.pos_weight(df, "label").first()["pos_weight"]
    assert abs(w - 572691 / 4179) < 1e-9


def test_no_positive_predictions(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "score double, label int")
    r = M.threshold_metrics(df).first()
    assert r.precision == 0.0 and r.f1 == 0.0


def test_auc_and_ap_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(round(rnd.random(), 1), int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, label int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df).first()[0] - auc) < 1e-12
    ap = 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for x, y in rows if x >= s and y == 1)
        fp = sum(1 for x, y in rows if x >= s and y == 0)
        ap += sum(1 for x, y in rows if x == s and y == 1) / len(pos) * tp / (tp + fp)
    assert abs(M.average_precision(df).first()[0] - ap) < 1e-12
    ll = -sum(y * math.log(min(max(s, 1e-7), 1 - 1e-7)) + (1 - y) * math.log(1 - min(max(s, 1e-7), 1 - 1e-7))
              for s, y in rows) / len(rows)
    assert abs(M.log_loss(df).first()[0] - ll) < 1e-12


def test_argmax_tie_goes_to_first(spark):
    camps = [dict(campaign_id=20, ordinal=1, true_conv_rate=0.1, value_per_conv=5.0, target_cpa=6.0, budget=10.0),
             dict(campaign_id=10, ordinal=2, true_conv_rate=0.1, value_per_conv=5.0, target_cpa=6.0, budget=10.0)]
    imps = spark.createDataFrame([(1, 1, "x")], "imp_id long, user_id long, imp_campaign_id_sampled_from string")
    r = CA.best_campaign(imps, CA.candidate_array(camps), predictor="heuristic").first()
    assert r.campaign_id_chosen == 20


def test_budget_overshoot_and_cap(spark):
    log = spark.createDataFrame([(1, 1, 7, 6.0, True), (2, 2, 7, 6.0, True), (3, 3, 7, 6.0, True)],
                                "imp_id long, user_id long, campaign_id long, market_price double, win boolean")
    budgets = spark.createDataFrame([(7, 10.0)], "campaign_id long, budget double")
    kept = AL.budget_pacing(log, budgets, block_size=2).orderBy("imp_id").collect()
    assert [r.imp_id for r in kept] == [1, 2] and kept[-1].budget_remaining == -2.0
    five = spark.createDataFrame([(i, 9, 7, 1.0, True) for i in range(5)],
                                 "imp_id long, user_id long, campaign_id long, market_price double, win boolean")
    assert [r.imp_id for r in AL.frequency_cap(five, 3).orderBy("imp_id").collect()] == [0, 1, 2]


def test_bid_zero_never_wins(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(50)], "imp_id long, bid double")
    out = df.withColumn("p", CA.market_price(F.col("bid"), F.col("imp_id"))).where(F.col("bid") > F.col("p"))
    assert out.count() == 0


def test_ratio_sample_keeps_its_size_at_high_rates(spark):
    """10 negatives against 1,000 positives: about 100 copies of each negative, none cut off."""
    from adspark.operators.sampling import ratio_sample

    df = spark.range(1010).select(F.col("id").alias("event_id"), (F.col("id") >= 10).cast("int").alias("conversion_flag"))
    out = ratio_sample(df, k=0.005, replace=True).groupBy("conversion_flag").count().collect()
    n = {r["conversion_flag"]: r["count"] for r in out}
    # Weights 1 and 200: negatives get 2/3 of 1,010 rows, a rate of about 67 each.
    want = 1010 * 2000 / 3000
    assert abs(n[0] - want) < 0.12 * want and abs(n[0] + n[1] - 1010) < 0.1 * 1010
    few = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") < 100).cast("int").alias("conversion_flag"))
    n = {r["conversion_flag"]: r["count"] for r in ratio_sample(few, k=20_000.0, replace=True).groupBy("conversion_flag").count().collect()}
    assert abs(n[1] - 20_000 * 100 / (100 + 19_900 / 20_000)) < 0.05 * 20_000  # a rate of about 198


def test_pacing_and_marginal_cover_every_period(spark):
    from adspark.operators.policy import marginal_cpa, pacing_error

    log = spark.createDataFrame([("base", 1, 0, True, 2.0, 1.0), ("new", 1, 1, True, 3.0, 0.5)], "policy string, campaign_id long, day int, win boolean, market_price double, pconv double")
    got = {r["day"]: (r["delta_spend"], r["delta_conv"]) for r in marginal_cpa(log, "base").collect()}
    assert got == {0: (-2.0, -1.0), 1: (3.0, 0.5)}
    budgets = spark.createDataFrame([(1, 10.0), (2, 10.0)], "campaign_id long, budget double")
    rows = {(r["campaign_id"], r["day"]): (r["cum_spend"], r["pacing_error"]) for r in pacing_error(log, budgets, 2).collect()}
    assert rows == {(1, 0): (2.0, 0.6), (1, 1): (5.0, 0.5), (2, 0): (0.0, 1.0), (2, 1): (0.0, 1.0)}
