"""Quality of the fitted models on planted signals, and the layout operators on planted files."""

import os

from pyspark.sql import functions as F

from adspark.functions.hashing import u
from adspark.operators import metrics as M
from adspark.operators import model as MO
from adspark.session import shared_path
from adspark.sources import io as IO


def _planted(spark, n, interaction):
    """Nine codes (two of them carry the signal) and eight numbers; about a tenth to a half positive."""
    df = spark.range(n)
    for i in range(9):
        df = df.withColumn(f"cat_{i}", F.floor(u(f"c{i}", F.col("id")) * 6).cast("int"))
    for i in range(8):
        df = df.withColumn(f"num_{i}", u(f"n{i}", F.col("id")))
    if interaction:  # neither code tells anything alone
        p = F.when((F.col("cat_0") + F.col("cat_1")) % 2 == 0, 0.95).otherwise(0.05)
    else:
        p = F.when(F.col("cat_0") == 2, 0.8).otherwise(0.1) + 0.1 * F.col("num_0")
    return df.withColumn("conversion_flag", (u("y", F.col("id")) < p).cast("int"))


def _auc(scored):
    return M.roc_auc(scored, "score", "conversion_flag").first()[0]


def test_logistic_beats_the_rate(spark):
    df = _planted(spark, 6000, interaction=False).cache()
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    auc = _auc(MO.fit_score_logistic(train, test, max_iter=20))
    rates = train.groupBy("cat_1").agg(F.avg("conversion_flag").alias("score"))
    assert auc > 0.75 and auc > _auc(test.join(rates, "cat_1")) + 0.15


def test_factors_find_interactions_that_logistic_cannot(spark):
    df = _planted(spark, 6000, interaction=True).cache()
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    linear = _auc(MO.fit_score_logistic(train, test, max_iter=20))
    factors = _auc(MO.fit_score_fm(train, test, max_iter=60))
    assert linear < 0.6 and factors > linear + 0.15


def test_compact_bounds_files_and_spreads_a_hot_value(spark):
    path = shared_path(spark, "compact-test")
    df = spark.range(1000).select(F.col("id").alias("event_id"), F.when(F.col("id") < 800, 1).otherwise(F.col("id") % 5 + 2).alias("campaign_id"))
    IO.compact(df, path, "campaign_id", "event_id", max_records_per_file=100)
    files = IO.file_row_counts(spark, path, "campaign_id").collect()
    assert max(r["n_rows"] for r in files) <= 100 and sum(r["n_rows"] for r in files) == 1000
    assert sum(r["campaign_id"] == 1 for r in files) >= 8


def test_file_subset_reads_the_named_files(spark):
    path = shared_path(spark, "subset-test")
    for c in range(3):
        spark.range(c * 10, c * 10 + 10).write.parquet(os.path.join(path, f"part{c}"))
    assert sorted(r["id"] for r in IO.read_file_subset(spark, f"{path}/*", "/part[02]/").collect()) == [*range(10), *range(20, 30)]


def test_factor_side_equals_the_fitted_model(spark):
    """Campaign by campaign, the split logit gives the probability that Spark's own model gives the rewritten row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import FMClassifier
    from pyspark.ml.functions import vector_to_array

    from adspark.operators import candidates as CA
    df = _planted(spark, 1500, interaction=True).cache()
    model = MO.fit_factors(df, factor_size=4, max_iter=10)
    fm = FMClassifier(featuresCol="features", labelCol="conversion_flag", factorSize=4, maxIter=10, seed=7)
    whole = Pipeline(stages=[MO._assembled(df, 9, 8), fm]).fit(df)
    few = df.limit(40).cache()
    side = MO.factor_side(few, model, range(1, 9)).select("id", "imp_logit", "imp_vector")
    camps = [dict(campaign_id=c, ordinal=c + 1, true_conv_rate=0.1, value_per_conv=1.0, target_cpa=1.0, budget=1.0) for c in range(6)]
    for c in camps:
        c["cand_weight"], c["cand_factors"] = model.level(0, c["campaign_id"])
    pairs = CA.candidates_of(side.withColumnRenamed("id", "imp_id"), [r.id for r in few.collect()], CA.candidate_array(camps), "factors",
                             imp_logit="imp_logit", imp_vector="imp_vector")
    got = {(r.imp_id, r.campaign_id): r.pconv for r in pairs.collect()}
    assert len(got) == 240
    for c in range(6):
        want = whole.transform(few.withColumn("cat_0", F.lit(c))).select("id", vector_to_array("probability")[1].alias("p")).collect()
        assert all(abs(got[r.id, c] - r.p) < 1e-6 for r in want)
    assert model.level(0, 99) == (0.0, [0.0] * 4)


def test_factors_choose_better_campaigns_than_the_linear_model(spark):
    """Where only pairs of codes matter, the pair score finds the campaign that converts; the linear score cannot."""
    from adspark.operators import candidates as CA
    df = _planted(spark, 6000, interaction=True).cache()
    model = MO.fit_factors(df.where("id % 5 > 0"), factor_size=8, max_iter=60)
    weights, bias = MO.fit_log_odds(df.where("id % 5 > 0"))
    test = df.where("id % 5 = 0")
    side = MO.linear_logit(MO.factor_side(test, model, range(1, 9)), weights, bias, range(1, 9), out="linear").withColumn("imp_id", F.col("id"))
    own = {r.code: r.weight for r in weights.where("feature = 0").collect()}
    camps = [dict(campaign_id=c, ordinal=c + 1, true_conv_rate=0.1, value_per_conv=1.0, target_cpa=1.0, budget=1.0) for c in range(6)]
    rate = {}
    for name, logit in (("factors", "imp_logit"), ("model", "linear")):
        for c in camps:
            c["cand_weight"], c["cand_factors"] = model.level(0, c["campaign_id"]) if name == "factors" else (own.get(c["campaign_id"], 0.0), None)
        best = CA.best_campaign(side, CA.candidate_array(camps), predictor=name, imp_logit=logit, imp_vector="imp_vector")
        hit = (F.col("campaign_id_chosen") + F.col("cat_1")) % 2 == 0  # what the planted rule pays
        rate[name] = best.agg(F.avg(hit.cast("double"))).first()[0]
    assert rate["factors"] > 0.9 and rate["model"] < 0.7
