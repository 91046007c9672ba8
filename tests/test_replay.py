"""The allocation fixpoint equals a plain serial loop."""

import pytest
from pyspark.sql import functions as F

from adspark.operators import allocate as AL
from adspark.operators import candidates as CA
from adspark.operators import profile as A
from adspark.plans import registry as R
from conftest import SF_SMALL
from serial_replay import serial_replay


def _setup(spark, budget):
    camps = CA.collect_campaigns(CA.campaign_params(A.campaign_conversion_rate(R.labelled(spark, SF_SMALL)),
                                                    budget=budget))
    imps = R.imps(spark, SF_SMALL).select(F.col("event_id").alias("imp_id"), F.col("unique_id").alias("user_id"),
                                          F.col("campaign_id").cast("string").alias("imp_campaign_id_sampled_from"))
    return camps, imps


@pytest.mark.parametrize("predictor,budget,tau,k", [("random", 20.0, 3, 16), ("heuristic", 1000.0, 2, 16),
                                                    ("rate", 5.0, None, 16), ("random", 10.0, 1, 2)])
def test_fixpoint_equals_serial(spark, predictor, budget, tau, k):
    camps, imps = _setup(spark, budget)
    log = AL.allocation_replay(imps, camps, predictor=predictor, beta=0.9, tau=tau, shortlist=k)
    got = sorted(log.collect(), key=lambda r: r.imp_id)
    rows = sorted((r.imp_id, r.user_id, r.imp_campaign_id_sampled_from) for r in imps.collect())
    want = serial_replay(rows, camps, predictor=predictor, beta=0.9, tau=tau)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a.imp_id, a.campaign_id, a.win, a.eligible_campaigns) == \
               (b["imp_id"], b["campaign_id"], b["win"], b["eligible_campaigns"])
        assert abs(a.budget_remaining - b["budget_remaining"]) < 1e-9


def test_carried_state_blocks_equal_whole(spark):
    camps, imps = _setup(spark, 20.0)
    whole = {r.imp_id: (r.campaign_id, r.win) for r in AL.allocation_replay(imps, camps, tau=3).collect()}
    mid = imps.agg(F.percentile_approx("imp_id", 0.5)).first()[0]
    first = AL.allocation_replay(imps.where(F.col("imp_id") <= mid), camps, tau=3)
    w = first.where(F.col("win"))
    spent0 = {r.campaign_id: r.s for r in w.groupBy("campaign_id").agg(F.sum("market_price").alias("s")).collect()}
    wins0 = w.groupBy("user_id", "campaign_id").agg(F.count(F.lit(1)).alias("n_prior"))
    second = AL.allocation_replay(imps.where(F.col("imp_id") > mid), camps, tau=3, spent0=spent0, wins0=wins0)
    blocks = {r.imp_id: (r.campaign_id, r.win) for r in first.unionByName(second).collect()}
    assert blocks == whole


def test_blocked_replay_equals_whole(spark):
    camps, imps = _setup(spark, 15.0)
    whole = sorted((r.imp_id, r.campaign_id, r.win, round(r.budget_remaining, 9))
                   for r in AL.allocation_replay(imps, camps, tau=2).collect())
    blocked = sorted((r.imp_id, r.campaign_id, r.win, round(r.budget_remaining, 9))
                     for r in AL.allocation_replay_blocked(imps, camps, 60, tau=2).collect())
    assert blocked == whole
