"""Bound-pruned candidate search over campaign tables of any length equals the array form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.operators import candidates as CA


def _campaigns(spark, n, seed=1, ties=False):
    rng = np.random.default_rng(seed)
    value = np.round(np.minimum(rng.pareto(1.5, n) * 5 + 0.5, 500), 1 if ties else 6)
    rows = [(int(10 * i), float(0.001 + 0.9 * r), float(v), float(v * 1.5), 1000.0, i + 1, float(w))
            for i, (v, r, w) in enumerate(zip(value, rng.random(n), rng.normal(0, 1, n)))]
    return spark.createDataFrame(rows, "campaign_id long, true_conv_rate double, value_per_conv double, target_cpa double, budget double, ordinal int, cand_weight double")


def _tops(df):
    return {r.imp_id: [(c.campaign_id, round(c.score, 9)) for c in r.top] for r in df.collect()}


@pytest.mark.parametrize("predictor", ["random", "model", "heuristic", "rate"])
@pytest.mark.parametrize("rule", ["value", "target_cpa"])
def test_pruned_equals_the_array_form(spark, predictor, rule):
    camps = _campaigns(spark, 130, ties=True)
    imps = spark.range(60).select(F.col("id").alias("imp_id"), (F.rand(3) * 4 - 3).alias("logit"))
    how = dict(predictor=predictor, rule=rule, imp_logit="logit")
    want = _tops(CA.top_candidates(imps, CA.candidate_array(CA.collect_campaigns(camps)), 3, **how))
    for block in (1000, 40, 7):
        assert _tops(CA.top_candidates_pruned(imps, camps, 3, block=block, **how)) == want
    best = CA.best_campaign_pruned(imps, camps, block=40, **how)
    array = CA.best_campaign(imps, CA.candidate_array(CA.collect_campaigns(camps)), **how)
    assert sorted(map(str, best.collect())) == sorted(map(str, array.select(*best.columns).collect()))


def test_fifty_thousand_campaigns(spark):
    n, camps = 50_000, _campaigns(spark, 50_000)
    imps = spark.range(40).select(F.col("id").alias("imp_id"), (F.col("id") / 10 - 4).alias("logit"))
    got = _tops(CA.top_candidates_pruned(imps, camps, 3, predictor="model", imp_logit="logit"))
    rows = camps.orderBy("ordinal").toPandas()
    for i, top in got.items():
        score = rows.value_per_conv.to_numpy() / (1 + np.exp(-(i / 10 - 4 + rows.cand_weight.to_numpy())))
        order = np.lexsort((np.arange(n), -score))[:3]
        assert [c for c, _ in top] == rows.campaign_id.to_numpy()[order].tolist()
        assert [s for _, s in top] == pytest.approx(score[order].tolist(), abs=1e-8)


def test_settled_impressions_leave(spark):
    camps = spark.createDataFrame([(i, 0.5, 100.0 / 2**i, 1.0, 10.0, i + 1, 0.0) for i in range(12)],
                                  "campaign_id long, true_conv_rate double, value_per_conv double, target_cpa double, budget double, ordinal int, cand_weight double")
    seen = []
    blocks = list(CA.campaign_blocks(camps, CA.score_bound("heuristic"), 4))
    assert [b for _, b in blocks] == sorted((b for _, b in blocks), reverse=True) and sum(len(c) for c, _ in blocks) == 12
    imps = spark.range(5).select(F.col("id").alias("imp_id"))
    whole = CA.candidate_array

    def counted(cs, extra=None):
        seen.append(len(cs))
        return whole(cs, extra)
    CA.candidate_array = counted
    try:
        got = _tops(CA.top_candidates_pruned(imps, camps, 2, predictor="heuristic", block=4))
    finally:
        CA.candidate_array = whole
    assert len(seen) == 1 and all([c for c, _ in t] == [0, 1] for t in got.values())  # the first block settles all


def test_statistics_and_empty_tables(spark):
    camps = _campaigns(spark, 50)
    imps = spark.range(30).select(F.col("id").alias("imp_id"))
    want = CA.candidate_statistics(imps, CA.candidate_array(CA.collect_campaigns(camps)))
    got = CA.candidate_statistics_blocked(imps, camps, block=11)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect())
    assert key(got) == key(want)
    none = camps.limit(0)
    assert all(r.top == [] for r in CA.top_candidates_pruned(imps, none, 2).collect())
    assert CA.best_campaign_pruned(imps, none).count() == 0 and CA.candidate_statistics_blocked(imps, none).count() == 0
    assert CA.top_candidates_pruned(imps.limit(0), camps, 2, block=9).count() == 0
