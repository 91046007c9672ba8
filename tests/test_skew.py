"""A third of all rows in one key: skew-safe operators still give exact answers."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adspark.operators import allocate as AL
from adspark.operators import candidates as CA
from adspark.operators import ordering as O
from adspark.operators import profile as A
from adspark.operators.quantiles import exact_quantiles
from adspark.functions.hashing import u
from adspark.plans import registry as R
from conftest import SF_SMALL
from serial_replay import serial_replay


@pytest.fixture(scope="module")
def hot(spark):
    """Impressions with every third event moved to campaign 42 / user 7."""
    i = R.imps(spark, SF_SMALL)
    h = F.col("event_id") % 3 == 0
    return (i.withColumn("campaign_id", F.when(h, F.lit(42)).otherwise(F.col("campaign_id")))
             .withColumn("unique_id", F.when(h, F.lit(7)).otherwise(F.col("unique_id"))))


def test_blocked_rank_equals_window(hot):
    got = O.ranked_within(hot, ["campaign_id"], u("s", F.col("event_id")), "event_id", n_blocks=16)
    w = Window.partitionBy("campaign_id").orderBy(u("s", F.col("event_id")), "event_id")
    want = hot.withColumn("_rank", F.row_number().over(w))
    assert sorted((r.event_id, r._rank) for r in got.select("event_id", "_rank").collect()) == \
        sorted((r.event_id, r._rank) for r in want.select("event_id", "_rank").collect())


def test_blocked_running_sum_equals_window(hot):
    got = O.running_sum_blocked(hot, ["campaign_id"], "event_id", "value", block_size=37, out_col="c")
    w = Window.partitionBy("campaign_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumn("c", F.sum("value").over(w))
    a = {r.event_id: r.c for r in got.select("event_id", "c").collect()}
    b = {r.event_id: r.c for r in want.select("event_id", "c").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_exact_quantiles_equal_percentile(hot):
    got = exact_quantiles(hot, ["campaign_id"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, rows_per_block=60)
    want = hot.groupBy("campaign_id").agg(*[F.percentile("value", p).alias(n)
                                            for n, p in [("p10", 0.1), ("p50", 0.5), ("p90", 0.9)]])
    a = {r.campaign_id: (r.p10, r.p50, r.p90) for r in got.collect()}
    b = {r.campaign_id: (r.p10, r.p50, r.p90) for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert all(abs(x - y) < 1e-9 for x, y in zip(a[k], b[k])), k


def test_replay_with_hot_user_equals_serial(spark, hot):
    lab = R.L.label_impressions(hot, R.convs(spark, SF_SMALL))
    camps = CA.collect_campaigns(CA.campaign_params(A.campaign_conversion_rate(lab), budget=30.0))
    imps = hot.select(F.col("event_id").alias("imp_id"), F.col("unique_id").alias("user_id"),
                      F.col("campaign_id").cast("string").alias("imp_campaign_id_sampled_from"))
    got = sorted(AL.allocation_replay(imps, camps, predictor="random", tau=2, shortlist=4).collect(),
                 key=lambda r: r.imp_id)
    rows = sorted((r.imp_id, r.user_id, r.imp_campaign_id_sampled_from) for r in imps.collect())
    want = serial_replay(rows, camps, predictor="random", beta=1.0, tau=2)
    assert [(r.imp_id, r.campaign_id, r.win) for r in got] == \
        [(w["imp_id"], w["campaign_id"], w["win"]) for w in want]


def test_attributed_latency_equals_brute_force(spark, hot):
    """Every conversion goes to its latest impression of the last seven days; null keys match nothing."""
    import datetime as dt

    from adspark.operators import label as L
    conv = R.convs(spark, SF_SMALL)
    h = F.col("conv_event_id") % 3 == 0
    conv = (conv.withColumn("imp_click_campaign_id", F.when(h, F.lit(42)).otherwise(F.col("imp_click_campaign_id")))
                .withColumn("imp_click_unique_id", F.when(h, F.lit(7)).otherwise(F.col("imp_click_unique_id"))))
    none = F.lit(None).cast("bigint")
    conv = conv.unionByName(conv.limit(5).withColumn("imp_click_campaign_id", none).withColumn("conv_event_id", -F.col("conv_event_id")))
    imp = hot.unionByName(hot.limit(5).withColumn("campaign_id", none))
    got = {r.conv_event_id: (r.event_id, r.latency_s) for r in L.conversion_latency(imp, conv, rows_per_block=60).collect()}
    imps = [(r.campaign_id, r.unique_id, r.dttm_utc, r.event_id) for r in hot.collect()]
    want = {}
    for r in conv.where("imp_click_campaign_id is not null").collect():
        before = [(t, e) for c, u_, t, e in imps if (c, u_) == (r.imp_click_campaign_id, r.imp_click_unique_id)
                  and dt.timedelta(0) <= r.conv_dttm_utc - t <= dt.timedelta(days=7)]
        if before:
            t, e = max(before)
            want[r.conv_event_id] = (e, (r.conv_dttm_utc - t).total_seconds())
    assert got.keys() == want.keys() and want
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in got)


def test_blocks_follow_crowded_scores(spark):
    """All scores below 0.01: the blocks still share them evenly, and AUC is exact."""
    from adspark.operators.metrics import roc_auc
    from adspark.operators.ordering import range_blocks

    df = spark.range(20_000).select((F.col("id") / 2_000_001.0).alias("score"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    sizes = [r["count"] for r in range_blocks(df, [F.col("score").desc()], 1000).groupBy("_b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * 1000
    rows = [(r["score"], r["label"]) for r in df.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    import bisect
    neg.sort()
    want = sum(bisect.bisect_left(neg, p) for p in pos) / (len(pos) * len(neg))
    assert abs(roc_auc(df, rows_per_block=1000).first()[0] - want) < 1e-12
