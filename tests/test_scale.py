"""Costly work is dealt to all tasks whatever the files look like, and done once."""

import os
import re

from pyspark.sql import functions as F

from adspark.operators import allocate as AL
from adspark.operators import candidates as CA
from adspark.operators import ordering as O
from adspark.session import shared_path
from adspark.sources import io as IO
from serial_replay import serial_replay

CAMPS = [dict(campaign_id=10 * i, ordinal=i, true_conv_rate=0.1, value_per_conv=float(3 + i * 7 % 5), target_cpa=float(4 + i % 3),
              budget=40.0) for i in range(1, 13)]


def _imps(spark, n):
    return spark.range(n).select(F.col("id").alias("imp_id"), (F.col("id") % 11).alias("user_id"),
                                 (F.col("id") % 3).cast("string").alias("imp_campaign_id_sampled_from"))


def test_one_row_group_is_spread(spark):
    """A scan of many partitions whose rows are all in one of them."""
    path = shared_path(spark, "one-group")
    spark.range(200_000).coalesce(1).write.parquet(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in O.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sum(sizes) == 200_000 and max(sizes) < 200_000 / spark.sparkContext.defaultParallelism


def test_readers_of_decisions_do_not_score_again(spark):
    log = AL.stateless_auction(_imps(spark, 50), CAMPS)
    assert "lambda" not in log._jdf.queryExecution().optimizedPlan().toString()
    budgets = spark.createDataFrame([(c["campaign_id"], c["budget"]) for c in CAMPS], "campaign_id long, budget double")
    paced = AL.budget_pacing(AL.decisions(_imps(spark, 50), CAMPS), budgets)
    assert "lambda" not in paced._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_is_scored_with_one_draw(spark):
    scored = _imps(spark, 5).select(CA.scored_candidates(CA.candidate_array(CAMPS), "random", F.col("imp_id")).alias("s"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_best_candidate_is_the_greatest_score(spark):
    for rule in ("value", "target_cpa"):
        for camps in (CAMPS, CA.best_first(CAMPS, rule), CAMPS[::-1], [c | dict(value_per_conv=-1.0) for c in CAMPS], CAMPS[:1]):
            cands = CA.candidate_array(camps)
            want = F.array_max(CA.scored_candidates(cands, "random", F.col("imp_id"), rule))
            got = CA.best_candidate(cands, "random", F.col("imp_id"), rule)
            rows = _imps(spark, 300).select(want.alias("want"), got.alias("got")).collect()
            assert all(r.want is not None and r.want == r.got for r in rows)


def test_replay_in_growing_blocks_equals_serial(spark):
    """Blocks of 40, 80, 160 and the rest; with the small budgets all is spent before the last."""
    for budget in (40.0, 15.0):
        camps = [c | dict(budget=budget) for c in CAMPS]
        imps = _imps(spark, 500)
        log = AL.allocation_replay(imps, camps, beta=0.9, tau=3, shortlist=4, first_block=40)
        got = sorted((r.imp_id, r.campaign_id, r.win, r.eligible_campaigns, round(r.budget_remaining, 6)) for r in log.collect())
        rows = [(r.imp_id, r.user_id, r.imp_campaign_id_sampled_from) for r in imps.orderBy("imp_id").collect()]
        want = serial_replay(rows, camps, predictor="random", beta=0.9, tau=3)
        assert got == [(w["imp_id"], w["campaign_id"], w["win"], w["eligible_campaigns"], round(w["budget_remaining"], 6)) for w in want]
        assert got[-1][0] > 40 and (budget > 15 or got[-1][0] < 280)


def test_small_files_do_not_mean_many_writers(spark):
    path = shared_path(spark, "small-files")
    df = spark.range(600).select((F.col("id") % 4).alias("campaign_id"), F.col("id").alias("event_id"))
    IO.compact(df, path, "campaign_id", "event_id", max_records_per_file=5)
    names = [f for _, _, files in os.walk(path.removeprefix("file:")) for f in files if f.endswith(".parquet")]
    assert len({re.match(r"part-(\d+)", f)[1] for f in names}) == 1 and len(names) == 120
    per_file = IO.file_row_counts(spark, path, "campaign_id").agg(F.max("n_rows"), F.sum("n_rows")).first()
    assert tuple(per_file) == (5, 600)
