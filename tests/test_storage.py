"""Committed appends, footer counts and mergeable sketches."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from adspark.operators import sketch as SK
from adspark.plans import registry as R
from adspark.session import shared_path
from adspark.sources import io as IO
from conftest import SF_SMALL


def test_a_repeated_append_adds_nothing(spark):
    path = shared_path(spark, "committed")
    with pytest.raises(ValueError):
        IO.read_committed(spark, path)
    assert IO.committed_batches(spark, path).count() == 0
    one, two = spark.range(10).toDF("imp_id"), spark.range(10, 25).toDF("imp_id")
    assert IO.append_committed(one, path, "b/1") and IO.append_committed(two, path, 2)
    assert not IO.append_committed(one, path, "b/1") and not IO.append_committed(one, path, 2)
    rows = IO.read_committed(spark, path)
    assert sorted(r.imp_id for r in rows.collect()) == list(range(25))
    assert {r.batch_id: r["count"] for r in rows.groupBy("batch_id").count().collect()} == {"b~2f1": 10, "2": 15}
    assert {r.batch_id: r.n_rows for r in IO.committed_batches(spark, path).collect()} == {"b/1": 10, "2": 15}
    with pytest.raises(ValueError):
        IO.append_committed(spark.range(3).toDF("other"), path, 3)


def test_unpublished_rows_are_not_read(spark):
    path = shared_path(spark, "committed-half")
    IO.append_committed(spark.range(4).toDF("imp_id"), path, 0)
    spark.range(100, 200).toDF("imp_id").write.parquet(f"{path}/data/1-{'a' * 32}")  # a writer that died before its manifest
    assert IO.read_committed(spark, path).count() == 4
    assert IO.append_committed(spark.range(100, 103).toDF("imp_id"), path, 1)
    assert IO.read_committed(spark, path).count() == 7


def test_of_two_writers_one_counts(spark):
    path = shared_path(spark, "committed-race")
    IO.append_committed(spark.range(1).toDF("imp_id"), path, "first")
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(IO.append_committed(spark.range(k, k + 5).toDF("imp_id"), path, "same"))) for k in (10, 20, 30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = sorted(r.imp_id for r in IO.read_committed(spark, path).where("batch_id = 'same'").collect())
    assert won.count(True) == 1 and got in [list(range(k, k + 5)) for k in (10, 20, 30)]


def test_counts_come_from_the_footers(spark):
    df = IO.footer_counts(spark, os.path.join(SF_SMALL, "events.parquet"), ["event_id"])
    assert "PushedAggregation: [COUNT(*), COUNT(event_id), MIN(event_id), MAX(event_id)]" in df._jdf.queryExecution().executedPlan().toString()
    ev = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    assert tuple(df.first()) == tuple(ev.agg(F.count("*"), F.count("event_id"), F.min("event_id"), F.max("event_id")).first())
    with pytest.raises(ValueError):
        IO.footer_counts(spark, os.path.join(SF_SMALL, "events.parquet"), ["event_type"])


def test_days_merge_without_the_past(spark):
    """Each day profiled alone and appended; the merged profile is within its bounds of the exact one."""
    n = 60_000
    df = spark.range(n).select((F.col("id") % 3).alias("campaign_id"), (F.col("id") % 5).alias("day"), (F.xxhash64("id") % 9000).alias("user"),
                               F.when(F.col("id") % 10 > 0, F.sqrt(F.col("id").cast("double"))).alias("value"))
    path = shared_path(spark, "sketches")
    for day in range(5):
        IO.append_committed(SK.profile_sketches(df.where(F.col("day") == day), ["campaign_id", "day"], ["user"], ["value"]), path, day)
    kept = IO.read_committed(spark, path).drop("batch_id")
    weeks = SK.merge_sketches(SK.merge_sketches(kept, ["day"]), [])  # merges of merges
    got = SK.estimates(weeks, [], {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    exact = df.agg(F.count("*"), F.count_distinct("user"), F.count("value"), F.avg("value"), F.min("value"), F.max("value")).first()
    assert got.n_rows == exact[0] and got.value_n == exact[2] and abs(got.value_mean - exact[3]) < 1e-6 and (got.value_min, got.value_max) == (exact[4], exact[5])
    assert abs(got.user_distinct - exact[1]) <= 0.05 * exact[1]
    for p, v in ((0.1, got.value_p10), (0.5, got.value_p50), (0.99, got.value_p99)):
        assert abs(df.where(F.col("value") <= v).count() / got.value_n - p) < 0.02
    nulls = SK.estimates(SK.profile_sketches(df.limit(5).withColumn("value", F.lit(None).cast("double")), ["campaign_id"], ["user"], ["value"]), ["campaign_id"], {"p50": 0.5})
    assert all(r.value_p50 is None and r.value_n == 0 and r.value_mean is None for r in nulls.collect())


def test_log_sink_counts_each_impression_once(spark):
    out = R.QUERIES["auction_log_sink"](spark, SF_SMALL)
    assert out.count() == out.select("imp_id").distinct().count() == R.imps(spark, SF_SMALL).count()
