"""Exact-size weighted sampling, range-coded dictionaries, sparse one-hot."""

import pytest
from pyspark.sql import functions as F

from adspark.operators import features as FE
from adspark.operators import sampling as P
from adspark.operators.ordering import running_sum_ranged


def test_exact_size_and_class_shares(spark):
    df = spark.range(20_000).select((F.col("id") * 7 - 5000).alias("event_id"), (F.col("id") % 20 == 0).cast("int").alias("conversion_flag"))
    for n in (1, 12_345, 60_000):
        got = P.ratio_sample_exact(df, k=4.0, n=n)
        assert got.count() == n and got.select("draw_id").distinct().count() == n
    # 1,000 positives at weight 4 and 19,000 others at weight 1: 17.4 % of the draws.
    share = got.agg(F.avg("conversion_flag")).first()[0]
    assert abs(share - 4000 / 23_000) < 5 * (0.174 * 0.826 / 60_000) ** 0.5
    assert P.ratio_sample_exact(df).count() == 20_000


def test_draws_follow_the_weights(spark):
    rows = [(i, float(w)) for i, w in enumerate([5, 0, 1, 3, -2, 1, 10])] + [(7, None)]
    df = spark.createDataFrame(rows, "event_id long, w double").repartition(3)
    got = {r.event_id: r["count"] for r in P.weighted_sample(df, F.col("w"), 20_000, rows_per_block=2).groupBy("event_id").count().collect()}
    assert set(got) == {0, 2, 3, 5, 6} and sum(got.values()) == 20_000
    for i, w in ((0, 5), (2, 1), (3, 3), (5, 1), (6, 10)):
        assert abs(got[i] - 1000 * w) < 6 * (1000 * w) ** 0.5
    assert P.weighted_sample(df, F.lit(0.0), 50).count() == 0 and P.weighted_sample(df, F.col("w"), 0).count() == 0
    assert P.weighted_sample(df.limit(0), F.col("w"), 50).count() == 0


def test_the_draw_does_not_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("event_id"), (1 + F.col("id") % 9).cast("double").alias("w"))
    draws = lambda d, b: sorted(map(tuple, P.weighted_sample(d, F.col("w"), 4000, rows_per_block=b).select("draw_id", "event_id").collect()))
    assert draws(df.repartition(1), 10_000) == draws(df.repartition(9), 137)


def test_running_sum_over_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("x"))
    want, acc = [], 0.0
    for i in range(1000):
        acc += i % 7
        want.append(acc)
    assert [r["_cum"] for r in running_sum_ranged(df, ["id"], "x", 90).orderBy("id").collect()] == want


def test_large_dictionary_spreads_and_keeps_its_codes(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("campaign_id"), F.concat(F.lit("f"), F.col("id") % 5000).alias("ua_device_family"), F.lit(None).cast("string").alias("country"))
    features = ["campaign_id", "ua_device_family", "country"]
    enc = FE.fit_ordinal_encoder(df, features, rows_per_block=20_000)
    got = enc.where("feature = 'campaign_id'").agg(F.count("*"), F.count_if(F.col("category").cast("long") == F.col("code"))).first()
    assert tuple(got) == (n, n)  # numbers in numeric order
    words = [r.category for r in enc.where("feature = 'ua_device_family'").orderBy("code").collect()]
    assert words == sorted(words) and len(words) == 5000
    assert [(r.category, r.code) for r in enc.where("feature = 'country'").collect()] == [("-1", 0)]
    sizes = enc.where("feature = 'campaign_id'").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < n / 2


def test_sparse_one_hot_of_many_levels(spark):
    n = 7_679
    df = spark.range(n).select(F.concat(F.lit("fam"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("ua_device_family"), (F.col("id") % 3).alias("campaign_id"))
    features = ["campaign_id", "ua_device_family"]
    enc = FE.fit_ordinal_encoder(df, features)
    unseen = df.limit(1).withColumn("ua_device_family", F.lit("other"))
    got = FE.one_hot_sparse(df.unionByName(unseen), enc, features).collect()
    for r in got:
        assert r.onehot.size == n + 3 and r.onehot.values == [1.0] * len(r.onehot.indices)
        assert r.onehot.indices == ([r.campaign_id] if r.ua_device_family == "other" else [r.campaign_id, 3 + int(r.ua_device_family[3:])])
    dropped = FE.one_hot_sparse(df.where("campaign_id = 0 AND ua_device_family = 'fam00003'"), enc, features, drop_first=True).first()
    assert dropped.onehot.size == n + 1 and dropped.onehot.indices == [2 + 2]
    with pytest.raises(ValueError):
        FE.one_hot(df, enc, "ua_device_family")
