"""The Bloom filter as a table: no key is missed, few others pass; the label join by it."""

from pyspark.sql import functions as F

from adspark.operators import keyfilter
from adspark.operators import label as L
from adspark.plans import registry as R
from conftest import SF_SMALL


def test_no_key_is_missed_and_few_others_pass(spark):
    n = 20_000
    keys = spark.range(n).select((F.col("id") * 3).alias("a"), F.concat(F.lit("u"), "id").alias("b"))
    table = keyfilter.build(keys.unionByName(keys.limit(100)).unionByName(spark.createDataFrame([(None, "x"), (1, None)], "a long, b string")), ["a", "b"], n)
    others = spark.range(5 * n).select((F.col("id") * 3 + 1).alias("a"), F.concat(F.lit("u"), "id").alias("b"))
    assert keyfilter.may_match(keys, ["a", "b"], table, n).where("NOT _may_match").count() == 0
    assert keyfilter.may_match(others, ["a", "b"], table, n).where("_may_match").count() < 0.015 * 5 * n
    nulls = spark.createDataFrame([(None, "u1"), (0, None), (None, None)], "a long, b string")
    assert keyfilter.may_match(nulls, ["a", "b"], table, n).where("_may_match").count() == 0
    assert keyfilter.may_match(keys, ["a", "b"], table.limit(0), n).where("_may_match").count() == 0


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_label_join_is_the_same_each_way(spark):
    imp = R.imps(spark, SF_SMALL).withColumn("unique_id", F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("unique_id")))
    conv = R.convs(spark, SF_SMALL).withColumn("imp_click_unique_id", F.when(F.col("conv_event_id") % 7 == 0, F.lit(None)).otherwise(F.col("imp_click_unique_id")))
    for label in (L.label_dedup, L.label_with_goal):
        want = _rows(label(imp, conv))
        assert _rows(label(imp, conv, broadcast_keys=0)) == want
        assert _rows(label(imp, conv, broadcast_keys=0, filter_keys=0)) == want
    assert _rows(L.label_dedup(imp, conv.limit(0), broadcast_keys=0)) == _rows(L.label_dedup(imp, conv.limit(0)))


def test_only_possible_matches_are_shuffled(spark):
    n = 30_000
    imp = R.imps(spark, SF_SMALL)
    imp = spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("campaign_id", "unique_id", "event_id") else F.col("id").alias(f.name) for f in imp.schema])
    conv = R.convs(spark, SF_SMALL)
    conv = spark.range(n // 100).select(*[(F.col("id") * 100).cast(f.dataType).alias(f.name) if f.name in L.CONV_KEYS else
                                          F.lit("2024-01-01 00:00:00").cast(f.dataType).alias(f.name) if f.name == "conv_dttm_utc" else
                                          F.lit(1).cast("string").cast(f.dataType).alias(f.name) for f in conv.schema])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.label_dedup(imp, conv, broadcast_keys=0)
        assert out.where("conversion_flag = 1").count() == n // 100 and out.count() == n
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One branch is shuffled, under the filter's test; the other goes straight into the union.
    left = plan.split("Union")[1]
    assert left.count("Exchange hashpartitioning(campaign_id") == 1
    assert left.index("Exchange hashpartitioning(campaign_id") < left.index("BroadcastHashJoin")
