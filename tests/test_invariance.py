"""Results do not depend on partitioning; plans have the expected shape."""

from adspark.operators import sampling as P
from adspark.plans import registry as R
from conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_splits_and_order_ignore_partitioning(spark):
    base = R.labelled(spark, SF_SMALL)
    a = _rows(P.stratified_split(base.repartition(1), n_blocks=8), ["event_id", "conv_event_id", "split"])
    b = _rows(P.stratified_split(base.repartition(17), n_blocks=64), ["event_id", "conv_event_id", "split"])
    assert a == b
    i = R.imps(spark, SF_SMALL)
    assert _rows(P.shuffled_order(i.repartition(1), n_blocks=4), ["event_id", "imp_id"]) == \
        _rows(P.shuffled_order(i.repartition(13), n_blocks=256), ["event_id", "imp_id"])
    assert _rows(P.sample_per_group(i.repartition(3), 5, n_blocks=2), ["event_id"]) == \
        _rows(P.sample_per_group(i.repartition(11), 5, n_blocks=128), ["event_id"])


def test_partition_filter_reaches_scan(spark):
    df = R.QUERIES["scan_partition_pruned"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [campaign_id" in plan and "IN (7,42,77)" in plan
    assert "PushedFilters: [IsNotNull(cnxn_type), EqualTo(cnxn_type,Cellular)]" in plan


def test_no_python_udf_in_sql_checked_hot_paths(spark):
    for name in ["label_impressions", "ua_enrich", "processed_features", "auction_log", "roc_auc"]:
        plan = R.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_intermediates_can_be_dropped(spark):
    import os

    from adspark.session import drop_intermediates, materialize, shared_path
    path = shared_path(spark, "to-drop")
    spark.range(3).write.parquet(path)
    drop_intermediates(spark)
    assert not os.path.exists(path.removeprefix("file:"))
    assert materialize(spark.range(4)).count() == 4 and os.path.exists(shared_path(spark, "x").rpartition("/")[0].removeprefix("file:"))
