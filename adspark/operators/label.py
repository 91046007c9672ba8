"""Impression <-> conversion labelling.

One left join on (campaign, user) replaces the reference's per-campaign loop.
The conversion side is reduced to one row per join key *before* the join
(earliest conversion plus a count; partial aggregation map-side), so every
impression yields exactly one row and a hot key never multiplies into
impression x conversion pairs.

Few impressions convert, so impressions are not shuffled to find that out.
By the number of conversions, ``left_join_first`` broadcasts the conversion
side, or else a Bloom filter of its keys (``keyfilter``): only impressions that
pass the filter are shuffled and joined, the others bypass the join. Beyond
that filter's bound both sides are shuffled. The reference's fan-out (one row per matching
pair, T1) is still available with ``fan_out=True`` for small inputs; no
registered query uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adspark.functions.timefeat import day_of_week_monday0, hour_of_day
from adspark.operators import keyfilter
from adspark.operators.ordering import range_blocks
from adspark.session import materialize

IMP_KEYS = ("campaign_id", "unique_id")
CONV_KEYS = ("imp_click_campaign_id", "imp_click_unique_id")


#: Conversions up to which their first-per-key table is broadcast, and a filter of their keys.
MAX_BROADCAST_KEYS = 1_000_000
MAX_FILTER_KEYS = 150_000_000


def _key_cond(imp: DataFrame, conv: DataFrame, imp_keys=IMP_KEYS, conv_keys=CONV_KEYS):
    cond = None
    for a, b in zip(imp_keys, conv_keys):
        c = imp[a] == conv[b]
        cond = c if cond is None else cond & c
    return cond


def _finish(joined: DataFrame, conv_cols: list[str]) -> DataFrame:
    """Rename, flag and time features shared by every labelling variant."""
    out = (joined
           .withColumnRenamed("dttm_utc", "impression_dttm_utc")
           .withColumn("conversion_flag", F.col("conv_dttm_utc").isNotNull().cast("tinyint"))
           .withColumn("impression_hour", hour_of_day(F.col("impression_dttm_utc")))
           .withColumn("impression_dayofweek", day_of_week_monday0(F.col("impression_dttm_utc"))))
    return out.drop(*[c for c in conv_cols if c in CONV_KEYS])


def first_conversions(conv: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest conversion (ties by id) and the number of conversions per key."""
    return (conv.groupBy(*keys)
            .agg(F.min_by(F.struct("conv_dttm_utc", "conv_event_id", "goal_name"),
                          F.struct("conv_dttm_utc", "conv_event_id")).alias("c"),
                 F.count(F.lit(1)).alias("n_conversions"))
            .select(*keys, "c.*", "n_conversions"))


def left_join_first(imp: DataFrame, first: DataFrame, imp_keys: list[str], conv_keys: list[str], n_conv: int,
                    broadcast_keys: int = MAX_BROADCAST_KEYS, filter_keys: int = MAX_FILTER_KEYS) -> DataFrame:
    """``imp`` left joined with ``first`` (one row per key); the way depends on ``n_conv``, a bound of its keys.

    The result is the same each way and has the columns of ``imp`` and those of
    ``first`` but for its keys.
    """
    keys = [f"_k{i}" for i in range(len(conv_keys))]
    right = first.select(*[F.col(c).alias(k) for c, k in zip(conv_keys, keys)], *[c for c in first.columns if c not in conv_keys])

    def joined(left: DataFrame, other: DataFrame) -> DataFrame:
        return left.join(other, [left[a] == other[b] for a, b in zip(imp_keys, keys)], "left").drop(*keys)

    if n_conv <= broadcast_keys:
        return joined(imp, F.broadcast(right))
    if n_conv > filter_keys or keyfilter.filter_bytes(n_conv) > keyfilter.MAX_FILTER_BYTES:
        return joined(imp, right)
    typed = imp.select("*", *[F.col(a).cast(first.schema[b].dataType).alias(k) for a, b, k in zip(imp_keys, conv_keys, keys)])
    # The filter is small and read by both branches: built once.
    table = materialize(keyfilter.build(right, keys, n_conv))
    marked = keyfilter.may_match(typed, keys, table, n_conv).drop(*keys)
    rest = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in keys]
    hits = joined(marked.where("_may_match").drop("_may_match"), right)
    return hits.unionByName(marked.where("NOT _may_match").drop("_may_match").select("*", *rest))


def label_impressions(imp: DataFrame, conv: DataFrame, fan_out: bool = False,
                      conv_cols: tuple[str, ...] = ("conv_event_id", "conv_dttm_utc", "goal_name")) -> DataFrame:
    """Label each impression with its key's conversions.

    Default: one row per impression carrying the earliest conversion and
    ``n_conversions``. ``fan_out=True`` gives the reference's one row per
    matching (impression, conversion) pair - quadratic in a hot key.
    """
    if not fan_out:
        return label_dedup(imp, conv)
    c = conv.select(*CONV_KEYS, *conv_cols)
    joined = imp.join(c, _key_cond(imp, c), "left")
    return _finish(joined, list(CONV_KEYS))


def label_dedup(imp: DataFrame, conv: DataFrame, **how) -> DataFrame:
    """One row per impression: attach the earliest conversion of its key (C11); ``how`` as in ``left_join_first``."""
    first = first_conversions(conv, list(CONV_KEYS))
    out = _finish(left_join_first(imp, first, list(IMP_KEYS), list(CONV_KEYS), conv.count(), **how), [])
    return out.withColumn("n_conversions", F.coalesce(F.col("n_conversions"), F.lit(0)))


def label_with_goal(imp: DataFrame, conv: DataFrame, **how) -> DataFrame:
    """Single-key (user) labelling carrying goal columns (J2): the user's earliest conversion; ``how`` as in ``left_join_first``."""
    first = first_conversions(conv, ["imp_click_unique_id"])
    out = _finish(left_join_first(imp, first, ["unique_id"], ["imp_click_unique_id"], conv.count(), **how), [])
    return (out.withColumn("goal_name", F.coalesce(F.col("goal_name"), F.lit("No Goal Name")))
               .withColumn("n_conversions", F.coalesce(F.col("n_conversions"), F.lit(0))))


def label_by_time_key(imp: DataFrame, conv: DataFrame) -> DataFrame:
    """Composite key linking: campaign, user and calendar day (J3); earliest conversion of that key."""
    i = imp.withColumn("_day", F.to_date("dttm_utc"))
    c = first_conversions(conv.withColumn("_cday", F.to_date("conv_dttm_utc")), [*CONV_KEYS, "_cday"])
    cond = _key_cond(i, c) & (i["_day"] == c["_cday"])
    joined = i.join(c, cond, "left").drop("_day", "_cday")
    return _finish(joined, list(CONV_KEYS)).withColumn("n_conversions", F.coalesce(F.col("n_conversions"), F.lit(0)))


CLICK_KEYS = ("imp_click_dttm_utc", "imp_click_campaign_id", "imp_click_placement_id")


def label_by_click(imp: DataFrame, conv: DataFrame, **how) -> DataFrame:
    """Composite key linking by time, campaign and placement of the clicked impression.

    For data without user ids: conversions carry ``CLICK_KEYS``, which equal
    (dttm_utc, campaign_id, placement_id) of the impression that was clicked.
    Impressions that share all three are linked alike; a null in any of them
    links nothing. Adds the earliest conversion of the key and
    ``n_conversions``; ``how`` as in ``left_join_first``.
    """
    first = first_conversions(conv, list(CLICK_KEYS))
    out = _finish(left_join_first(imp, first, ["dttm_utc", "campaign_id", "placement_id"], list(CLICK_KEYS), conv.count(), **how), [])
    return out.withColumn("n_conversions", F.coalesce(F.col("n_conversions"), F.lit(0)))


def device_type_lookup(df: DataFrame, lookup: DataFrame, code_col: str = "device_type",
                       out_col: str = "device_type_full", max_rows: int = 10_000) -> DataFrame:
    """Left join to the device-type dimension (J4); broadcast when it has at most ``max_rows`` rows."""
    lk = lookup.select(F.col("short").alias("_short"), F.col("full_name").alias(out_col))
    if lookup.limit(max_rows + 1).count() <= max_rows:
        lk = F.broadcast(lk)
    return df.join(lk, df[code_col] == lk["_short"], "left").drop("_short")


def conversion_latency(imp: DataFrame, conv: DataFrame, window_days: int = 7, rows_per_block: int = 1_000_000) -> DataFrame:
    """Each conversion with the impression it goes to, and the seconds between them.

    That is the latest impression of its campaign and user at or before it,
    at most ``window_days`` earlier (ties to the highest id); a conversion
    without one is left out, so is any row without a campaign or user. One row
    per conversion at most.

    No pair join: impressions and conversions are stacked and cut into ranges
    of (campaign, user, time) that follow the data. Inside a range a running
    maximum gives the last impression; a small window over the ranges' maxima
    gives the last one of any earlier range of the key. A hot key is spread
    over as many ranges as its rows fill.
    """
    key = ["campaign_id", "unique_id"]
    stack = (imp.select(*key, "event_id", F.col("dttm_utc").alias("ts"), "device_type", F.lit(0).alias("kind"))
             .unionByName(conv.select(F.col("imp_click_campaign_id").alias("campaign_id"),
                                      F.col("imp_click_unique_id").alias("unique_id"),
                                      F.col("conv_event_id").alias("event_id"), F.col("conv_dttm_utc").alias("ts"),
                                      F.lit(None).cast("string").alias("device_type"), F.lit(1).alias("kind")))
             .where(F.col("campaign_id").isNotNull() & F.col("unique_id").isNotNull())
             .withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts"))
    rows = range_blocks(stack, [F.col(c) for c in (*key, "_us", "kind", "event_id")], rows_per_block)
    seen = F.when(F.col("kind") == 0, F.struct("_us", "event_id", "device_type"))
    # Ascending time, impressions before conversions at equal time.
    w_in = Window.partitionBy(*key, "_b").orderBy("_us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inb = rows.withColumn("_last_in", F.max(seen).over(w_in)).where(F.col("kind") == 1)
    w_blk = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key, "_b").agg(F.max(seen).alias("_end"))
    before = ends.withColumn("_last_before", F.max("_end").over(w_blk)).where(F.col("_last_before").isNotNull()).drop("_end")
    j = inb.drop("device_type").join(before, [*key, "_b"], "left").withColumn("_i", F.coalesce("_last_in", "_last_before"))
    gap = F.col("_us") - F.col("_i._us")
    return (j.where(gap <= F.lit(window_days * 86_400_000_000))
             .select(*key, F.col("_i.event_id").alias("event_id"), F.col("event_id").alias("conv_event_id"),
                     F.col("_i.device_type").alias("device_type"), (gap / F.lit(1e6)).alias("latency_s")))
