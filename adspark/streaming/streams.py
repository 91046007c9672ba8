"""Structured Streaming operators.

Sources are Parquet folders or files; every query runs with an
``availableNow`` trigger to drain what is there, with its checkpoint in the
shared checkpoint folder so a restarted query resumes where it stopped. Where
the order of rows matters, a source is fed range by range, each written by as
many tasks as it needs and drained as one micro-batch. Sinks are Parquet
folders (append) or ``foreachBatch`` writers that own one folder per batch id,
so a replayed batch rewrites its folder and touches no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from adspark.operators.ordering import range_blocks
from adspark.session import REQUIRED_CONF, shared_path, staged


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event table as a stream, with ``ts`` as TIMESTAMP (watermarks need it)."""
    schema = spark.read.parquet(path).schema
    # A stream reads a folder or a pattern: the pattern also finds a single file.
    return spark.readStream.schema(schema).parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def ranges(df: DataFrame, order_col: str, n: int) -> list[DataFrame]:
    """``df`` cut into at most ``n`` consecutive ranges of an integer column, about equal in rows."""
    cuts = df.agg(F.percentile_approx(order_col, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.where(F.col(order_col) > lo)
        out.append(part if hi is None else part.where(F.col(order_col) <= hi))
    return out


#: Rows that a micro-batch of ``drain_ranges`` holds.
BATCH_ROWS = 5_000_000


def drain_ranges(df: DataFrame, order_col: str, n: int, build, name: str = "stream", **how) -> str:
    """Feed ``df`` to a stream range by range and drain each as one micro-batch.

    ``build`` turns the source stream into the query; it starts anew for each
    range on the same checkpoint and sink, as a query does after a restart.
    There are at least ``n`` ranges, and more where one would hold more than
    ``BATCH_ROWS`` rows.
    """
    spark, df = df.sparkSession, staged(df, f"{name}-rows")
    n = max(n, -(-df.count() // BATCH_ROWS))
    path = shared_path(spark, f"{name}-in")
    how = {"sink": shared_path(spark, f"{name}-out"), "checkpoint": shared_path(spark, f"{name}-ckpt")} | how
    for part in ranges(df, order_col, n):
        part.write.mode("append").parquet(path)
        sink = drain(build(spark.readStream.schema(df.schema).parquet(path)), name=name, **how)
    return sink


def drain(stream_df: DataFrame, sink: str | None = None, output_mode: str = "append",
          foreach_batch=None, name: str = "stream", checkpoint: str | None = None) -> str:
    """Run to completion with ``availableNow``; returns the sink path (Parquet).

    Passing the ``checkpoint`` (and ``sink``) of an earlier run resumes it:
    only files not yet processed are read, and keyed state carries over.
    """
    spark = stream_df.sparkSession
    sink = sink or shared_path(spark, f"{name}-out")
    ckpt = checkpoint or shared_path(spark, f"{name}-ckpt")
    w = stream_df.writeStream.option("checkpointLocation", ckpt).outputMode(output_mode).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format("parquet").option("path", sink).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return sink


# ---------------------------------------------------------------------------
# Frequency cap with keyed state
# ---------------------------------------------------------------------------
CAPPED = "imp_id long, user_id long, campaign_id long, win_no long"


class CapProcessor(StatefulProcessor):
    """Wins so far of one user, in a map by campaign; emits the wins that are among a campaign's first ``tau``.

    The user is the key, so one state store entry per (user, campaign) is read
    and written through the map, and a user's campaigns share a task. Of a
    batch only the ``tau - n`` smallest ids of each campaign are held, whatever
    the number of rows.
    """

    def __init__(self, tau: int):
        self.tau = tau

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.wins = handle.getMapState("wins", "campaign_id long", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[int, list[int]]] = {}  # campaign -> (wins before, smallest ids)
        for pdf in rows:
            for campaign, ids in pdf.groupby("campaign_id")["imp_id"]:
                at = int(campaign)
                if at not in held:
                    held[at] = (self.wins.getValue((at,))[0] if self.wins.containsKey((at,)) else 0, [])
                before, kept = held[at]
                held[at] = (before, sorted([*kept, *ids.nsmallest(max(self.tau - before, 0)).tolist()])[:max(self.tau - before, 0)])
        out = [(int(i), int(key[0]), at, before + no) for at, (before, kept) in held.items() for no, i in enumerate(kept, 1)]
        for at, (before, kept) in held.items():
            if kept:
                self.wins.updateValue((at,), (before + len(kept),))
        yield pd.DataFrame(out, columns=["imp_id", "user_id", "campaign_id", "win_no"]).astype("int64")

    def close(self) -> None:
        pass


def stream_frequency_cap(wins_stream: DataFrame, tau: int) -> DataFrame:
    """First ``tau`` wins per (user, campaign) across micro-batches (R3), by ``transformWithState``.

    Batches must arrive in id order. Map state needs the RocksDB state store,
    which is set on the session if it was another; a restart on the same
    checkpoint carries the counts on. Wins without a user or campaign have no
    cap to count against and are left out.
    """
    for key in [k for k in REQUIRED_CONF if k.startswith("spark.sql.streaming.stateStore.")]:
        wins_stream.sparkSession.conf.set(key, REQUIRED_CONF[key])
    wins = wins_stream.select("imp_id", "user_id", "campaign_id").where("user_id IS NOT NULL AND campaign_id IS NOT NULL")
    return wins.groupBy("user_id").transformWithStateInPandas(CapProcessor(tau), CAPPED, "append", "none")


# ---------------------------------------------------------------------------
# Windowed spend and conversions
# ---------------------------------------------------------------------------
def windowed_spend(log_stream: DataFrame, ts: str = "ts", window: str = "1 day",
                   watermark: str = "2 days") -> DataFrame:
    """Per event-time window: wins, spend, expected conversions, CPA."""
    won = F.col("win")
    agg = (log_stream.withWatermark(ts, watermark)
           .groupBy(F.window(ts, window).alias("w"))
           .agg(F.count_if(won).alias("wins"),
                F.sum(F.when(won, F.col("market_price")).otherwise(F.lit(0.0))).alias("spend"),
                F.sum(F.when(won, F.col("pconv")).otherwise(F.lit(0.0))).alias("conv")))
    return agg.withColumn("cpa", F.when(F.col("conv") > 0, F.col("spend") / F.col("conv")))


def write_updates(path: str):
    """foreachBatch writer for update-mode results: batch b owns the folder ``batch_id=b``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def latest_updates(spark: SparkSession, path: str, key: str = "w") -> DataFrame:
    """The last state of each key that ``write_updates`` wrote."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch_id")]), "batch_id").alias("v")).select(key, "v.*")


# ---------------------------------------------------------------------------
# Delayed conversion attribution
# ---------------------------------------------------------------------------
def attribution_rows(imp: DataFrame, conv: DataFrame) -> DataFrame:
    """Impressions (kind 0) and conversions (kind 1) as one table of (campaign_id, unique_id, us, kind, event_id)."""
    i = imp.select("campaign_id", "unique_id", F.col("dttm_utc").alias("ts"), F.lit(0).alias("kind"), "event_id")
    c = conv.select(F.col("imp_click_campaign_id").alias("campaign_id"), F.col("imp_click_unique_id").alias("unique_id"),
                    F.col("conv_dttm_utc").alias("ts"), F.lit(1).alias("kind"), F.col("conv_event_id").alias("event_id"))
    both = i.unionByName(c)
    return both.select("campaign_id", "unique_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "kind", "event_id")


def stream_attribution(out_path: str, state_path: str, window_days: int = 7, watermark: str = "1 day",
                       rows_per_block: int = 1_000_000):
    """foreachBatch body: conversions with the impression they go to, and impressions that got none.

    Batches are ``attribution_rows``. A conversion goes to the latest
    impression of its campaign and user at or before it, at most
    ``window_days`` earlier (ties to the highest id): (event_id,
    conv_event_id, latency_s), one row per conversion, settled when the
    watermark has passed it. An impression whose window has passed without one
    is emitted with nulls. The watermark lies ``watermark`` behind the newest
    row so far; rows that come after it has passed them are late and left out,
    as are rows without a campaign, user or time, which match nothing. What
    is open when a bounded input ends is settled by ``finish_attribution``.

    Batch b reads the snapshot of batch b-1 (the watermark, impressions whose
    window is open and unsettled conversions, as plain rows) and overwrites its
    own folders. A missing snapshot fails the batch. No group is held in one
    task or row: rows are cut into ranges of (campaign, user, time) of about
    ``rows_per_block`` rows, and only the last impression of each key in a
    range is carried on to the next.
    """
    delay_ms = pd.Timedelta(watermark) // pd.Timedelta("1ms")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = f"{state_path}/batch_id={batch_id}"
        newest, was, rows = batch.agg(F.max("us")).first()[0], None, batch.withColumn("got", F.lit(False))
        if batch_id > 0:
            prev = f"{state_path}/batch_id={batch_id - 1}"
            was = spark.read.parquet(f"{prev}/clock").first()["now"]
            if was is not None:
                rows = rows.where(F.col("us") > was)
            rows = rows.unionByName(spark.read.parquet(f"{prev}/rows"))
        now = max((t for t in (was, None if newest is None else (newest // 1000 - delay_ms) * 1000) if t is not None), default=None)
        spark.createDataFrame([(now,)], "now long").write.mode("overwrite").parquet(f"{state}/clock")
        rows = rows.where(F.col("us").isNotNull() & F.col("campaign_id").isNotNull() & F.col("unique_id").isNotNull())
        passed, window_us = F.lit(now).cast("bigint"), window_days * 86_400_000_000
        is_open = F.when(F.col("kind") == 0, F.col("us") + window_us >= passed).otherwise(F.col("us") > passed)
        _settle(rows, is_open, F.col("us") <= passed, f"{out_path}/batch_id={batch_id}", window_us, rows_per_block) \
            .write.mode("overwrite").parquet(f"{state}/rows")
    return run


def finish_attribution(spark: SparkSession, out_path: str, state_path: str, window_days: int = 7, rows_per_block: int = 1_000_000) -> None:
    """Settle what ``stream_attribution`` has left open, as if no row came any more.

    For inputs that end: with it the output equals the batch form. The rows go
    to the folder of the batch after the last one and the state stays, so the
    call can be repeated, and a stream that goes on after all rewrites that
    folder with what has really passed. A last batch that did not finish (its
    snapshot lacks the rows) fails the call.
    """
    last = spark.read.option("basePath", state_path).parquet(f"{state_path}/batch_id=*/clock").agg(F.max("batch_id")).first()[0]
    rows = spark.read.parquet(f"{state_path}/batch_id={last}/rows")
    _settle(rows, F.lit(False), F.lit(True), f"{out_path}/batch_id={last + 1}", window_days * 86_400_000_000, rows_per_block)


def _settle(rows: DataFrame, is_open: Column, is_due: Column, out: str, window_us: int, rows_per_block: int) -> DataFrame:
    """Write the due conversions with their impressions, and closed impressions without one; returns the rows still open."""
    key, spark = ["campaign_id", "unique_id"], rows.sparkSession
    rows = range_blocks(rows, [F.col(c) for c in (*key, "us", "kind", "event_id")], rows_per_block)
    is_imp = F.col("kind") == 0

    # The last impression so far: in the range by a running maximum, before it by one over the ranges of the key.
    seen = F.when(is_imp, F.struct("us", "event_id"))
    w_in = Window.partitionBy(*key, "_b").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    conv = rows.withColumn("_in", F.max(seen).over(w_in)).where(~is_imp & is_due)
    w_b = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*key, "_b").agg(F.max(seen).alias("_end"))
    ends = ends.withColumn("_before", F.max("_end").over(w_b)).where(F.col("_before").isNotNull()).drop("_end")
    gap = F.col("us") - F.col("_i.us")
    conv = conv.join(ends, [*key, "_b"], "left").withColumn("_i", F.coalesce("_in", "_before")).where(gap <= window_us)
    conv = conv.select(*key, F.col("_i.event_id").alias("event_id"), F.col("event_id").alias("conv_event_id"), (gap / F.lit(1e6)).alias("latency_s"))
    conv.write.mode("overwrite").parquet(f"{out}/converted=true")

    hit = spark.read.parquet(f"{out}/converted=true").select(*key, "event_id").distinct()
    hit = hit.withColumn("kind", F.lit(0)).withColumn("_hit", F.lit(True))
    rows = rows.drop("_b").join(hit, [*key, "kind", "event_id"], "left")
    rows = rows.withColumn("got", F.col("got") | F.col("_hit").isNotNull()).drop("_hit")
    none = rows.where(is_imp & ~is_open & ~F.col("got"))
    none.select(*key, "event_id", F.lit(None).cast("long").alias("conv_event_id"), F.lit(None).cast("double").alias("latency_s")) \
        .write.mode("overwrite").parquet(f"{out}/converted=false")
    return rows.where(is_open)


def join_attribution(imp_stream: DataFrame, conv_stream: DataFrame, window_days: int = 7, watermark: str = "1 day") -> DataFrame:
    """Conversions with each impression they may go to, as a stream-stream outer join.

    Both sides have a watermark and the times a range, so Spark drops an
    impression from its state once its window has passed, and emits a
    conversion without any impression (nulls) once no impression can come.
    Append mode: (campaign_id, unique_id, conv_event_id, conv_ts, event_id,
    ts), a row per pair; ``latest_impression`` leaves the one that counts.

    Inputs as ``ad_impressions`` / ``ad_conversions``; rows without a campaign,
    user or time match nothing. Use it where a key has few rows in a window: it
    emits all pairs and keeps a key's rows in one task. ``stream_attribution``
    is for hot keys: one row per conversion, ranges instead of keys.
    """
    imp = imp_stream.select("campaign_id", "unique_id", "event_id", F.col("dttm_utc").cast("timestamp").alias("ts"))
    conv = conv_stream.select(F.col("imp_click_campaign_id").alias("c_campaign"), F.col("imp_click_unique_id").alias("c_user"), "conv_event_id",
                              F.col("conv_dttm_utc").cast("timestamp").alias("conv_ts"))
    imp, conv = imp.withWatermark("ts", watermark), conv.where("c_campaign IS NOT NULL AND c_user IS NOT NULL").withWatermark("conv_ts", watermark)
    near = F.expr(f"campaign_id = c_campaign AND unique_id = c_user AND ts <= conv_ts AND ts >= conv_ts - INTERVAL {int(window_days)} DAYS")
    both = conv.join(imp, near, "left_outer")
    return both.select(F.col("c_campaign").alias("campaign_id"), F.col("c_user").alias("unique_id"), "conv_event_id", "conv_ts", "event_id", "ts")


def latest_impression(pairs: DataFrame) -> DataFrame:
    """Of each conversion's pairs the latest impression (ties to the highest id): event_id, conv_event_id, latency_s."""
    last = pairs.groupBy("conv_event_id", "conv_ts").agg(F.max(F.when(F.col("event_id").isNotNull(), F.struct("ts", "event_id"))).alias("i"))
    gap = (F.unix_micros("conv_ts") - F.unix_micros("i.ts")) / F.lit(1e6)
    return last.select(F.col("i.event_id").alias("event_id"), "conv_event_id", gap.alias("latency_s"))


# ---------------------------------------------------------------------------
# Allocation with carried budgets and caps
# ---------------------------------------------------------------------------
def stream_allocation(camps: list[dict], out_path: str, state_path: str, predictor: str = "random", beta: float = 1.0,
                      tau: int = 3):
    """foreachBatch body: exact replay of each micro-batch with state carried between batches.

    Batch b reads the state snapshot of batch b-1 (spend per campaign, wins
    per (user, campaign)), runs the fixpoint replay on its impressions, and
    overwrites ``log/batch_id=b`` and ``state/batch_id=b``. A replayed batch
    id rewrites the same folders. Batches must arrive in impression order. A
    missing snapshot fails the batch: budgets and caps never start over.
    """
    from adspark.operators.allocate import allocation_replay

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        spent0, wins0 = {}, None
        if batch_id > 0:
            prev = f"{state_path}/batch_id={batch_id - 1}"
            sp = spark.read.parquet(f"{prev}/spend")
            spent0 = {r["campaign_id"]: r["spent"] for r in sp.collect()}  # one row per campaign
            wins0 = spark.read.parquet(f"{prev}/wins")
        if batch.limit(1).count() == 0:
            log = None
        else:
            log = allocation_replay(batch, camps, predictor=predictor, beta=beta, tau=tau,
                                    spent0=spent0, wins0=wins0)
            log.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
            log = spark.read.parquet(f"{out_path}/batch_id={batch_id}")
        # New snapshot = previous snapshot + this batch's wins.
        spend_rows = [(int(k), float(v)) for k, v in spent0.items()]
        spend = spark.createDataFrame(spend_rows, "campaign_id long, spent double")
        wins = wins0 if wins0 is not None else spark.createDataFrame([], "user_id long, campaign_id long, n_prior long")
        if log is not None:
            w = log.where(F.col("win"))
            spend = (spend.unionByName(w.groupBy("campaign_id").agg(F.sum("market_price").alias("spent")))
                     .groupBy("campaign_id").agg(F.sum("spent").alias("spent")))
            wins = (wins.unionByName(w.groupBy("user_id", "campaign_id").agg(F.count(F.lit(1)).alias("n_prior")))
                    .groupBy("user_id", "campaign_id").agg(F.sum("n_prior").alias("n_prior")))
        spend.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}/spend")
        wins.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}/wins")
    return run
