"""Stream results equal the batch results after an availableNow drain over several files."""

from adspark.plans import registry as R
from conftest import SF_SMALL


def _rows(df):
    return sorted((r.imp_id, r.campaign_id, r.win, r.eligible_campaigns, round(r.budget_remaining, 6))
                  for r in df.collect())


def test_stream_allocation_equals_batch_replay(spark):
    batch = R.QUERIES["allocation_replay"](spark, SF_SMALL)
    stream = R.QUERIES["stream_allocation"](spark, SF_SMALL)
    assert _rows(stream) == _rows(batch)


def test_stream_cap_equals_batch_cap(spark):
    b = sorted(tuple(r) for r in R.QUERIES["frequency_cap"](spark, SF_SMALL).collect())
    s = sorted(tuple(r) for r in R.QUERIES["stream_frequency_cap"](spark, SF_SMALL)
               .select("imp_id", "user_id", "campaign_id", "win_no").collect())
    assert s == b


def test_stream_cap_resumes_from_checkpoint(spark):
    """Drain half the files, add the rest, drain again on the same checkpoint: equals batch."""
    from pyspark.sql import functions as F

    from adspark.session import shared_path
    from adspark.streaming import streams as ST
    log = R.stateless_log(spark, SF_SMALL)
    mid = log.agg(F.percentile_approx("imp_id", 0.5)).first()[0]
    path = shared_path(spark, "resume-src")
    sink, ckpt = shared_path(spark, "resume-out"), shared_path(spark, "resume-ckpt")

    def run(part):
        part.write.mode("append").parquet(path)
        src = spark.readStream.schema(log.schema).parquet(path).where(F.col("win"))
        ST.drain(ST.stream_frequency_cap(src, R.TAU), sink=sink, checkpoint=ckpt)
    run(log.where(F.col("imp_id") <= mid))
    first = spark.read.parquet(sink).count()
    run(log.where(F.col("imp_id") > mid))
    got = sorted(tuple(r) for r in spark.read.parquet(sink).select("imp_id", "user_id", "campaign_id", "win_no")
                 .collect())
    want = sorted(tuple(r) for r in R.QUERIES["frequency_cap"](spark, SF_SMALL).collect())
    assert 0 < first < len(want)
    assert got == want


def test_missing_state_fails_the_batch(spark):
    """Without the snapshot of the batch before, a batch must not start from zero spend."""
    import pytest

    from adspark.operators import candidates as CA
    from adspark.session import shared_path
    from adspark.streaming import streams as ST
    camps = CA.collect_campaigns(R.campaigns(spark, SF_SMALL))
    body = ST.stream_allocation(camps, shared_path(spark, "lost-log"), shared_path(spark, "lost-state"))
    ai = R.auction_imps(spark, SF_SMALL).drop("dttm_utc").limit(5)
    body(ai, 0)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        body(ai, 2)


def test_stream_attribution_of_a_hot_key(spark):
    """A third of all rows in one key, fed in four ranges, cut into small blocks: equals brute force, and the state holds open rows only."""
    import bisect

    from pyspark.sql import functions as F

    from adspark.session import shared_path
    from adspark.streaming import streams as ST
    day = 86_400_000_000
    rows = ST.attribution_rows(R.imps(spark, SF_SMALL), R.convs(spark, SF_SMALL))
    h = F.col("event_id") % 3 == 0
    rows = (rows.withColumn("campaign_id", F.when(h, F.lit(42)).otherwise(F.col("campaign_id")))
                .withColumn("unique_id", F.when(h, F.lit(7)).otherwise(F.col("unique_id"))))
    none = F.lit(None).cast("bigint")
    rows = rows.unionByName(rows.limit(5).withColumn("campaign_id", none).withColumn("event_id", -F.col("event_id")))
    out, state = shared_path(spark, "hot-out"), shared_path(spark, "hot-state")
    ST.drain_ranges(rows, "us", 4, lambda src: src, "hot", foreach_batch=ST.stream_attribution(out, state, rows_per_block=50))
    got = sorted((r.event_id, r.conv_event_id or 0, r.latency_s or 0.0) for r in spark.read.parquet(out).collect())

    rows = rows.collect()
    now = max(r.us for r in rows) // 1000 * 1000 - day
    keys = {}
    for r in rows:
        if r.campaign_id is not None and r.unique_id is not None and r.kind == 0:
            keys.setdefault((r.campaign_id, r.unique_id), []).append((r.us, r.event_id))
    want, hit = [], set()
    for v in keys.values():
        v.sort()
    for r in rows:
        imps = keys.get((r.campaign_id, r.unique_id), [])
        n = bisect.bisect_right(imps, (r.us, float("inf")))
        if r.kind == 1 and r.us <= now and n and r.us - imps[n - 1][0] <= 7 * day:
            want.append((imps[n - 1][1], r.event_id, (r.us - imps[n - 1][0]) / 1e6))
            hit.add(imps[n - 1][1])
    want += [(e, 0, 0.0) for v in keys.values() for us, e in v if us + 7 * day < now and e not in hit]
    assert got == sorted(want) and len(hit) > 10

    for b in range(4):  # what is kept is plain rows, none settled
        kept, clock = spark.read.parquet(f"{state}/batch_id={b}/rows"), spark.read.parquet(f"{state}/batch_id={b}/clock").first()["now"]
        settled = F.when(F.col("kind") == 0, F.col("us") + 7 * day < clock).otherwise(F.col("us") <= clock)
        assert kept.where(settled).count() == 0
    assert kept.count() < len(rows)


def test_attribution_finished_equals_batch_and_is_taken_back_when_rows_come(spark):
    """Settling what is open equals the batch form; done twice it adds nothing, and a stream that goes on replaces it."""
    from pyspark.sql import functions as F

    from adspark.operators import label as L
    from adspark.session import shared_path
    from adspark.streaming import streams as ST
    imp, conv = R.imps(spark, SF_SMALL), R.convs(spark, SF_SMALL)
    rows = ST.attribution_rows(imp, conv)
    out, state, src, ckpt = (shared_path(spark, f"finish-{n}") for n in ("out", "state", "src", "ckpt"))
    body = ST.stream_attribution(out, state, rows_per_block=100)

    def read():
        return sorted((r.event_id, r.conv_event_id or 0, round(r.latency_s or 0.0, 3)) for r in spark.read.parquet(out).collect())

    def feed(part):
        part.write.mode("append").parquet(src)
        ST.drain(spark.readStream.schema(rows.schema).parquet(src), foreach_batch=body, checkpoint=ckpt)

    def want(imp, conv):
        got = [(r.event_id, r.conv_event_id, round(r.latency_s, 3)) for r in L.conversion_latency(imp, conv).collect()]
        hit = {e for e, _, _ in got}
        return sorted(got + [(r.event_id, 0, 0.0) for r in imp.where("campaign_id IS NOT NULL AND unique_id IS NOT NULL").collect() if r.event_id not in hit])

    parts = ST.ranges(rows, "us", 3)
    for part in parts[:2]:
        feed(part)
    upto = parts[1].agg(F.max("us")).first()[0]
    till = lambda c: F.unix_micros(F.col(c).cast("timestamp")) <= upto
    settled = read()
    for _ in range(2):
        ST.finish_attribution(spark, out, state, rows_per_block=100)
        assert read() == want(imp.where(till("dttm_utc")), conv.where(till("conv_dttm_utc")))
    assert len(settled) < len(read())
    feed(parts[2])
    ST.finish_attribution(spark, out, state, rows_per_block=100)
    assert read() == want(imp, conv)


def test_stream_attribution_needs_its_state(spark):
    import pytest

    from adspark.session import shared_path
    from adspark.streaming import streams as ST
    body = ST.stream_attribution(shared_path(spark, "gone-out"), shared_path(spark, "gone-state"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        body(ST.attribution_rows(R.imps(spark, SF_SMALL), R.convs(spark, SF_SMALL)), 1)


def test_join_attribution_equals_batch_and_survives_a_restart(spark):
    """Matched rows of the stream-stream join equal the batch form, drained whole or in two runs on one checkpoint."""
    from pyspark.sql import functions as F

    from adspark.operators import label as L
    from adspark.session import shared_path
    from adspark.sources import fixtures as FX
    from adspark.streaming import streams as ST
    want = sorted((r.event_id, r.conv_event_id, round(r.latency_s, 3)) for r in L.conversion_latency(R.imps(spark, SF_SMALL), R.convs(spark, SF_SMALL)).collect())
    whole = sorted((r.event_id, r.conv_event_id, r.latency_s) for r in R.QUERIES["stream_join_attribution"](spark, SF_SMALL).collect())
    assert whole == want and want
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    mid = ev.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    path, sink, ckpt = (shared_path(spark, n) for n in ("pairs-src", "pairs-out", "pairs-ckpt"))
    for part in (F.unix_micros(F.col("ts").cast("timestamp")) <= mid, F.unix_micros(F.col("ts").cast("timestamp")) > mid):
        ev.where(part).write.mode("append").parquet(path)
        src = spark.readStream.schema(ev.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
        ST.drain(ST.join_attribution(FX.impressions_from_events(src), FX.conversions_from_events(src)), sink=sink, checkpoint=ckpt)
    pairs = spark.read.parquet(sink)
    got = sorted((r.event_id, r.conv_event_id, round(r.latency_s, 3)) for r in ST.latest_impression(pairs.where("event_id IS NOT NULL")).collect())
    assert got == want
    none = pairs.where("event_id IS NULL").select("conv_event_id").collect()
    assert none and not {r.conv_event_id for r in none} & {c for _, c, _ in want}  # passed by the watermark, without an impression
