"""Ad-domain views over the driver tables (see FIXTURES.md section 3).

``ad_impressions`` and ``ad_conversions`` are derived from ``events`` with
plain column expressions, so every operator reads data whose size grows with
the given tables. The DuckDB twins of these views (``IMPRESSIONS_SQL`` and
``CONVERSIONS_SQL``) let the oracle run the same mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping (chosen by us; order matters: the value
# at position i is picked by ``key % n == i``).
# ---------------------------------------------------------------------------
CNXN_TYPES = ["Cable/DSL", "Cellular", "Corporate", "Dialup"]  # event_id % 5, 4 -> null
COUNTRIES = ["us", "ca", "gb", "de", "fr", "mx"]  # user_id % 6
DEVICE_CODES = ["p", "d", "t"]  # event_id % 3
DEVICE_TYPES = [("p", "Mobile Phone"), ("d", "Desktop"), ("t", "Tablet"), ("c", "Connected TV")]
GOAL_NAMES = ["lead", "content"]  # event_id % 20 < 12 -> lead, else content
USER_AGENTS = [  # event_id % 17, 16 -> null
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 13; SM-G991B) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/119.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/16.6 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 12; SM-T870) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/118.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.61",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Safari/605.1.15",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (compatible; bingbot/2.0; +http://www.bing.com/bingbot.htm)",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_5 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) CriOS/119.0.6045.169 Mobile/15E148 Safari/604.1",
    "curl/8.4.0",
    "UnknownClient/1.0",
]
DMA_BASE, DMA_MOD, DMA_NULL_EVERY = 500, 211, 17
PRIZM_MOD = 69
PLACEMENT_MOD = 40
UA_MOD = 17

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(key: Column, values: list) -> Column:
    """``values[key]`` as a CASE chain (null when key is out of range)."""
    out = None
    for i, v in enumerate(values):
        out = F.when(key == i, F.lit(v)) if out is None else out.when(key == i, F.lit(v))
    return out


def sql_pick(key_sql: str, values: list) -> str:
    def lit(v):
        return "'" + str(v).replace("'", "''") + "'"
    whens = " ".join(f"WHEN {key_sql} = {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"CASE {whens} END"


def campaign_of(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def ad_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw impressions: ``events`` of type view, with ad columns derived by rule."""
    return impressions_from_events(load(spark, sf_dir, "events"))


def impressions_from_events(events: DataFrame) -> DataFrame:
    """The impression mapping over any events DataFrame (batch or stream)."""
    ev = events.where(F.col("event_type") == "view")
    eid, uid = F.col("event_id"), F.col("user_id")
    return ev.select(
        campaign_of(F.col("props")).alias("campaign_id"),
        uid.alias("unique_id"),
        eid.alias("event_id"),
        F.col("ts").alias("dttm_utc"),
        pick(eid % 5, CNXN_TYPES).alias("cnxn_type"),
        F.when(eid % DMA_NULL_EVERY == 0, F.lit(None)).otherwise(uid % DMA_MOD + DMA_BASE)
        .cast("smallint").alias("dma"),
        pick(uid % 6, COUNTRIES).alias("country"),
        F.when(eid % 2 == 0, F.lit(None))
        .otherwise(F.lpad((uid % PRIZM_MOD + 1).cast("string"), 2, "0")).alias("prizm_premier_code"),
        pick(eid % 3, DEVICE_CODES).alias("device_type"),
        pick(eid % UA_MOD, USER_AGENTS).alias("user_agent"),
        F.col("value").alias("value"),
        (uid % PLACEMENT_MOD + 1).alias("placement_id"),
    )


def ad_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw conversions: ``events`` of type purchase."""
    return conversions_from_events(load(spark, sf_dir, "events"))


def conversions_from_events(events: DataFrame) -> DataFrame:
    """The conversion mapping over any events DataFrame (batch or stream)."""
    ev = events.where(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    return ev.select(
        campaign_of(F.col("props")).alias("imp_click_campaign_id"),
        F.col("user_id").alias("imp_click_unique_id"),
        eid.alias("conv_event_id"),
        F.col("ts").alias("conv_dttm_utc"),
        F.when(eid % 20 < 12, F.lit(GOAL_NAMES[0])).otherwise(F.lit(GOAL_NAMES[1])).alias("goal_name"),
        pick(eid % 3, DEVICE_CODES).alias("conv_device_type"),
        F.col("value").alias("conv_value"),
    )


def device_types(spark: SparkSession) -> DataFrame:
    """The device-type lookup dimension (short code -> full name)."""
    return spark.createDataFrame(DEVICE_TYPES, "short string, full_name string")


# --------------------------------------------------------------------------
# DuckDB twins of the views above (used by the SQL oracle).
# --------------------------------------------------------------------------
IMPRESSIONS_SQL = f"""
SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS campaign_id,
       user_id AS unique_id,
       event_id,
       ts AS dttm_utc,
       {sql_pick('event_id % 5', CNXN_TYPES)} AS cnxn_type,
       CAST(CASE WHEN event_id % {DMA_NULL_EVERY} = 0 THEN NULL ELSE user_id % {DMA_MOD} + {DMA_BASE} END AS SMALLINT) AS dma,
       {sql_pick('user_id % 6', COUNTRIES)} AS country,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE lpad(CAST(user_id % {PRIZM_MOD} + 1 AS VARCHAR), 2, '0') END AS prizm_premier_code,
       {sql_pick('event_id % 3', DEVICE_CODES)} AS device_type,
       {sql_pick(f'event_id % {UA_MOD}', USER_AGENTS)} AS user_agent,
       value,
       user_id % {PLACEMENT_MOD} + 1 AS placement_id
FROM events WHERE event_type = 'view'
"""

CONVERSIONS_SQL = f"""
SELECT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS imp_click_campaign_id,
       user_id AS imp_click_unique_id,
       event_id AS conv_event_id,
       ts AS conv_dttm_utc,
       CASE WHEN event_id % 20 < 12 THEN '{GOAL_NAMES[0]}' ELSE '{GOAL_NAMES[1]}' END AS goal_name,
       {sql_pick('event_id % 3', DEVICE_CODES)} AS conv_device_type,
       value AS conv_value
FROM events WHERE event_type = 'purchase'
"""

DEVICE_TYPES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{n}')" for s, n in DEVICE_TYPES) + ") AS t(short, full_name)"
