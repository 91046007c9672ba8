"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each operator is re-stated in plain SQL over the fixture views. Taken from the
code under test, and so not checked here, are data alone: the fixture mapping,
the feature lists and the user-agent rules (tests hold these by hand-written
cases).
"""

from __future__ import annotations

from adspark.functions.hashing import sql_u  # noqa: F401
from adspark.sources.fixtures import CONVERSIONS_SQL, DEVICE_TYPES_SQL, IMPRESSIONS_SQL  # noqa: F401

ORACLE_SQL: dict[str, str] = {}

BASE = f"""
imp AS ({IMPRESSIONS_SQL}),
conv AS ({CONVERSIONS_SQL}),
first_c AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id
                                 ORDER BY conv_dttm_utc, conv_event_id) AS rn,
              count(*) OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id) AS n_conversions
    FROM conv) WHERE rn = 1
),
lab AS (
  SELECT i.campaign_id, i.unique_id, i.event_id, i.dttm_utc AS impression_dttm_utc,
         i.cnxn_type, i.dma, i.country, i.prizm_premier_code, i.device_type, i.user_agent, i.value,
         c.conv_event_id, c.conv_dttm_utc, c.goal_name, coalesce(c.n_conversions, 0) AS n_conversions,
         CAST(c.conv_dttm_utc IS NOT NULL AS TINYINT) AS conversion_flag,
         CAST(hour(i.dttm_utc) AS INTEGER) AS impression_hour,
         CAST(isodow(i.dttm_utc) - 1 AS INTEGER) AS impression_dayofweek
  FROM imp i LEFT JOIN first_c c
    ON i.campaign_id = c.imp_click_campaign_id AND i.unique_id = c.imp_click_unique_id
)"""


def q(name: str, body: str, ctes: str = "") -> None:
    """Register ``WITH <base>, <ctes> <body>``."""
    extra = f",\n{ctes}" if ctes else ""
    ORACLE_SQL[name] = f"WITH {BASE}{extra}\n{body}"


q("label_impressions", """
SELECT event_id, campaign_id, unique_id, conv_event_id, goal_name, conversion_flag, n_conversions,
       impression_hour, impression_dayofweek
FROM lab""")

q("campaign_conversion_rate", """
SELECT campaign_id, count(*) AS impressions, CAST(sum(conversion_flag) AS BIGINT) AS conversions,
       round(avg(CAST(conversion_flag AS DOUBLE)), 9) AS conv_rate
FROM lab GROUP BY campaign_id""")


# --------------------------------------------------------------------------
# Helper CTE text
# --------------------------------------------------------------------------
from adspark.operators.features import (  # noqa: E402
    BOOLEAN_FEATURES,
    CATEGORICAL_FEATURES,
    NUMERIC_CATEGORICALS,
    NUMERIC_FEATURES,
)
from adspark.operators.useragent import UA_FIELDS, sql_rule_expr  # noqa: E402
from adspark.sources.fixtures import CNXN_TYPES  # noqa: E402

UA_SELECT = ", ".join(f"{sql_rule_expr('coalesce(user_agent, {q})'.format(q=chr(39) * 2), f)} AS {f}"
                      for f in UA_FIELDS)

SPLIT_U = sql_u("'split42'", "campaign_id", "event_id")

CLEAN_CTES = f"""
cleaned AS (SELECT lab.*, {UA_SELECT} FROM lab),
splitc AS (
  SELECT * EXCLUDE (_u), CASE WHEN _u < 0.8 THEN 'train' WHEN _u < 0.9 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {SPLIT_U} AS _u FROM cleaned)
),
train AS (SELECT * FROM splitc WHERE split = 'train')"""


def cat_value_sql(f: str) -> str:
    if f in NUMERIC_CATEGORICALS:
        return f"CAST(coalesce(CAST({f} AS BIGINT), -1) AS VARCHAR)"
    return f"coalesce(CAST({f} AS VARCHAR), '-1')"


def num_select_sql() -> str:
    parts = [f"CAST({b} AS DOUBLE) AS {b}_d" for b in BOOLEAN_FEATURES]
    for col, period, stem in [("impression_hour", 24.0, "hour"), ("impression_dayofweek", 7.0, "day")]:
        parts.append(f"sin((2 * pi()) * CAST({col} AS DOUBLE) / CAST({period} AS DOUBLE)) AS {stem}_sin")
        parts.append(f"cos((2 * pi()) * CAST({col} AS DOUBLE) / CAST({period} AS DOUBLE)) AS {stem}_cos")
    return ", ".join(parts)


NUM_NAMES = [f"{b}_d" for b in BOOLEAN_FEATURES] + ["hour_sin", "hour_cos", "day_sin", "day_cos"]

ENC_CTES = CLEAN_CTES + ",\n" + "enc_long AS (\n" + "\n  UNION\n".join(
    f"  SELECT '{f}' AS feature, {cat_value_sql(f)} AS category, "
    f"{'coalesce(CAST(' + f + ' AS BIGINT), -1)' if f in NUMERIC_CATEGORICALS else 'CAST(NULL AS BIGINT)'} AS sort_num FROM train"
    for f in CATEGORICAL_FEATURES) + "\n),\n" + """enc AS (
  SELECT feature, category,
         CAST(dense_rank() OVER (PARTITION BY feature ORDER BY sort_num NULLS LAST, category) - 1 AS BIGINT) AS code
  FROM enc_long
),
train_num AS (SELECT *, """ + num_select_sql() + """ FROM train),
scaler AS (
""" + "\n  UNION ALL\n".join(
    f"  SELECT '{nf}' AS feature, avg({nn}) AS mean, "
    f"CASE WHEN coalesce(stddev_pop({nn}), 0) = 0 THEN 1.0 ELSE stddev_pop({nn}) END AS scale FROM train_num"
    for nf, nn in zip(NUMERIC_FEATURES, NUM_NAMES)) + "\n),\n" + \
    "all_num AS (SELECT *, " + num_select_sql() + " FROM splitc)"


def encoded_sql(reserve: bool = False) -> str:
    """Select list + joins applying the encoder to splitc rows (alias s)."""
    sel, joins = [], []
    for i, f in enumerate(CATEGORICAL_FEATURES):
        code = f"e{i}.code + 1" if reserve else f"e{i}.code"
        sel.append(f"coalesce({code}, 0) AS {f}")
        joins.append(f"LEFT JOIN enc e{i} ON e{i}.feature = '{f}' AND e{i}.category = {cat_value_sql('s.' + f)}")
    return ", ".join(sel), "\n".join(joins)


def scaled_sql(alias: str = "s") -> str:
    parts = []
    for nf, nn in zip(NUMERIC_FEATURES, NUM_NAMES):
        parts.append(f"(({alias}.{nn} - (SELECT mean FROM scaler WHERE feature = '{nf}')) / "
                     f"(SELECT scale FROM scaler WHERE feature = '{nf}'))")
    return parts


# --------------------------------------------------------------------------
# Cleaning and filters
# --------------------------------------------------------------------------
q("drop_prefix", "SELECT event_id, campaign_id, unique_id, cnxn_type, dma FROM imp")

q("fill_missing", """
SELECT event_id, conv_event_id, coalesce(cnxn_type, 'Unknown') AS cnxn_type, coalesce(dma, CAST(-1 AS SMALLINT)) AS dma,
       coalesce(prizm_premier_code, '-1') AS prizm_premier_code, coalesce(goal_name, 'No Goal Name') AS goal_name,
       coalesce(user_agent, '') AS user_agent
FROM lab""")

q("enforce_schema", """
SELECT event_id, conv_event_id, CAST(campaign_id AS BIGINT) AS campaign_id, CAST(dma AS SMALLINT) AS dma,
       CAST(conversion_flag AS TINYINT) AS conversion_flag, CAST(impression_hour AS TINYINT) AS impression_hour,
       CAST(impression_dayofweek AS TINYINT) AS impression_dayofweek
FROM lab""")

ORACLE_SQL["coerce_timestamp"] = """
SELECT event_id, parsed IS NULL AS is_null, epoch_us(parsed) AS epoch_us
FROM (SELECT event_id,
             TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'garbage' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS parsed
      FROM events)"""

q("time_features", """
SELECT event_id, CAST(hour(dttm_utc) AS INTEGER) AS impression_hour,
       CAST(isodow(dttm_utc) - 1 AS INTEGER) AS impression_dayofweek FROM imp""")

q("limit_impressions", "SELECT event_id, campaign_id, unique_id FROM imp ORDER BY event_id LIMIT 100")

q("scan_filter_campaign", "SELECT event_id, campaign_id, unique_id FROM imp WHERE campaign_id = 42")

# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
q("label_dedup", """
SELECT i.event_id, f.conv_event_id, CAST(f.conv_event_id IS NOT NULL AS TINYINT) AS conversion_flag,
       coalesce(f.n_conversions, 0) AS n_conversions
FROM imp i LEFT JOIN first_conv f
  ON i.campaign_id = f.imp_click_campaign_id AND i.unique_id = f.imp_click_unique_id""", """
first_conv AS (
  SELECT imp_click_campaign_id, imp_click_unique_id, conv_event_id, n_conversions FROM (
    SELECT *, row_number() OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id
                                 ORDER BY conv_dttm_utc, conv_event_id) AS rn,
              count(*) OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id) AS n_conversions
    FROM conv) WHERE rn = 1)""")

q("label_with_goal", """
SELECT i.event_id, c.conv_event_id, coalesce(c.goal_name, 'No Goal Name') AS goal_name,
       CAST(c.conv_dttm_utc IS NOT NULL AS TINYINT) AS conversion_flag, coalesce(c.n, 0) AS n_conversions
FROM imp i LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY imp_click_unique_id ORDER BY conv_dttm_utc, conv_event_id) AS rn,
                           count(*) OVER (PARTITION BY imp_click_unique_id) AS n FROM conv) WHERE rn = 1) c
  ON i.unique_id = c.imp_click_unique_id""")

q("label_by_time_key", """
SELECT i.event_id, c.conv_event_id, CAST(c.conv_dttm_utc IS NOT NULL AS TINYINT) AS conversion_flag,
       coalesce(c.n, 0) AS n_conversions
FROM imp i LEFT JOIN (
  SELECT * FROM (SELECT *, CAST(conv_dttm_utc AS DATE) AS d,
                           row_number() OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id, CAST(conv_dttm_utc AS DATE)
                                              ORDER BY conv_dttm_utc, conv_event_id) AS rn,
                           count(*) OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id, CAST(conv_dttm_utc AS DATE)) AS n
                 FROM conv) WHERE rn = 1) c
  ON i.campaign_id = c.imp_click_campaign_id AND i.unique_id = c.imp_click_unique_id
 AND CAST(i.dttm_utc AS DATE) = c.d""")

q("device_type_lookup", """
SELECT i.event_id, i.device_type, d.full_name AS device_type_full FROM imp i LEFT JOIN dev d ON i.device_type = d.short
UNION ALL
SELECT c.conv_event_id AS event_id, c.conv_device_type AS device_type, d.full_name AS device_type_full
FROM conv c LEFT JOIN dev d ON c.conv_device_type = d.short""", f"dev AS ({DEVICE_TYPES_SQL})")

# Each conversion with its latest impression of at most seven days before.
ATTRIBUTED = """attributed AS (
  SELECT * FROM (
    SELECT i.event_id, c.conv_event_id, i.device_type, (epoch_us(c.conv_dttm_utc) - epoch_us(i.dttm_utc)) / 1e6 AS latency_s,
           row_number() OVER (PARTITION BY c.conv_event_id ORDER BY i.dttm_utc DESC, i.event_id DESC) AS rn
    FROM imp i JOIN conv c ON i.campaign_id = c.imp_click_campaign_id AND i.unique_id = c.imp_click_unique_id
     AND c.conv_dttm_utc >= i.dttm_utc AND c.conv_dttm_utc <= i.dttm_utc + INTERVAL 7 DAY)
  WHERE rn = 1)"""

q("conversion_latency", """
SELECT device_type_full, count(*) AS n, round(avg(latency_s), 3) AS mean_s,
       round(quantile_cont(latency_s, 0.5), 3) AS median_s, round(min(latency_s), 3) AS min_s,
       round(max(latency_s), 3) AS max_s
FROM (SELECT d.full_name AS device_type_full, latency_s FROM attributed a LEFT JOIN dev d ON a.device_type = d.short)
GROUP BY device_type_full""", ATTRIBUTED + f",\ndev AS ({DEVICE_TYPES_SQL})")

ORACLE_SQL["orders_returns_label"] = """
SELECT o.o_orderkey, l.l_linenumber, CAST(l.l_orderkey IS NOT NULL AS TINYINT) AS returned
FROM orders o LEFT JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') l
  ON o.o_orderkey = l.l_orderkey"""

# --------------------------------------------------------------------------
# Aggregation and profiling
# --------------------------------------------------------------------------
q("rank_campaigns", """
SELECT *, row_number() OVER (ORDER BY conv_rate DESC, campaign_id ASC) AS rank FROM (
  SELECT campaign_id, count(*) AS impressions, CAST(sum(conversion_flag) AS BIGINT) AS conversions,
         round(avg(CAST(conversion_flag AS DOUBLE)), 9) AS conv_rate
  FROM lab GROUP BY campaign_id)""")

q("count_pos_neg", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE conversion_flag = 1) AS n_pos,
       count(*) FILTER (WHERE conversion_flag <> 1) AS n_neg FROM lab""")

q("pos_weight", """
SELECT n_pos, n_neg, round(CASE WHEN n_pos = 0 THEN 1.0 ELSE CAST(n_neg AS DOUBLE) / n_pos END, 9) AS pos_weight
FROM (SELECT count(*) FILTER (WHERE conversion_flag = 1) AS n_pos,
             count(*) FILTER (WHERE conversion_flag <> 1) AS n_neg FROM lab)""")

q("split_label_rate", f"""
SELECT split, count(*) AS n_rows, round(avg(CAST(conversion_flag AS DOUBLE)), 9) AS label_rate
FROM (SELECT *, CASE WHEN _u < 0.8 THEN 'train' WHEN _u < 0.9 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, {SPLIT_U} AS _u FROM lab))
GROUP BY split""")

_PROFILE_COLS = ["cnxn_type", "dma", "country", "prizm_premier_code", "device_type", "user_agent", "goal_name",
                 "conv_event_id"]
q("missing_counts", "SELECT * FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0 / greatest(count(*), 1), 9) AS pct_missing FROM lab"
    for c in _PROFILE_COLS) + "\n) WHERE n_missing > 0")

q("distinct_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM lab"
    for c in ["campaign_id", "unique_id", "cnxn_type", "dma", "country", "prizm_premier_code", "device_type",
              "user_agent"]))

q("describe_numeric", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", round(CAST(count({c}) AS DOUBLE), 6) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
       round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, round(min(CAST({c} AS DOUBLE)), 6) AS min,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, round(max(CAST({c} AS DOUBLE)), 6) AS max FROM imp"""
    for c in ["value", "dma", "campaign_id"]))

_CAT_COLS = ["cnxn_type", "country", "prizm_premier_code", "device_type", "goal_name"]
q("describe_categorical", """
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS unique,
       max(CASE WHEN rn = 1 THEN value END) AS top, max(n) AS freq
FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rn
      FROM (SELECT "column", value, count(*) AS n FROM (
""" + "\n UNION ALL\n".join(f"        SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM lab"
                              for c in _CAT_COLS) + """
      ) WHERE value IS NOT NULL GROUP BY "column", value))
GROUP BY "column" """)

q("crosstab_goal", """
SELECT d.full_name AS device_type_full,
       count(*) FILTER (WHERE c.goal_name = 'lead') AS lead,
       count(*) FILTER (WHERE c.goal_name = 'content') AS content
FROM conv c LEFT JOIN dev d ON c.conv_device_type = d.short
GROUP BY d.full_name""", f"dev AS ({DEVICE_TYPES_SQL})")

q("value_counts", "SELECT cnxn_type, count(*) AS n FROM imp GROUP BY cnxn_type")

q("histogram", """
SELECT bin, count(*) AS n FROM (
  SELECT CAST(CASE WHEN value < 0.0 THEN 0 WHEN value > 100.0 THEN 21 WHEN value = 100.0 THEN 20
                   ELSE floor(20 * (value - 0.0) / (100.0 - 0.0)) + 1 END AS BIGINT) AS bin
  FROM imp WHERE value IS NOT NULL) GROUP BY bin""")

# --------------------------------------------------------------------------
# Splits and sampling
# --------------------------------------------------------------------------
q("hash_split", f"""
SELECT event_id, conv_event_id, CASE WHEN _u < 0.8 THEN 'train' WHEN _u < 0.9 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, {SPLIT_U} AS _u FROM lab)""")

_DEDUP_CTE = """
first_conv AS (
  SELECT imp_click_campaign_id, imp_click_unique_id, conv_event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY imp_click_campaign_id, imp_click_unique_id
                                 ORDER BY conv_dttm_utc, conv_event_id) AS rn FROM conv) WHERE rn = 1),
dedup AS (
  SELECT i.*, f.conv_event_id, CAST(f.conv_event_id IS NOT NULL AS TINYINT) AS conversion_flag
  FROM imp i LEFT JOIN first_conv f
    ON i.campaign_id = f.imp_click_campaign_id AND i.unique_id = f.imp_click_unique_id)"""

q("stratified_split", f"""
SELECT event_id, conversion_flag,
       CASE WHEN rn <= round(n * CAST(0.7 AS DOUBLE)) THEN 'train'
            WHEN rn <= round(n * CAST(0.7 AS DOUBLE)) + round(n * CAST(0.15 AS DOUBLE)) THEN 'val'
            ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY conversion_flag ORDER BY {sql_u("'strat7'", 'event_id')}, event_id) AS rn,
             count(*) OVER (PARTITION BY conversion_flag) AS n FROM dedup)""", _DEDUP_CTE)

q("sample_per_campaign", f"""
SELECT event_id, campaign_id FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY {sql_u("'sample11'", 'event_id')}, event_id) AS rn
  FROM imp) WHERE rn <= 10""")

q("ratio_sample", f"""
SELECT event_id, conversion_flag FROM dedup, rate
WHERE conversion_flag = 1 OR {sql_u("'ratio5'", 'event_id')} < least(1.0, r)""", _DEDUP_CTE + """,
rate AS (SELECT CASE WHEN n = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * p / n END AS r FROM (
  SELECT count(*) FILTER (WHERE conversion_flag = 1) AS p, count(*) FILTER (WHERE conversion_flag <> 1) AS n
  FROM dedup))""")

q("ratio_sample_replace", f"""
SELECT event_id, conversion_flag, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy_id FROM (
  SELECT d.event_id, d.conversion_flag, d.conv_event_id, count(c.c) AS copies
  FROM dedup d JOIN rate r ON r.flag = d.conversion_flag, generate_series(1, CAST(r.draws AS BIGINT)) AS g(i)
  LEFT JOIN cdf c ON c.flag = d.conversion_flag AND {sql_u("'ratio5'", 'd.event_id', 'i')} >= c.c
  GROUP BY ALL) WHERE copies > 0""", _DEDUP_CTE + """,
size AS (SELECT count(*) FILTER (WHERE conversion_flag = 1) AS p, count(*) FILTER (WHERE conversion_flag <> 1) AS n FROM dedup),
rate AS (SELECT flag, w * (p + n) / (p + n / CAST(2.0 AS DOUBLE)) AS r, greatest(1, ceil(w * (p + n) / (p + n / CAST(2.0 AS DOUBLE)) / 16)) AS draws
         FROM size, (VALUES (1, CAST(1.0 AS DOUBLE)), (0, CAST(0.5 AS DOUBLE))) AS v(flag, w)),
cdf AS (SELECT flag, sum(exp(-r / draws + m * ln(r / draws) - lgamma(m + 1))) OVER (PARTITION BY flag ORDER BY m) AS c
        FROM rate, range(0, 80) t(m))""")

q("shuffled_order", f"""
SELECT event_id, row_number() OVER (ORDER BY {sql_u("'perm3'", 'event_id')}, event_id) AS imp_id FROM imp""")

q("assign_users", f"""
SELECT event_id, CAST(floor({sql_u("'user1'", 'event_id')} * 1000) AS BIGINT) AS user_id FROM imp""")

# --------------------------------------------------------------------------
# User agents and features
# --------------------------------------------------------------------------
q("ua_enrich", f"SELECT event_id, {UA_SELECT} FROM imp")

q("ua_distinct", f"SELECT user_agent, {UA_SELECT} FROM (SELECT DISTINCT coalesce(user_agent, '') AS user_agent FROM imp)")

q("numeric_features", """
SELECT event_id, conv_event_id, """ + ", ".join(f"{b}_d AS {b}" for b in BOOLEAN_FEATURES) + ", " +
  ", ".join(f"round({c}, 9) AS {c}" for c in ["hour_sin", "hour_cos", "day_sin", "day_cos"]) +
  " FROM (SELECT *, " + num_select_sql() + " FROM cleaned)", CLEAN_CTES)

q("fit_ordinal_encoder", "SELECT feature, category, code FROM enc", ENC_CTES)

q("category_sizes", "SELECT feature, CAST(count(*) + 1 AS BIGINT) AS size FROM enc GROUP BY feature", ENC_CTES)

_sel, _joins = encoded_sql()
q("ordinal_encode", f"SELECT s.event_id, s.conv_event_id, s.split, {_sel} FROM splitc s\n{_joins}", ENC_CTES)
_sel_r, _joins_r = encoded_sql(reserve=True)
q("ordinal_encode_reserve", f"SELECT s.event_id, s.conv_event_id, s.split, {_sel_r} FROM splitc s\n{_joins_r}",
  ENC_CTES)

q("fit_scaler", "SELECT feature, round(mean, 9) AS mean, round(scale, 9) AS scale FROM scaler", ENC_CTES)

q("scale_features", "SELECT s.event_id, s.conv_event_id, " + ", ".join(
    f"round({e}, 6) AS {nf}" for e, nf in zip(scaled_sql(), NUMERIC_FEATURES)) + " FROM all_num s", ENC_CTES)

_sel_p, _joins_p = encoded_sql()
_cat_p = ", ".join(f"coalesce(e{i}.code, 0) AS cat_{i}" for i in range(len(CATEGORICAL_FEATURES)))
_num_p = ", ".join(f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 4) AS num_{i}" for i, e in enumerate(scaled_sql()))
q("processed_features", f"""
SELECT s.event_id, s.conv_event_id, s.split, {_cat_p}, {_num_p},
       CAST(s.conversion_flag AS FLOAT) AS conversion_flag
FROM all_num s
{_joins_p}""", ENC_CTES)

_cat_arr = "[" + ", ".join(f"coalesce(e{i}.code, 0)" for i in range(len(CATEGORICAL_FEATURES))) + "]"
q("feature_vectors", f"""
SELECT s.event_id, s.conv_event_id, array_to_string({_cat_arr}, ',') AS cat_text, CAST(8 AS INTEGER) AS n_num,
       CAST(s.conversion_flag AS FLOAT) AS label
FROM all_num s
{_joins_p}""", ENC_CTES)

q("feature_counts", "SELECT CAST(9 AS BIGINT) AS n_cat, CAST(8 AS BIGINT) AS n_num, count(*) AS n_rows FROM splitc",
  ENC_CTES)

q("one_hot", "SELECT event_id, conv_event_id, " + ", ".join(
    f"CAST(coalesce(cnxn_type, '-1') = '{lv}' AS TINYINT) AS \"cnxn_type_{lv}\"" for lv in sorted(CNXN_TYPES)) +
  " FROM splitc", ENC_CTES)


# --------------------------------------------------------------------------
# Campaigns, candidates, auction
# --------------------------------------------------------------------------
def U(salt: str, *keys: str) -> str:
    return sql_u(f"'{salt}'", *keys)


D = "CAST({} AS DOUBLE)".format

CAMP_CTES = f"""
rates AS (SELECT campaign_id, avg(CAST(conversion_flag AS DOUBLE)) AS conv_rate FROM lab GROUP BY campaign_id),
camps AS (
  SELECT campaign_id, conv_rate AS true_conv_rate, vpc AS value_per_conv,
         vpc * ({D(1.1)} + {D(1.9)} * {U('cpa0', 'campaign_id')}) AS target_cpa,
         {D(1000.0)} AS budget,
         CAST(row_number() OVER (ORDER BY campaign_id) AS INTEGER) AS ordinal
  FROM (SELECT *, least(greatest(({D(0.8)} + {D(0.4)} * {U('vpc0', 'campaign_id')}) / conv_rate, {D(0.5)}), {D(500.0)}) AS vpc
        FROM rates WHERE conv_rate > 0)
),
aimp AS (SELECT event_id AS imp_id, unique_id AS user_id, CAST(campaign_id AS VARCHAR) AS imp_campaign_id_sampled_from,
                dttm_utc FROM imp)"""

PCONV = {"random": U("pconv", "a.imp_id", "c.campaign_id"), "heuristic": D(1.0), "rate": "c.true_conv_rate"}


def log_ctes(pred: str) -> str:
    return f"""
pairs_{pred} AS (
  SELECT a.imp_id, a.user_id, a.imp_campaign_id_sampled_from, c.campaign_id, c.ordinal, c.value_per_conv,
         c.budget, {PCONV[pred]} AS pconv, {PCONV[pred]} * c.value_per_conv AS score
  FROM aimp a CROSS JOIN camps c
),
best_{pred} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY imp_id ORDER BY score DESC, ordinal ASC) AS rn,
              count(*) OVER (PARTITION BY imp_id) AS eligible_campaigns
    FROM pairs_{pred}) WHERE rn = 1
),
out_{pred} AS (
  SELECT *, bid * ({D(0.9)} + {D(0.2)} * {U('price', 'imp_id')}) AS market_price FROM (
    SELECT *, pconv * value_per_conv AS expected_value, greatest({D(0.0)}, {D(0.9)} * (pconv * value_per_conv)) AS bid
    FROM best_{pred})
),
log_{pred} AS (
  SELECT imp_id, imp_campaign_id_sampled_from, user_id, campaign_id, value_per_conv AS campaign_value_per_conv,
         expected_value, bid, market_price, bid > market_price AS win, pconv,
         CASE WHEN bid > market_price THEN expected_value - market_price ELSE 0.0 END AS utility,
         budget - sum(CASE WHEN bid > market_price THEN market_price ELSE 0.0 END)
                  OVER (PARTITION BY campaign_id ORDER BY imp_id ROWS UNBOUNDED PRECEDING) AS budget_remaining,
         eligible_campaigns, score AS chosen_score
  FROM out_{pred}
)"""


AUCTION = CAMP_CTES + "," + log_ctes("random")
_LOG_D = ["campaign_value_per_conv", "expected_value", "bid", "market_price", "pconv", "utility",
          "budget_remaining", "chosen_score"]
_LOG_COLS = ["imp_id", "imp_campaign_id_sampled_from", "user_id", "campaign_id", "campaign_value_per_conv",
             "expected_value", "bid", "market_price", "win", "pconv", "utility", "budget_remaining",
             "eligible_campaigns", "chosen_score"]
ROUNDED_LOG = ", ".join(f"round({c}, 9) AS {c}" if c in _LOG_D else c for c in _LOG_COLS)

q("campaign_params", """
SELECT campaign_id, ordinal, round(true_conv_rate, 9) AS true_conv_rate, round(value_per_conv, 9) AS value_per_conv,
       round(target_cpa, 9) AS target_cpa, budget FROM camps""", CAMP_CTES)

q("candidate_scores", """
SELECT imp_id, rn - 1 AS rank, campaign_id, round(pconv, 9) AS pconv, round(score, 9) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY imp_id ORDER BY score DESC, ordinal) AS rn FROM pairs_random) WHERE rn <= 3""", AUCTION)

q("candidate_diagnostics", """
SELECT campaign_id, count(*) AS impressions, c.budget, round(avg(pconv), 9) AS mean_pconv, round(max(pconv), 9) AS max_pconv,
       round(avg(score), 9) AS mean_score, round(max(score), 9) AS max_score,
       round(c.value_per_conv, 9) AS value_per_conv, round(c.true_conv_rate, 9) AS true_conv_rate
FROM pairs_random p JOIN camps c USING (campaign_id) GROUP BY ALL""", AUCTION)

q("best_campaign", "SELECT imp_id, campaign_id, round(score, 9) AS chosen_score, eligible_campaigns FROM best_random",
  AUCTION)

q("policy_heuristic", "SELECT imp_id, campaign_id, round(pconv, 9) AS pconv, round(score, 9) AS chosen_score FROM best_heuristic",
  CAMP_CTES + "," + log_ctes("heuristic"))

q("policy_random", "SELECT imp_id, campaign_id, round(pconv, 9) AS pconv, round(score, 9) AS chosen_score FROM best_random",
  AUCTION)

q("bid_price", "SELECT imp_id, round(expected_value, 9) AS expected_value, round(bid, 9) AS bid FROM out_random", AUCTION)

_Z = (f"sqrt(-2.0 * ln(greatest({U('price1', 'imp_id')}, {D(1e-12)}))) * "
      f"cos({D(2.0)} * pi() * {U('price2', 'imp_id')})")
q("market_outcome", f"""
SELECT imp_id, round(market_price, 9) AS market_price, bid > market_price AS win,
       round({D(0.005)} * exp({D(0.5)} * ({_Z})), 9) AS lognormal_price,
       bid > {D(0.005)} * exp({D(0.5)} * ({_Z})) AS lognormal_win
FROM out_random""", AUCTION)

q("auction_log", f"SELECT {ROUNDED_LOG} FROM log_random", AUCTION)

q("frequency_cap", """
SELECT imp_id, user_id, campaign_id, win_no FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, campaign_id ORDER BY imp_id) AS win_no
  FROM log_random WHERE win) WHERE win_no <= 3""", AUCTION)
ORACLE_SQL["stream_frequency_cap"] = ORACLE_SQL["frequency_cap"]

q("budget_pacing", """
SELECT imp_id, campaign_id, round(cum - market_price, 9) AS spent_before, round(budget - cum, 9) AS budget_remaining
FROM (SELECT l.imp_id, l.campaign_id, l.market_price, c.budget,
             sum(l.market_price) OVER (PARTITION BY l.campaign_id ORDER BY l.imp_id ROWS UNBOUNDED PRECEDING) AS cum
      FROM log_random l JOIN camps c USING (campaign_id) WHERE l.win)
WHERE cum - market_price < budget""", AUCTION)

q("eligible_campaigns", """
SELECT a.imp_id, a.user_id,
       count(*) FILTER (WHERE (bc.cut IS NULL OR a.imp_id <= bc.cut) AND (uc.cut IS NULL OR a.imp_id <= uc.cut))
         AS eligible_campaigns
FROM aimp a CROSS JOIN camps c
LEFT JOIN bc ON bc.campaign_id = c.campaign_id
LEFT JOIN uc ON uc.user_id = a.user_id AND uc.campaign_id = c.campaign_id
GROUP BY a.imp_id, a.user_id""", AUCTION + """,
bc AS (SELECT campaign_id, min(imp_id) AS cut FROM (
         SELECT l.campaign_id, l.imp_id, c.budget,
                sum(l.market_price) OVER (PARTITION BY l.campaign_id ORDER BY l.imp_id ROWS UNBOUNDED PRECEDING) AS cum
         FROM log_random l JOIN camps c USING (campaign_id) WHERE l.win) WHERE cum >= budget GROUP BY campaign_id),
uc AS (SELECT user_id, campaign_id, imp_id AS cut FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, campaign_id ORDER BY imp_id) AS rn FROM log_random WHERE win)
       WHERE rn = 3)""")

q("run_summary", """
SELECT t.*, r.total_remaining, r.avg_remaining, r.exhausted_campaigns FROM (
  SELECT count(*) AS processed, count(*) FILTER (WHERE win) AS wins,
         round(sum(CASE WHEN win THEN market_price ELSE 0.0 END), 9) AS spend,
         round(sum(utility), 9) AS total_utility,
         round(sum(CASE WHEN win THEN pconv ELSE 0.0 END), 9) AS expected_conversions,
         count(DISTINCT campaign_id) AS campaigns_touched FROM log_random) t,
 (SELECT round(sum(rem), 9) AS total_remaining, round(avg(rem), 9) AS avg_remaining,
         count(*) FILTER (WHERE rem <= 0) AS exhausted_campaigns
  FROM (SELECT c.budget - coalesce(s.spent, 0.0) AS rem FROM camps c LEFT JOIN (
          SELECT campaign_id, sum(CASE WHEN win THEN market_price ELSE 0.0 END) AS spent FROM log_random
          GROUP BY campaign_id) s USING (campaign_id))) r""", AUCTION)

# --------------------------------------------------------------------------
# Metrics
# --------------------------------------------------------------------------
SCORED = f"""
rates_s AS (SELECT campaign_id, avg(CAST(conversion_flag AS DOUBLE)) AS conv_rate FROM lab GROUP BY campaign_id),
sc AS (SELECT l.event_id, l.campaign_id,
              round(least(greatest({D(0.5)} * r.conv_rate + {D(0.5)} * {U('score', 'l.event_id')}, {D(0.0)}), {D(1.0)}), 2) AS score,
              CAST(l.conversion_flag AS INTEGER) AS label
       FROM lab l JOIN rates_s r USING (campaign_id)),
g AS (SELECT score AS s, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) - sum(label) AS DOUBLE) AS neg FROM sc GROUP BY score),
cum AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above,
                  coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_above
        FROM g),
cm AS (SELECT count(*) FILTER (WHERE score < 0.5 AND label <> 1) AS tn, count(*) FILTER (WHERE score >= 0.5 AND label <> 1) AS fp,
              count(*) FILTER (WHERE score < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS tp
       FROM sc)"""


RAW_SCORED = SCORED.replace(f"round(least(greatest({D(0.5)} * r.conv_rate", f"(least(greatest({D(0.5)} * r.conv_rate").replace(f"{D(1.0)}), 2) AS score", f"{D(1.0)})) AS score")


def _lossexpr(w: str = "1.0") -> str:
    p = f"least(greatest(CAST(score AS DOUBLE), {D(1e-7)}), {D(1.0 - 1e-7)})"
    return f"-({w} * CAST(label AS DOUBLE) * ln({p}) + (1.0 - CAST(label AS DOUBLE)) * ln(1.0 - {p}))"


q("roc_auc", "SELECT round(sum(neg * (pos_above + pos / 2.0)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM cum", RAW_SCORED)

q("average_precision", """
SELECT round(sum(pos * (pos_above + pos) / ((pos_above + pos) + (neg_above + neg))) / sum(pos), 9) AS average_precision
FROM cum""", RAW_SCORED)

q("log_loss", f"SELECT round(avg({_lossexpr()}), 9) AS log_loss FROM sc", SCORED)

q("weighted_log_loss", f"""
SELECT round(avg({_lossexpr('w.w')}), 9) AS weighted_log_loss FROM sc,
  (SELECT CASE WHEN count(*) FILTER (WHERE label = 1) = 0 THEN 1.0
               ELSE CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) / count(*) FILTER (WHERE label = 1) END AS w
   FROM sc) w""", SCORED)


def _r(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


_P, _R = _r("tp", "tp + fp"), _r("tp", "tp + fn")
q("threshold_metrics", f"""
SELECT {D(0.5)} AS threshold, tp + fp + fn + tn AS n, round({_r('tp + tn', 'tp + fp + fn + tn')}, 9) AS accuracy,
       round({_P}, 9) AS precision, round({_R}, 9) AS recall,
       round(CASE WHEN {_P} + {_R} = 0 THEN 0.0 ELSE 2 * {_P} * {_R} / ({_P} + {_R}) END, 9) AS f1
FROM cm""", SCORED)

q("confusion_matrix", "SELECT tn, fp, fn, tp FROM cm", SCORED)

_P0, _R0 = _r("tn", "tn + fn"), _r("tn", "tn + fp")
_F = "CASE WHEN {p} + {r} = 0 THEN 0.0 ELSE 2 * {p} * {r} / ({p} + {r}) END".format
q("classification_report", f"""
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       round(support, 9) AS support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM x
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM x
  UNION ALL SELECT 'macro avg', p0 * 0.5 + p1 * 0.5, r0 * 0.5 + r1 * 0.5, f0 * 0.5 + f1 * 0.5, s0 + s1 FROM x
  UNION ALL SELECT 'weighted avg', p0 * (s0 / (s0 + s1)) + p1 * (s1 / (s0 + s1)), r0 * (s0 / (s0 + s1)) + r1 * (s1 / (s0 + s1)),
                   f0 * (s0 / (s0 + s1)) + f1 * (s1 / (s0 + s1)), s0 + s1 FROM x)""", SCORED + f""",
x AS (SELECT {_P0} AS p0, {_R0} AS r0, {_F(p=_P0, r=_R0)} AS f0, CAST(tn + fp AS DOUBLE) AS s0,
             {_P} AS p1, {_R} AS r1, {_F(p=_P, r=_R)} AS f1, CAST(tp + fn AS DOUBLE) AS s1 FROM cm)""")

_REL = """rel AS (SELECT CAST(least(floor(score * 15), 14) AS INTEGER) AS bin, count(*) AS n,
                avg(CAST(score AS DOUBLE)) AS avg_score, avg(CAST(label AS DOUBLE)) AS avg_label FROM sc GROUP BY 1)"""
q("calibration_error", "SELECT round(sum(n * abs(avg_score - avg_label)) / sum(n), 9) AS ece FROM rel",
  SCORED + "," + _REL)
q("reliability_table", "SELECT bin, n, round(avg_score, 9) AS avg_score, round(avg_label, 9) AS avg_label FROM rel",
  SCORED + "," + _REL)

q("roc_auc_binned", """
SELECT round(sum((fpr - coalesce(fpr2, 0.0)) * (tpr + coalesce(tpr2, 0.0)) / 2.0), 9) AS roc_auc_binned FROM (
  SELECT tpr, fpr, lead(tpr) OVER (ORDER BY t) AS tpr2, lead(fpr) OVER (ORDER BY t) AS fpr2 FROM (
    SELECT t, tp / max(tp) OVER () AS tpr, fp / max(fp) OVER () AS fpr, tp_all FROM (
      SELECT t, CAST(sum(pos) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS tp,
                CAST(sum(cnt - pos) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS fp, 0 AS tp_all
      FROM (SELECT g.t, coalesce(b.pos, 0) AS pos, coalesce(b.cnt, 0) AS cnt
            FROM range(-1, 256) g(t) LEFT JOIN (
              SELECT CAST(least(greatest(floor(score * 255), -1), 255) AS INTEGER) AS k, sum(label) AS pos, count(*) AS cnt
              FROM sc GROUP BY 1) b ON b.k = g.t))
  ) WHERE t >= 0)""", SCORED)

q("best_run", f"""
SELECT arg_min(run, (val_loss, run)) AS best_run, round(min(val_loss), 9) AS best_loss FROM (
  SELECT split AS run, avg({_lossexpr()}) AS val_loss FROM (
    SELECT *, CASE WHEN _u < 0.8 THEN 'train' WHEN _u < 0.9 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, {SPLIT_U} AS _u FROM sc)) GROUP BY split)""", SCORED)

# --------------------------------------------------------------------------
# Policy analytics
# --------------------------------------------------------------------------
_WEEK = """wk AS (SELECT imp_id, CAST(floor(date_diff('day', (SELECT min(CAST(dttm_utc AS DATE)) FROM aimp),
                                                CAST(dttm_utc AS DATE)) / 7) AS INTEGER) AS day FROM aimp)"""

# The definition: for every campaign and period, what it should have spent by then and what it has.
q("pacing_error", """
SELECT c.campaign_id, d.day, round(spent, 9) AS cum_spend, round(plan, 9) AS planned, round(abs(spent - plan) / plan, 9) AS pacing_error
FROM camps c CROSS JOIN (SELECT unnest(range(0, (SELECT max(day) + 1 FROM wk)))::INTEGER AS day) d,
LATERAL (SELECT c.budget * (d.day + 1) / CAST((SELECT max(day) + 1 FROM wk) AS DOUBLE) AS plan,
                (SELECT coalesce(sum(l.market_price), 0.0) FROM log_random l JOIN wk w USING (imp_id)
                 WHERE l.win AND l.campaign_id = c.campaign_id AND w.day <= d.day) AS spent) x""",
  AUCTION + "," + _WEEK)

# The serial loop itself: one impression per step, carrying spend per campaign and won (user, campaign) pairs.
q("allocation_replay", f"""
SELECT imp_id, imp_campaign_id_sampled_from, user_id, b.c AS campaign_id, round(b.v, 9) AS campaign_value_per_conv,
       round(b.p * b.v, 9) AS expected_value, round(bid, 9) AS bid, round(price, 9) AS market_price, win, round(b.p, 9) AS pconv,
       round(CASE WHEN win THEN b.p * b.v - price ELSE 0.0 END, 9) AS utility, round(1000.0 - spent[b.o], 9) AS budget_remaining,
       eligible_campaigns, round(b.s, 9) AS chosen_score
FROM step WHERE b IS NOT NULL""", AUCTION + f""",
todo AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY imp_id) AS n, imp_id, any_value(imp_campaign_id_sampled_from) AS imp_campaign_id_sampled_from,
         any_value(user_id) AS user_id, {D(0.9)} + {D(0.2)} * {U('price', 'imp_id')} AS factor,
         list({{'o': ordinal, 's': score, 'p': pconv, 'v': value_per_conv, 'c': campaign_id}} ORDER BY score DESC, ordinal) AS cands
  FROM pairs_random GROUP BY imp_id),
step AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT list(CAST(0 AS DOUBLE)) FROM camps) AS spent, CAST([] AS VARCHAR[]) AS won,
         CAST(NULL AS BIGINT) AS imp_id, CAST(NULL AS VARCHAR) AS imp_campaign_id_sampled_from, CAST(NULL AS BIGINT) AS user_id,
         (SELECT cands[1] FROM todo WHERE FALSE) AS b, CAST(0 AS DOUBLE) AS bid, CAST(0 AS DOUBLE) AS price, FALSE AS win,
         CAST(0 AS BIGINT) AS eligible_campaigns
  UNION ALL
  SELECT n, CASE WHEN win THEN list_transform(spent, lambda x, i: CASE WHEN i = b.o THEN x + price ELSE x END) ELSE spent END,
         CASE WHEN win THEN list_append(won, user_id || ':' || b.c) ELSE won END,
         imp_id, imp_campaign_id_sampled_from, user_id, b, bid, price, win, eligible_campaigns
  FROM (SELECT *, bid * factor AS price, bid > bid * factor AS win FROM (
    SELECT *, elig[1] AS b, greatest({D(0.0)}, {D(0.9)} * (elig[1].p * elig[1].v)) AS bid, len(elig) AS eligible_campaigns FROM (
      SELECT t.*, s.spent, s.won,
             list_filter(t.cands, lambda x: s.spent[x.o] < 1000.0 AND len(list_filter(s.won, lambda w: w = t.user_id || ':' || x.c)) < 3) AS elig
      FROM step s JOIN todo t ON t.n = s.n + 1))))""")
ORACLE_SQL["allocation_replay"] = ORACLE_SQL["allocation_replay"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE_SQL["stream_allocation"] = ORACLE_SQL["allocation_replay"]

q("compact_files", "SELECT campaign_id, count(*) AS n_rows, TRUE AS within_limit FROM imp GROUP BY campaign_id")

q("scan_file_subset", "SELECT event_id, campaign_id FROM imp WHERE event_id % 4 IN (0, 2)")

q("auction_summary", """
SELECT campaign_id, count(*) AS impressions, count(*) FILTER (WHERE win) AS wins,
       round(avg(CAST(win AS DOUBLE)), 9) AS win_rate, round(sum(CASE WHEN win THEN market_price ELSE 0.0 END), 9) AS spend,
       round(quantile_cont(market_price, 0.5), 9) AS median_price, round(quantile_cont(market_price, 0.9), 9) AS p90_price
FROM log_random GROUP BY campaign_id""", AUCTION)


# --------------------------------------------------------------------------
# Sources, sinks, layout
# --------------------------------------------------------------------------
q("scan_partition_pruned", """
SELECT event_id, campaign_id, unique_id, cnxn_type FROM imp
WHERE campaign_id IN (7, 42, 77) AND cnxn_type = 'Cellular'""")

q("list_campaigns", "SELECT DISTINCT campaign_id FROM imp")

q("write_read_roundtrip", "SELECT event_id, campaign_id, conv_event_id, goal_name, conversion_flag FROM lab")

ORACLE_SQL["auction_log_sink"] = ORACLE_SQL["auction_log"]
ORACLE_SQL["preprocessor_roundtrip"] = ORACLE_SQL["fit_ordinal_encoder"]
ORACLE_SQL["apply_batches"] = ORACLE_SQL["scale_features"]

# --------------------------------------------------------------------------
# Models
# --------------------------------------------------------------------------
_cats = ", ".join(f"coalesce(e{i}.code, 0) AS cat_{i}" for i in range(len(CATEGORICAL_FEATURES)))
_LIN = ENC_CTES + f""",
proc AS (SELECT s.event_id, s.conv_event_id, s.split, {_cats}, CAST(CAST(s.conversion_flag AS FLOAT) AS DOUBLE) AS y
         FROM all_num s
{_joins_p}),
ptrain AS (SELECT * FROM proc WHERE split = 'train'),
bias AS (SELECT ln((sum(y) + 1.0) / (count(*) - sum(y) + 1.0)) AS b FROM ptrain),
wlong AS (""" + "\n  UNION ALL\n".join(f"  SELECT {i} AS feature, cat_{i} AS code, y FROM ptrain"
                                       for i in range(len(CATEGORICAL_FEATURES))) + """),
wt AS (SELECT feature, code, ln((sum(y) + 1.0) / (count(*) - sum(y) + 1.0)) - (SELECT b FROM bias) AS weight
       FROM wlong GROUP BY feature, code)"""
_logit = "(SELECT b FROM bias)" + "".join(f" + coalesce(w{i}.weight, 0.0)" for i in range(len(CATEGORICAL_FEATURES)))
_wjoins = "\n".join(f"LEFT JOIN wt w{i} ON w{i}.feature = {i} AND w{i}.code = p.cat_{i}"
                    for i in range(len(CATEGORICAL_FEATURES)))
q("score_linear", f"""
SELECT p.event_id, p.conv_event_id, round(1.0 / (1.0 + exp(-({_logit}))), 9) AS score
FROM proc p
{_wjoins}""", _LIN)
ORACLE_SQL["score_plugin"] = ORACLE_SQL["score_linear"]

# --------------------------------------------------------------------------
# Streaming
# --------------------------------------------------------------------------
_sel_s, _joins_s = encoded_sql()
_cat_s = ", ".join(f"coalesce(e{i}.code, 0) AS cat_{i}" for i in range(len(CATEGORICAL_FEATURES)))
q("stream_features", f"""
SELECT s.event_id, CAST(hour(s.dttm_utc) AS INTEGER) AS impression_hour,
       CAST(isodow(s.dttm_utc) - 1 AS INTEGER) AS impression_dayofweek, s.ua_browser, s.ua_is_mobile, {_cat_s}
FROM impf s
{_joins_s}""", ENC_CTES + f",\nimpf AS (SELECT imp.*, {UA_SELECT} FROM imp)")

q("stream_windowed_cpa", """
SELECT strftime(date_trunc('day', a.dttm_utc), '%Y-%m-%d') AS day, count(*) FILTER (WHERE l.win) AS wins,
       round(sum(CASE WHEN l.win THEN l.market_price ELSE 0.0 END), 9) AS spend,
       round(sum(CASE WHEN l.win THEN l.pconv ELSE 0.0 END), 9) AS conv,
       round(CASE WHEN sum(CASE WHEN l.win THEN l.pconv ELSE 0.0 END) > 0
                  THEN sum(CASE WHEN l.win THEN l.market_price ELSE 0.0 END) / sum(CASE WHEN l.win THEN l.pconv ELSE 0.0 END) END, 9) AS cpa
FROM log_random l JOIN aimp a USING (imp_id)
GROUP BY 1""", AUCTION)

# What is settled once the stream's time is a day behind the last event: conversions by then with
# their impression, and impressions that no conversion of the seven days after them went to.
q("stream_attribution", """
SELECT a.event_id, a.conv_event_id, round(a.latency_s, 3) AS latency_s FROM attributed a JOIN conv c USING (conv_event_id), clock
WHERE c.conv_dttm_utc <= clock.t
UNION ALL
SELECT i.event_id, NULL, NULL FROM imp i, clock WHERE i.dttm_utc + INTERVAL 7 DAY < clock.t
 AND i.campaign_id IS NOT NULL AND i.unique_id IS NOT NULL AND i.event_id NOT IN (SELECT event_id FROM attributed)""",
  ATTRIBUTED + """,
clock AS (SELECT date_trunc('milliseconds', max(t)) - INTERVAL 1 DAY AS t FROM (SELECT dttm_utc AS t FROM imp UNION ALL SELECT conv_dttm_utc FROM conv))""")

# At the end of the input: all conversions, and all impressions that none went to.
q("stream_attribution_finished", """
SELECT event_id, conv_event_id, round(latency_s, 3) AS latency_s FROM attributed
UNION ALL
SELECT event_id, NULL, NULL FROM imp
WHERE campaign_id IS NOT NULL AND unique_id IS NOT NULL AND event_id NOT IN (SELECT event_id FROM attributed)""", ATTRIBUTED)

ORACLE_SQL["ua_enrich_distinct"] = ORACLE_SQL["ua_enrich"]


# --------------------------------------------------------------------------
# Counterfactual features, model predictor, CSV lookup
# --------------------------------------------------------------------------
_CAMP_CODE = """
camp_code AS (SELECT c.*, coalesce(e.code, 0) AS code FROM camps c
              LEFT JOIN enc e ON e.feature = 'campaign_id' AND e.category = CAST(c.campaign_id AS VARCHAR))"""
_CF = _LIN + "," + CAMP_CTES + "," + _CAMP_CODE
_imp_codes = ", ".join(f"coalesce(e{i}.code, 0) AS cat_{i}" for i in range(len(CATEGORICAL_FEATURES)))
_imp_logit = "(SELECT b FROM bias)" + "".join(f" + coalesce(w{i}.weight, 0.0)" for i in range(1, 9))
_imp_wjoins = "\n".join(f"LEFT JOIN wt w{i} ON w{i}.feature = {i} AND w{i}.code = k.cat_{i}" for i in range(1, 9))
_PM = _CF + f""",
impf AS (SELECT imp.*, {UA_SELECT} FROM imp),
impk AS (SELECT s.event_id, {_imp_codes} FROM impf s
{_joins_s}),
impl AS (SELECT k.event_id AS imp_id, {_imp_logit} AS imp_logit FROM impk k
{_imp_wjoins}),
cw AS (SELECT c.campaign_id, c.ordinal, c.value_per_conv, coalesce(w.weight, 0.0) AS cand_weight
       FROM camp_code c LEFT JOIN wt w ON w.feature = 0 AND w.code = c.code),
mpairs AS (SELECT l.imp_id, c.campaign_id, c.ordinal,
                  1.0 / (1.0 + exp(-(l.imp_logit + c.cand_weight))) AS pconv, c.value_per_conv
           FROM impl l CROSS JOIN cw c)"""
q("policy_model", """
SELECT imp_id, campaign_id, round(pconv, 9) AS pconv, round(score, 9) AS chosen_score FROM (
  SELECT *, pconv * value_per_conv AS score,
         row_number() OVER (PARTITION BY imp_id ORDER BY pconv * value_per_conv DESC, ordinal ASC) AS rn
  FROM mpairs) WHERE rn = 1""", _PM)

_proc_wjoins = _imp_wjoins.replace("k.cat_", "p.cat_")
q("counterfactual_features", f"""
SELECT event_id, conv_event_id, campaign_id, round(score, 9) AS score, code AS cat_0, {", ".join(f"cat_{i}" for i in range(1, 9))} FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, conv_event_id ORDER BY score DESC, ordinal ASC) AS rn FROM (
    SELECT l.* EXCLUDE (cat_0), c.campaign_id, c.code, c.ordinal,
           1.0 / (1.0 + exp(-(l.imp_logit + coalesce(w.weight, 0.0)))) * c.value_per_conv AS score
    FROM (SELECT p.*, {_imp_logit} AS imp_logit FROM proc p
          {_proc_wjoins}) l
    CROSS JOIN camp_code c LEFT JOIN wt w ON w.feature = 0 AND w.code = c.code)) WHERE rn = 1""", _CF)

q("device_lookup_csv", """
SELECT i.event_id, i.device_type, d.full_name AS device_type_full FROM imp i LEFT JOIN dev d ON i.device_type = d.short""",
  f"dev AS ({DEVICE_TYPES_SQL})")


# --------------------------------------------------------------------------
# The three policies: constant CPM on a random campaign, value only, the model
# --------------------------------------------------------------------------
POLICIES = _PM + "," + log_ctes("heuristic") + f""",
best_cpm AS (SELECT * FROM (
  SELECT a.imp_id, c.*, row_number() OVER (PARTITION BY a.imp_id ORDER BY {U('pick', 'a.imp_id', 'c.campaign_id')} DESC, c.ordinal) AS rn
  FROM aimp a CROSS JOIN camps c) WHERE rn = 1),
best_model AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY imp_id ORDER BY pconv * value_per_conv DESC, ordinal ASC) AS rn FROM mpairs) WHERE rn = 1),
bids AS (
  SELECT 'random' AS policy, imp_id, true_conv_rate AS pconv, true_conv_rate * value_per_conv AS expected_value, {D(0.001)} AS bid FROM best_cpm
  UNION ALL SELECT 'model', imp_id, pconv, pconv * value_per_conv, greatest({D(0.0)}, {D(0.9)} * (pconv * value_per_conv)) FROM best_model
  UNION ALL SELECT 'heuristic', imp_id, pconv, expected_value, bid FROM out_heuristic),
plogs AS (SELECT *, bid > market_price AS win FROM (
  SELECT *, bid * ({D(0.9)} + {D(0.2)} * {U('price', 'imp_id')}) AS market_price FROM bids))"""

q("policy_comparison", """
SELECT policy, impressions, wins, round(spend, 9) AS spend, round(expected_conversions, 9) AS expected_conversions,
       round(revenue_uplift, 9) AS revenue_uplift,
       round(CASE WHEN expected_conversions = 0 THEN NULL ELSE spend / expected_conversions END, 9) AS cpa
FROM (SELECT policy, count(*) AS impressions, count(*) FILTER (WHERE win) AS wins,
             sum(CASE WHEN win THEN market_price ELSE 0.0 END) AS spend,
             sum(CASE WHEN win THEN pconv ELSE 0.0 END) AS expected_conversions,
             sum(CASE WHEN win THEN expected_value - market_price ELSE 0.0 END) AS revenue_uplift
      FROM plogs GROUP BY policy)""", POLICIES)

_PER = POLICIES + "," + _WEEK + """,
per AS (SELECT policy, day, sum(CASE WHEN win THEN market_price ELSE 0.0 END) AS spend,
               sum(CASE WHEN win THEN pconv ELSE 0.0 END) AS conv
        FROM plogs JOIN wk USING (imp_id) GROUP BY policy, day),
full_grid AS (SELECT policy, day, coalesce(spend, 0.0) AS spend, coalesce(conv, 0.0) AS conv
              FROM (SELECT DISTINCT policy FROM plogs) CROSS JOIN (SELECT DISTINCT day FROM wk) LEFT JOIN per USING (policy, day))"""

q("marginal_cpa", """
SELECT p.policy, p.day, round(p.spend - b.spend, 9) AS delta_spend, round(p.conv - b.conv, 9) AS delta_conv,
       round(CASE WHEN p.conv = b.conv THEN NULL ELSE (p.spend - b.spend) / (p.conv - b.conv) END, 9) AS marginal_cpa
FROM full_grid p JOIN full_grid b USING (day) WHERE b.policy = 'random' AND p.policy <> 'random'""", _PER)

q("marginal_cpa_window", """
SELECT policy, day, round(spend - before.s, 9) AS delta_spend, round(conv - before.c, 9) AS delta_conv,
       round(CASE WHEN conv = before.c THEN NULL ELSE (spend - before.s) / (conv - before.c) END, 9) AS marginal_cpa
FROM (SELECT *, lag({'s': spend, 'c': conv}) OVER (PARTITION BY policy ORDER BY day) AS before FROM full_grid)
WHERE before IS NOT NULL""", _PER)


q("ratio_sample_exact", f"""
SELECT p.i AS draw_id, l.event_id, l.conversion_flag
FROM (SELECT i, ({sql_u("'point13'", 'i')} + {sql_u("'fine13'", 'i')} / 4294967296.0) * (SELECT max(hi) FROM line) AS at
      FROM range((SELECT count(*) FROM line)) AS r(i)) p
JOIN line l ON l.hi - l.w <= p.at AND p.at < l.hi""", _DEDUP_CTE + """,
line AS (SELECT event_id, conversion_flag, CAST(CASE WHEN conversion_flag = 1 THEN 2 ELSE 1 END AS DOUBLE) AS w,
                sum(CAST(CASE WHEN conversion_flag = 1 THEN 2 ELSE 1 END AS DOUBLE)) OVER (ORDER BY event_id) AS hi FROM dedup)""")

_start = [" + ".join([f"(SELECT count(*) FROM enc WHERE feature = '{g}')" for g in CATEGORICAL_FEATURES[:i]] or ["0"]) for i in range(len(CATEGORICAL_FEATURES))]
_index = ", ".join(f"e{i}.code + {o}" for i, o in enumerate(_start))
q("one_hot_sparse", f"""
SELECT s.event_id, s.conv_event_id, (SELECT count(*) FROM enc) AS n_levels,
       array_to_string(list_filter([{_index}], lambda x: x IS NOT NULL), ',') AS indices,
       len(list_filter([{_index}], lambda x: x IS NOT NULL)) AS n_known
FROM splitc s
{_joins}""", ENC_CTES)

q("label_by_click", """
SELECT i.event_id, c.conv_event_id, CAST(c.conv_event_id IS NOT NULL AS TINYINT) AS conversion_flag, coalesce(c.n, 0) AS n_conversions
FROM imp i LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, campaign_id, placement_id ORDER BY conv_dttm_utc, conv_event_id) AS rn,
                        count(*) OVER (PARTITION BY t, campaign_id, placement_id) AS n
                 FROM (SELECT a.conv_event_id, v.conv_dttm_utc, s.dttm_utc AS t, v.imp_click_campaign_id AS campaign_id, s.placement_id
                       FROM attributed a JOIN imp s ON s.event_id = a.event_id JOIN conv v ON v.conv_event_id = a.conv_event_id)) WHERE rn = 1) c
  ON i.dttm_utc = c.t AND i.campaign_id = c.campaign_id AND i.placement_id = c.placement_id""", ATTRIBUTED)

q("sketch_profile", """
SELECT campaign_id, count(*) AS n_rows, count(value) AS value_n, round(min(value), 9) AS value_min, round(max(value), 9) AS value_max,
       true AS users_near, true AS agents_near, true AS p50_near, true AS p90_near
FROM imp GROUP BY campaign_id""")

ORACLE_SQL["footer_counts"] = "SELECT count(*) AS n_rows, " + ", ".join(
    f"count({c}) AS {c}_n, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("event_id", "user_id", "value")) + " FROM events"

q("stream_join_attribution", "SELECT event_id, conv_event_id, round(latency_s, 3) AS latency_s FROM attributed", ATTRIBUTED)

# What a fitted model must reach: all scores are probabilities, and they rank better than chance.
q("model_quality", """
SELECT model, n_rows, n_pos, TRUE AS in_range, TRUE AS above_chance
FROM (SELECT count(*) AS n_rows, CAST(sum(conversion_flag) AS BIGINT) AS n_pos FROM train) CROSS JOIN (VALUES ('log_odds'), ('logistic'), ('factors')) AS m(model)""", CLEAN_CTES)

# --------------------------------------------------------------------------
# The same results reached in another way: one SQL text for both forms
# --------------------------------------------------------------------------
for _form, _same in [("label_key_filter", "label_impressions"), ("goal_key_filter", "label_with_goal"),
                     ("candidate_scores_pruned", "candidate_scores"), ("best_campaign_pruned", "best_campaign"),
                     ("candidate_diagnostics_blocked", "candidate_diagnostics")]:
    ORACLE_SQL[_form] = ORACLE_SQL[_same]
