"""User-agent enrichment (F1, F2).

Each output field is a first-match rule list (pattern -> value) turned into
one ``CASE WHEN ua RLIKE p1 THEN v1 ...`` expression, so matching runs in
whole-stage codegen. The default ``method="inline"`` evaluates the rules per
row with no shuffle at all (the fact table is never moved for this).
``method="distinct"`` matches each distinct user-agent string once and joins
the result back (parse-once, F2), which pays off only when matching is much
more expensive than a shuffle of the fact table.

The default rules are ours; pass others as ``rules`` (``rules_from`` reads them
from a table). Patterns stay in the subset that Java regex and RE2 read the
same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOT = "(?i)bot|crawl|spider|slurp"
TABLET = "iPad|SM-T|Kindle|Silk/|Tablet"
HANDHELD = "iPhone|iPod|Windows Phone|Mobile"

# Ordered first-match rules (pattern, value) per output field, then the default.
# A handheld Android says "Mobile"; one that does not is a tablet. "Tablet PC" is a Windows component.
UA_RULES: dict[str, tuple[list[tuple[str, object]], object]] = {
    "ua_browser": ([
        ("Googlebot", "Googlebot"), ("bingbot", "bingbot"), ("FBAN|FBAV", "Facebook"),
        ("Edg/|EdgA/|EdgiOS/|Edge/", "Edge"), ("OPR/|OPiOS/|Opera", "Opera"), ("SamsungBrowser/", "Samsung Internet"),
        ("FxiOS/", "Firefox iOS"), ("CriOS/", "Chrome Mobile iOS"), ("MSIE |Trident/", "IE"), ("Firefox/", "Firefox"),
        ("Chrome/.*Mobile", "Chrome Mobile"), ("Chrome/", "Chrome"), ("Mobile/.*Safari/", "Mobile Safari"),
        ("Safari/", "Safari"), ("curl/", "curl"),
    ], "Other"),
    "ua_os": ([
        ("Windows Phone", "Windows Phone"), ("iPhone OS|CPU OS", "iOS"), ("Android", "Android"), ("Windows NT", "Windows"),
        ("CrOS", "Chrome OS"), ("Mac OS X", "Mac OS X"), ("Linux", "Linux"),
    ], "Other"),
    "ua_device_family": ([
        (BOT, "Spider"), ("iPhone", "iPhone"), ("iPad", "iPad"), ("SM-T", "Samsung SM-T"),
        ("SM-G", "Samsung SM-G"), ("SM-", "Samsung"), ("Pixel", "Pixel"), ("Lenovo", "Lenovo"), ("Macintosh", "Mac"),
    ], "Other"),
    "ua_device_brand": ([
        (BOT, "Spider"), ("iPhone|iPad|iPod|Macintosh", "Apple"), ("SM-|SAMSUNG", "Samsung"), ("Pixel", "Google"),
        ("Lenovo", "Lenovo"), ("Kindle|Silk/", "Amazon"),
    ], "Unknown"),
    "ua_is_mobile": ([(BOT, False), ("Windows NT", False), (TABLET, False), (HANDHELD, True)], False),
    "ua_is_tablet": ([(BOT, False), ("Windows NT", False), (TABLET, True), (HANDHELD, False), ("Android", True)], False),
    "ua_is_pc": ([(BOT, False), ("Windows NT", True), (TABLET, False), (HANDHELD, False), ("Android", False),
                  ("Macintosh|X11|CrOS", True)], False),
    "ua_is_bot": ([(BOT, True)], False),
}
UA_FIELDS = list(UA_RULES)


_META = set(".^$*+?()[]{}\\")


def matches(ua: Column, pat: str) -> Column:
    """Partial match of ``pat``; literal alternatives become substring tests (no regex engine)."""
    if not (_META & set(pat)):
        alts = pat.split("|")
        cond = ua.contains(alts[0])
        for a in alts[1:]:
            cond = cond | ua.contains(a)
        return cond
    return ua.rlike(pat)


def rule_expr(ua: Column, field: str, table: dict = UA_RULES) -> Column:
    """First-match value of one field: CASE over its rules, in order."""
    rules, default = table[field]
    out = None
    for pat, val in rules:
        cond = matches(ua, pat)
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out.otherwise(F.lit(default))


def sql_rule_expr(ua_sql: str, field: str) -> str:
    """DuckDB text of :func:`rule_expr` (regexp_matches is a partial match, like RLIKE)."""
    rules, default = UA_RULES[field]

    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return "'" + str(v).replace("'", "''") + "'"
    whens = " ".join(f"WHEN regexp_matches({ua_sql}, '{p}') THEN {lit(v)}" for p, v in rules)
    return f"CASE {whens} ELSE {lit(default)} END"


def parse_columns(ua: Column, rules: dict = UA_RULES) -> list[Column]:
    return [rule_expr(ua, f, rules).alias(f) for f in rules]


def rules_from(rows: DataFrame, defaults: dict[str, object]) -> dict:
    """A rule set from a table (field, pattern, value, priority), lowest priority first.

    The rules are what a person maintains; they become one expression, so they
    are read to the driver.
    """
    ordered = rows.select("field", "pattern", "value", "priority").orderBy("field", "priority").collect()
    return {f: ([(r["pattern"], r["value"]) for r in ordered if r["field"] == f], d) for f, d in defaults.items()}


def ua_enrich(df: DataFrame, ua_col: str = "user_agent", method: str = "inline",
              drop_source: bool = True, rules: dict = UA_RULES) -> DataFrame:
    """Add a column per field of ``rules``, by default the eight ``ua_*``; a null user agent is treated as ""."""
    ua = F.coalesce(F.col(ua_col), F.lit(""))
    if method == "inline":
        out = df.select("*", *parse_columns(ua, rules))
    elif method == "distinct":
        keyed = df.withColumn("_ua", ua)
        dim = keyed.select("_ua").distinct().select("_ua", *parse_columns(F.col("_ua"), rules))
        out = keyed.join(dim, "_ua", "left").drop("_ua")
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.drop(ua_col) if drop_source else out


def distinct_user_agents(df: DataFrame, ua_col: str = "user_agent") -> DataFrame:
    """The parse-once intermediate: one row per distinct UA string with its fields."""
    ua = F.coalesce(F.col(ua_col), F.lit(""))
    return df.select(ua.alias("_ua")).distinct().select(F.col("_ua").alias(ua_col),
                                                         *parse_columns(F.col("_ua")))
