"""Projection, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adspark.functions.timefeat import coerce_timestamp as _coerce
from adspark.functions.timefeat import day_of_week_monday0, hour_of_day


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Drop every column whose name starts with ``prefix`` (C4)."""
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def fill_missing(df: DataFrame, values: dict) -> DataFrame:
    """Per-column null fill, e.g. ``{"goal_name": "No Goal Name", "dma": -1}``."""
    cols = []
    for c in df.columns:
        if c in values:
            cols.append(F.coalesce(F.col(c), F.lit(values[c]).cast(df.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def enforce_schema(df: DataFrame, dtypes: dict, strict: bool = True) -> DataFrame:
    """Cast columns to the given types.

    ``strict`` uses ``cast`` (ANSI: overflow or bad text fails the job, as
    wanted for schema enforcement); otherwise ``try_cast`` gives null.
    """
    cols = []
    for c in df.columns:
        if c in dtypes:
            cast = F.col(c).cast(dtypes[c]) if strict else F.col(c).try_cast(dtypes[c])
            cols.append(cast.alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def coerce_timestamps(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Parse text columns to timestamps; bad text becomes null."""
    return df.select(*[(_coerce(F.col(c), fmt).alias(c) if c in columns else F.col(c)) for c in df.columns])


def time_features(df: DataFrame, ts_col: str = "impression_dttm_utc",
                  hour_col: str = "impression_hour", dow_col: str = "impression_dayofweek") -> DataFrame:
    """Hour of day and Monday=0 day of week."""
    return (df.withColumn(hour_col, hour_of_day(F.col(ts_col)))
              .withColumn(dow_col, day_of_week_monday0(F.col(ts_col))))


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter; on a partition column it prunes partitions."""
    return df.where(F.col(column) == F.lit(value))


def limit_impressions(df: DataFrame, n: int, order_key: str = "event_id") -> DataFrame:
    """First ``n`` impressions in stream order (C14): a top-k, not a full sort."""
    return df.orderBy(F.col(order_key).asc()).limit(n)
