"""Time features: hour of day, Monday=0 day of week, cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week_monday0(ts: Column) -> Column:
    """Monday=0 .. Sunday=6 (``weekday``; ``dayofweek`` would give Monday=2)."""
    return F.weekday(ts)


def coerce_timestamp(text: Column, fmt: str | None = None) -> Column:
    """Parse text to a timestamp; unparsable text becomes null, not an error."""
    if fmt:
        return F.try_to_timestamp(text, F.lit(fmt))
    return F.try_to_timestamp(text)


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    ang = F.lit(2.0 * math.pi) * x.cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)
