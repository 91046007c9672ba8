"""Column-level helpers."""

from adspark.functions.hashing import normal, sql_u, u  # noqa: F401
from adspark.functions.timefeat import (  # noqa: F401
    coerce_timestamp,
    cyclical,
    day_of_week_monday0,
    hour_of_day,
)
