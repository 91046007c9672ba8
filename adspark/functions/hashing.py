"""Keyed uniforms: reproducible randomness that does not depend on partitioning.

``u(salt, key)`` takes the first 32 bits of ``md5(salt ':' key)`` and scales
them to [0, 1). The same number comes out of DuckDB via
``sql_u(salt_sql, key_sql)``, so queries that draw random numbers can still
be checked against an SQL oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _as_col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def u(salt, *keys) -> Column:
    """Uniform in [0, 1) from md5 of ``salt:key1:key2...`` (oracle-checkable)."""
    parts = [_as_col(salt).cast("string")] + [_as_col(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def sql_u(salt_sql: str, *key_sqls: str) -> str:
    """DuckDB text for :func:`u`; arguments are SQL expressions."""
    parts = [f"CAST({salt_sql} AS VARCHAR)"] + [f"CAST({k} AS VARCHAR)" for k in key_sqls]
    joined = " || ':' || ".join(parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 8)) AS BIGINT) / {TWO_32})"


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms (u1 shifted off zero)."""
    safe = F.greatest(u1, F.lit(1e-12))
    return F.sqrt(F.lit(-2.0) * F.log(safe)) * F.cos(F.lit(2.0 * math.pi) * u2)
