"""Run each registered Spark query and its DuckDB oracle; compare rows and values.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_conn(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm_val(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm_val(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm_val(x) for x in v)
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_val(v) if not hasattr(v, "tolist") else _norm_val(v.tolist()) for v in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return False, f"columns differ: {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows differ: {len(spark_pdf)} vs {len(duck_pdf)}"
    a, b = normalise(spark_pdf), normalise(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(a)} rows"


def run(sf_dir: str, names: list[str] | None = None) -> dict:
    import __spark_entry__ as E
    from adspark.session import build_session

    spark = build_session("local[8]", 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in sqls:
                results[name] = ("R", True, f"{len(sp)} rows (no oracle)", t1 - t0)
            else:
                dk = con.sql(sqls[name]).df()
                ok, msg = compare(sp, dk)
                results[name] = ("D", ok, msg, t1 - t0)
        except Exception as e:  # noqa: BLE001
            results[name] = ("?", False, f"ERROR {type(e).__name__}: {str(e)[:300]}", time.time() - t0)
        kind, ok, msg, dt = results[name]
        print(f"{'OK ' if ok else 'BAD'} {kind} {name:32s} {dt:6.1f}s  {msg}", flush=True)
    n_ok = sum(1 for v in results.values() if v[1])
    print(f"{n_ok}/{len(results)} ok")
    return results


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    run(sf, sys.argv[2:] or None)
