"""Comparison of a Spark result with DuckDB's result of the oracle SQL."""

from __future__ import annotations

import glob
import math
import os


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        c.execute(f"create view {name} as select * from '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def same(spark_rows, spark_names, duck_rows, duck_names) -> str:
    """Empty if equal, else what differs."""
    if sorted(spark_names) != sorted(duck_names):
        return f"columns {sorted(spark_names)} and {sorted(duck_names)}"
    shape = lambda rows, names: sorted(tuple(cell(r[names.index(n)]) for n in sorted(names)) for r in rows)
    a, b = shape(spark_rows, list(spark_names)), shape(duck_rows, list(duck_names))
    if a == b:
        return ""
    return f"{len(a)} and {len(b)} rows; only here {sorted(set(a) - set(b))[:2]}, only there {sorted(set(b) - set(a))[:2]}"
