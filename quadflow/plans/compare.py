"""Order-insensitive comparison of a Spark result with a DuckDB oracle.

Used by the test-suite at small scale factors; it collects both sides, so it
is a test utility, not part of any operator.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def compare(spark_df, sql: str, con, show: int = 5) -> tuple[bool, str]:
    s_cols = spark_df.columns
    o = con.execute(sql)
    o_cols = [d[0] for d in o.description]
    o_rows = o.fetchall()
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns differ: spark={sorted(s_cols)} oracle={sorted(o_cols)}"
    cols = sorted(s_cols)
    s_rows = [tuple(_norm(r[c]) for c in cols) for r in spark_df.collect()]
    o_idx = [o_cols.index(c) for c in cols]
    o_rows = [tuple(_norm(r[i]) for i in o_idx) for r in o_rows]
    if len(s_rows) != len(o_rows):
        return False, f"row count spark={len(s_rows)} oracle={len(o_rows)}"
    s_sorted, o_sorted = sorted(s_rows, key=_key), sorted(o_rows, key=_key)
    diffs = [(a, b) for a, b in zip(s_sorted, o_sorted) if a != b]
    if diffs:
        lines = [f"{len(diffs)} differing rows of {len(s_rows)}; columns {cols}"]
        for a, b in diffs[:show]:
            lines.append(f"  spark : {a}\n  oracle: {b}")
        return False, "\n".join(lines)
    return True, f"{len(s_rows)} rows match"
