"""Runs a registered query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(root: str):
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{root}/{t}.parquet"
        if glob.glob(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if type(v).__name__ == "Timestamp":
        return v.isoformat()
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differ(spark, root: str, query, sql: str) -> str:
    """'' when the rows agree, else what differs."""
    df = query(spark, root)
    ours, c = rows_of(df.columns, [tuple(r) for r in df.collect()]), connect(root)
    rel = c.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    if not ours:
        return "no rows"
    if ours != theirs:
        return f"{sum(ours.values())} / {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:3]}; only sql {list((theirs - ours).items())[:3]}"
    return ""
