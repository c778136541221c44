"""Compare a query with its SQL on DuckDB, as sorted rows of named columns."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v) if abs(v) < 2**50 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    return v


def rows(names, values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """Empty if the query and the SQL agree in names and rows."""
    con = duck(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    out = [f"only the query has {n} x {r}" for r, n in list((got - want).items())[:3]]
    return out + [f"only the SQL has {n} x {r}" for r, n in list((want - got).items())[:3]]
