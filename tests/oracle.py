"""Compares a query's rows with its SQL run by DuckDB on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    if v is not None and hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, sql, sf_dir):
    """None, or a text that says what differs."""
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, want {sorted(names)}"
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if have == want:
        return None
    odd = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(have)} rows, want {len(want)}; first differences (have, want): {odd[:2]}"
