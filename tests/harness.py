"""Runs a registered query on Spark and its SQL on DuckDB, and compares the rows whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    """A value that compares alike from both engines."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs between a Spark result and its SQL: columns, then rows; empty if they are equal."""
    names = sorted(df.columns)
    con = duck(sf_dir)
    found = con.execute(sql)
    theirs = [c[0] for c in found.description]
    if sorted(theirs) != names:
        return [f"columns {names} and {sorted(theirs)}"]
    at = [theirs.index(n) for n in names]
    expected = Counter(tuple(plain(r[k]) for k in at) for r in found.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    out = [f"only Spark: {r} x{n}" for r, n in list((got - expected).items())[:3]] + [f"only SQL: {r} x{n}" for r, n in list((expected - got).items())[:3]]
    return out and [f"{sum(got.values())} and {sum(expected.values())} rows", *out]
