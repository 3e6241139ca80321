"""Compares a query's rows with those of its SQL in DuckDB, as sorted values by column name."""

from __future__ import annotations

import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            path = os.path.join(sf_dir, f)
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if x == 0:
        return 0
    return x


def differences(spark_df, con, sql: str) -> str | None:
    """What differs, or None: column names, kinds of types, number of rows, values."""
    names = sorted(spark_df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    want_kind = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp_ntz": "TIMESTAMP"}
    for c, k in spark_df.dtypes:
        if want_kind.get(k, kinds[c]) != kinds[c]:
            return f"type of {c}: {k} and {kinds[c]}"
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    a = sorted((tuple(_plain(r[c]) for c in names) for r in spark_df.collect()), key=key)
    order = [rel.columns.index(c) for c in names]
    b = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=key)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None
