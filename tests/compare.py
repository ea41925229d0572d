"""Compare a Spark result with the same query in DuckDB, the way a value hash would."""

from __future__ import annotations

import glob
import math
import os
import time
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else ("0.0" if v == 0 else repr(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    out = []
    start = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    differences.sql_seconds = time.time() - start
    got_cols = spark_df.columns
    got = [tuple(r) for r in spark_df.collect()]
    if sorted(want_cols) != sorted(got_cols):
        return [f"columns differ: {sorted(got_cols)} against {sorted(want_cols)}"]
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if kinds.get(kind, want_types[name]) != want_types[name]:
            out.append(f"type of {name}: {kind} against {want_types[name]}")
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        out.append(f"rows: {len(a)} against {len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        names = sorted(got_cols)
        x, y = bad[0]
        diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
        out.append(f"{len(bad)} rows differ; first: {diff} in {dict(zip(names[:3], x[:3]))}")
    return out
