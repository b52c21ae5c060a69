"""Comparison helpers shared by ``tools/check_oracle.py`` and the tests:
run a key on Spark and its SQL on DuckDB, compare names, kinds and sorted rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "item"):
        return v.item()
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__) if x is not None else "", x if x is not None else 0)
                 for x in row)


_EXACT = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def _kind(t: str) -> str:
    t = t.lower()
    if any(x in t for x in ("int", "long", "short", "byte")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal", "real")):
        return "float"
    if "timestamp" in t:
        return "ts"
    if "date" in t:
        return "date"
    if any(x in t for x in ("string", "varchar", "char")):
        return "str"
    return t



def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(sdf, rel) -> list[str]:
    """Problems found between a Spark DataFrame and a DuckDB relation."""
    s_cols = sdf.columns
    s_types = [f.dataType.simpleString() for f in sdf.schema.fields]
    s_rows = [tuple(_norm(x) for x in r) for r in sdf.collect()]
    d_cols = rel.columns
    d_types = [str(x) for x in rel.types]
    d_rows = [tuple(_norm(x) for x in r) for r in rel.fetchall()]
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        return [f"columns spark={s_cols} oracle={d_cols}"]
    sk, dk = dict(zip(s_cols, s_types)), dict(zip(d_cols, d_types))
    bad = [(c, sk[c], dk[c]) for c in s_cols if _EXACT.get(sk[c], _kind(sk[c])) != dk[c]]
    if bad:
        problems.append(f"types {bad}")
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_idx = [d_cols.index(s_cols[i]) for i in order]
    s_rows = sorted((tuple(r[i] for i in order) for r in s_rows), key=_key)
    d_rows = sorted((tuple(r[i] for i in d_idx) for r in d_rows), key=_key)
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} oracle={len(d_rows)}")
    else:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
        if diff:
            problems.append(f"{len(diff)} differing rows, e.g. spark={diff[0][0]} oracle={diff[0][1]}")
    return problems
