"""Side-by-side check of a Spark DataFrame against DuckDB SQL on the same
parquet tables (row count, column names, order-insensitive values)."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

_CONS: dict[str, duckdb.DuckDBPyConnection] = {}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    if sf_dir not in _CONS:
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        _CONS[sf_dir] = con
    return _CONS[sf_dir]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _family(t: str) -> str:
    t = t.lower()
    if any(k in t for k in ("bigint", "int", "long", "short", "byte", "hugeint")) and "interval" not in t:
        return "int"
    if any(k in t for k in ("double", "float", "decimal", "real")):
        return "float"
    if any(k in t for k in ("string", "varchar")):
        return "string"
    if "bool" in t:
        return "bool"
    if "timestamp" in t or "date" in t:
        return "time"
    return t


_EXACT = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
          "smallint": "SMALLINT", "tinyint": "TINYINT", "date": "DATE"}


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    con = duck(sf_dir)
    rel = con.sql(sql)
    dcols = list(rel.columns)
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    stypes = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    drows = rel.fetchall()
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    out = {"spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_cols": sorted(scols), "oracle_cols": sorted(dcols)}
    out["cols_match"] = sorted(scols) == sorted(dcols)
    if out["cols_match"]:
        bad = {c: (stypes[c], dtypes[c]) for c in scols if _family(stypes[c]) != _family(dtypes[c])}
        if bad:
            out["type_mismatch"] = bad
        exact = {c: (stypes[c], dtypes[c]) for c in scols if _EXACT.get(stypes[c]) != dtypes[c]}
        if exact:
            out["exact_type_diff"] = exact
    if not out["cols_match"]:
        out["match"] = False
        return out
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in srows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    out["match"] = sc == dc
    if not out["match"]:
        out["only_spark"] = list((sc - dc).items())[:5]
        out["only_oracle"] = list((dc - sc).items())[:5]
    return out
