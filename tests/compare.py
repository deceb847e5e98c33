"""Spark result vs DuckDB oracle: row count, column names, order-insensitive values."""

from __future__ import annotations

import datetime
import decimal
import math


def _norm(v, digits: int | None):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        f = float(v)
        return round(f, digits) if digits is not None else f
    if isinstance(v, int):
        return float(v) if digits is not None else v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows_of(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, duck_con, sql: str, digits: int | None = 9) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = duck_con.sql(sql)
    d_cols = res.columns
    d_rows = res.fetchall()
    out = {"spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": sorted(s_cols) == sorted(d_cols)}
    if not out["columns_match"]:
        out["spark_only"] = sorted(set(s_cols) - set(d_cols))
        out["oracle_only"] = sorted(set(d_cols) - set(s_cols))
        out["values_match"] = False
        return out
    a, b = rows_of(s_cols, s_rows, digits), rows_of(d_cols, d_rows, digits)
    out["values_match"] = a == b
    out["exact_match"] = rows_of(s_cols, s_rows, None) == rows_of(d_cols, d_rows, None)
    if not out["values_match"]:
        sa, sb = set(a), set(b)
        out["spark_extra"] = [r for r in a if r not in sb][:3]
        out["oracle_extra"] = [r for r in b if r not in sa][:3]
    return out


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
