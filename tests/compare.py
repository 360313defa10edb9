"""Run a query and its SQL counterpart and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def spark_rows(df):
    return normal_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return normal_rows([c[0] for c in cur.description], cur.fetchall())


def differences(spark_df, con, sql, limit: int = 3):
    """Empty when both sides agree in columns, rows and values."""
    sc, sr = spark_rows(spark_df)
    dc, dr = sql_rows(con, sql)
    if sc != dc:
        return [("columns", sc, dc)]
    if len(sr) != len(dr):
        only = [r for r in sr if r not in set(dr)][:limit] if len(sr) < 200_000 else []
        return [("rows", len(sr), len(dr), only)]
    return [(a, b) for a, b in zip(sr, dr) if a != b][:limit]
