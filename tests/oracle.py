"""Compares a query with its SQL on DuckDB."""

import decimal
import glob
import math
import os

import duckdb
import numpy as np

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 9)
    return str(v)


def rows(cols, got):
    return sorted(repr(tuple(plain(v) for v in r)) for r in got)


def agree(df, sql: str, folder: str = DATA) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    wanted = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql})").fetchall()
    assert rows(cols, df.select(*cols).collect()) == rows(cols, wanted)
