"""Compares a query with its SQL on DuckDB over the same tables."""

import glob
import math
import os
from collections import Counter

import numpy as np

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple, np.ndarray)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return int(v)
    return v


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def compare(spark, con, run, sql):
    df = run(spark, DATA)
    columns = sorted(df.columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    other = con.sql(sql)
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    theirs = Counter(repr(tuple(plain(r[i]) for i in at)) for r in other.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
