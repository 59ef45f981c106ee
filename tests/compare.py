"""Query results and DuckDB results in one normal form."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_value, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(_value(v) for v in r) for r in frame[cols].itertuples(index=False, name=None))
