"""DuckDB beside Spark: the same rows, in any order, values to six digits."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def duck(sql: str, sf_dir: str = SMALL) -> pd.DataFrame:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con.sql(sql).df()


def _plain(v):
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([_plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(_plain, r)) for r in df.itertuples(index=False))


def same(spark, run, sql: str, sf_dir: str = SMALL) -> None:
    got, want = run(spark, sf_dir).toPandas(), duck(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0  # an empty answer proves nothing
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
