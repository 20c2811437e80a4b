"""Comparing a query with its SQL in DuckDB."""

import glob

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {p.rsplit('/', 1)[-1].removesuffix('.parquet')} as select * from '{p}'")
    return c


def tidy(frame):
    columns = sorted(frame.columns)
    out = frame[columns].copy()
    for c in columns:
        if not str(out[c].dtype).startswith(("int", "float", "bool", "Int", "Float")):
            out[c] = out[c].astype(str)
    return out.sort_values(columns).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = tidy(got), tidy(want)
    assert a.shape == b.shape
    for c in a.columns:
        assert ((a[c].isna() & b[c].isna()) | (a[c] == b[c])).all(), c
