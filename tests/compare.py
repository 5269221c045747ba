"""Rows of a Spark result against DuckDB's over the same Parquet files."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return float(value)


def rows(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False, name=None)), key=repr)


def alike(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-3 if abs(a) > 100 else 1e-5)
    return a == b


def assert_same(got, want) -> None:
    (gn, g), (wn, w) = rows(got), rows(want)
    assert gn == wn
    assert len(g) == len(w)
    for a, b in zip(g, w, strict=True):
        assert all(alike(x, y) for x, y in zip(a, b, strict=True)), (a, b)
