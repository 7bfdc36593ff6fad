"""Rows of a query and of its SQL, in a form that compares."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return [tuple(frame.columns), *sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))]
