"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def duck(sql: str, sf_dir: str = SF):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c.execute(sql).df()


def rows(df) -> list[tuple]:
    def value(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
