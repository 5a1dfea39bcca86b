"""Runs a query and its SQL side by side, order-insensitively."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def show(v) -> str:  # noqa: ANN001
        if v is None or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, float):
            return f"{v:.8g}"
        return str(v.tolist() if hasattr(v, "tolist") else v)

    df = df[sorted(df.columns)]
    return sorted(tuple(show(v) for v in r) for r in df.itertuples(index=False))
