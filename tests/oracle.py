"""Runs a registered query and its SQL on one folder of tables and compares the rows."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, np.ndarray):
        return tuple(map(plain, x.tolist()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    if pd.isna(x):
        return None
    if isinstance(x, float | np.floating):
        return round(float(x), 5)
    return x.item() if hasattr(x, "item") else x


def rows(frame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.astype(object).itertuples(index=False)), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if not a and "upsert" not in sql:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} != {y}" for x, y in zip(a, b) if x != y), "")
