"""Compare a Spark result with the SQL result: columns by name, rows in any order, values exactly."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)]
    plain = [tuple(_plain(v) for v in row) for row in ordered.itertuples(index=False, name=None)]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def difference(got: pd.DataFrame, wanted: pd.DataFrame) -> str | None:
    """None if both hold the same, else the first thing that differs."""
    if sorted(got.columns) != sorted(wanted.columns):
        return f"columns {sorted(got.columns)} against {sorted(wanted.columns)}"
    if len(got) != len(wanted):
        return f"{len(got)} rows against {len(wanted)}"
    for left, right in zip(rows(got), rows(wanted)):
        if left != right:
            return f"{left} against {right}"[:1000]
    return None
