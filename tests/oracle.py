"""Compare a query with its SQL on DuckDB: columns, row count and all values."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NA or (isinstance(value, float) and value != value):
            return ""
        if hasattr(value, "item"):
            value = value.item()
        if isinstance(value, float) and value.is_integer():
            value = int(value)
        return repr(value)

    columns = sorted(frame.columns)
    return sorted(tuple(map(cell, row)) for row in frame[columns].astype(object).itertuples(index=False))


def difference(spark, db, sf_dir: str, query, sql: str) -> str | None:
    found = query(spark, sf_dir)
    columns = found.columns
    ours = pd.DataFrame([tuple(row) for row in found.collect()], columns=columns, dtype=object)
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    theirs = pd.DataFrame(answer.fetchall(), columns=names, dtype=object)
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    if len(ours) == 0:
        return "no rows"
    a, b = normal(ours), normal(theirs)
    for left, right in zip(a, b):
        if left != right:
            return f"{sorted(columns)}: {left} != {right}"
    return None
