"""Run a query in Spark and its SQL in DuckDB and compare the rows as bags."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.12g}"
    return str(v)


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def differences(df, db, sql: str, limit: int = 5) -> list[str]:
    """Empty if both sides agree in column names, row count and values."""
    result = db.sql(sql)
    names = list(result.columns)
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(names) ^ set(df.columns))}"]
    theirs = _bag(result.fetchall(), names)
    ours = _bag([tuple(r) for r in df.collect()], df.columns)
    if ours == theirs:
        return []
    notes = [f"rows {len(ours)} vs {len(theirs)}", str(sorted(names))]
    only = [("spark", r) for r in sorted(set(ours) - set(theirs))[:limit]]
    only += [("sql", r) for r in sorted(set(theirs) - set(ours))[:limit]]
    return notes + [f"{side}: {row}" for side, row in only]
