"""Run a registered query in Spark and its SQL twin in DuckDB and compare rows, column types and values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canonical(table) -> pd.DataFrame:
    names = sorted(table.column_names)
    frame = pd.DataFrame({n: [repr(v) for v in table.column(n).to_pylist()] for n in names})
    return frame.sort_values(names).reset_index(drop=True) if names else frame


def difference(spark_df, sql: str, con) -> str | None:
    """None when equal, else a short description."""
    left, right = spark_df.toArrow(), con.execute(sql).to_arrow_table()
    if sorted(left.column_names) != sorted(right.column_names):
        return f"columns {sorted(left.column_names)} vs {sorted(right.column_names)}"
    if left.num_rows != right.num_rows:
        return f"rows {left.num_rows} vs {right.num_rows}"
    types = {
        n: (str(left.schema.field(n).type), str(right.schema.field(n).type))
        for n in left.column_names
        if str(left.schema.field(n).type) != str(right.schema.field(n).type)
    }
    if types:
        return f"types {types}"
    a, b = _canonical(left), _canonical(right)
    bad = (a != b).any(axis=1)
    if bad.any():
        k = bad.idxmax()
        cols = [c for c in a.columns if a.loc[k, c] != b.loc[k, c]]
        return f"{bad.sum()} of {len(a)} rows differ, first in {[(c, a.loc[k, c], b.loc[k, c]) for c in cols]}"
    return None
