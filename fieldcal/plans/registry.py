"""Registered queries and their SQL twins.

A query is a function (spark, sf_dir) -> DataFrame. Its twin is SQL text over the same parquet tables; a name that starts
with ``fx_`` in the text is a common table expression of ``SQL_VIEWS`` and is put in front of the statement, with the
expressions it needs in turn. ``r6(x)`` in the text stands for rounding to six decimals; the query side is rounded alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SQL_VIEWS: dict[str, str] = {}
DECIMALS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Round double columns; adding 0.0 turns a negative zero into zero."""
    return df.select(
        *[
            (F.round(f.name, DECIMALS) + F.lit(0.0)).alias(f.name) if f.dataType == T.DoubleType() else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def view(name: str, sql: str) -> None:
    SQL_VIEWS[name] = sql


def _expand_rounding(sql: str) -> str:
    out, pos = [], 0
    while (at := sql.find("r6(", pos)) >= 0:
        depth, end = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out.append(sql[pos:at] + f"(round({_expand_rounding(sql[at + 3:end - 1])}, {DECIMALS}) + 0.0)")
        pos = end
    return "".join(out) + sql[pos:]


def _needed_views(sql: str, seen: list[str]) -> list[str]:
    for name in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
        if name in SQL_VIEWS and name not in seen:
            _needed_views(SQL_VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def complete_sql(sql: str) -> str:
    """The statement with every view it uses written out in front of it."""
    names = _needed_views(sql, [])
    recursive = "WITH RECURSIVE " if "RECURSIVE" in sql else "WITH "
    head = recursive + ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in names) + "\n" if names else ""
    return _expand_rounding(head + sql.strip().removeprefix("RECURSIVE"))
