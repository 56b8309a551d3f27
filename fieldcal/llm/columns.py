"""Extra columns of a table of documents, kept out of the way of an operator's own names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator(docs)``, in which extra columns, whatever their names, pass under other ones and come back with their own.

    A name changes in the plan only. Where the operator adds a column of the same name as an extra one, the operator's stays.
    """
    prefix = "__extra"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    extra = {c: f"{prefix}_{k}" for k, c in enumerate(c for c in docs.columns if c not in DOCUMENT)}
    done = operator(docs.withColumnsRenamed(extra))
    added = {c.lower() for c in done.columns if c not in extra.values()}
    done = done.drop(*[inner for outer, inner in extra.items() if outer.lower() in added])
    return done.withColumnsRenamed({inner: outer for outer, inner in extra.items() if outer.lower() not in added})
