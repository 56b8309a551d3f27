"""Wide <-> long, labels, grid index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.functions.expressions import nonzero
from fieldcal.operators.joins import with_group_stats

PARAMETERS = ("alpha", "beta", "tau")


def melt(df: DataFrame, ids: Sequence[str], var: str = "variable", value: str = "value") -> DataFrame:
    """All columns but ``ids`` to (variable, value) rows."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], var, value)


def cast_wide(df: DataFrame, ids: Sequence[str], var: str, value: str, values: Sequence) -> DataFrame:
    """Long to wide; ``values`` are the new columns, given so that no extra job looks for them."""
    return df.groupBy(*ids).pivot(var, list(values)).agg(F.first(value, ignorenulls=True))


def drop_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "series") -> DataFrame:
    """One row per key with the sorted array of its (fields) structs.

    The array holds the whole series of a key, so the keys must bound it (a cell's years, not raw records).
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def unnest(df: DataFrame, name: str = "series") -> DataFrame:
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.inline(name))


def axis_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct coordinates of one axis with a dense 1-based index; the grid resolution bounds their number."""
    return df.select(column).distinct().withColumn(
        "position", F.dense_rank().over(Window.orderBy(column)).cast("int")
    )


def grid_index(df: DataFrame, long: str = "long", lat: str = "lat") -> DataFrame:
    """Complete grid of the region: (long, lat, i, j, s) for every longitude x latitude pair.

    ``i`` counts latitudes upward, ``j`` longitudes, ``s = (j - 1) * n_lat + i``. Pairs without data get a row too.
    """
    axis = lambda c: F.sort_array(F.collect_set(c))
    axes = df.agg(axis(long).alias("_longs"), axis(lat).alias("_lats"))
    columns = axes.select("_lats", F.posexplode("_longs").alias("_j", "long"))
    cells = columns.select("_j", "long", F.size("_lats").alias("_n_lat"), F.posexplode("_lats").alias("_i", "lat"))
    return cells.select(
        "long",
        "lat",
        (F.col("_i") + 1).alias("i"),
        (F.col("_j") + 1).alias("j"),
        (F.col("_j") * F.col("_n_lat") + F.col("_i") + 1).alias("s"),
    )


def attach_grid(df: DataFrame, grid: DataFrame, on: str = "s") -> DataFrame:
    """Give values keyed by cell index their coordinates."""
    return df.join(grid.select(on, "long", "lat"), on, "inner")


def stack_parameters(df: DataFrame, keys: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """Columns ``alpha_<suffix>, beta_<suffix>, tau_<suffix>`` to rows keyed by ``par``.

    ``suffixes`` may hold patterns such as ``"{}_hat"`` and ``"var_{}_hat"``; each becomes one column,
    named after the pattern without the placeholder.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(p).alias("par"),
                *[F.col(s.format(p)).cast("double").alias(s.format("").strip("_").replace("__", "_")) for s in suffixes],
            )
            for p in PARAMETERS
        ]
    )
    return df.select(*keys, F.inline(rows))


def unstack_parameters(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Inverse of ``stack_parameters``: one row per key, columns ``<par>_<column>``."""
    cells = [
        F.max(F.when(F.col("par") == p, F.col(c))).alias(f"{p}_{c}") for p in PARAMETERS for c in columns
    ]
    return df.groupBy(*keys).agg(*cells)


def split_parameter_name(df: DataFrame, column: str, par: str = "par", kind: str = "type") -> DataFrame:
    parts = F.split(F.col(column), "_")
    return df.withColumns({par: parts[0], kind: parts[1]})


def recode(column: Column, labels: dict[str, str]) -> Column:
    """Replace each pattern by its label, in order."""
    for pattern, label in labels.items():
        column = F.regexp_replace(column, pattern, label)
    return column


def long_parameters(df: DataFrame, keys: Sequence[str], method: str) -> DataFrame:
    """Estimates and variances of a wide estimate table as (variable, estimate, variance, method)."""
    names = [f"{p}_hat" for p in PARAMETERS] + [f"var_{p}_hat" for p in PARAMETERS]
    rows = df.select(*keys, *names).unpivot(list(keys), names, "name", "value")
    rows = rows.select(
        *keys,
        F.regexp_replace("name", "^var_|_hat$", "").alias("variable"),
        F.when(F.col("name").rlike("^var_"), "variance").otherwise("estimate").alias("what"),
        "value",
    )
    wide = cast_wide(rows, [*keys, "variable"], "what", "value", ["estimate", "variance"])
    return wide.withColumn("method", F.lit(method))


def minmax_rescale(
    df: DataFrame, col: str, lo: float = -1.0, hi: float = 1.0, keys: Sequence[str] = (), out: str | None = None
) -> DataFrame:
    """Linear map of the column's range (whole table, or per key) onto [lo, hi]."""
    if lo >= hi:
        raise ValueError("lo must be smaller than hi")
    out = out or f"{col}_scaled"
    low, high = F.min(col), F.max(col)
    if keys:
        ranged = with_group_stats(df, keys, _lo=low, _hi=high)
    else:
        limits = df.agg(F.struct(low.alias("lo"), high.alias("hi")).alias("limits")).scalar()
        ranged = df.withColumn("_limits", limits).withColumns(
            {"_lo": F.col("_limits.lo"), "_hi": F.col("_limits.hi")}
        ).drop("_limits")
    share = (F.col(col) - F.col("_lo")) / nonzero(F.col("_hi") - F.col("_lo"))
    return ranged.withColumn(out, share * F.lit(hi - lo) + F.lit(float(lo))).drop("_lo", "_hi")


def map_values(df: DataFrame, rule: Callable[[Column], Column], ids: Sequence[str]) -> DataFrame:
    """Apply one rule to every value column of a wide table."""
    return df.withColumns({c: rule(F.col(c)) for c in df.columns if c not in ids})
