"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.functions.expressions import lead_time_days, lead_time_yday, nonzero
from fieldcal.session import cut_lineage

# A key is hot when it holds more than 1/HOT_SHARES of all rows, so there are fewer than HOT_SHARES hot keys
# whatever the data: the hot side of the split below is always small enough to broadcast.
HOT_SHARES = 1000
BROADCAST_BYTES = 256 * 1024 * 1024


def fits_broadcast(df: DataFrame) -> bool:
    """Measured, not estimated: the row number (counted no further than the limit) times a row's width in memory."""
    width = 48 + sum(8 if f.dataType.typeName() != "string" else 48 for f in df.schema.fields)
    limit = BROADCAST_BYTES // width
    return df.limit(limit + 1).count() <= limit


def _all_equal(pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [F.col(left).eqNullSafe(F.col(right)) for left, right in pairs])


def _split_join(fact: DataFrame, unique: DataFrame, keys: Sequence[str], counts: DataFrame, how: str) -> DataFrame:
    """Join with hot keys by broadcast and all other keys by shuffle.

    ``counts`` holds one row per key of ``fact`` with its row number ``_rows``.
    """
    total = counts.agg(F.sum("_rows")).scalar()
    hot_keys = F.broadcast(
        counts.filter(F.col("_rows") * F.lit(HOT_SHARES) > total).select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    )
    same = _all_equal([(k, f"_key_{k}") for k in keys])
    in_fact = _all_equal([(k, f"_hot_{k}") for k in keys])
    in_unique = _all_equal([(f"_key_{k}", f"_hot_{k}") for k in keys])
    few = F.broadcast(unique.join(hot_keys, in_unique, "left_semi"))
    hot = fact.join(hot_keys, in_fact, "left_semi").join(few, same, how)
    cold = fact.join(hot_keys, in_fact, "left_anti").join(unique, same, how)
    return hot.unionByName(cold)


def join_unique(
    fact: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """Equi-join a table with repeated keys to one with a single row per key (``how``: inner or left), null-safe.

    The unique side is broadcast when its measured size allows it: the large table is then not shuffled. Beyond that
    the join shuffles, with the hot keys of the large table taken out and joined by broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    renamed = unique.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    if fits_broadcast(unique):
        joined = fact.join(F.broadcast(renamed), _all_equal([(k, f"_key_{k}") for k in keys]), how)
    else:
        if counts is None:
            counts = fact.groupBy(*keys).agg(F.count("*").alias("_rows"))
        joined = _split_join(fact, renamed, keys, counts, how)
    return joined.drop(*[f"_key_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], bounded: bool = False, **aggregates: Column) -> DataFrame:
    """Add group aggregates to every row.

    ``bounded=True`` says that a group is small by construction (one row per year, say): a window then needs one
    shuffle. Otherwise a window could sort a huge group inside one task, so the groups are aggregated on the map side,
    the one-row-per-group result is stored, and its rows are joined back.
    """
    if bounded:
        group = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(group) for n, c in aggregates.items()})
    stats = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in aggregates.items()])
    stats = cut_lineage(stats)
    return join_unique(df, stats.drop("_rows"), keys, "inner", stats.select(*keys, "_rows"))


def anomaly(df: DataFrame, keys: Sequence[str], bounded: bool = False, **columns: str) -> DataFrame:
    """``name=col`` adds ``name = col - mean(col)`` within the group."""
    means = with_group_stats(df, keys, bounded, **{f"_mean_{n}": F.avg(c) for n, c in columns.items()})
    return means.withColumns({n: F.col(c) - F.col(f"_mean_{n}") for n, c in columns.items()}).drop(
        *[f"_mean_{n}" for n in columns]
    )


def leave_one_out(
    df: DataFrame, keys: Sequence[str], anomalies: dict[str, str], means: dict[str, str], bounded: bool = False
) -> DataFrame:
    """Row-wise leave-one-out statistics; null in groups of one row.

    ``anomalies`` maps a new column to the column whose distance to the mean of the *other* rows it holds,
    ``means`` maps a new column to the column whose mean over the *other* rows it holds.
    """
    wanted = sorted({*anomalies.values(), *means.values()})
    out = with_group_stats(df, keys, bounded, _n=F.count("*"), **{f"_mean_{c}": F.avg(c) for c in wanted})
    others = nonzero(F.col("_n") - F.lit(1.0))
    shift = {c: (F.col(c) - F.col(f"_mean_{c}")) / others for c in wanted}
    added = {name: F.col("_n") * shift[c] for name, c in anomalies.items()}
    added |= {name: F.col(f"_mean_{c}") - shift[c] for name, c in means.items()}
    return out.withColumns(added).drop("_n", *[f"_mean_{c}" for c in wanted])


def build_hindcast(obs: DataFrame, forecast: DataFrame, lead: str = "datediff") -> DataFrame:
    """Observations joined to forecasts on (long, lat, date), with the lead time in days.

    ``lead="yday"`` takes the day-of-year difference instead, which is wrong across a new year.
    """
    rule = {"datediff": lead_time_days, "yday": lead_time_yday}[lead]
    joined = join_unique(forecast, obs, ["long", "lat", "date"])
    return joined.withColumn("lead_time", rule(F.col("date"), F.col("start_date")))


def fold_values(df: DataFrame, fold: str) -> Column:
    """Sorted distinct fold labels as an array expression (a scalar subquery, nothing passes the driver)."""
    return F.sort_array(df.select(F.collect_set(fold).alias("labels")).scalar())


def expand_folds(df: DataFrame, fold: str = "year", label: str = "fold", folds: Sequence | None = None) -> DataFrame:
    """Every row once for each fold it trains: all folds except its own.

    A narrow explode; the theta join ``row.year <> fold.year`` never becomes a nested loop.
    """
    labels = F.array(*[F.lit(f) for f in folds]) if folds is not None else fold_values(df, fold)
    return df.withColumn(label, F.explode(F.array_except(labels, F.array(fold))))


def merge_inner(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Fold a list of wide tables with an inner join on shared keys."""
    return reduce(lambda left, right: left.join(right, list(keys), "inner"), tables)
