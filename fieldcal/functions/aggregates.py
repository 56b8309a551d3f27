"""Aggregate expressions. All merge from partial results, so a hot group is combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldcal.functions.expressions import nonzero


def weighted_mean(x: Column, w: Column) -> Column:
    """Weighted mean over the rows where ``x`` is present; booleans count as 0 and 1."""
    x = x.cast("double")
    return F.sum(w * x) / nonzero(F.sum(F.when(x.isNotNull(), w)))


def weighted_sd(x: Column, w: Column) -> Column:
    """Weighted standard deviation, population form."""
    mean = weighted_mean(x, w)
    return F.sqrt(F.greatest(F.lit(0.0), weighted_mean(x * x, w) - mean * mean))


def weighted_se(x: Column, w: Column) -> Column:
    return weighted_sd(x, w) / F.sqrt(nonzero(F.count(x).cast("double")))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both sides, null where either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / nonzero(F.stddev_pop(x) * F.stddev_pop(y))
