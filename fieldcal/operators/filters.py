"""Predicates. Each is a plain comparison on a stored column wherever it can be, so it reaches the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.expressions import lead_week

# Fixed values: (longitude from, to, latitude from, to), inclusive.
REGIONS = {
    "africa": (-20.0, 55.0, -40.0, 40.0),
    "se_asia": (90.0, 150.0, -15.0, 40.0),
    "europe": (-24.0, 60.0, 34.5, 69.0),
    "europe_3w": (-15.0, 30.0, 30.0, 70.0),
    "uk": (-10.5, 2.5, 48.0, 60.0),
}

Transform = Callable[[DataFrame], DataFrame]


def filter_region(region: str | Sequence[float]) -> Transform:
    """Keep a named region or a box (long from, to, lat from, to); for ``df.transform``."""
    west, east, south, north = REGIONS[region] if isinstance(region, str) else region
    return lambda df: df.filter(F.col("long").between(west, east) & F.col("lat").between(south, north))


def map_window(south: float = -70.0, north: float = 80.0, west: float | None = None, east: float | None = None) -> Transform:
    """Keep the points a map shows."""
    def keep(df: DataFrame) -> DataFrame:
        df = df.filter(F.col("lat").between(south, north))
        return df if west is None else df.filter(F.col("long").between(west, east))
    return keep


def filter_lead_set(leads: Sequence[int]) -> Transform:
    return lambda df: df.filter(F.col("lead_time").isin(*leads))


def filter_lead_week(week: int) -> Transform:
    """Lead times of one week. Written as a range on the stored column, so parquet can skip by it."""
    return lambda df: df.filter((F.col("lead_time") > 7 * (week - 1)) & (F.col("lead_time") <= 7 * week))


def filter_lead_modulo(divisor: int, rest: int) -> Transform:
    return lambda df: df.filter(F.pmod(F.col("lead_time"), F.lit(divisor)) == rest)


def filter_lead_range(first: int, last: int) -> Transform:
    return lambda df: df.filter(F.col("lead_time").between(first, last))


def filter_train_fold(fold: int) -> Transform:
    return lambda df: df.filter(F.col("year") != fold)


def filter_test_fold(fold: int) -> Transform:
    return lambda df: df.filter(F.col("year") == fold)


def with_lead_week(df: DataFrame) -> DataFrame:
    return df.withColumn("lead_week", lead_week(F.col("lead_time")))
