"""Tables stored by their keys, so that joins and groupings by those keys need no shuffle.

Tables that are to meet are bucketed and sorted by the same keys with the same number of buckets: forecasts and observations by cell and
date, since both keys of a join must be those of the buckets; a hindcast by cell, which serves every grouping by cell and anything else. A
bucket is one file, written by one task. A cell has one row for each date and lead time by construction of the grid, so buckets are even.
Choose ``buckets`` so that one fits a task (about 200 MB of rows); the number is fixed for all tables that are to meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.functions.expressions import lead_time_days
from fieldcal.session import scratch_path

#: coordinates are told apart to this part of a degree
RESOLUTION = 10_000


def cell_key(long: Column, lat: Column) -> Column:
    """One integer per coordinate pair. Floating-point keys are normalised by every operator, which loses a stored partitioning."""
    whole = lambda c: F.round(c * RESOLUTION).cast("long")
    return whole(long) * F.lit(1000 * RESOLUTION) + whole(lat)


class CellTables:
    """Bucketed tables of one run. The tables leave the catalog when the block ends; their files stay in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int = 16) -> None:
        self.spark, self.buckets, self.names = spark, buckets, []

    def __enter__(self) -> CellTables:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def store(self, df: DataFrame, by: Sequence[str] = ("cell",), sort: Sequence[str] = ()) -> DataFrame:
        """``df`` (with long and lat) and its key ``cell``, stored by ``by`` and sorted by ``by`` and ``sort``."""
        name = f"cells_{uuid.uuid4().hex}"
        self.names.append(name)
        keyed = df.withColumn("cell", cell_key(F.col("long"), F.col("lat")))
        placed = keyed.repartition(self.buckets, *by).sortWithinPartitions(*by, *sort)
        writer = placed.write.bucketBy(self.buckets, *by).sortBy(*by, *sort).option("compression", "zstd")
        writer.option("path", scratch_path(self.spark, "cells")).saveAsTable(name)
        return self.spark.table(name)


def join_stored(forecast: DataFrame, obs: DataFrame) -> DataFrame:
    """Stored forecasts with the stored observation of their cell and date, and the lead time in days: buckets merge where they lie."""
    joined = forecast.hint("merge").join(obs.drop("long", "lat"), ["cell", "date"])
    return joined.withColumn("lead_time", lead_time_days(F.col("date"), F.col("start_date")))
