"""Tables laid out for regions: rows near each other on the globe lie near each other in the files.

A row's place is its Z-order key: the bits of its longitude and latitude steps in turn. The first bits (the zone, 32 x 32 over the globe) are
a partition column, so a box lists only the folders of zones it meets; inside a zone rows are sorted by the whole key, so that the row
groups' smallest and largest coordinates leave out most of the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.operators.filters import REGIONS, filter_region

#: halvings of each axis in a zone and in the whole key
ZONE_BITS, KEY_BITS = 5, 16


def _steps(value: Column, low: float, high: float, bits: int) -> Column:
    """Number of the step of ``value`` among 2^bits of equal width; values outside go to the first or last step."""
    last = (1 << bits) - 1
    return F.least(F.greatest(F.floor((value - low) / (high - low) * (1 << bits)), F.lit(0)), F.lit(last)).cast("long")


def _interleaved(x: Column, y: Column, bits: int) -> Column:
    key = F.lit(0).cast("long")
    for b in range(bits):
        for value, side in ((x, 0), (y, 1)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(value, b).bitwiseAND(F.lit(1).cast("long")), 2 * b + side))
    return key


def z_key(long: Column, lat: Column, bits: int = KEY_BITS) -> Column:
    """Z-order key of wrapped coordinates; null where one is null or not a number."""
    key = _interleaved(_steps(long, -180.0, 180.0, bits), _steps(lat, -90.0, 90.0, bits), bits)
    return F.when(~(F.isnan(long) | F.isnan(lat)), key)


def zones_of(box: Sequence[float]) -> list[int]:
    """Zones a box (long from, to, lat from, to) meets, in ascending order: at most 1024."""
    count = 1 << ZONE_BITS

    def span(first: float, last: float, low: float, high: float) -> range:
        step = lambda v: min(max(int((v - low) / (high - low) * count // 1), 0), count - 1)
        return range(step(first), step(last) + 1)

    west, east, south, north = box
    spread = lambda v: sum(((v >> b) & 1) << 2 * b for b in range(ZONE_BITS))
    return sorted(spread(x) | spread(y) << 1 for x in span(west, east, -180.0, 180.0) for y in span(south, north, -90.0, 90.0))


def write_clustered(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write ``df`` (with long and lat) by zone and Z-order key.

    Ranges are cut by the key and then by ``order`` (a date, say), so a cell with very many rows is shared among tasks; by sampled
    bounds tasks are even, and a task writes to few zones. Rows without a place keep the null zone, which no box meets.
    """
    placed = df.withColumn("_key", z_key(F.col("long"), F.col("lat")))
    placed = placed.withColumn("zone", F.shiftright("_key", 2 * (KEY_BITS - ZONE_BITS)).cast("int"))
    ranged = placed.repartitionByRange("zone", "_key", *order).sortWithinPartitions("zone", "_key", *order).drop("_key")
    ranged.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("zone").parquet(path)


def read_region(spark: SparkSession, path: str, region: str | Sequence[float]) -> DataFrame:
    """Rows of a named region or a box: zones outside it are not listed, row groups outside it not decoded."""
    box = REGIONS[region] if isinstance(region, str) else region
    return spark.read.parquet(path).where(F.col("zone").isin(zones_of(box))).transform(filter_region(box)).drop("zone")
