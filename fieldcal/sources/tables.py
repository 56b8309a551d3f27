"""Field tables: read with a given schema, write partitioned, keep per-fold results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.operators.filters import filter_region

# Valid ranges of the coordinate columns after longitudes are wrapped.
COORDINATE_RANGES = {"long": (-180.0, 180.0), "lat": (-90.0, 90.0)}


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    region: str | Sequence[float] | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Read a stored table; region and years become pushed filters (years prune partitions)."""
    stored = spark.read.parquet(path)
    missing = [f.name for f in schema.fields if f.name not in stored.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    df = stored.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    if years is not None:
        df = df.filter(F.col("year").isin(*years))
    return df.transform(filter_region(region)) if region is not None else df


def range_violations(df: DataFrame) -> DataFrame:
    """Number of rows outside the valid range of each coordinate."""
    outside = {c: ~F.col(c).between(*r) for c, r in COORDINATE_RANGES.items() if c in df.columns}
    return df.agg(F.count("*").alias("rows"), *[F.count_if(rule).alias(f"bad_{c}") for c, rule in outside.items()])


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",), mode: str = "overwrite") -> None:
    """Write parquet, replacing only the partitions the data holds.

    The rebalance hint gathers each partition's rows into few files and splits a partition too large for one task.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in partition_by])
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def scan_wide_bands(spark: SparkSession, path: str, bands: Sequence[str] | None = None) -> DataFrame:
    """Decoded wide field table: x, y and one column per band; only the chosen bands are read."""
    wide = spark.read.parquet(path)
    if bands is None:
        bands = [c for c in wide.columns if c.startswith("band")]
    return wide.select("x", "y", *bands)


def pack_bands(wide: DataFrame, bands: Sequence[str] | None = None) -> DataFrame:
    """Wide field table to (x, y, values): all bands of a cell in one array, in the order of ``bands`` (by default band1, band2, ...).

    Stored once in this form, a table of any number of bands is read, exploded and joined by a plan of the same size.
    """
    if bands is None:
        bands = sorted((c for c in wide.columns if c.startswith("band")), key=lambda c: int(c.removeprefix("band")))
    return wide.select("x", "y", F.array(*bands).alias("values"))


def band_rows(packed: DataFrame, meta: DataFrame, value: str) -> DataFrame:
    """(x, y, values) and band metadata to one row per cell and band, with the metadata's columns; places without a value go.

    The place in the array, from 1, is the metadata's ``band_id``. Metadata is one row per band, the joined rows are cells times bands.
    """
    rows = packed.select("x", "y", F.posexplode("values").alias("_place", value)).where(F.col(value).isNotNull())
    named = rows.select("x", "y", (F.col("_place") + 1).alias("band_id"), value)
    return named.join(meta, "band_id").drop("band_id", "band")


def write_fold_results(results: DataFrame, grid: DataFrame, path: str) -> None:
    """Per-fold results by year, keyed by cell index, with the coordinate grid stored once beside them."""
    write_table(results, f"{path}/folds")
    grid.write.mode("overwrite").parquet(f"{path}/grid")


def read_fold_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/folds"), spark.read.parquet(f"{path}/grid")
