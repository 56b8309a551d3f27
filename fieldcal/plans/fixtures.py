"""Forecast-shaped views over the ``lineitem`` table.

48 cells (8 longitudes j, 6 latitudes i), years 1995 to 2001, lead times 3, 6, ..., 21 days. Rows that share cell, year
and lead time are ensemble members. The true slope of a cell is 0.5 + 0.05 j.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldcal.functions.expressions import wrap_longitude
from fieldcal.operators.estimate import mean_by
from fieldcal.operators.filters import filter_lead_week
from fieldcal.operators.joins import anomaly
from fieldcal.session import cut_lineage

KEYS = ["j", "i", "long", "lat"]
CELL_TIME = ["j", "i", "year", "lead_time"]
BANDS = 49
#: bands that are looked up among each other, and metadata rows that are made together
STRETCH, CHUNK = 64, 4096
MEMBER_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return (
        li.select(
            (F.col("l_partkey") % 8).cast("int").alias("j"),
            (F.floor(F.col("l_partkey") / 8.0) % 6).cast("int").alias("i"),
            F.year("l_shipdate").alias("year"),
            (F.col("l_linenumber") * 3).cast("int").alias("lead_time"),
            ((F.col("l_orderkey") % 4) * 6).cast("int").alias("hour"),
            (F.col("l_quantity") / 2.003).alias("fcst"),
            *MEMBER_ORDER,
        )
        .withColumn(
            "obs_raw",
            F.lit(5.0) + F.lit(0.2) * F.col("i")
            + (F.lit(0.5) + F.lit(0.05) * F.col("j")) * F.col("fcst")
            + F.col("l_extendedprice") / 20011.0 * (F.lit(0.5) + F.lit(0.02) * F.col("lead_time")),
        )
    )


def _with_coordinates(df: DataFrame) -> DataFrame:
    start = F.make_date("year", F.lit(6), F.lit(29))
    raw_long = ((F.lit(345) + F.lit(3) * F.col("j")) % 360).cast("double")
    return df.withColumns(
        {
            "raw_long": raw_long,
            "long": wrap_longitude(raw_long),
            "lat": (F.lit(36) + F.lit(6) * F.col("i")).cast("double"),
            "start_date": start,
            "date": F.date_add(start, F.col("lead_time")),
        }
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ensemble member."""
    return _with_coordinates(_raw_members(spark, sf_dir)).drop(*MEMBER_ORDER)


def hindcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble and control hindcast in one pass: grouped on four integer keys, combined on the map side."""
    stats = _raw_members(spark, sf_dir).groupBy(*CELL_TIME).agg(
        F.avg("obs_raw").alias("obs"),
        F.avg("fcst").alias("ens_mean"),
        F.stddev_samp("fcst").alias("ens_sd"),
        F.count("*").alias("members"),
        F.min_by("fcst", F.struct(*MEMBER_ORDER)).alias("control"),
    )
    return _with_coordinates(stats).drop("raw_long")


def hindcast_ens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindcast(spark, sf_dir).drop("control")


def hindcast_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*KEYS, "date", "year", "lead_time", "obs"]
    return hindcast(spark, sf_dir).select(*columns, F.col("control").alias("fcst"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble hindcast with the mean renamed to ``fcst``."""
    return hindcast(spark, sf_dir).select(*KEYS, "year", "lead_time", "date", "obs", F.col("ens_mean").alias("fcst"))


def analysis_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-daily fields in Kelvin on longitudes 0..360."""
    keys = ["raw_long", "lat", "date", "hour"]
    stats = members(spark, sf_dir).groupBy(*keys).agg((F.avg("obs_raw") + F.lit(273.15)).alias("t2m"))
    ts = F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + F.col("hour") * F.lit(3600))
    return stats.select(
        F.col("raw_long").alias("x"), F.col("lat").alias("y"), ts.alias("ref_ts"), "date", "hour", "t2m"
    )


def band_number() -> F.Column:
    """1..49: position of (year, lead_time) in order, from the known years 1995..2001 and leads 3..21."""
    return ((F.col("year") - F.lit(1995)) * F.lit(7) + F.col("lead_time") / F.lit(3)).cast("int")


def band_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per band: band_id, band, start_date, veri_date."""
    dates = hindcast(spark, sf_dir).select("year", "lead_time", "start_date", F.col("date").alias("veri_date")).distinct()
    return dates.withColumn("band_id", band_number()).select(
        "band_id",
        F.concat(F.lit("band"), F.col("band_id").cast("string")).alias("band"),
        "start_date",
        "veri_date",
        "year",
        "lead_time",
    )


def band_columns() -> list[str]:
    return [f"band{k}" for k in range(1, BANDS + 1)]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide control field table: x (0..360), y and band1..band49."""
    h = hindcast_control(spark, sf_dir).select(
        F.when(F.col("long") < 0, F.col("long") + 360).otherwise(F.col("long")).alias("x"),
        F.col("lat").alias("y"),
        F.concat(F.lit("band"), band_number().cast("string")).alias("band"),
        "fcst",
    )
    return h.groupBy("x", "y").pivot("band", band_columns()).agg(F.first("fcst"))


def packed(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """(x, y, band_id, value) rows to one array per cell, null where a cell lacks a band. A cell holds its bands, not raw records.

    A band is looked up among those of its stretch of ``STRETCH`` bands, so the work grows with the bands and not with their square. Every
    cell has every stretch, empty ones too.
    """
    last = bands.agg(F.max("band_id")).scalar().cast("int")
    stretch = F.floor((F.col("band_id") - 1) / STRETCH).cast("int")
    every = rows.select("x", "y").distinct().withColumn("band_id", F.explode(F.sequence(F.lit(1), last, F.lit(STRETCH))))
    entries = rows.select("x", "y", stretch.alias("stretch"), F.struct("band_id", value).alias("entry"))
    entries = entries.unionByName(every.select("x", "y", stretch.alias("stretch")), allowMissingColumns=True)
    held = entries.groupBy("x", "y", "stretch").agg(F.map_from_entries(F.collect_list("entry")).alias("held"))
    first = F.col("stretch") * STRETCH
    places = held.withColumn("place", F.sequence(first + 1, F.least(first + STRETCH, last)))
    parts = places.select("x", "y", "stretch", F.transform("place", lambda b: F.try_element_at("held", b)).alias("part"))
    whole = parts.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("stretch", "part"))).alias("parts"))
    return whole.select("x", "y", F.flatten("parts.part").alias("values"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Band numbers from 1 in the order of ``keys``: one row per band."""
    return rows.select(*keys).distinct().withColumn("band_id", F.row_number().over(Window.orderBy(*keys)))


def ensemble_bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packed ensemble fields, a band for every start, lead time and member, and their metadata rows."""
    order = Window.partitionBy(*CELL_TIME).orderBy(*MEMBER_ORDER)
    rows = _with_coordinates(_raw_members(spark, sf_dir).withColumn("member", F.row_number().over(order)))
    rows = cut_lineage(rows.select(F.col("raw_long").alias("x"), F.col("lat").alias("y"), "start_date", F.col("date").alias("veri_date"), "member", "fcst"))
    # members count from 1 without a gap, so a band's number is its member after the bands of all earlier dates
    dates = ["start_date", "veri_date"]
    before = Window.orderBy(*dates).rowsBetween(Window.unboundedPreceding, -1)
    counts = cut_lineage(rows.groupBy(*dates).agg(F.max("member").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    chunks = counts.withColumn("first", F.explode(F.sequence(F.lit(1), "n", F.lit(CHUNK))))
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *dates, "first")
    bands = chunks.withColumn("member", F.explode(F.sequence("first", F.least(F.col("first") + (CHUNK - 1), "n"))))
    number = (F.col("before") + F.col("member")).cast("int").alias("band_id")
    numbered = rows.join(F.broadcast(counts), dates).select("x", "y", number, "fcst")
    return packed(numbered, counts.select((F.col("before") + F.col("n")).alias("band_id")), "fcst"), bands.select(number, *dates)


def analysis_bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Packed analysis fields in Kelvin, a band for every date and hour, and their metadata rows."""
    rows = cut_lineage(analysis_raw(spark, sf_dir))
    bands = _numbered(rows, ["date", "hour"])
    meta = bands.select("band_id", F.col("date").alias("start_date"), F.col("date").alias("veri_date"))
    return packed(rows.join(bands, ["date", "hour"]), bands, "t2m"), meta


def hindcast_3w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week-3 control hindcast: weekly mean per cell and year, with the forecast's anomaly in its cell."""
    weekly = mean_by(
        hindcast_control(spark, sf_dir).transform(filter_lead_week(3)), [*KEYS, "year"], "obs", "fcst"
    )
    return anomaly(weekly, KEYS, bounded=True, fcst_anom="fcst")


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with planted faults: longitudes out of range, missing latitudes, repeated rows."""
    misplaced = daily(spark, sf_dir).select(
        F.when((F.col("j") + F.col("i") + F.col("year")) % 11 == 0, F.col("long") + 400).otherwise(F.col("long")).alias("long"),
        F.when(~((F.col("i") == 2) & (F.col("year") == 1999) & (F.col("lead_time") == 12)), F.col("lat")).alias("lat"),
        "year", "lead_time", "obs", "fcst")
    misplaced = cut_lineage(misplaced)
    return misplaced.unionByName(misplaced.where("lead_time = 9 and year % 3 = 0"))


def worldwide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily forecasts on a grid over the globe, so that every region keeps some rows and leaves others."""
    return daily(spark, sf_dir).select(
        (F.lit(-157.5) + F.lit(45) * F.col("j")).alias("long"), (F.lit(-70.0) + F.lit(28) * F.col("i")).alias("lat"), "year", "lead_time", "fcst")
