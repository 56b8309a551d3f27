"""Band metadata text -> one row per band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcal.functions.expressions import epoch_to_date

# Where the dump keeps each item, and the 1-based place of year, month, day of the verifying date.
BAND_SEPARATOR = "\nBand "
REFERENCE_TIME = r"GRIB_REF_TIME=\s*(\d+) sec"
TEMPLATE_VALUES = r"GRIB_PDS_TEMPLATE_ASSEMBLED_VALUES=\s*([^\n]*)"
VERIFYING_YMD = (25, 26, 27)


def parse_band_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(band_id, band, start_date, veri_date) from a metadata dump.

    The band separator is the record separator, so a split of the file holds whole blocks and the parse is a
    projection. The header block has no band id and falls out.
    """
    blocks = spark.read.option("lineSep", BAND_SEPARATOR).text(path)
    band_id = F.regexp_extract("value", r"^(?:Band )?(\d+) ", 1)
    values = F.split(F.regexp_extract("value", TEMPLATE_VALUES, 1), " +")
    year, month, day = [F.try_element_at(values, F.lit(k)).try_cast("int") for k in VERIFYING_YMD]
    parsed = blocks.select(
        F.nullif(band_id, F.lit("")).cast("int").alias("band_id"),
        F.nullif(F.regexp_extract("value", REFERENCE_TIME, 1), F.lit("")).cast("bigint").alias("_seconds"),
        F.to_date(F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.make_date(year, month, day))).alias(
            "veri_date"
        ),
    ).filter("band_id is not null")
    return parsed.select(
        "band_id",
        F.concat(F.lit("band"), F.col("band_id").cast("string")).alias("band"),
        epoch_to_date(F.col("_seconds")).alias("start_date"),
        "veri_date",
    )


def band_text(meta: DataFrame) -> DataFrame:
    """Metadata rows in the dump's text form, one block per row (column ``value``), for round trips."""
    head = F.concat(F.lit("Band "), F.col("band_id").cast("string"), F.lit(" Block=240x1 Type=Float64, ColorInterp=Undefined"))
    seconds = F.unix_timestamp(F.col("start_date").cast("timestamp")).cast("string")
    filler = " ".join(["0"] * (VERIFYING_YMD[0] - 1))
    ymd = [F.date_format("veri_date", part) for part in ("yyyy", "MM", "dd")]
    template = F.concat_ws(" ", F.lit(f"    GRIB_PDS_TEMPLATE_ASSEMBLED_VALUES={filler}"), *ymd, F.lit("0 0 0 1"))
    lines = [
        head,
        F.lit('  Description = 2[m] HTGL="Specified height level above ground"'),
        F.lit("  Metadata:"),
        F.lit("    GRIB_ELEMENT=T"),
        F.concat(F.lit("    GRIB_REF_TIME=  "), seconds, F.lit(" sec UTC")),
        template,
    ]
    return meta.select(F.concat_ws("\n", *lines).alias("value"))
