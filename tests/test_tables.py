"""Sources, sinks, expressions, filters and their plans."""

import math
import time

import pytest
from pyspark.sql import functions as F

from fieldcal.functions import expressions as E
from fieldcal.operators import filters, reshape
from fieldcal.plans import fixtures, registry
from fieldcal.plans.queries_tables import HINDCAST_SCHEMA
from fieldcal.session import scratch_path
from fieldcal.sources import metadata, tables


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "t")
    df = spark.range(1000).select(
        (F.col("id") % 60 - 30).cast("double").alias("long"), (F.col("id") % 40 + 30).cast("double").alias("lat"),
        (F.lit(2000) + F.col("id") % 4).cast("int").alias("year"), F.lit(3).alias("lead_time"),
        F.rand(1).alias("obs"), F.rand(2).alias("fcst"))
    tables.write_table(df, path)
    return path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_and_year_reach_the_scan(spark, stored):
    plan = plan_of(tables.read_table(spark, stored, HINDCAST_SCHEMA, "uk", [2001]).select("long", "obs"))
    assert "GreaterThanOrEqual(lat,48.0)" in plan and "year" in plan.split("PartitionFilters")[1][:60]
    assert "fcst" not in plan.split("ReadSchema")[1]


def test_lead_week_filter_reaches_the_scan(spark, stored):
    plan = plan_of(spark.read.parquet(stored).transform(filters.filter_lead_week(3)))
    assert "GreaterThan(lead_time,14)" in plan and "LessThanOrEqual(lead_time,21)" in plan


def test_missing_column_is_reported(spark, stored):
    schema = HINDCAST_SCHEMA.__class__([*HINDCAST_SCHEMA.fields]).add("absent", "double")
    with pytest.raises(ValueError, match="absent"):
        tables.read_table(spark, stored, schema)


def test_range_check(spark):
    df = spark.createDataFrame([(200.0, 10.0), (10.0, 91.0), (0.0, 0.0)], "long double, lat double")
    assert tables.range_violations(df).first().asDict() == {"rows": 3, "bad_long": 1, "bad_lat": 1}


def test_write_replaces_only_its_partitions(spark):
    path = scratch_path(spark, "t")
    tables.write_table(spark.createDataFrame([(1, 2000), (2, 2001)], "v int, year int"), path)
    tables.write_table(spark.createDataFrame([(9, 2001)], "v int, year int"), path)
    assert sorted((r.v, r.year) for r in spark.read.parquet(path).collect()) == [(1, 2000), (9, 2001)]


def test_metadata_without_verifying_date(spark, tmp_path):
    text = (
        "Driver: GRIB\nFiles: x\n"
        "Band 1 Block=240x1\n  Metadata:\n    GRIB_REF_TIME=  946706400 sec UTC\n"
        "Band 12 Block=240x1\n    GRIB_PDS_TEMPLATE_ASSEMBLED_VALUES=" + " ".join(["0"] * 24) + " 2000 7 2 0 0\n"
        "    GRIB_REF_TIME=  962236800 sec UTC\n"
    )
    (tmp_path / "info.txt").write_text(text)
    got = [tuple(map(str, r)) for r in metadata.parse_band_metadata(spark, str(tmp_path / "info.txt")).orderBy("band_id").collect()]
    assert got == [("1", "band1", "2000-01-01", "None"), ("12", "band12", "2000-06-29", "2000-07-02")]


def test_quantiles():
    assert math.isclose(E.t_quantile(0.975, 19), 2.093024054408263, rel_tol=1e-9)
    assert math.isclose(E.t_quantile(0.05, 3), -2.353363434801823, rel_tol=1e-8)
    assert math.isclose(E.normal_quantile(0.005), -2.575829303548901, rel_tol=1e-9)
    assert math.isclose(E.t_log_constant(19), -0.9320903732, rel_tol=1e-9)


def test_step_bin_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.999,), (1.0,), (1.01,), (None,), (-0.2,)], "v double")
    assert [r[0] for r in df.select(E.step_bin(F.col("v"), -1, 1, 5)).collect()] == [0, 4, 4, None, None, 2]


def test_rescale_rejects_an_empty_range(spark):
    with pytest.raises(ValueError):
        reshape.minmax_rescale(spark.createDataFrame([(1.0,)], "v double"), "v", 1.0, 1.0)


def test_grid_is_complete(spark):
    df = spark.createDataFrame([(0.0, 1.0), (3.0, 2.0), (6.0, 2.0)], "long double, lat double")
    got = {(r.long, r.lat): (r.i, r.j, r.s) for r in reshape.grid_index(df).collect()}
    assert got == {(0.0, 1.0): (1, 1, 1), (0.0, 2.0): (2, 1, 2), (3.0, 1.0): (1, 2, 3), (3.0, 2.0): (2, 2, 4),
                   (6.0, 1.0): (1, 3, 5), (6.0, 2.0): (2, 3, 6)}


def test_rounding_text():
    assert registry.complete_sql("SELECT r6(f(a, r6(b))) AS x") == "SELECT (round(f(a, (round(b, 6) + 0.0)), 6) + 0.0) AS x"


def test_packing_many_bands(spark):
    """Each band was looked up among all bands of its cell, so 60,000 bands took minutes."""
    n = 60000
    bands = spark.range(1, n + 1, 1, 4).select(F.col("id").cast("int").alias("band_id"))
    rows = bands.select(
        F.explode(F.array(F.lit(0.0), F.lit(3.0), F.lit(None).cast("double"))).alias("x"), F.lit(1.0).alias("y"), "band_id",
        F.col("band_id").cast("double").alias("v")).where("x is null or (x = 0 and band_id % 7 = 0) or (x = 3 and band_id between 1000 and 1001)")
    start = time.time()
    found = {r.x: r["values"] for r in fixtures.packed(rows, bands, "v").collect()}
    assert time.time() - start < 60
    assert found == {
        0.0: [float(k) if k % 7 == 0 else None for k in range(1, n + 1)], 3.0: [float(k) if k in (1000, 1001) else None for k in range(1, n + 1)],
        None: [float(k) for k in range(1, n + 1)]}


def test_bands_of_the_ensemble_are_numbered_in_order(spark, sf_dir):
    fields, meta = fixtures.ensemble_bands(spark, sf_dir)
    rows = meta.orderBy("band_id").collect()
    assert [r.band_id for r in rows] == list(range(1, len(rows) + 1))
    dates = [(r.start_date, r.veri_date) for r in rows]
    assert dates == sorted(dates)
    assert fields.where(F.size("values") != len(rows)).isEmpty()
