"""Checks in the scan, ingest by year, kept moments, tables stored by cell."""

import math
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldcal.operators import estimate
from fieldcal.session import scratch_path
from fieldcal.operators.filters import REGIONS
from fieldcal.sources.checked import ScanChecks
from fieldcal.sources.clustered import read_region, write_clustered, z_key, zones_of
from fieldcal.sources.colocated import CellTables, cell_key, join_stored
from fieldcal.sources.increments import YearStore, fingerprints
from tests.test_tables import plan_of

KEYS = ["long", "lat", "lead_time"]


@pytest.fixture(scope="module")
def hindcast(spark):
    return spark.range(4000).select(
        (F.col("id") % 5).cast("double").alias("long"), (F.col("id") % 3).cast("double").alias("lat"),
        (F.col("id") % 2).cast("int").alias("lead_time"), (F.lit(2000) + F.col("id") % 7).cast("int").alias("year"),
        F.when(F.col("id") % 11 != 0, F.lit(1e6) + F.hash("id") % 97).cast("double").alias("obs"),
        (F.lit(-1e6) + F.hash("id", F.lit(1)) % 89).cast("double").alias("fcst"))


def close(left, right, keys):
    rows = [{tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (left, right)]
    assert rows[0].keys() == rows[1].keys() and rows[0]
    for key, a in rows[0].items():
        for name, value in a.items():
            other = rows[1][key][name]
            assert value == other or math.isclose(value, other, rel_tol=1e-7, abs_tol=1e-9), (key, name, value, other)


def test_checks_count_without_dropping(spark):
    rows = [(190.0, 1.0, 1), (-180.0, 90.0, 1), (None, 91.0, 2), (math.nan, 0.0, 3), (-180.0, 90.0, 1)]
    checks = ScanChecks(keys=["long", "lat"])
    kept = checks.watch(spark.createDataFrame(rows, "long double, lat double, v int")).collect()
    assert len(kept) == 4
    assert checks.metrics() == {"rows": 5, "bad_long": 2, "bad_lat": 1, "null_long": 1, "null_lat": 0, "kept": 4, "duplicates": 1}


def test_checks_drop_and_empty_table(spark):
    rows = [(190.0, 1.0), (-180.0, 90.0), (None, 1.0)]
    checks = ScanChecks(drop=True)
    assert checks.watch(spark.createDataFrame(rows, "long double, lat double")).collect() == [(-180.0, 90.0)]
    assert checks.metrics()["kept"] == 1 and checks.metrics()["duplicates"] == 0
    empty = ScanChecks(keys=["long"])
    assert empty.watch(spark.createDataFrame([], "long double, lat double")).collect() == []
    assert set(empty.metrics().values()) == {0}
    with pytest.raises(ValueError):
        ScanChecks(keys=["date"]).watch(spark.createDataFrame(rows, "long double, lat double"))


def test_a_year_is_built_once(spark, hindcast):
    store, built = YearStore(spark, scratch_path(spark, "years")), []

    def build(rows):
        built.append(sorted((r.year for r in rows.select("year").distinct().collect()), key=str))
        return rows

    with pytest.raises(ValueError):
        store.read()
    assert store.update(hindcast, build) == {"built": list(range(2000, 2007)), "withdrawn": []}
    assert store.update(hindcast.repartition(3), build) == {"built": [], "withdrawn": []}
    changed = hindcast.where("year != 2003").withColumn("obs", F.when(F.col("year") == 2001, 0.0).otherwise(F.col("obs")))
    changed = changed.unionByName(hindcast.where("year = 2002").withColumn("year", F.lit(None).cast("int")))
    assert store.update(changed, build) == {"built": [2001, None], "withdrawn": [2003]}
    assert built == [list(range(2000, 2007)), [2001, None]]
    got = store.read().drop("version")
    assert got.exceptAll(changed).count() == changed.exceptAll(got).count() == 0
    assert store.update(hindcast, build) == {"built": [2001, 2003], "withdrawn": [None]}
    got = store.read().drop("version")
    assert got.exceptAll(hindcast).count() == hindcast.exceptAll(got).count() == 0


def test_a_failed_update_leaves_the_store(spark, hindcast):
    store = YearStore(spark, scratch_path(spark, "years"))
    store.update(hindcast.where("year < 2003"), lambda rows: rows)

    def fail(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.update(hindcast, fail)
    hindcast.write.parquet(f"{store.path}/parts/version=2")  # parts of an update that did not reach the manifest
    assert store.read().count() == hindcast.where("year < 2003").count()
    assert store.update(hindcast, lambda rows: rows)["built"] == [2003, 2004, 2005, 2006]
    assert store.read().count() == hindcast.count()


def test_fingerprints_see_repeated_rows_and_moved_nulls(spark):
    of = lambda rows: fingerprints(spark.createDataFrame(rows, "year int, a int, b int")).collect()
    assert of([(1, 2, 3), (1, 4, 5)]) == of([(1, 4, 5), (1, 2, 3)])
    assert of([(1, 2, 3), (1, 2, 3)]) != of([(1, 4, 5), (1, 4, 5)])
    assert of([(1, None, 3)]) != of([(1, 3, None)])


def test_state_with_an_added_year_equals_a_full_run(spark, hindcast):
    store = YearStore(spark, scratch_path(spark, "moments"))
    for source in (hindcast.where("year < 2006"), hindcast):
        changed = store.update(source, lambda rows: estimate.fold_moments(rows, KEYS))
    assert changed["built"] == [2006]
    state = store.read().drop("version")
    close(estimate.mle_from_moments(state, KEYS), estimate.mle(hindcast, KEYS), KEYS)
    close(estimate.mos_from_moments(state, KEYS), estimate.mos_coefficients(hindcast, KEYS), KEYS)
    close(estimate.loo_from_moments(state, KEYS), estimate.loo_mle(hindcast, KEYS, method="join"), [*KEYS, "year"])
    # moments over all lead times from the same state
    close(estimate.mle_from_moments(state, KEYS[:2]), estimate.mle(hindcast, KEYS[:2]), KEYS[:2])


def test_stored_tables_meet_without_a_shuffle(spark, hindcast):
    dated = hindcast.withColumns({"start_date": F.make_date("year", F.lit(6), F.lit(29))})
    dated = dated.withColumn("date", F.date_add("start_date", F.col("lead_time")))
    forecast = dated.select("long", "lat", "start_date", "date", "fcst").dropDuplicates(["long", "lat", "date"])
    obs = dated.select("long", "lat", "date", "obs").dropDuplicates(["long", "lat", "date"])
    with CellTables(spark, 4) as store:
        left, right = store.store(forecast, ["cell", "date"]), store.store(obs, ["cell", "date"])
        joined = join_stored(left, right)
        assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
        expected = forecast.join(obs, ["long", "lat", "date"]).count()
        assert joined.count() == expected > 0
        stored = store.store(hindcast, sort=["lead_time", "year"])
        folds = estimate.loo_mle(stored, ["cell", *KEYS], folds=list(range(2000, 2007)))
        assert "Exchange" not in plan_of(folds)
        close(folds.drop("cell"), estimate.loo_mle(hindcast, KEYS, method="join"), [*KEYS, "year"])
        names = list(store.names)
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_cell_keys_differ(spark):
    cells = spark.sql("SELECT a / 4 AS long, b / 4 AS lat FROM (SELECT explode(sequence(-720, 720)) a), (SELECT explode(sequence(-360, 360)) b)")
    assert cells.select(cell_key(F.col("long"), F.col("lat"))).distinct().count() == 1441 * 721


def _globe(spark):
    return spark.sql("SELECT a * 1.5 AS long, b * 1.5 AS lat, c AS year FROM (SELECT explode(sequence(-120, 120)) a), "
                     "(SELECT explode(sequence(-60, 60)) b), (SELECT explode(sequence(1, 3)) c)").selectExpr(
        "CAST(long AS double) AS long", "CAST(lat AS double) AS lat", "year")


@pytest.fixture(scope="module")
def globe(spark):
    path = scratch_path(spark, "clustered")
    write_clustered(_globe(spark), path, ["year"])
    return path


@pytest.mark.parametrize("region", ["uk", "europe", (-180.0, 180.0, -90.0, 90.0), (178.0, 180.0, 88.0, 90.0), (11.25, 11.25, 0.0, 0.0)])
def test_a_box_reads_its_zones_only(spark, globe, region):
    path = globe
    box = REGIONS[region] if isinstance(region, str) else region
    west, east, south, north = box
    rows = read_region(spark, path, region)
    expected = _globe(spark).where(F.col("long").between(west, east) & F.col("lat").between(south, north))
    assert rows.exceptAll(expected).count() == expected.exceptAll(rows).count() == 0
    read = {r[0] for r in spark.read.parquet(path).where(F.col("zone").isin(zones_of(box))).select(F.input_file_name()).distinct().collect()}
    files = list(Path(path).rglob("*.parquet"))
    assert len(read) <= len(files) and (region != "uk" or len(read) < len(files) / 20)
    assert "PartitionFilters: [zone" in plan_of(rows).replace("isnotnull(zone", "zone")
    assert "GreaterThanOrEqual(lat" in plan_of(rows)


def test_rows_without_a_place_and_out_of_range(spark):
    rows = [(None, 1.0), (math.nan, 1.0), (200.0, 95.0), (180.0, 90.0), (-180.0, -90.0), (3.0, None)]
    df = spark.createDataFrame(rows, "long double, lat double")
    path = scratch_path(spark, "clustered")
    write_clustered(df, path)
    assert spark.read.parquet(path).count() == 6
    assert {tuple(r) for r in read_region(spark, path, (-180.0, 180.0, -90.0, 90.0)).collect()} == {(180.0, 90.0), (-180.0, -90.0)}


def test_row_groups_are_compact(globe):
    """Rows sorted by the key: a file's coordinates span far less than the table's."""
    for file in Path(globe).rglob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        bounds = [group.column(k).statistics for k in range(group.num_columns) if group.column(k).path_in_schema == "long"]
        assert bounds[0].max - bounds[0].min <= 11.25


def test_keys_interleave(spark):
    df = spark.createDataFrame([(-180.0, -90.0), (0.0, -90.0), (-180.0, 0.0), (179.9, 89.9)], "long double, lat double")
    assert [r[0] for r in df.select(z_key(F.col("long"), F.col("lat"), 1)).collect()] == [0, 1, 2, 3]
