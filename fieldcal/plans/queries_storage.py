"""Queries for storage: checks in the scan, ingest by year, kept moments, tables stored by cell."""

from pyspark.sql import functions as F

from fieldcal.functions import expressions as E
from fieldcal.operators import estimate, filters
from fieldcal.plans import fixtures as fx
from fieldcal.plans.queries_estimates import CELL_LEAD
from fieldcal.plans.registry import ORACLES, query
from fieldcal.session import cut_lineage, scratch_path
from fieldcal.sources import tables
from fieldcal.sources.checked import ScanChecks
from fieldcal.sources.clustered import read_region, write_clustered
from fieldcal.sources.colocated import CellTables, join_stored
from fieldcal.sources.increments import YearStore

# ---- checks in the pass that uses the table ----

CELL_TIME = ["long", "lat", "year", "lead_time"]
COUNTS = {
    "rows": "count(*) FROM fx_faulty",
    "bad_long": "count(*) FROM fx_faulty WHERE NOT long BETWEEN -180 AND 180",
    "bad_lat": "count(*) FROM fx_faulty WHERE NOT lat BETWEEN -90 AND 90",
    **{f"null_{c}": f"count(*) FROM fx_faulty WHERE {c} IS NULL" for c in CELL_TIME},
    "kept": "count(DISTINCT (long, lat, year, lead_time)) FROM fx_valid",
    "duplicates": "count(*) - count(DISTINCT (long, lat, year, lead_time)) FROM fx_valid",
}


def _checked(spark, sf_dir):
    checks, path = ScanChecks(keys=CELL_TIME, drop=True), scratch_path(spark, "checked")
    tables.write_table(checks.watch(fx.faulty(spark, sf_dir)), path)
    return checks, path


@query("scan_checks", " UNION ALL ".join(f"SELECT '{name}' AS metric, (SELECT {count}) AS value" for name, count in COUNTS.items()))
def _(spark, sf_dir):
    return _checked(spark, sf_dir)[0].report(spark)


@query("scan_checked_rows", "SELECT DISTINCT long, lat, year, lead_time, r6(obs) AS obs, r6(fcst) AS fcst FROM fx_valid")
def _(spark, sf_dir):
    return spark.read.parquet(_checked(spark, sf_dir)[1])


# ---- ingest by year ----


@query("ingest_by_year", "SELECT x, y, date, r6(avg(t2m)) AS t2m, CAST(year(date) AS INT) AS year, "
       "CAST(CASE WHEN year(date) IN (1998, 2001) THEN 2 ELSE 1 END AS INT) AS version FROM fx_analysis_raw GROUP BY x, y, date")
def _(spark, sf_dir):
    """A year was corrected, a year came, a year without a source goes; the others stay as they were built."""
    now = cut_lineage(fx.analysis_raw(spark, sf_dir).withColumn("year", F.year("date")))
    before = now.where("year < 2001").withColumn("t2m", F.when(F.col("year") == 1998, F.col("t2m") + 1).otherwise(F.col("t2m")))
    before = before.unionByName(now.where("year = 1996").withColumn("year", F.lit(1990)))
    store = YearStore(spark, scratch_path(spark, "analysis"))
    for source in (before, now):
        store.update(source, lambda rows: estimate.daily_mean(rows, ["x", "y", "year"], "ref_ts", "t2m"))
    return store.read()


# ---- estimates from kept moments ----


def moment_state(spark, sf_dir):
    """Moments by cell, lead time and year, brought from an earlier hindcast to the present one."""
    now = cut_lineage(fx.daily(spark, sf_dir).select(*CELL_LEAD, "year", "obs", "fcst"))
    before = now.where("year < 2001").withColumn("obs", F.when(F.col("year") == 1996, F.col("obs") * 2).otherwise(F.col("obs")))
    before = before.unionByName(now.where("year = 1997").withColumn("year", F.lit(1990)))
    store = YearStore(spark, scratch_path(spark, "moments"))
    for source in (before, now):
        store.update(source, lambda rows: estimate.fold_moments(rows, CELL_LEAD))
    return store.read()


@query("mle_from_state", ORACLES["mle_with_variance"])
def _(spark, sf_dir):
    return estimate.mle_from_moments(moment_state(spark, sf_dir), CELL_LEAD)


@query("loo_from_state", ORACLES["loo_mle"])
def _(spark, sf_dir):
    return estimate.loo_from_moments(moment_state(spark, sf_dir), CELL_LEAD)


@query("mos_from_state", ORACLES["mos_coefficients"])
def _(spark, sf_dir):
    return estimate.mos_from_moments(moment_state(spark, sf_dir), CELL_LEAD).transform(filters.filter_lead_set([3, 7, 14, 21, 28]))


@query("information_from_state", " UNION ALL ".join(
    f"SELECT long, lat, lead_time, '{p}' AS par, r6(1.0 / var_{p}_hat) AS w FROM fx_mle" for p in ("alpha", "beta", "tau")))
def _(spark, sf_dir):
    estimates = estimate.mle_from_moments(moment_state(spark, sf_dir), CELL_LEAD)
    return estimate.information_diagonal(estimates, CELL_LEAD)


# ---- tables stored by cell ----


def _stored_sides(store, spark, sf_dir):
    daily = estimate.daily_mean(fx.analysis_raw(spark, sf_dir), ["x", "y"], "ref_ts", "t2m")
    obs = daily.select(
        E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "date", E.kelvin_to_celsius(F.col("t2m")).alias("obs"))
    forecast = fx.hindcast(spark, sf_dir).select("long", "lat", "start_date", "date", F.col("control").alias("fcst"))
    return store.store(forecast, ["cell", "date"]), store.store(obs, ["cell", "date"])


@query("join_obs_fcst_stored", ORACLES["join_obs_fcst"])
def _(spark, sf_dir):
    with CellTables(spark) as store:
        joined = join_stored(*_stored_sides(store, spark, sf_dir))
        return cut_lineage(joined.select("long", "lat", "date", "lead_time", "obs", "fcst"))


@query("loo_mle_stored", ORACLES["loo_mle"])
def _(spark, sf_dir):
    with CellTables(spark) as store:
        stored = store.store(fx.daily(spark, sf_dir).select(*CELL_LEAD, "year", "obs", "fcst"), sort=["lead_time", "year"])
        found = estimate.loo_mle(stored, ["cell", "long", "lat", "lead_time"])
        return cut_lineage(found.drop("cell"))


# ---- layout for regions ----

BOXES = {"africa": filters.REGIONS["africa"], "se_asia": filters.REGIONS["se_asia"], "europe": filters.REGIONS["europe"],
         "edge": (112.5, 180.0, -90.0, -42.0), "nowhere": (0.0, 20.0, 0.0, 10.0)}


@query("scan_clustered_regions", " UNION ALL ".join(
    f"SELECT '{name}' AS region, long, lat, year, lead_time, r6(fcst) AS fcst FROM fx_global "
    f"WHERE long BETWEEN {west} AND {east} AND lat BETWEEN {south} AND {north}" for name, (west, east, south, north) in BOXES.items()))
def _(spark, sf_dir):
    path = scratch_path(spark, "clustered")
    write_clustered(fx.worldwide(spark, sf_dir), path, ["year", "lead_time"])
    found = None
    for name, box in BOXES.items():
        rows = read_region(spark, path, box).select(F.lit(name).alias("region"), "long", "lat", "year", "lead_time", "fcst")
        found = rows if found is None else found.unionByName(rows)
    return found
