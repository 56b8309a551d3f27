"""Queries for sources, sinks, reshaping, filters, sorting and set operations."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions import expressions as E
from fieldcal.operators import estimate, filters, joins, reshape
from fieldcal.plans import fixtures as fx
from fieldcal.plans import workflows
from fieldcal.plans.registry import query
from fieldcal.session import cut_lineage, scratch_path
from fieldcal.sources import metadata, tables

FIELDS = "j, i, long, lat, year, lead_time"
HINDCAST_SCHEMA = T.StructType(
    [
        T.StructField("long", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("lead_time", T.IntegerType()),
        T.StructField("obs", T.DoubleType()),
        T.StructField("fcst", T.DoubleType()),
    ]
)

# ---- sources and sinks ----


@query("scan_hindcast", "SELECT long, lat, year, lead_time, r6(obs) AS obs, r6(fcst) AS fcst FROM fx_daily "
       "WHERE long BETWEEN -15 AND 30 AND lat BETWEEN 30 AND 70 AND year IN (1996, 1997, 1998)")
def _(spark, sf_dir):
    path = scratch_path(spark, "hindcast")
    tables.write_table(fx.daily(spark, sf_dir), path)
    return tables.read_table(spark, path, HINDCAST_SCHEMA, "europe_3w", [1996, 1997, 1998])


@query("parse_band_metadata", "SELECT band_id, band, start_date, veri_date FROM fx_meta")
def _(spark, sf_dir):
    path = scratch_path(spark, "bands")
    text = metadata.band_text(fx.band_meta(spark, sf_dir))
    header = spark.createDataFrame([("Driver: GRIB/GRIdded Binary (.grb)\nFiles: none\nSize is 240, 121",)], "value string")
    header.union(text).coalesce(1).write.text(path)
    return metadata.parse_band_metadata(spark, path)


@query("scan_wide_bands", "SELECT x, y, " + ", ".join(f"r6({b}) AS {b}" for b in fx.band_columns()) + " FROM fx_wide")
def _(spark, sf_dir):
    path = scratch_path(spark, "wide")
    fx.wide(spark, sf_dir).write.parquet(path)
    return tables.scan_wide_bands(spark, path)


def stored_bands(spark, bands):
    """Packed bands and their metadata dump, written as files and read back."""
    packed, meta = bands
    path = scratch_path(spark, "packed")
    packed.write.parquet(f"{path}/fields")
    metadata.band_text(meta).write.text(f"{path}/text")
    return spark.read.parquet(f"{path}/fields"), cut_lineage(metadata.parse_band_metadata(spark, f"{path}/text"))


OBSERVED = """
SELECT CASE WHEN x > 180 THEN x - 360 ELSE x END AS long, y AS lat, date, avg(t2m) - 273.15 AS obs FROM fx_analysis_raw GROUP BY x, y, date
"""


@query("ingest_analysis_wide", f"SELECT long, lat, date, r6(obs) AS obs FROM ({OBSERVED}) o")
def _(spark, sf_dir):
    return workflows.observations_packed(*stored_bands(spark, fx.analysis_bands(spark, sf_dir)))


@query("ingest_ensemble_hindcast", f"""
SELECT e.long, e.lat, e.date, e.year, e.lead_time, r6(o.obs) AS obs, r6(e.ens_mean) AS ens_mean, r6(e.ens_sd) AS ens_sd
FROM fx_ens e JOIN ({OBSERVED}) o ON e.long = o.long AND e.lat = o.lat AND e.date = o.date
""")
def _(spark, sf_dir):
    analysis, ensemble = fx.analysis_bands(spark, sf_dir), fx.ensemble_bands(spark, sf_dir)
    hindcast = workflows.ingest_ensemble_packed(*stored_bands(spark, analysis), *stored_bands(spark, ensemble))
    return hindcast.select("long", "lat", "date", "year", "lead_time", "obs", "ens_mean", "ens_sd")


@query("daily_mean_by_year", "SELECT x, y, date, r6(avg(t2m)) AS t2m, CAST(year(date) AS INT) AS year "
       "FROM fx_analysis_raw GROUP BY x, y, date")
def _(spark, sf_dir):
    path = scratch_path(spark, "daily")
    daily = estimate.daily_mean(fx.analysis_raw(spark, sf_dir), ["x", "y"], "ref_ts", "t2m")
    tables.write_table(daily.withColumn("year", F.year("date")), path)
    return spark.read.parquet(path)


@query("write_table", f"SELECT {FIELDS}, date, r6(obs) AS obs, r6(fcst) AS fcst FROM fx_daily")
def _(spark, sf_dir):
    path = scratch_path(spark, "table")
    tables.write_table(fx.daily(spark, sf_dir), path)
    return spark.read.parquet(path)


FOLD_STORE = """
SELECT w.year, CAST(g.s AS INT) AS s, r6(w.obs) AS y, g.long, g.lat
FROM fx_weekly w JOIN fx_grid g ON w.long = g.long AND w.lat = g.lat
"""


def _fold_store(spark, sf_dir):
    path = scratch_path(spark, "folds")
    weekly = fx.hindcast_3w(spark, sf_dir)
    grid = reshape.grid_index(fx.daily(spark, sf_dir))
    keyed = weekly.join(grid.select("long", "lat", "s"), ["long", "lat"]).select("year", "s", F.col("obs").alias("y"))
    tables.write_fold_results(keyed, grid.select("s", "long", "lat"), path)
    return tables.read_fold_results(spark, path)


@query("write_fold_results", "SELECT year, s, y FROM (" + FOLD_STORE + ") f")
def _(spark, sf_dir):
    folds, _grid = _fold_store(spark, sf_dir)
    return folds.select("year", "s", "y")


@query("read_fold_results", FOLD_STORE)
def _(spark, sf_dir):
    folds, grid = _fold_store(spark, sf_dir)
    return reshape.attach_grid(folds, grid)


# ---- projections and reshaping ----


@query("rename_map", "SELECT x AS long, y AS lat, date, r6(avg(t2m)) AS obs FROM fx_analysis_raw GROUP BY x, y, date")
def _(spark, sf_dir):
    daily = estimate.daily_mean(fx.analysis_raw(spark, sf_dir), ["x", "y"], "ref_ts", "t2m")
    return daily.withColumnsRenamed({"x": "long", "y": "lat", "t2m": "obs"})


@query("wrap_longitude", "SELECT x, CASE WHEN x > 180 THEN x - 360 ELSE x END AS long, count(*) AS n "
       "FROM fx_analysis_raw GROUP BY x")
def _(spark, sf_dir):
    counts = fx.analysis_raw(spark, sf_dir).groupBy("x").agg(F.count("*").alias("n"))
    return counts.withColumn("long", E.wrap_longitude(F.col("x")))


@query("kelvin_to_celsius", "SELECT x, y, date, hour, r6(t2m - 273.15) AS obs FROM fx_analysis_raw")
def _(spark, sf_dir):
    raw = fx.analysis_raw(spark, sf_dir)
    return raw.select("x", "y", "date", "hour", E.kelvin_to_celsius(F.col("t2m")).alias("obs"))


@query("melt_fields", "SELECT x, y, band, r6(fcst) AS fcst FROM fx_long_bands")
def _(spark, sf_dir):
    return reshape.melt(fx.wide(spark, sf_dir), ["x", "y"], "band", "fcst").filter("fcst is not null")


@query("cast_wide", "SELECT long, lat, lead_time, " + ", ".join(
    f"r6(max(CASE WHEN year = {y} THEN obs END)) AS y{y}" for y in range(1995, 2002)
) + " FROM fx_daily GROUP BY long, lat, lead_time")
def _(spark, sf_dir):
    rows = fx.daily(spark, sf_dir).withColumn("label", F.concat(F.lit("y"), F.col("year").cast("string")))
    return reshape.cast_wide(rows, ["long", "lat", "lead_time"], "label", "obs", [f"y{y}" for y in range(1995, 2002)])


@query("select_verifying_dates", """
SELECT x, y, date, r6(avg(t2m)) AS t2m FROM fx_analysis_raw
WHERE date IN (SELECT veri_date FROM fx_meta WHERE lead_time IN (3, 9)) GROUP BY x, y, date
""")
def _(spark, sf_dir):
    # the dates of two lead times stand in for a forecast set smaller than the analysis
    dates = fx.band_meta(spark, sf_dir).filter("lead_time in (3, 9)").select(F.col("veri_date").alias("date")).distinct()
    kept = fx.analysis_raw(spark, sf_dir).join(dates, "date", "left_semi")
    return estimate.daily_mean(kept, ["x", "y"], "ref_ts", "t2m")


KEYED = "SELECT long, lat, CAST(start_date AS VARCHAR) || '::' || CAST(date AS VARCHAR) AS key, r6(fcst) AS fcst FROM fx_control"


def _encoded(spark, sf_dir):
    h = fx.hindcast(spark, sf_dir)
    return h.select("long", "lat", E.encode_key(F.col("start_date"), F.col("date")).alias("key"), F.col("control").alias("fcst"))


@query("encode_key", KEYED)
def _(spark, sf_dir):
    return _encoded(spark, sf_dir)


@query("decode_key", f"""
SELECT long, lat, fcst, CAST(substr(key, 1, 10) AS DATE) AS start_date, CAST(substr(key, 13, 10) AS DATE) AS date
FROM ({KEYED}) k
""")
def _(spark, sf_dir):
    start, date = E.decode_key(F.col("key"))
    return _encoded(spark, sf_dir).select("long", "lat", "fcst", start.alias("start_date"), date.alias("date"))


LONG_HAT = """
SELECT long, lat, lead_time, 'alpha_hat' AS par, alpha_hat AS value FROM fx_mle
UNION ALL SELECT long, lat, lead_time, 'beta_hat', beta_hat FROM fx_mle
UNION ALL SELECT long, lat, lead_time, 'tau_hat', tau_hat FROM fx_mle
"""


def _long_hat(spark, sf_dir):
    m = estimate.mle(fx.daily(spark, sf_dir), ["long", "lat", "lead_time"])
    return reshape.melt(m.select("long", "lat", "lead_time", "alpha_hat", "beta_hat", "tau_hat"), ["long", "lat", "lead_time"], "par")


@query("split_parameter_name", f"SELECT long, lat, lead_time, split_part(par, '_', 1) AS par, split_part(par, '_', 2) AS type, "
       f"r6(value) AS value FROM ({LONG_HAT}) x")
def _(spark, sf_dir):
    return reshape.split_parameter_name(_long_hat(spark, sf_dir), "par")


@query("recode_labels", f"""
SELECT long, lat, lead_time, regexp_replace(par, '_hat$', '') AS par, regexp_matches(par, '^tau') AS is_scale,
  replace(split_part(par, '_', 2), 'hat', 'maximum likelihood') AS type, r6(value) AS value FROM ({LONG_HAT}) x
""")
def _(spark, sf_dir):
    rows = reshape.split_parameter_name(_long_hat(spark, sf_dir), "par", "short", "kind")
    return rows.select(
        "long", "lat", "lead_time",
        reshape.recode(F.col("par"), {"_hat$": ""}).alias("par"),
        F.col("par").rlike("^tau").alias("is_scale"),
        reshape.recode(F.col("kind"), {"hat": "maximum likelihood", "smooth": "posterior mean"}).alias("type"),
        "value",
    )


@query("long_parameters", " UNION ALL ".join(
    f"SELECT long, lat, lead_time, '{p}' AS variable, r6({p}_hat) AS estimate, r6(var_{p}_hat) AS variance, "
    "'likelihood' AS method FROM fx_mle" for p in ("alpha", "beta", "tau")))
def _(spark, sf_dir):
    keys = ["long", "lat", "lead_time"]
    return reshape.long_parameters(estimate.mle(fx.daily(spark, sf_dir), keys), keys, "likelihood")


@query("drop_columns", "SELECT lead_time, r6(avg(obs)) AS obs, r6(avg(ens_mean)) AS ens_mean FROM fx_ens GROUP BY lead_time")
def _(spark, sf_dir):
    h = fx.hindcast_ens(spark, sf_dir).groupBy("lead_time").agg(
        F.avg("obs").alias("obs"), F.avg("ens_mean").alias("ens_mean"), F.stddev_samp("obs").alias("obs_se"),
        F.stddev_samp("ens_mean").alias("ens_mean_se"), F.sum("members").alias("members"))
    return reshape.drop_suffix(h, "_se").drop("members")


@query("nest_series", """
SELECT long, lat, CAST(len(series) AS INT) AS n, r6(list_sum(list_transform(series, lambda e: e.a * e.o))) AS dot
FROM (SELECT long, lat, list({'a': fcst_anom, 'o': obs}) AS series FROM fx_3w GROUP BY long, lat) s
""")
def _(spark, sf_dir):
    nested = reshape.nest(fx.hindcast_3w(spark, sf_dir), ["long", "lat"], ["year", "fcst_anom", "obs"])
    dot = F.aggregate("series", F.lit(0.0), lambda acc, e: acc + e["fcst_anom"] * e["obs"])
    return nested.select("long", "lat", F.size("series").alias("n"), dot.alias("dot"))


@query("unnest_series", "SELECT long, lat, year, r6(fcst_anom) AS fcst_anom, r6(obs) AS obs FROM fx_3w")
def _(spark, sf_dir):
    return reshape.unnest(reshape.nest(fx.hindcast_3w(spark, sf_dir), ["long", "lat"], ["year", "fcst_anom", "obs"]))


@query("crossing", "SELECT v.variable, g.long, g.lat FROM (VALUES ('alpha'), ('beta'), ('tau')) v(variable) CROSS JOIN fx_grid g")
def _(spark, sf_dir):
    grid = reshape.grid_index(fx.daily(spark, sf_dir))
    return grid.select(F.explode(F.array(*[F.lit(p) for p in reshape.PARAMETERS])).alias("variable"), "long", "lat")


@query("grid_index", "SELECT * FROM fx_grid")
def _(spark, sf_dir):
    return reshape.grid_index(fx.daily(spark, sf_dir))


STACKED = " UNION ALL ".join(
    f"SELECT long, lat, lead_time, '{p}' AS par, r6({p}_hat) AS hat, r6(var_{p}_hat) AS var_hat FROM fx_mle"
    for p in ("alpha", "beta", "tau"))


def _stacked(spark, sf_dir):
    keys = ["long", "lat", "lead_time"]
    return reshape.stack_parameters(estimate.mle(fx.daily(spark, sf_dir), keys), keys, ["{}_hat", "var_{}_hat"])


@query("stack_parameters", STACKED)
def _(spark, sf_dir):
    return _stacked(spark, sf_dir)


@query("unstack_parameters", "SELECT long, lat, lead_time, " + ", ".join(
    f"r6({p}_hat) AS {p}_hat, r6(var_{p}_hat) AS {p}_var_hat" for p in ("alpha", "beta", "tau")) + " FROM fx_mle")
def _(spark, sf_dir):
    return reshape.unstack_parameters(_stacked(spark, sf_dir), ["long", "lat", "lead_time"], ["hat", "var_hat"])


@query("concat_with_id", "SELECT year, long, lat, r6(obs) AS obs FROM fx_weekly")
def _(spark, sf_dir):
    # the fold label is a partition column of the store, so binding the folds needs no union
    folds, grid = _fold_store(spark, sf_dir)
    return reshape.attach_grid(folds, grid).select("year", "long", "lat", F.col("y").alias("obs"))


@query("attach_grid", "SELECT g.s, w.year, g.long, g.lat, r6(w.fcst) AS fcst FROM fx_weekly w "
       "JOIN fx_grid g ON w.long = g.long AND w.lat = g.lat")
def _(spark, sf_dir):
    grid = reshape.grid_index(fx.daily(spark, sf_dir))
    weekly = fx.hindcast_3w(spark, sf_dir)
    values = weekly.join(grid.select("long", "lat", "s"), ["long", "lat"]).select("s", "year", "fcst")
    return reshape.attach_grid(values, grid)


@query("field_lookup", """
SELECT c.long, c.lat, c.year, c.lead_time, r6(CAST(0.5 + 0.05 * t.j AS DOUBLE)) AS beta_true, r6(c.fcst) AS fcst
FROM fx_control c LEFT JOIN (SELECT DISTINCT i, j FROM fx_ens) t ON c.i = t.i AND c.j = t.j
""")
def _(spark, sf_dir):
    h = fx.hindcast_control(spark, sf_dir)
    truth = h.select("i", "j").distinct().withColumn("beta_true", F.lit(0.5) + F.lit(0.05) * F.col("j"))
    return joins.join_unique(h, truth, ["i", "j"], "left").select("long", "lat", "year", "lead_time", "beta_true", "fcst")


@query("minmax_rescale", """
SELECT long, lat, year, lead_time,
  r6((fcst - min(fcst) OVER ()) / (max(fcst) OVER () - min(fcst) OVER ()) * 10.0 + 10.0) AS fcst_scaled,
  r6((fcst - min(fcst) OVER w) / nullif(max(fcst) OVER w - min(fcst) OVER w, 0) * 2.0 - 1.0) AS field_scaled
FROM fx_daily WINDOW w AS (PARTITION BY year, lead_time)
""")
def _(spark, sf_dir):
    daily = fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "fcst")
    whole = reshape.minmax_rescale(daily, "fcst", 10.0, 20.0)
    return reshape.minmax_rescale(whole, "fcst", -1.0, 1.0, ["year", "lead_time"], "field_scaled").drop("fcst")


# ---- filters ----

PICK = "long, lat, year, lead_time, fcst"
ROWS = "SELECT long, lat, year, lead_time, r6(fcst) AS fcst FROM fx_daily"


def _filtered(spark, sf_dir, rule):
    return fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "fcst").transform(rule)


for _name, _rule, _where in [
    ("filter_region", filters.filter_region("europe"), "long BETWEEN -24 AND 60 AND lat BETWEEN 34.5 AND 69"),
    ("filter_region_uk", filters.filter_region("uk"), "long BETWEEN -10.5 AND 2.5 AND lat BETWEEN 48 AND 60"),
    ("filter_region_africa", filters.filter_region("africa"), "long BETWEEN -20 AND 55 AND lat BETWEEN -40 AND 40"),
    ("filter_region_se_asia", filters.filter_region("se_asia"), "long BETWEEN 90 AND 150 AND lat BETWEEN -15 AND 40"),
    ("filter_region_box", filters.filter_region((0.0, 3.0, 51.0, 54.0)), "long BETWEEN 0 AND 3 AND lat BETWEEN 51 AND 54"),
    ("filter_lead_set", filters.filter_lead_set([3, 7, 21, 42]), "lead_time IN (3, 7, 21, 42)"),
    ("filter_lead_week", filters.filter_lead_week(3), "ceil(lead_time / 7.0) = 3"),
    ("filter_lead_modulo", filters.filter_lead_modulo(7, 1), "lead_time % 7 = 1"),
    ("filter_train_fold", filters.filter_train_fold(1998), "year <> 1998"),
    ("filter_test_fold", filters.filter_test_fold(1998), "year = 1998"),
    ("filter_lead_range", filters.filter_lead_range(10, 14), "lead_time BETWEEN 10 AND 14"),
    ("filter_equals", lambda df: df.filter("year = 1999 and lead_time = 12"), "year = 1999 AND lead_time = 12"),
    ("map_window", filters.map_window(40.0, 60.0, -9.0, 3.0), "lat BETWEEN 40 AND 60 AND long BETWEEN -9 AND 3"),
]:
    query(_name, f"{ROWS} WHERE {_where}")(lambda spark, sf_dir, rule=_rule: _filtered(spark, sf_dir, rule))


# ---- sort, distinct, set operations ----


@query("sort_grid", "SELECT long, lat, year, r6(obs) AS obs FROM fx_weekly ORDER BY long, lat DESC, year")
def _(spark, sf_dir):
    return fx.hindcast_3w(spark, sf_dir).select("long", "lat", "year", "obs").orderBy("long", F.desc("lat"), "year")


@query("distinct_values", """
SELECT y.year, (SELECT count(DISTINCT long) FROM fx_ens) AS n_long, (SELECT count(DISTINCT lat) FROM fx_ens) AS n_lat
FROM (SELECT DISTINCT year FROM fx_ens) y
""")
def _(spark, sf_dir):
    h = fx.daily(spark, sf_dir)
    counts = h.agg(F.struct(F.countDistinct("long").alias("n_long"), F.countDistinct("lat").alias("n_lat"))).scalar()
    return h.select("year").distinct().withColumn("_c", counts).select("year", "_c.n_long", "_c.n_lat")


@query("union_results", """
SELECT long, lat, lead_time, 'daily' AS method, r6(alpha_hat) AS alpha_hat FROM fx_mle
UNION ALL SELECT long, lat, 21 AS lead_time, 'weekly' AS method, r6(alpha_hat) AS alpha_hat FROM fx_mle3w
""")
def _(spark, sf_dir):
    one = estimate.mle(fx.daily(spark, sf_dir), ["long", "lat", "lead_time"]).withColumn("method", F.lit("daily"))
    two = estimate.mle(fx.hindcast_3w(spark, sf_dir), ["long", "lat"]).withColumns({"method": F.lit("weekly"), "lead_time": F.lit(21)})
    columns = ["long", "lat", "lead_time", "method", "alpha_hat"]
    return one.select(*columns).unionByName(two.select(*columns))
