"""Queries for joins, aggregates, windows, scalar functions and estimation."""

from pyspark.sql import functions as F

from fieldcal.functions import aggregates as A
from fieldcal.functions import expressions as E
from fieldcal.operators import estimate, filters, joins, predict, reshape, smoothing, spatial, verify
from fieldcal.plans import fixtures as fx
from fieldcal.plans.registry import query
from fieldcal.plans.sql_views import weighted_mean_sql

CELL_LEAD = ["long", "lat", "lead_time"]

# ---- joins ----


@query("join_obs_fcst", """
SELECT c.long, c.lat, c.date, CAST(c.date - c.start_date AS INT) AS lead_time, r6(o.t2m) AS obs, r6(c.fcst) AS fcst
FROM fx_control c JOIN (
  SELECT CASE WHEN x > 180 THEN x - 360 ELSE x END AS long, y AS lat, date, avg(t2m) - 273.15 AS t2m
  FROM fx_analysis_raw GROUP BY x, y, date) o
ON c.long = o.long AND c.lat = o.lat AND c.date = o.date
""")
def _(spark, sf_dir):
    daily = estimate.daily_mean(fx.analysis_raw(spark, sf_dir), ["x", "y"], "ref_ts", "t2m")
    obs = daily.select(
        E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "date",
        E.kelvin_to_celsius(F.col("t2m")).alias("obs"),
    )
    forecast = fx.hindcast(spark, sf_dir).select("long", "lat", "start_date", "date", F.col("control").alias("fcst"))
    return joins.build_hindcast(obs, forecast).select("long", "lat", "date", "lead_time", "obs", "fcst")


@query("join_cv_hindcast", """
SELECT l.long, l.lat, l.fold AS year, l.lead_time, r6(l.alpha_hat) AS alpha_hat, r6(l.beta_hat) AS beta_hat, r6(d.obs) AS obs
FROM fx_loo l JOIN fx_daily d ON l.long = d.long AND l.lat = d.lat AND l.fold = d.year AND l.lead_time = d.lead_time
""")
def _(spark, sf_dir):
    daily = fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "obs", "fcst")
    cv = estimate.loo_mle(daily, CELL_LEAD).select("long", "lat", "year", "lead_time", "alpha_hat", "beta_hat")
    return predict.join_cv_hindcast(daily.drop("fcst"), cv)


@query("join_params_xbar", """
SELECT m.long, m.lat, r6(m.alpha_hat - m.beta_hat * x.xbar) AS intercept, r6(m.beta_hat) AS slope
FROM fx_mle m JOIN (SELECT long, lat, avg(fcst) AS xbar FROM fx_daily WHERE lead_time = 6 GROUP BY long, lat) x
ON m.long = x.long AND m.lat = x.lat WHERE m.lead_time = 6
""")
def _(spark, sf_dir):
    daily = fx.daily(spark, sf_dir).filter("lead_time = 6")
    params = estimate.mle(daily, CELL_LEAD)
    xbar = estimate.mean_by(daily, ["long", "lat"], "fcst").withColumnRenamed("fcst", "xbar")
    joined = params.join(xbar, ["long", "lat"])
    return joined.select(
        "long", "lat", (F.col("alpha_hat") - F.col("beta_hat") * F.col("xbar")).alias("intercept"), F.col("beta_hat").alias("slope")
    )


@query("expand_folds", "SELECT fold, lead_time, count(*) AS n, r6(sum(obs)) AS obs FROM fx_train GROUP BY fold, lead_time")
def _(spark, sf_dir):
    rows = joins.expand_folds(fx.daily(spark, sf_dir).select("year", "lead_time", "obs"))
    return rows.groupBy("fold", "lead_time").agg(F.count("*").alias("n"), F.sum("obs").alias("obs"))


@query("right_join", """
SELECT w.long, w.lat, w.year, r6(w.obs) AS obs, r6(u.alpha_hat) AS alpha_hat
FROM (SELECT * FROM fx_mle3w WHERE long BETWEEN -10.5 AND 2.5 AND lat BETWEEN 48 AND 60) u
RIGHT JOIN fx_weekly w ON u.long = w.long AND u.lat = w.lat
""")
def _(spark, sf_dir):
    weekly = fx.hindcast_3w(spark, sf_dir)
    part = estimate.mle(weekly.transform(filters.filter_region("uk")), ["long", "lat"]).select("long", "lat", "alpha_hat")
    return part.join(weekly.select("long", "lat", "year", "obs"), ["long", "lat"], "right")


@query("keyed_lookup", "SELECT x, y, veri_date AS date, r6(fcst) AS fcst FROM fx_long_bands b JOIN fx_meta m ON b.band_id = m.band_id")
def _(spark, sf_dir):
    long_rows = reshape.melt(fx.wide(spark, sf_dir), ["x", "y"], "band", "fcst").filter("fcst is not null")
    meta = fx.band_meta(spark, sf_dir).select("band", F.col("veri_date").alias("date"))
    return long_rows.join(meta, "band").drop("band")


@query("merge_years", "SELECT x, y, r6(band3) AS band3, r6(band10) AS band10, r6(band45) AS band45 FROM fx_wide")
def _(spark, sf_dir):
    wide = fx.wide(spark, sf_dir)
    return joins.merge_inner([wide.select("x", "y", b) for b in ("band3", "band10", "band45")], ["x", "y"])


@query("merge_years_long", "SELECT x, y, date, r6(avg(t2m)) AS t2m FROM fx_analysis_raw GROUP BY x, y, date")
def _(spark, sf_dir):
    raw = fx.analysis_raw(spark, sf_dir)
    parts = [estimate.daily_mean(raw.filter(F.year("date") < 1998), ["x", "y"], "ref_ts", "t2m"),
             estimate.daily_mean(raw.filter(F.year("date") >= 1998), ["x", "y"], "ref_ts", "t2m")]
    return parts[0].unionByName(parts[1])


@query("neighbour_join", "SELECT a.s, b.s AS s_neighbour FROM fx_grid a JOIN fx_grid b ON abs(a.i - b.i) + abs(a.j - b.j) = 1")
def _(spark, sf_dir):
    return spatial.neighbours(reshape.grid_index(fx.daily(spark, sf_dir)))


# ---- aggregations ----


@query("daily_mean", "SELECT x, y, date, r6(avg(t2m)) AS t2m FROM fx_analysis_raw GROUP BY x, y, date")
def _(spark, sf_dir):
    return estimate.daily_mean(fx.analysis_raw(spark, sf_dir), ["x", "y"], "ref_ts", "t2m")


@query("ensemble_stats", "SELECT long, lat, start_date, date, r6(ens_mean) AS ens_mean, r6(ens_sd) AS ens_sd FROM fx_ens")
def _(spark, sf_dir):
    return estimate.ensemble_stats(fx.members(spark, sf_dir), ["long", "lat", "start_date", "date"])


@query("weekly_mean", """
SELECT long, lat, year, CAST(ceil(lead_time / 7.0) AS INT) AS lead_week, r6(avg(obs)) AS obs, r6(avg(fcst)) AS fcst
FROM fx_control GROUP BY long, lat, year, ceil(lead_time / 7.0)
""")
def _(spark, sf_dir):
    rows = fx.hindcast_control(spark, sf_dir).transform(filters.with_lead_week)
    return estimate.mean_by(rows, ["long", "lat", "year", "lead_week"], "obs", "fcst")


@query("correlation_bias", """
SELECT long, lat, lead_time, r6(covar_pop(fcst, obs) / nullif(stddev_pop(fcst) * stddev_pop(obs), 0)) AS cor,
  r6(avg(fcst - obs)) AS bias FROM fx_daily WHERE lead_time IN (3, 7, 21, 42) GROUP BY long, lat, lead_time
""")
def _(spark, sf_dir):
    daily = fx.daily(spark, sf_dir).transform(filters.filter_lead_set([3, 7, 21, 42]))
    return estimate.correlation_bias(daily, CELL_LEAD)


@query("correlation_bias_weekly", """
SELECT long, lat, lead_week, r6(covar_pop(fcst, obs) / nullif(stddev_pop(fcst) * stddev_pop(obs), 0)) AS cor, r6(avg(fcst - obs)) AS bias
FROM (SELECT long, lat, year, CAST(ceil(lead_time / 7.0) AS INT) AS lead_week, avg(obs) AS obs, avg(fcst) AS fcst
  FROM fx_control GROUP BY long, lat, year, ceil(lead_time / 7.0)) w
GROUP BY long, lat, lead_week
""")
def _(spark, sf_dir):
    rows = fx.hindcast_control(spark, sf_dir).transform(filters.with_lead_week)
    weekly = estimate.mean_by(rows, ["long", "lat", "year", "lead_week"], "obs", "fcst")
    return estimate.correlation_bias(weekly, ["long", "lat", "lead_week"])


@query("summary_moments", "SELECT long, lat, r6(vyy) AS vyy, r6(vzz) AS vzz, r6(vyz) AS vyz, r6(ybar) AS ybar, n FROM fx_mle3w")
def _(spark, sf_dir):
    return estimate.moments(fx.hindcast_3w(spark, sf_dir), ["long", "lat"], "fcst_anom")


@query("cov_var_slope", """
SELECT c.lat, c.long, c.lead_time, r6(avg(c.obs)) AS alpha_hat, r6(covar_samp(c.fcst, c.obs) / nullif(var_samp(c.fcst), 0)) AS beta_hat,
  r6(0.5 * ln(avg((c.obs - b.a - b.b * (c.fcst - b.m)) ** 2))) AS tau_hat
FROM fx_control c JOIN (
  SELECT long, lat, lead_time, avg(obs) AS a, avg(fcst) AS m, covar_samp(fcst, obs) / nullif(var_samp(fcst), 0) AS b
  FROM fx_control GROUP BY long, lat, lead_time) b
ON c.long = b.long AND c.lat = b.lat AND c.lead_time = b.lead_time
WHERE c.lead_time % 7 = 1 GROUP BY c.lat, c.long, c.lead_time
""")
def _(spark, sf_dir):
    control = fx.hindcast_control(spark, sf_dir)
    return estimate.cov_var_slope(control, ["lat", "long", "lead_time"]).transform(filters.filter_lead_modulo(7, 1))


@query("group_mean", "SELECT long, lat, r6(avg(fcst)) AS fcst_mean FROM fx_weekly WHERE year <> 1997 GROUP BY long, lat")
def _(spark, sf_dir):
    train = fx.hindcast_3w(spark, sf_dir).transform(filters.filter_train_fold(1997))
    return estimate.mean_by(train, ["long", "lat"], "fcst").withColumnRenamed("fcst", "fcst_mean")


@query("first_in_group", "SELECT long, lat, r6(avg(fcst)) AS fcst_mean FROM fx_weekly GROUP BY long, lat")
def _(spark, sf_dir):
    rows = fx.hindcast_3w(spark, sf_dir).withColumn("fcst_mean", F.col("fcst") - F.col("fcst_anom"))
    # constant in the group, so any row will do; the smallest is the same on every run
    return rows.groupBy("long", "lat").agg(F.min("fcst_mean").alias("fcst_mean"))


@query("weighted_mean", f"""
SELECT lead_time, r6({weighted_mean_sql('obs')}) AS obs, r6({weighted_mean_sql('CAST(obs > fcst AS DOUBLE)')}) AS above
FROM (SELECT *, cos(lat * pi() / 180) AS ww FROM fx_daily) d GROUP BY lead_time
""")
def _(spark, sf_dir):
    w = E.coslat(F.col("lat"))
    return fx.daily(spark, sf_dir).groupBy("lead_time").agg(
        A.weighted_mean(F.col("obs"), w).alias("obs"), A.weighted_mean(F.col("obs") > F.col("fcst"), w).alias("above"))


@query("weighted_sd", """
SELECT lead_time, r6(sqrt(sum(ww * (obs - m) ** 2) / sum(ww))) AS obs_sd
FROM (SELECT *, sum(ww * obs) OVER w / sum(ww) OVER w AS m
  FROM (SELECT *, cos(lat * pi() / 180) AS ww FROM fx_daily) a WINDOW w AS (PARTITION BY lead_time)) d GROUP BY lead_time
""")
def _(spark, sf_dir):
    return fx.daily(spark, sf_dir).groupBy("lead_time").agg(
        A.weighted_sd(F.col("obs"), E.coslat(F.col("lat"))).alias("obs_sd"))


@query("count_rows", "SELECT long, lat, lead_time, count(*) AS n FROM fx_daily GROUP BY long, lat, lead_time")
def _(spark, sf_dir):
    return fx.daily(spark, sf_dir).groupBy(*CELL_LEAD).agg(F.count("*").alias("n"))


@query("global_aggregate", "SELECT r6(avg((obs - fcst) ** 2)) AS mse_raw, count(*) AS n FROM fx_daily")
def _(spark, sf_dir):
    error = F.col("obs") - F.col("fcst")
    return fx.daily(spark, sf_dir).agg(F.avg(error * error).alias("mse_raw"), F.count("*").alias("n"))


@query("parameter_variance", "SELECT lead_time, r6(var_samp(alpha_hat)) AS var_alpha, r6(var_samp(beta_hat)) AS var_beta, "
       "r6(var_samp(tau_hat)) AS var_tau FROM fx_mle GROUP BY lead_time")
def _(spark, sf_dir):
    return smoothing.parameter_variance(estimate.mle(fx.daily(spark, sf_dir), CELL_LEAD), ["lead_time"])


@query("field_range", "SELECT min(long) AS long_min, max(long) AS long_max, min(lat) AS lat_min, max(lat) AS lat_max FROM fx_daily")
def _(spark, sf_dir):
    return fx.daily(spark, sf_dir).agg(*[rule(c).alias(f"{c}_{n}") for c in ("long", "lat") for n, rule in (("min", F.min), ("max", F.max))])


# ---- windows ----


@query("group_anomaly", """
SELECT long, lat, year, lead_time, r6(obs - avg(obs) OVER w) AS obs_anom, r6(fcst - avg(fcst) OVER w) AS fcst_anom
FROM fx_daily WINDOW w AS (PARTITION BY long, lat, lead_time)
""")
def _(spark, sf_dir):
    return joins.anomaly(fx.daily(spark, sf_dir), CELL_LEAD, obs_anom="obs", fcst_anom="fcst").select(
        "long", "lat", "year", "lead_time", "obs_anom", "fcst_anom")


def _left_out(spark, sf_dir):
    daily = fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "obs", "fcst")
    return joins.leave_one_out(daily, CELL_LEAD, {"fcst_anom": "fcst"}, {"ybar": "obs"})


@query("loo_anomaly", """
SELECT a.long, a.lat, a.year, a.lead_time, r6(max(a.fcst) - avg(b.fcst)) AS fcst_anom
FROM fx_daily a LEFT JOIN fx_daily b ON a.long = b.long AND a.lat = b.lat AND a.lead_time = b.lead_time AND a.year <> b.year
GROUP BY a.long, a.lat, a.year, a.lead_time
""")
def _(spark, sf_dir):
    return _left_out(spark, sf_dir).select("long", "lat", "year", "lead_time", "fcst_anom")


@query("loo_climatology", """
SELECT a.long, a.lat, a.year, a.lead_time, r6(avg(b.obs)) AS ybar
FROM fx_daily a LEFT JOIN fx_daily b ON a.long = b.long AND a.lat = b.lat AND a.lead_time = b.lead_time AND a.year <> b.year
GROUP BY a.long, a.lat, a.year, a.lead_time
""")
def _(spark, sf_dir):
    return _left_out(spark, sf_dir).select("long", "lat", "year", "lead_time", "ybar")


@query("dense_rank_index", "SELECT long, CAST(dense_rank() OVER (ORDER BY long) AS INT) AS position FROM (SELECT DISTINCT long FROM fx_ens) l")
def _(spark, sf_dir):
    return reshape.axis_values(fx.daily(spark, sf_dir), "long")


# ---- scalar functions ----

AT = "long, lat, year, lead_time"


def _scalar(name, sql, **columns):
    """Query that adds expressions to the ensemble hindcast's keys."""
    query(name, f"SELECT {AT}, {sql} FROM fx_ens")(
        lambda spark, sf_dir: fx.hindcast(spark, sf_dir).select(
            "long", "lat", "year", "lead_time", *[build().alias(n) for n, build in columns.items()]))


_scalar("year_of_date", "CAST(year(date) AS INT) AS date_year", date_year=lambda: E.year_of(F.col("date")))
_scalar("epoch_to_date", "CAST(make_timestamp((epoch(start_date) + 43200)::BIGINT * 1000000) AS DATE) AS ref_date",
        ref_date=lambda: E.epoch_to_date(F.unix_timestamp(F.col("start_date").cast("timestamp")) + 43200))
_scalar("lead_time_days", "CAST(date - start_date AS INT) AS days", days=lambda: E.lead_time_days(F.col("date"), F.col("start_date")))
_scalar("lead_time_yday", "CAST(dayofyear(date) - dayofyear(start_date) AS INT) AS days",
        days=lambda: E.lead_time_yday(F.col("date"), F.col("start_date")))
_scalar("lead_week", "CAST(ceil(lead_time / 7.0) AS INT) AS week", week=lambda: E.lead_week(F.col("lead_time")))
_scalar("coslat_weight", "r6(cos(lat * pi() / 180)) AS ww", ww=lambda: E.coslat(F.col("lat")))
_scalar("log_exp_sqrt_power", "r6(ln(nullif(members, 0))) AS ln_m, r6(exp(-ens_sd)) AS exp_sd, r6(sqrt(members)) AS sqrt_m, r6(obs ** 2) AS obs_sq",
        ln_m=lambda: F.ln(E.nonzero(F.col("members").cast("double"))), exp_sd=lambda: F.exp(-F.col("ens_sd")),
        sqrt_m=lambda: F.sqrt("members"), obs_sq=lambda: F.pow("obs", F.lit(2.0)))
_scalar("concat_text", "CAST(year AS VARCHAR) || '-' || CAST(month(date) AS VARCHAR) || '-' || CAST(day(date) AS VARCHAR) AS label",
        label=lambda: F.concat_ws("-", "year", F.month("date").cast("string"), F.day("date").cast("string")))
_scalar("split_text", "CAST(year AS VARCHAR) AS item",
        item=lambda: F.element_at(F.split(F.concat(F.lit("    T=  "), F.col("year").cast("string"), F.lit(" sec UTC")), " +"), 3))
_scalar("grep_lines", "CASE WHEN regexp_matches('band' || lead_time, '^band1') THEN 1 ELSE 0 END AS hit",
        hit=lambda: F.when(F.concat(F.lit("band"), F.col("lead_time").cast("string")).rlike("^band1"), 1).otherwise(0))
_scalar("regex_text", "regexp_replace('var_' || lead_time || '_hat', '^var_|_hat$', '', 'g') AS variable",
        variable=lambda: reshape.recode(F.concat(F.lit("var_"), F.col("lead_time").cast("string"), F.lit("_hat")), {"^var_|_hat$": ""}))
_scalar("conditional", "CASE WHEN ens_sd > 8 THEN 'wide' ELSE 'narrow' END AS spread",
        spread=lambda: F.when(F.col("ens_sd") > 8, "wide").otherwise("narrow"))
_scalar("between_inclusive", "lead_time BETWEEN 9 AND 15 AS inside", inside=lambda: F.col("lead_time").between(9, 15))
_scalar("normal_quantile", "r6(ens_mean + -2.5758293035489 * ens_sd) AS low", low=lambda: F.col("ens_mean") + F.lit(E.normal_quantile(0.005)) * F.col("ens_sd"))
_scalar("t_quantile", "r6(ens_mean + 2.0930240544083 * ens_sd) AS high", high=lambda: F.col("ens_mean") + F.lit(E.t_quantile(0.975, 19)) * F.col("ens_sd"))
_scalar("t_log_density", "r6(-0.93209037322372 - 10 * ln(1 + ((obs - ens_mean) / nullif(ens_sd, 0)) ** 2 / 19)) AS log_density",
        log_density=lambda: E.t_log_density((F.col("obs") - F.col("ens_mean")) / E.nonzero(F.col("ens_sd")), 19))


@query("round_columns", f"SELECT {AT}, r6(round_even(obs, 2)) AS obs, r6(round_even(fcst, 2)) AS fcst FROM fx_daily")
def _(spark, sf_dir):
    rows = fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "obs", "fcst")
    return verify.round_columns(rows, 2)


# ---- regression ----


@query("mos_coefficients", """
SELECT long, lat, lead_time, r6(ybar) AS ybar, r6(xbar) AS xbar, r6(sxx) AS sxx, r6(sxy) AS sxy, r6(ybar) AS beta0_hat,
  r6(sxy / nullif(sxx, 0)) AS beta1_hat, r6(sqrt(rss / n)) AS sigma_hat
FROM (SELECT long, lat, lead_time, max(my) AS ybar, max(mx) AS xbar, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy, count(*) AS n,
    sum(dy * dy) - sum(dx * dy) ** 2 / nullif(sum(dx * dx), 0) AS rss
  FROM (SELECT *, avg(obs) OVER w AS my, avg(fcst) OVER w AS mx, obs - avg(obs) OVER w AS dy, fcst - avg(fcst) OVER w AS dx
    FROM fx_daily WINDOW w AS (PARTITION BY long, lat, lead_time)) c GROUP BY long, lat, lead_time) m
WHERE lead_time IN (3, 7, 14, 21, 28)
""")
def _(spark, sf_dir):
    return estimate.mos_coefficients(fx.daily(spark, sf_dir), CELL_LEAD).transform(filters.filter_lead_set([3, 7, 14, 21, 28]))


@query("lm_per_cell", """
SELECT long, lat, r6(alpha_hat) AS alpha_hat, r6(beta_hat) AS beta_hat, r6(exp(tau_hat)) AS sigma_hat, r6(tau_hat) AS tau_hat,
  r6(vzz) AS sxx, n, r6(var_alpha_hat) AS var_alpha_hat, r6(var_beta_hat) AS var_beta_hat, r6(var_tau_hat) AS var_tau_hat FROM fx_mle3w
""")
def _(spark, sf_dir):
    return estimate.lm_per_cell(fx.hindcast_3w(spark, sf_dir))


ESTIMATES_SQL = ("r6(alpha_hat) AS alpha_hat, r6(beta_hat) AS beta_hat, r6(tau_hat) AS tau_hat, n, "
                 "r6(var_alpha_hat) AS var_alpha_hat, r6(var_beta_hat) AS var_beta_hat, r6(var_tau_hat) AS var_tau_hat")


@query("mle_with_variance", f"SELECT long, lat, lead_time, {ESTIMATES_SQL} FROM fx_mle")
def _(spark, sf_dir):
    return estimate.mle(fx.daily(spark, sf_dir), CELL_LEAD)


@query("information_diagonal", " UNION ALL ".join(
    f"SELECT long, lat, '{p}' AS par, r6({w}) AS w FROM fx_mle3w"
    for p, w in (("alpha", "n * exp(-2 * tau_hat)"), ("beta", "n * vzz * exp(-2 * tau_hat)"), ("tau", "2.0::DOUBLE * n"))))
def _(spark, sf_dir):
    return estimate.information_diagonal(estimate.lm_per_cell(fx.hindcast_3w(spark, sf_dir)), ["long", "lat"])


LOO = f"SELECT long, lat, lead_time, fold AS year, {ESTIMATES_SQL} FROM fx_loo"


@query("loo_mle", LOO)
def _(spark, sf_dir):
    return estimate.loo_mle(fx.daily(spark, sf_dir), CELL_LEAD)


@query("loo_mle_fold_join", LOO)
def _(spark, sf_dir):
    return estimate.loo_mle(fx.daily(spark, sf_dir), CELL_LEAD, method="join")
