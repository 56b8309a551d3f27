"""Queries for verification and for the tables behind the figures."""

from pyspark.sql import functions as F

from fieldcal.operators import estimate, figures, filters, predict, reshape, verify
from fieldcal.plans import fixtures as fx
from fieldcal.plans import workflows
from fieldcal.plans import queries_spatial as chain
from fieldcal.plans.registry import query
from fieldcal.plans.sql_views import weighted_mean_sql, weighted_se_sql
from fieldcal.session import cut_lineage

CELL_LEAD = ["long", "lat", "lead_time"]

# ---- verification of plug-in predictions ----


@query("mse_by_lead", "SELECT lead_time, " + ", ".join(
    f"r6(mse_{m}) AS mse_{m}, r6(mse_{m}_se) AS mse_{m}_se" for m in ("hat", "smooth", "clim")) + " FROM fx_scores")
def _(spark, sf_dir):
    return verify.score_by_lead(chain.predictions(spark, sf_dir))


@query("skill_by_lead", """
SELECT lead_time, r6(round_even(mse_hat, 2)) AS mse_hat, r6(round_even(mse_smooth, 2)) AS mse_smooth,
  r6(round_even(mse_clim, 2)) AS mse_clim, r6(round_even((mse_hat - mse_smooth) / nullif(mse_clim - mse_hat, 0), 2)) AS skill
FROM fx_scores WHERE lead_time BETWEEN 10 AND 14
""")
def _(spark, sf_dir):
    return verify.skill_by_lead(verify.score_by_lead(chain.predictions(spark, sf_dir)))


@query("relative_improvement", "SELECT lead_time, r6((mse_smooth - mse_hat) / nullif(mse_hat - mse_clim, 0)) AS relative_improvement FROM fx_scores")
def _(spark, sf_dir):
    return verify.relative_improvement(verify.score_by_lead(chain.predictions(spark, sf_dir)))


def _band(mean: str, name: str) -> str:
    m, se = weighted_mean_sql(mean), weighted_se_sql(mean)
    return (f"SELECT lead_time, r6({m}) AS {name}, r6({se}) AS {name}_se, r6({m} - 2 * {se}) AS {name}_lower, "
            f"r6({m} + 2 * {se}) AS {name}_upper FROM ")


GAIN = "(obs - yhat) ** 2 - (obs - ystar) ** 2"


@query("mse_difference_by_lead", _band(GAIN, "mse_diff") + "fx_pred GROUP BY lead_time")
def _(spark, sf_dir):
    return verify.mse_difference_by_lead(chain.predictions(spark, sf_dir))


@query("mse_difference_map", f"SELECT lead_time, long, lat, r6({weighted_mean_sql(GAIN)}) AS mse_diff FROM fx_pred GROUP BY lead_time, long, lat")
def _(spark, sf_dir):
    return verify.mse_map(chain.predictions(spark, sf_dir))


def _inside(y: str) -> str:
    q = "2.0930240544083"
    return weighted_mean_sql(f"CAST((obs > {y} - {q} * sqrt({y}_var) AND obs < {y} + {q} * sqrt({y}_var)) AS DOUBLE)")


@query("interval_coverage", f"SELECT lead_time, r6({_inside('yhat')}) AS cov95_hat, r6({_inside('ystar')}) AS cov95_star FROM fx_pred GROUP BY lead_time")
def _(spark, sf_dir):
    return verify.coverage(chain.predictions(spark, sf_dir))


def _t_score(y: str, tau: str) -> str:
    return f"(-{tau} - 0.93209037322372 - 10 * ln(1 + ((obs - {y}) * exp(-{tau})) ** 2 / 19))"


@query("log_score_difference", _band("g", "ign_diff") + f"""
(SELECT lead_time, ww, {_t_score('ystar', 'tau_smooth')} - {_t_score('yhat', 'tau_hat')} AS g FROM fx_pred) p GROUP BY lead_time
""")
def _(spark, sf_dir):
    return verify.log_score(chain.predictions(spark, sf_dir))


# ---- verification of ensembles ----


def _errors(spark, sf_dir):
    keys = ["year", "long", "lat"]
    weekly = cut_lineage(fx.hindcast_3w(spark, sf_dir))
    obs = weekly.select(*keys, "obs")
    return [verify.ensemble_errors(chain.ensemble(weekly, m), obs, f"y_{m}", m, keys) for m in ("hat", "star")]


MSE_CELLS = """
SELECT h.long, h.lat, h.mse_hat, s.mse_star FROM (SELECT long, lat, avg(sqerr_hat) AS mse_hat FROM fx_err_hat GROUP BY long, lat) h
RIGHT JOIN (SELECT long, lat, avg(sqerr_star) AS mse_star FROM fx_err_star GROUP BY long, lat) s ON h.long = s.long AND h.lat = s.lat
"""


@query("ensemble_mse_map", f"SELECT long, lat, r6(mse_hat) AS mse_hat, r6(mse_star) AS mse_star FROM ({MSE_CELLS}) m")
def _(spark, sf_dir):
    return verify.ensemble_mse_map(*_errors(spark, sf_dir))


@query("ensemble_mse_global", f"SELECT r6({weighted_mean_sql('mse_hat')}) AS mse_hat, r6({weighted_mean_sql('mse_star')}) AS mse_star "
       f"FROM (SELECT *, cos(lat / 180 * pi()) AS ww FROM ({MSE_CELLS}) m) w")
def _(spark, sf_dir):
    return verify.ensemble_mse_global(verify.ensemble_mse_map(*_errors(spark, sf_dir)))


@query("fraction_improved", """
SELECT r6(sum(cos(s.lat / 180 * pi()) * CASE WHEN s.sqerr_star < h.sqerr_hat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / sum(cos(s.lat / 180 * pi()))) AS frac_impr
FROM fx_err_hat h RIGHT JOIN fx_err_star s ON h.year = s.year AND h.long = s.long AND h.lat = s.lat
""")
def _(spark, sf_dir):
    return verify.fraction_improved(*_errors(spark, sf_dir))


# ---- scores against the known truth ----

def true_slope():
    return F.lit(0.5) + F.lit(0.05) * F.col("j")


@query("mse_methods_global", """
SELECT r6(avg((p.obs - p.yhat) ** 2)) AS mse_hat, r6(avg((p.obs - p.ystar) ** 2)) AS mse_star,
  r6(avg((p.obs - (p.alpha_hat + (0.5 + 0.05 * p.j) * p.fcst_anom)) ** 2)) AS mse_perf, r6(avg((p.obs - p.ybar) ** 2)) AS mse_clim
FROM fx_pred p
""")
def _(spark, sf_dir):
    cells = fx.daily(spark, sf_dir).select("long", "lat", "j").distinct()
    pred = chain.predictions(spark, sf_dir).join(cells, ["long", "lat"])
    pred = pred.withColumn("yperf", F.col("alpha_hat") + true_slope() * F.col("fcst_anom"))
    return verify.mse_table(pred, "obs", {"hat": "yhat", "star": "ystar", "perf": "yperf", "clim": "ybar"})


@query("parameter_mse", """
SELECT 'likelihood' AS method, 'beta' AS variable, r6(avg((beta_hat - (0.5 + 0.05 * j)) ** 2)) AS mse FROM fx_cv
UNION ALL SELECT 'posterior', 'beta', r6(avg((beta_smooth - (0.5 + 0.05 * j)) ** 2)) FROM fx_cv
""")
def _(spark, sf_dir):
    cells = fx.daily(spark, sf_dir).select("long", "lat", "j").distinct()
    cv = chain.cv_smoothed(spark, sf_dir).join(cells, ["long", "lat"]).select(
        true_slope().alias("true"), F.col("beta_hat").alias("likelihood"), F.col("beta_smooth").alias("posterior"))
    rows = cv.unpivot(["true"], ["likelihood", "posterior"], "method", "estimate").withColumn("variable", F.lit("beta"))
    return verify.parameter_mse(rows)


# ---- tables behind the figures ----


def _step_sql(column: str) -> str:
    lo, hi, k = figures.STEPS[column]
    return (f"CASE WHEN {column} BETWEEN {lo} AND {hi} THEN CAST(least(floor(({column} - {lo}) / {(hi - lo) / k!r}), {k - 1}) AS INT) END "
            f"AS {column}_step")


@query("step_binned_map", f"""
SELECT long, lat, lead_time, r6(cor) AS cor, r6(bias) AS bias, {_step_sql('cor')}, {_step_sql('bias')} FROM (
  SELECT long, lat, lead_time, covar_pop(fcst, obs) / nullif(stddev_pop(fcst) * stddev_pop(obs), 0) AS cor, avg(fcst - obs) AS bias
  FROM fx_daily GROUP BY long, lat, lead_time) c
""")
def _(spark, sf_dir):
    return figures.step_binned_map(estimate.correlation_bias(fx.daily(spark, sf_dir), CELL_LEAD), "cor", "bias")


@query("step_binned_coefficients", f"""
SELECT long, lat, lead_time, {_step_sql('beta0_hat')}, {_step_sql('beta1_hat')}, {_step_sql('sigma_hat')}
FROM (SELECT long, lat, lead_time, alpha_hat AS beta0_hat, beta_hat AS beta1_hat, exp(tau_hat) AS sigma_hat FROM fx_mle) m
""")
def _(spark, sf_dir):
    coefficients = estimate.mos_coefficients(fx.daily(spark, sf_dir), CELL_LEAD)
    steps = figures.step_binned_map(coefficients, "beta0_hat", "beta1_hat", "sigma_hat")
    return steps.select(*CELL_LEAD, "beta0_hat_step", "beta1_hat_step", "sigma_hat_step")


@query("interval_table", """
SELECT long, lat, lead_time, r6(alpha_hat) AS alpha_hat, r6(alpha_hat - 2 * sqrt(var_alpha_hat)) AS lower,
  r6(alpha_hat + 2 * sqrt(var_alpha_hat)) AS upper FROM fx_mle
""")
def _(spark, sf_dir):
    m = estimate.mle(fx.daily(spark, sf_dir), CELL_LEAD).select(*CELL_LEAD, "alpha_hat", "var_alpha_hat")
    return figures.interval_table(m, "alpha_hat", "var_alpha_hat").drop("var_alpha_hat")


@query("method_compare_long", " UNION ALL ".join(
    f"SELECT long, lat, year, lead_time, '{p}' AS par, '{label}' AS type, r6({p}_{kind}) AS value FROM fx_cv"
    for p in reshape.PARAMETERS for kind, label in figures.METHOD_LABELS.items()))
def _(spark, sf_dir):
    return figures.method_compare_long(chain.cv_smoothed(spark, sf_dir), ["long", "lat", "year", "lead_time"])


BOX = (-9.0, 0.0, 42.0, 54.0)


@query("regression_lines", """
SELECT c.long, c.lat, r6(x.xbar) AS xbar, r6(c.alpha_hat - c.beta_hat * x.xbar) AS intercept_hat, r6(c.beta_hat) AS slope_hat,
  r6(c.alpha_smooth - c.beta_smooth * x.xbar) AS intercept_smooth, r6(c.beta_smooth) AS slope_smooth
FROM fx_cv c JOIN (SELECT long, lat, avg(fcst) AS xbar FROM fx_daily WHERE lead_time = 6 GROUP BY long, lat) x
  ON c.long = x.long AND c.lat = x.lat
WHERE c.long BETWEEN -9 AND 0 AND c.lat BETWEEN 42 AND 54 AND c.year = 2000 AND c.lead_time = 6
""")
def _(spark, sf_dir):
    return figures.regression_lines(chain.cv_smoothed(spark, sf_dir), fx.daily(spark, sf_dir), BOX, 2000, 6)


@query("likelihood_vs_posterior_sd", " UNION ALL ".join(
    f"SELECT long, lat, year, lead_time, '{p}' AS variable, r6(sqrt(var_{p}_hat)) AS sd_likelihood, r6(sqrt({p}_smooth_var)) AS sd_posterior FROM fx_cv"
    for p in reshape.PARAMETERS))
def _(spark, sf_dir):
    keys = ["long", "lat", "year", "lead_time"]
    cv = chain.cv_smoothed(spark, sf_dir)
    rows = reshape.stack_parameters(cv, keys, ["var_{}_hat", "{}_smooth_var"]).withColumnsRenamed(
        {"par": "variable", "var_hat": "likelihood", "smooth_var": "posterior"})
    long_rows = rows.unpivot([*keys, "variable"], ["likelihood", "posterior"], "method", "variance")
    return figures.sd_by_method(long_rows, [*keys, "variable"])


# ---- whole workflows ----


@query("ingest_control_hindcast", """
SELECT c.long, c.lat, c.date, CAST(year(c.date) AS INT) AS year, CAST(c.date - c.start_date AS INT) AS lead_time,
  r6(o.t2m) AS obs, r6(c.fcst) AS fcst
FROM fx_control c JOIN (
  SELECT CASE WHEN x > 180 THEN x - 360 ELSE x END AS long, y AS lat, date, avg(t2m) - 273.15 AS t2m
  FROM fx_analysis_raw GROUP BY x, y, date) o
ON c.long = o.long AND c.lat = o.lat AND c.date = o.date
""")
def _(spark, sf_dir):
    return workflows.ingest_control(fx.analysis_raw(spark, sf_dir), fx.wide(spark, sf_dir), fx.band_meta(spark, sf_dir))


@query("week3_hindcast", "SELECT long, lat, year, r6(obs) AS obs, r6(fcst) AS fcst, r6(fcst_anom) AS fcst_anom FROM fx_3w "
       "WHERE long BETWEEN -15 AND 30 AND lat BETWEEN 30 AND 70")
def _(spark, sf_dir):
    return workflows.week3(fx.hindcast_control(spark, sf_dir))


@query("daily_verification_integrated")
def _(spark, sf_dir):
    return workflows.daily_verification(fx.daily(spark, sf_dir)).tables()["mse_by_lead"]


@query("week3_verification")
def _(spark, sf_dir):
    return workflows.week3_verification(workflows.week3(fx.hindcast_control(spark, sf_dir)), samples=40).tables["ensemble_mse_map"]
