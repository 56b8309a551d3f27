"""Queries for spatial algebra, smoothing, the precision's posterior, ensembles and predictions."""

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from fieldcal.functions import expressions as E
from fieldcal.operators import determinant, estimate, gradients, predict, reshape, smoothing, spatial, verify
from fieldcal.operators.joins import leave_one_out
from fieldcal.plans import fixtures as fx
from fieldcal.plans.registry import query
from fieldcal.plans.sql_views import DRAW_SEED, DRAW_TOLERANCE, DRAWS, KAPPA, PROBES, SAMPLES, STEPS, TOLERANCE, laplacian_sql, normal_sql, uniform_sql
from fieldcal.session import cut_lineage, scratch_path

CELL_LEAD = ["long", "lat", "lead_time"]
FOLD_LEAD = ["year", "lead_time"]


def daily_columns(spark, sf_dir):
    """The daily hindcast, stored once: every step after it reads this small table instead of the raw rows."""
    return cut_lineage(fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", "obs", "fcst"))


def weekly_columns(spark, sf_dir):
    return cut_lineage(fx.hindcast_3w(spark, sf_dir).select("long", "lat", "year", "obs", "fcst", "fcst_anom"))


def grid_of(hindcast):
    return cut_lineage(reshape.grid_index(hindcast))


def mle_fields(spark, sf_dir):
    """Estimates of every lead time on the grid."""
    daily = daily_columns(spark, sf_dir)
    return smoothing.estimates_on_grid(estimate.mle(daily, CELL_LEAD), grid_of(daily), ["lead_time"])


def loo_fields(daily, grid):
    """Leave-one-year-out estimates of every lead time on the grid."""
    return smoothing.estimates_on_grid(estimate.loo_mle(daily, CELL_LEAD), grid, FOLD_LEAD)


def converged(daily, grid):
    """Leave-one-year-out fields smoothed until their residual is small."""
    return gradients.smooth(loo_fields(daily, grid), KAPPA, [*FOLD_LEAD, "par"], TOLERANCE)


_kept = {}


def kept(spark, sf_dir, name, make):
    """A table that several queries start from, stored once a session and folder."""
    where = (spark.sparkContext.applicationId, sf_dir, name)
    if where in _kept:
        try:
            return spark.read.parquet(_kept[where])
        except AnalysisException:  # the owner of the shared folder has cleared it
            pass
    _kept[where] = scratch_path(spark, name)
    make().write.parquet(_kept[where])
    return spark.read.parquet(_kept[where])


def cv_smoothed(spark, sf_dir):
    """Cross-validated parameters on converged smoothing; all scores start from it."""
    def make():
        daily = daily_columns(spark, sf_dir)
        grid = grid_of(daily)
        return smoothing.cv_table(converged(daily, grid), grid, FOLD_LEAD)
    return kept(spark, sf_dir, "cv", make)


def weekly_draws(spark, sf_dir):
    """Posterior draws of the week-3 fields, all solved together."""
    def make():
        weekly = weekly_columns(spark, sf_dir)
        est = smoothing.estimates_on_grid(estimate.mle(weekly, ["long", "lat"], z="fcst_anom"), grid_of(weekly), [])
        return gradients.sample(est, KAPPA, ["par"], DRAWS, DRAW_SEED, DRAW_TOLERANCE)
    return kept(spark, sf_dir, "draws", make)


def weekly_inputs(spark, sf_dir):
    """Week-3 fields, cell moments and hyperprior rates."""
    weekly = weekly_columns(spark, sf_dir)
    grid = grid_of(weekly)
    est = estimate.lm_per_cell(weekly)
    moments = estimate.moments(weekly, ["long", "lat"], "fcst_anom").join(grid.select("long", "lat", "s"), ["long", "lat"])
    return smoothing.estimates_on_grid(est, grid, []), moments.drop("long", "lat"), est


# ---- spatial algebra ----

TRIPLETS = """
SELECT a.s AS r, b.s AS c, CASE WHEN a.s = b.s THEN
    CASE WHEN a.i > 1 THEN 1 ELSE 0 END + CASE WHEN a.i < (SELECT max(i) FROM fx_grid) THEN 1 ELSE 0 END
  + CASE WHEN a.j > 1 THEN 1 ELSE 0 END + CASE WHEN a.j < (SELECT max(j) FROM fx_grid) THEN 1 ELSE 0 END
  ELSE -1 END AS t
FROM fx_grid a JOIN fx_grid b ON abs(a.i - b.i) + abs(a.j - b.j) <= 1
"""


@query("rw2d_structure", f"""
SELECT p.r AS row, q.r AS col, CAST(sum(p.t * q.t) AS DOUBLE) AS value FROM ({TRIPLETS}) p JOIN ({TRIPLETS}) q ON p.c = q.c
GROUP BY p.r, q.r HAVING sum(p.t * q.t) <> 0
""")
def _(spark, sf_dir):
    return spatial.rw2d_structure(reshape.grid_index(daily_columns(spark, sf_dir)))


@query("grid_laplacian", f"SELECT lead_time, CAST(i + 1 AS INT) AS i, CAST(j + 1 AS INT) AS j, r6(v) AS lap FROM ({laplacian_sql('fx_mle', 'alpha_hat', 'lead_time')}) l")
def _(spark, sf_dir):
    alpha = mle_fields(spark, sf_dir).filter("par = 'alpha'")
    return spatial.grid_laplacian(alpha, "value", ["lead_time"]).select("lead_time", "i", "j", "lap")


@query("roughness", " UNION ALL ".join(
    f"SELECT lead_time, '{p}' AS par, r6(sum(v * v)) AS roughness FROM ({laplacian_sql('fx_mle', f'{p}_hat', 'lead_time')}) l GROUP BY lead_time"
    for p in KAPPA))
def _(spark, sf_dir):
    return spatial.roughness(mle_fields(spark, sf_dir), "value", ["lead_time", "par"])


@query("log_likelihood", """
SELECT lead_time, r6(sum(-n * tau_hat - n / 2.0 * exp(-2 * tau_hat)
  * (vyy + beta_hat ** 2 * vzz - 2 * beta_hat * vyz + (alpha_hat - ybar) ** 2))) AS log_lik
FROM fx_mle GROUP BY lead_time
""")
def _(spark, sf_dir):
    daily = daily_columns(spark, sf_dir)
    params = estimate.mle(daily, CELL_LEAD).select(*CELL_LEAD, *[F.col(f"{p}_hat").alias(p) for p in KAPPA])
    return smoothing.log_likelihood(params, estimate.moments(daily, CELL_LEAD), CELL_LEAD, ["lead_time"])


@query("log_prior", "SELECT lead_time, r6(sum(term)) AS log_prior FROM (" + " UNION ALL ".join(
    f"SELECT lead_time, count(*) / 2.0 * ln({k}) - {k} / 2.0 * sum(v * v) AS term "
    f"FROM ({laplacian_sql('fx_mle', f'{p}_hat', 'lead_time')}) l GROUP BY lead_time" for p, k in KAPPA.items())
    + ") t GROUP BY lead_time")
def _(spark, sf_dir):
    return smoothing.log_prior(mle_fields(spark, sf_dir), KAPPA, ["lead_time"])


_Q = "-2.5758293035489"


@query("log_hyperprior", f"""
SELECT v.lead_time, v.par, x.log_kappa,
  r6(-1.0 * (v.var * {_Q}) ** 2 / 2.0 * exp(2.0 * x.log_kappa)) AS half_normal,
  r6(-(-ln(0.01::DOUBLE) * v.var / 0.1) * exp(x.log_kappa)) AS exponential,
  r6(-1.0 / (v.var ** 2 * ({_Q}) ** 2) / 2.0 * exp(x.log_kappa)) AS exploratory
FROM (""" + " UNION ALL ".join(f"SELECT lead_time, '{p}' AS par, var_samp({p}_hat) AS var FROM fx_mle GROUP BY lead_time" for p in KAPPA) + """) v
CROSS JOIN (VALUES (-10.0::DOUBLE), (-8.0), (-6.0), (-4.0), (-2.0), (0.0)) x(log_kappa)
""")
def _(spark, sf_dir):
    variance = smoothing.parameter_variance(estimate.mle(daily_columns(spark, sf_dir), CELL_LEAD), ["lead_time"])
    rows = variance.unpivot(["lead_time"], [f"var_{p}" for p in KAPPA], "name", "var")
    rows = rows.withColumn("log_kappa", F.explode(F.array(*[F.lit(float(k)) for k in range(-10, 1, 2)])))
    kinds = ("half_normal", "exponential", "exploratory")
    return rows.select(
        "lead_time", F.regexp_replace("name", "^var_", "").alias("par"), "log_kappa",
        *[smoothing.log_hyperprior(F.col("log_kappa"), smoothing.hyper_lambda(F.col("var"), k), k).alias(k) for k in kinds])


HALF_NORMAL = " UNION ALL ".join(f"""
SELECT lead_time, '{p}' AS par, log_kappa, -1.0 * (var_samp({p}_hat) * {_Q}) ** 2 / 2.0 * exp(2.0 * log_kappa) AS log_density
FROM fx_mle CROSS JOIN (SELECT CAST(unnest(range(-10, 21)) AS DOUBLE) AS log_kappa) x GROUP BY lead_time, log_kappa""" for p in KAPPA)


@query("sample_kappa_prior", f"""
SELECT lead_time, par, sample, min(log_kappa) AS log_kappa
FROM (SELECT lead_time, par, log_kappa, sum(exp(log_density)) OVER w / sum(exp(log_density)) OVER (PARTITION BY lead_time, par) AS share
  FROM ({HALF_NORMAL}) p WINDOW w AS (PARTITION BY lead_time, par ORDER BY log_kappa)) c
JOIN (SELECT lead_time, par, sample, {uniform_sql('11', 'lead_time', 'par', 'sample', "'uniform'")} AS u
  FROM (SELECT DISTINCT lead_time, par FROM ({HALF_NORMAL}) q) g
  CROSS JOIN (SELECT CAST(unnest(range(1, {DRAWS + 1})) AS INT) AS sample) n) d USING (lead_time, par)
WHERE share >= u GROUP BY lead_time, par, sample
""")
def _(spark, sf_dir):
    """Draws of each log precision from its half-normal hyperprior on an even axis."""
    variance = smoothing.parameter_variance(estimate.mle(daily_columns(spark, sf_dir), CELL_LEAD), ["lead_time"])
    rows = variance.unpivot(["lead_time"], [f"var_{p}" for p in KAPPA], "name", "var")
    rows = rows.withColumn("log_kappa", F.explode(F.array(*[F.lit(float(k)) for k in range(-10, 21)])))
    density = smoothing.log_hyperprior(F.col("log_kappa"), smoothing.hyper_lambda(F.col("var"), "half_normal"), "half_normal")
    points = cut_lineage(rows.select("lead_time", F.regexp_replace("name", "^var_", "").alias("par"), "log_kappa", density.alias("log_density")))
    return predict.sample_from_grid(points, ["lead_time", "par"], ["log_kappa"], DRAWS, 11, "log_density")


# ---- smoothing ----


@query("smooth_fixed_steps", "SELECT fold AS year, lead_time, par, CAST(i + 1 AS INT) AS i, CAST(j + 1 AS INT) AS j, r6(y) AS value, "
       "r6(x) AS smooth FROM fx_s2")
def _(spark, sf_dir):
    daily = daily_columns(spark, sf_dir)
    return spatial.smooth_fixed_steps(loo_fields(daily, grid_of(daily)), KAPPA, FOLD_LEAD, 2).drop("weight")


@query("smooth_fields_cg", "SELECT fold AS year, lead_time, par, i, j, r6(y) AS value, r6(x) AS smooth, residual < 1e-6 AS solved FROM fx_cg")
def _(spark, sf_dir):
    daily = daily_columns(spark, sf_dir)
    return converged(daily, grid_of(daily)).select(*FOLD_LEAD, "par", "i", "j", "value", "smooth", (F.col("residual") < 1e-6).alias("solved"))


@query("lanczos_coefficients", "SELECT f.lead_time AS lead_time, f.par AS par, f.probe AS probe, step, r6(round(alpha, 4)) AS alpha, r6(round(beta, 4)) AS beta FROM fx_lanczos")
def _(spark, sf_dir):
    fields = cut_lineage(gradients.whole_fields(mle_fields(spark, sf_dir), KAPPA, ["lead_time", "par"]))
    rows = determinant.lanczos(fields, ["lead_time", "par"], PROBES, STEPS, 5)
    return rows.withColumns({c: F.round(c, 4) for c in ("alpha", "beta")})


@query("log_determinant")
def _(spark, sf_dir):
    """Of kappa R + D for every lead time and parameter."""
    return determinant.of_estimates(mle_fields(spark, sf_dir), KAPPA, ["lead_time", "par"])


@query("smooth_fields")
def _(spark, sf_dir):
    est = mle_fields(spark, sf_dir)
    kappas = smoothing.kappa_axis(spark, [0.0, 2.0, 4.0])
    return smoothing.smooth_fields(est, kappas, ["lead_time"])


@query("smooth_fields_residual", "SELECT lead_time, par, log_kappa, 0.0::DOUBLE AS residual FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT lead_time, '{p}' AS par FROM fx_mle" for p in KAPPA) + ") g CROSS JOIN (VALUES (0.0::DOUBLE), (3.0)) k(log_kappa)")
def _(spark, sf_dir):
    """Largest entry of (kappa R + D) x - D y, with R applied as two grid Laplacians: zero to six decimals for a right solve."""
    est = cut_lineage(mle_fields(spark, sf_dir))
    keys = ["lead_time", "par", "log_kappa"]
    solved = smoothing.smooth_fields(est, smoothing.kappa_axis(spark, [0.0, 3.0]), ["lead_time"], variance=False)
    rows = solved.join(est.select("lead_time", "par", "s", "value", "weight"), ["lead_time", "par", "s"], "left").na.fill(
        0.0, ["value", "weight"])
    once = spatial.grid_laplacian(rows, "mean", keys, "lap", ["value", "weight"])
    twice = spatial.grid_laplacian(once, "lap", keys, "lap2", ["mean", "value", "weight"])
    rest = F.exp("log_kappa") * F.col("lap2") + F.col("weight") * (F.col("mean") - F.col("value"))
    return twice.groupBy(*keys).agg(F.max(F.abs(rest)).alias("residual"))


@query("kappa_marginal_total", "SELECT lead_time, par, 16::BIGINT AS points, 1.0::DOUBLE AS probability FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT lead_time, '{p}' AS par FROM fx_mle" for p in KAPPA) + ") g")
def _(spark, sf_dir):
    marginal = smoothing.kappa_marginal(mle_fields(spark, sf_dir), ["lead_time"])
    return marginal.groupBy("lead_time", "par").agg(F.count("*").alias("points"), F.sum("probability").alias("probability"))


@query("smooth_fields_integrated")
def _(spark, sf_dir):
    daily = daily_columns(spark, sf_dir)
    return smoothing.smooth_integrated(loo_fields(daily, grid_of(daily)), FOLD_LEAD)


@query("kappa_marginal")
def _(spark, sf_dir):
    return smoothing.kappa_marginal(mle_fields(spark, sf_dir), ["lead_time"])


@query("kappa_log_posterior")
def _(spark, sf_dir):
    est, moments, estimates = weekly_inputs(spark, sf_dir)
    lam = smoothing.lambda_table(estimates, "half_normal")
    return smoothing.kappa_log_posterior(est, moments, smoothing.kappa_axis(spark, [-2.0, 0.0, 2.0]), [], "half_normal", lam)


@query("kappa_grid")
def _(spark, sf_dir):
    est, moments, estimates = weekly_inputs(spark, sf_dir)
    lam = smoothing.lambda_table(estimates, "exploratory")
    return smoothing.kappa_log_posterior(est, moments, smoothing.kappa_axis(spark), [], "exploratory", lam)


@query("sample_kappa_grid")
def _(spark, sf_dir):
    """Draws of the three log precisions from their evaluated joint posterior."""
    est, moments, estimates = weekly_inputs(spark, sf_dir)
    lam = smoothing.lambda_table(estimates, "half_normal")
    points = cut_lineage(smoothing.kappa_log_posterior(est, moments, smoothing.kappa_axis(spark), [], "half_normal", lam))
    return predict.sample_from_grid(points, [], [f"lk_{p}" for p in KAPPA], DRAWS, 11)


def _mode(spark, sf_dir):
    est, moments, estimates = weekly_inputs(spark, sf_dir)
    lam = smoothing.lambda_table(estimates, "half_normal")
    found = smoothing.kappa_mode(est, moments, [], "half_normal", lam)[0]
    return est, found


@query("kappa_mode_laplace")
def _(spark, sf_dir):
    _est, found = _mode(spark, sf_dir)
    numbers = lambda k: [float(found["mode"][k]), *map(float, found["cov"][k])] if found["status"] == "ok" else [None] * 4
    rows = [(p, *numbers(k), found["status"]) for k, p in enumerate(KAPPA)]
    return spark.createDataFrame(rows, "par string, log_kappa double, cov_alpha double, cov_beta double, cov_tau double, status string")


@query("sample_fields")
def _(spark, sf_dir):
    est, found = _mode(spark, sf_dir)
    if found["status"] != "ok":
        raise ValueError(f"no draws without a mode: {found['status']}")
    draws = predict.sample_log_kappa(predict.with_normal(spark.range(1), found["mode"], found["cov"]), 50, 7).drop("id")
    return smoothing.sample_fields(est, draws, [], 7)


@query("sample_fields_cg", "SELECT par, sample, i, j, r6(round(value, 4)) AS value FROM fx_drawn")
def _(spark, sf_dir):
    return weekly_draws(spark, sf_dir).select("par", "sample", "i", "j", F.round("value", 4).alias("value"))


@query("posterior_moments_cg", "SELECT par, i, j, count(value) AS draws, r6(avg(value)) AS mean, r6(var_samp(value)) AS var FROM fx_drawn GROUP BY par, i, j")
def _(spark, sf_dir):
    return gradients.moments_of_draws(weekly_draws(spark, sf_dir), ["par"])


# ---- draws and ensembles ----


@query("hash_normal", f"SELECT long, lat, year, lead_time, r6({normal_sql('year', 'i', 'j', 'lead_time')}) AS z FROM fx_daily")
def _(spark, sf_dir):
    z = E.hash_normal(F.col("year"), F.col("i"), F.col("j"), F.col("lead_time"))
    return fx.daily(spark, sf_dir).select("long", "lat", "year", "lead_time", z.alias("z"))


MODE = (2.0, 5.0, 4.0)
COV = ((0.5, 0.1, 0.0), (0.1, 0.8, 0.2), (0.0, 0.2, 0.6))
_ROOT = np.linalg.cholesky(np.array(COV))


def _draw_sql(row: int) -> str:
    terms = [f"{float(_ROOT[row, c])!r}::DOUBLE * z{c}" for c in range(row + 1)]
    return " + ".join([f"{MODE[row]!r}::DOUBLE", *terms])


@query("sample_log_kappa", "SELECT year, lead_time, sample, " + ", ".join(
    f"r6({_draw_sql(k)}) AS lk_{p}" for k, p in enumerate(KAPPA)) + " FROM (SELECT year, lead_time, sample, " + ", ".join(
    f"{normal_sql('11', 'year', 'lead_time', 'sample', chr(39) + f'kappa{k}' + chr(39))} AS z{k}" for k in range(3))
    + " FROM (SELECT DISTINCT year, lead_time FROM fx_ens) g CROSS JOIN (SELECT CAST(unnest(range(1, 101)) AS INT) AS sample) n) d")
def _(spark, sf_dir):
    groups = fx.daily(spark, sf_dir).select("year", "lead_time").distinct()
    return predict.sample_log_kappa(predict.with_normal(groups, MODE, COV), 100, 11)


def _draws(weekly, shift):
    cv = estimate.loo_mle(weekly, ["j", "i"], z="fcst_anom")
    keys = ["i", "j", "year"]
    fields = reshape.stack_parameters(cv, keys, ["{}_hat", "var_{}_hat"]).withColumn("seed", F.col("year") + shift)
    return predict.sample_mle(fields, keys, SAMPLES, "seed")


@query("sample_mle", "SELECT i, j, fold AS year, par, sample, r6(value) AS value FROM fx_mle_draws_hat")
def _(spark, sf_dir):
    return _draws(cut_lineage(fx.hindcast_3w(spark, sf_dir)), 0)


@query("sample_summary", """
SELECT i, j, fold AS year, par, r6(avg(value)) AS mean, r6(stddev_samp(value)) AS sd, r6(var_samp(value)) AS var
FROM fx_mle_draws_hat GROUP BY i, j, fold, par
""")
def _(spark, sf_dir):
    return verify.sample_summary(_draws(cut_lineage(fx.hindcast_3w(spark, sf_dir)), 0), ["i", "j", "year", "par"])


def ensemble(weekly, method):
    """Predictive draws from estimates; ``star`` repeats ``hat`` with other draws, so both stay checkable."""
    keys = ["i", "j", "year"]
    params = predict.parameters_wide(_draws(weekly, {"hat": 0, "star": 1000}[method]), keys)
    z = predict.left_out_anomaly(weekly, ["i", "j", "long", "lat"])
    return predict.predictive_ensemble(params, z, keys, "year", f"y_{method}", label=method)


ENSEMBLE = "SELECT year, i, j, long, lat, sample, r6(y_hat) AS y_hat, r6(y) AS y FROM fx_ens_hat"


@query("predictive_ensemble", ENSEMBLE)
def _(spark, sf_dir):
    return ensemble(cut_lineage(fx.hindcast_3w(spark, sf_dir)), "hat").select("year", "i", "j", "long", "lat", "sample", "y_hat", "y")


@query("predictive_ensemble_smoothed")
def _(spark, sf_dir):
    """From posterior field draws of each fold at fixed precisions."""
    weekly = weekly_columns(spark, sf_dir)
    grid = grid_of(weekly)
    est = smoothing.estimates_on_grid(estimate.loo_mle(weekly, ["long", "lat"], z="fcst_anom"), grid, ["year"])
    kappas = predict.sample_log_kappa(predict.with_normal(weekly.select("year").distinct(), MODE, COV), SAMPLES, 11)
    params = predict.parameters_wide(smoothing.sample_fields(est, kappas, ["year"], 11), ["year", "s"])
    z = predict.left_out_anomaly(weekly, ["long", "lat"]).join(grid.select("long", "lat", "s"), ["long", "lat"])
    return predict.predictive_ensemble(params, z, ["year", "s"], "year", "y_star", label="star")


# ---- plug-in predictions ----


def predictions(spark, sf_dir):
    """Left-out hindcast rows with parameters, climatology and both predictions."""
    daily = daily_columns(spark, sf_dir)
    # the hindcast was aggregated to one row per cell, lead time and year, so a group is at most one row per year
    left = leave_one_out(daily, CELL_LEAD, {"fcst_anom": "fcst"}, {"ybar": "obs"}, bounded=True).drop("fcst")
    return predict.predict(predict.join_cv_hindcast(left, cv_smoothed(spark, sf_dir)))


@query("point_prediction", "SELECT long, lat, year, lead_time, r6(yhat) AS yhat, r6(ystar) AS ystar FROM fx_pred")
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("long", "lat", "year", "lead_time", "yhat", "ystar")


@query("prediction_variance", "SELECT long, lat, year, lead_time, r6(yhat_var) AS yhat_var, r6(ystar_var) AS ystar_var FROM fx_pred")
def _(spark, sf_dir):
    return predictions(spark, sf_dir).select("long", "lat", "year", "lead_time", "yhat_var", "ystar_var")


@query("climatology_forecast", "SELECT long, lat, lead_time, r6(avg(obs)) AS fcst_clim FROM fx_daily GROUP BY long, lat, lead_time")
def _(spark, sf_dir):
    return predict.climatology(fx.daily(spark, sf_dir), CELL_LEAD)
