"""The three end-to-end jobs: ingest, daily leave-one-year-out verification, week-3 ensemble verification.

Each stage that several later stages read is stored once in the shared folder (``cut_lineage``); everything between two
stores is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.functions import expressions as E
from fieldcal.operators import estimate, filters, joins, predict, reshape, smoothing, spatial, verify
from fieldcal.session import cut_lineage
from fieldcal.sources import tables

CELL = ["long", "lat"]
CELL_LEAD = ["long", "lat", "lead_time"]
FOLD_LEAD = ["year", "lead_time"]


def observations(analysis: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Sub-daily Kelvin fields (x, y, ref_ts, t2m) to daily Celsius observations (long, lat, date, obs).

    ``dates`` (column ``date``) keeps the days some forecast verifies on.
    """
    daily = estimate.daily_mean(analysis, ["x", "y"], "ref_ts", "t2m")
    if dates is not None:
        daily = daily.join(dates.select("date").distinct(), "date", "left_semi")
    return daily.select(
        E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "date", E.kelvin_to_celsius(F.col("t2m")).alias("obs")
    )


def analysis_rows(packed: DataFrame, meta: DataFrame) -> DataFrame:
    """Packed analysis bands, several to a date, to (x, y, date, t2m); ``start_date`` of the metadata is the day of a band."""
    return tables.band_rows(packed, meta.select("band_id", F.col("start_date").alias("date")), "t2m")


def observations_packed(packed: DataFrame, meta: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Packed sub-daily Kelvin bands to daily Celsius observations (long, lat, date, obs).

    With ``dates`` the metadata is reduced first, so bands of other days fall out when they are exploded and are never averaged.
    """
    if dates is not None:
        meta = meta.join(dates.select(F.col("date").alias("start_date")).distinct(), "start_date", "left_semi")
    daily = analysis_rows(packed, meta).groupBy("x", "y", "date").agg(F.avg("t2m").alias("t2m"))
    return daily.select(
        E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "date", E.kelvin_to_celsius(F.col("t2m")).alias("obs"))


def ingest_ensemble_packed(analysis: DataFrame, analysis_meta: DataFrame, ensemble: DataFrame, ensemble_meta: DataFrame) -> DataFrame:
    """Ensemble hindcast from packed bands: (long, lat, date, year, lead_time, obs, ens_mean, ens_sd, members).

    Both metadata tables are as ``parse_band_metadata`` gives them. Members that share cell, start and verifying date are summarised
    before anything is joined.
    """
    members = tables.band_rows(ensemble, ensemble_meta.select("band_id", "start_date", F.col("veri_date").alias("date")), "fcst")
    stats = estimate.ensemble_stats(
        members.select(E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "start_date", "date", "fcst"),
        ["long", "lat", "start_date", "date"])
    obs = cut_lineage(observations_packed(analysis, analysis_meta, ensemble_meta.select(F.col("veri_date").alias("date"))))
    return joins.build_hindcast(obs, stats).drop("start_date").withColumn("year", F.year("date"))


def forecast_rows(wide: DataFrame, meta: DataFrame) -> DataFrame:
    """Wide bands and their metadata to (long, lat, start_date, date, fcst); members of an ensemble are repeated rows."""
    rows = reshape.melt(wide, ["x", "y"], "band", "fcst").filter("fcst is not null")
    dated = rows.join(meta.select("band", "start_date", F.col("veri_date").alias("date")), "band")
    return dated.select(E.wrap_longitude(F.col("x")).alias("long"), F.col("y").alias("lat"), "start_date", "date", "fcst")


def ingest_control(analysis: DataFrame, wide: DataFrame, meta: DataFrame) -> DataFrame:
    """Control hindcast: (long, lat, date, year, lead_time, obs, fcst)."""
    obs = cut_lineage(observations(analysis, meta.select(F.col("veri_date").alias("date"))))
    return joins.build_hindcast(obs, forecast_rows(wide, meta)).drop("start_date").withColumn("year", F.year("date"))


def ingest_ensemble(analysis: DataFrame, wide: DataFrame, meta: DataFrame) -> DataFrame:
    """Ensemble hindcast: members are summarised before anything is joined, so the join sees one row per field and cell."""
    obs = cut_lineage(observations(analysis, meta.select(F.col("veri_date").alias("date"))))
    stats = estimate.ensemble_stats(forecast_rows(wide, meta), ["long", "lat", "start_date", "date"])
    return joins.build_hindcast(obs, stats).drop("start_date").withColumn("year", F.year("date"))


def week3(control: DataFrame, region: str | Sequence[float] = "europe_3w", week: int = 3) -> DataFrame:
    """Weekly means of one lead week per cell and year, with the forecast anomaly."""
    rows = control.transform(filters.filter_region(region)).transform(filters.filter_lead_week(week))
    # aggregated to one row per cell and year, so an anomaly window is at most one row per year
    return joins.anomaly(estimate.mean_by(rows, [*CELL, "year"], "obs", "fcst"), CELL, bounded=True, fcst_anom="fcst")


@dataclass
class DailyVerification:
    cv: DataFrame
    predictions: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        scores = verify.score_by_lead(self.predictions)
        return {
            "mse_by_lead": scores,
            "skill_by_lead": verify.skill_by_lead(scores),
            "relative_improvement": verify.relative_improvement(scores),
            "mse_difference_by_lead": verify.mse_difference_by_lead(self.predictions),
            "mse_difference_map": verify.mse_map(self.predictions),
            "interval_coverage": verify.coverage(self.predictions),
            "log_score_difference": verify.log_score(self.predictions),
        }


def daily_verification(
    hindcast: DataFrame, smoother: str = "integrated", kappa: dict[str, float] | None = None, steps: int = 2, **options
) -> DailyVerification:
    """Leave-one-year-out estimates, smoothing and predictions for every year and lead time at once.

    ``hindcast`` holds (long, lat, year, lead_time, obs, fcst). ``smoother``: ``integrated`` (precision integrated out;
    ``options`` go to ``smooth_integrated``) or ``fixed_steps`` with ``kappa`` and ``steps``.
    """
    hindcast = cut_lineage(hindcast.select("long", "lat", "year", "lead_time", "obs", "fcst"))
    grid = cut_lineage(reshape.grid_index(hindcast))
    est = smoothing.estimates_on_grid(estimate.loo_mle(hindcast, CELL_LEAD), grid, FOLD_LEAD)
    if smoother == "integrated":
        fields = smoothing.smooth_integrated(est, FOLD_LEAD, **options)
    elif smoother == "fixed_steps":
        fields = spatial.smooth_fixed_steps(est, kappa, FOLD_LEAD, steps, **options)
    else:
        raise ValueError(f"unknown smoother {smoother}")
    cv = cut_lineage(smoothing.cv_table(fields, grid, FOLD_LEAD))
    left = joins.leave_one_out(hindcast, CELL_LEAD, {"fcst_anom": "fcst"}, {"ybar": "obs"}).drop("fcst")
    return DailyVerification(cv, predict.predict(predict.join_cv_hindcast(left, cv)))


@dataclass
class Week3Verification:
    forecasts: DataFrame
    grid: DataFrame
    modes: DataFrame
    tables: dict[str, DataFrame]


def week3_verification(
    weekly: DataFrame, samples: int = 500, seed: int = 1, hyperprior: str = "half_normal", legacy_half_tau: bool = False, **options
) -> Week3Verification:
    """Per left-out year: estimates, posterior of the precisions, field draws, both predictive ensembles and their scores.

    ``weekly`` holds (long, lat, year, obs, fcst, fcst_anom), one row per cell and year. All years run in the same jobs.
    """
    weekly = cut_lineage(weekly.select(*CELL, "year", "obs", "fcst", "fcst_anom"))
    grid = cut_lineage(reshape.grid_index(weekly))
    placed = cut_lineage(weekly.join(grid.select(*CELL, "s"), CELL))

    estimates = cut_lineage(estimate.loo_mle(weekly, CELL, z="fcst_anom"))
    est = cut_lineage(smoothing.estimates_on_grid(estimates, grid, ["year"]))
    # moments of each training set, from the same expansion the folds are defined by
    train = joins.expand_folds(placed, "year", "fold").drop("year").withColumnRenamed("fold", "year")
    moments = estimate.moments(train, ["year", "s"], "fcst_anom")
    lam = smoothing.lambda_table(estimates, hyperprior, ["year"])
    found = smoothing.kappa_mode(est, moments, ["year"], hyperprior, lam, **options)
    modes = predict.modes_table(weekly.sparkSession, found, weekly.select("year"))

    keys = ["year", "s"]
    z = cut_lineage(predict.left_out_anomaly(placed, ["s", *CELL]))
    star = predict.parameters_wide(
        smoothing.sample_fields(est, predict.sample_log_kappa(modes, samples, seed), ["year"], seed), keys)
    hat = predict.parameters_wide(
        predict.sample_mle(est.withColumn("var_hat", F.lit(1.0) / F.col("weight")).withColumnRenamed("value", "hat"),
                           keys, samples, "year"), keys)
    y_star = predict.predictive_ensemble(star, z, keys, "year", "y_star", legacy_half_tau, "star")
    y_hat = predict.predictive_ensemble(hat, z.select(*keys, "z"), keys, "year", "y_hat", legacy_half_tau, "hat").drop("z")
    forecasts = cut_lineage(y_star.join(y_hat, [*keys, "sample"]))

    at = ["year", *CELL]
    obs = weekly.select(*at, "obs")
    errors = {m: cut_lineage(verify.ensemble_errors(forecasts, obs, f"y_{m}", m, at)) for m in ("hat", "star")}
    mse = verify.ensemble_mse_map(errors["hat"], errors["star"])
    tables = {
        "ensemble_mse_map": mse,
        "ensemble_mse_global": verify.ensemble_mse_global(mse),
        "fraction_improved": verify.fraction_improved(errors["hat"], errors["star"]),
    }
    return Week3Verification(forecasts, grid, modes, tables)
