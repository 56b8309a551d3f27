"""Scores. Every one is a grouped weighted mean, merged from partial sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.aggregates import weighted_mean, weighted_se
from fieldcal.functions.expressions import coslat, nonzero, t_log_density, t_quantile

# Score name -> prediction column of the daily variant.
METHODS = {"hat": "yhat", "smooth": "ystar", "clim": "ybar"}
AREA = lambda: coslat(F.col("lat"))


def _squared_error(prediction: str) -> Column:
    error = F.col("obs") - F.col(prediction)
    return error * error


def score_by_lead(pred: DataFrame, methods: dict[str, str] = METHODS) -> DataFrame:
    """Area-weighted mean squared error and its standard error for each method and lead time."""
    columns = []
    for name, column in methods.items():
        error = _squared_error(column)
        columns += [weighted_mean(error, AREA()).alias(f"mse_{name}"), weighted_se(error, AREA()).alias(f"mse_{name}_se")]
    return pred.groupBy("lead_time").agg(*columns)


def skill_by_lead(scores: DataFrame, first: int = 10, last: int = 14, digits: int = 2) -> DataFrame:
    """Improvement by smoothing in units of the estimates' improvement over climatology, rounded half to even."""
    kept = scores.filter(F.col("lead_time").between(first, last)).select("lead_time", "mse_hat", "mse_smooth", "mse_clim")
    skill = (F.col("mse_hat") - F.col("mse_smooth")) / nonzero(F.col("mse_clim") - F.col("mse_hat"))
    return round_columns(kept.withColumn("skill", skill), digits)


def round_columns(df: DataFrame, digits: int, half_even: bool = True) -> DataFrame:
    rule = F.bround if half_even else F.round
    return df.withColumns({f.name: rule(f.name, digits) for f in df.schema.fields if f.dataType.typeName() == "double"})


def relative_improvement(scores: DataFrame) -> DataFrame:
    gain = (F.col("mse_smooth") - F.col("mse_hat")) / nonzero(F.col("mse_hat") - F.col("mse_clim"))
    return scores.select("lead_time", gain.alias("relative_improvement"))


def mse_difference_by_lead(pred: DataFrame) -> DataFrame:
    """Squared-error difference (estimates minus smoothed) with its band of two standard errors."""
    gain = _squared_error("yhat") - _squared_error("ystar")
    scores = pred.groupBy("lead_time").agg(
        weighted_mean(gain, AREA()).alias("mse_diff"), weighted_se(gain, AREA()).alias("mse_diff_se")
    )
    return _with_band(scores, "mse_diff")


def _with_band(df: DataFrame, name: str) -> DataFrame:
    width = F.lit(2.0) * F.col(f"{name}_se")
    return df.withColumns({f"{name}_lower": F.col(name) - width, f"{name}_upper": F.col(name) + width})


def mse_map(pred: DataFrame, keys: Sequence[str] = ("lead_time", "long", "lat")) -> DataFrame:
    """Squared-error difference per cell; the weight is constant in a cell, so a plain mean."""
    return pred.groupBy(*keys).agg(F.avg(_squared_error("yhat") - _squared_error("ystar")).alias("mse_diff"))


def coverage(pred: DataFrame, level: float = 0.95, df: float = 19) -> DataFrame:
    """Area-weighted share of observations strictly inside the prediction interval."""
    q = F.lit(t_quantile((1 + level) / 2, df))
    columns = []
    for name, column in (("hat", "yhat"), ("star", "ystar")):
        width = q * F.sqrt(F.col(f"{column}_var"))
        inside = (F.col("obs") > F.col(column) - width) & (F.col("obs") < F.col(column) + width)
        columns.append(weighted_mean(inside, AREA()).alias(f"cov{round(level * 100)}_{name}"))
    return pred.groupBy("lead_time").agg(*columns)


def log_score(pred: DataFrame, df: float = 19) -> DataFrame:
    """Log score of the predictive t distribution, smoothed minus estimates."""
    score = lambda y, tau: -F.col(tau) + t_log_density((F.col("obs") - F.col(y)) * F.exp(-F.col(tau)), df)
    gain = score("ystar", "tau_smooth") - score("yhat", "tau_hat")
    scores = pred.groupBy("lead_time").agg(
        weighted_mean(gain, AREA()).alias("ign_diff"), weighted_se(gain, AREA()).alias("ign_diff_se")
    )
    return _with_band(scores, "ign_diff")


def sample_summary(samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.var_samp(value).alias("var")
    )


def ensemble_errors(forecast: DataFrame, obs: DataFrame, value: str, name: str, keys: Sequence[str]) -> DataFrame:
    """Squared error of the ensemble mean for every observation; an observation without forecast keeps a null error."""
    mean = forecast.groupBy(*keys).agg(F.avg(value).alias(f"{value}_bar"))
    error = F.col(f"{value}_bar") - F.col("obs")
    return mean.join(obs, list(keys), "right").withColumn(f"sqerr_{name}", error * error)


def ensemble_mse_map(hat: DataFrame, star: DataFrame, cell: Sequence[str] = ("long", "lat")) -> DataFrame:
    """Per-cell mean squared errors of both methods side by side."""
    left = hat.groupBy(*cell).agg(F.avg("sqerr_hat").alias("mse_hat"))
    right = star.groupBy(*cell).agg(F.avg("sqerr_star").alias("mse_star"))
    return left.join(right, list(cell), "right")


def ensemble_mse_global(mse: DataFrame) -> DataFrame:
    return mse.agg(*[weighted_mean(F.col(f"mse_{m}"), AREA()).alias(f"mse_{m}") for m in ("hat", "star")])


def fraction_improved(hat: DataFrame, star: DataFrame, keys: Sequence[str] = ("year", "long", "lat")) -> DataFrame:
    """Area-weighted share of forecasts whose error is smaller after smoothing."""
    joined = hat.select(*keys, "sqerr_hat").join(star.select(*keys, "sqerr_star"), list(keys), "right")
    return joined.agg(weighted_mean(F.col("sqerr_star") < F.col("sqerr_hat"), AREA()).alias("frac_impr"))


def mse_table(df: DataFrame, truth: str, methods: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Plain mean squared error of each prediction column against ``truth``."""
    error = lambda c: (F.col(truth) - F.col(c)) * (F.col(truth) - F.col(c))
    return df.groupBy(*keys).agg(*[F.avg(error(c)).alias(f"mse_{m}") for m, c in methods.items()])


def parameter_mse(long_parameters: DataFrame) -> DataFrame:
    """Mean squared error of (estimate, true) rows by method and variable."""
    error = F.col("estimate") - F.col("true")
    return long_parameters.groupBy("method", "variable").agg(F.avg(error * error).alias("mse"))
