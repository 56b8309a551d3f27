"""Per-group regression of observation on forecast, in closed form from mergeable moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.aggregates import correlation
from fieldcal.functions.expressions import nonzero
from fieldcal.operators.joins import expand_folds, fold_values

ESTIMATES = ("alpha_hat", "beta_hat", "tau_hat", "n", "var_alpha_hat", "var_beta_hat", "var_tau_hat")


def complete_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Both columns null where either is, so that all moments of a group come from the same rows. Groups keep their rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumns({x: F.when(both, F.col(x)), y: F.when(both, F.col(y))})


def daily_mean(df: DataFrame, keys: Sequence[str], ts_col: str, value_col: str) -> DataFrame:
    """Mean of sub-daily values per key and calendar date."""
    return df.groupBy(*keys, F.to_date(ts_col).alias("date")).agg(F.avg(value_col).alias(value_col))


def ensemble_stats(members: DataFrame, keys: Sequence[str], value: str = "fcst") -> DataFrame:
    """Ensemble mean and sample standard deviation."""
    return members.groupBy(*keys).agg(F.avg(value).alias("ens_mean"), F.stddev_samp(value).alias("ens_sd"))


def mean_by(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def correlation_bias(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    fcst, obs = F.col("fcst"), F.col("obs")
    return df.groupBy(*keys).agg(correlation(fcst, obs).alias("cor"), F.avg(fcst - obs).alias("bias"))


def moments(df: DataFrame, keys: Sequence[str], z: str = "fcst") -> DataFrame:
    """Population moments (vyy, vzz, vyz), the mean observation and the number of rows with both values of each group.

    ``var_pop`` and ``covar_pop`` centre while they merge, so one map-side-combined pass is enough and no row
    has to see its group's mean first.
    """
    return complete_pairs(df, "obs", z).groupBy(*keys).agg(
        F.var_pop("obs").alias("vyy"),
        F.var_pop(z).alias("vzz"),
        F.covar_pop("obs", z).alias("vyz"),
        F.avg("obs").alias("ybar"),
        F.count("obs").alias("n"),
    )


def _residual_variance(vyy: Column, vzz: Column, vyz: Column) -> Column:
    """Mean squared residual (divided by n); null instead of zero or less, so that its log exists."""
    s2 = vyy - vyz * vyz / nonzero(vzz)
    return F.when(s2 > 0, s2)


def _with_estimates(m: DataFrame) -> DataFrame:
    """alpha, beta, tau = ln(sigma) and their asymptotic variances from the moment columns."""
    vzz, n = F.col("vzz"), nonzero(F.col("n"))
    s2 = _residual_variance(F.col("vyy"), vzz, F.col("vyz"))
    return m.withColumns(
        {
            "alpha_hat": F.col("ybar"),
            "beta_hat": F.col("vyz") / nonzero(vzz),
            "tau_hat": F.lit(0.5) * F.ln(s2),
            "var_alpha_hat": s2 / n,
            "var_beta_hat": s2 / nonzero(n * vzz),
            "var_tau_hat": F.lit(1.0) / (F.lit(2.0) * n),
        }
    )


def mle(df: DataFrame, keys: Sequence[str], z: str = "fcst") -> DataFrame:
    """Maximum-likelihood regression per group, with the variances of the three estimates."""
    return _with_estimates(moments(df, keys, z)).select(*keys, *ESTIMATES)


def lm_per_cell(df: DataFrame, keys: Sequence[str] = ("long", "lat"), z: str = "fcst_anom") -> DataFrame:
    """Regression on a forecast anomaly: intercept at z = 0, slope, residual sd, sxx = mean(z^2), n, variances."""
    m = complete_pairs(df, "obs", z).groupBy(*keys).agg(
        F.var_pop("obs").alias("vyy"),
        F.var_pop(z).alias("vzz"),
        F.covar_pop("obs", z).alias("vyz"),
        F.avg("obs").alias("ybar"),
        F.avg(z).alias("zbar"),
        F.avg(F.col(z) * F.col(z)).alias("sxx"),
        F.count("obs").alias("n"),
    )
    return (
        _with_estimates(m)
        .withColumns(
            {
                "alpha_hat": F.col("ybar") - F.col("beta_hat") * F.col("zbar"),
                "sigma_hat": F.exp("tau_hat"),
                "var_beta_hat": F.exp(F.lit(2.0) * F.col("tau_hat")) / nonzero(F.col("n") * F.col("sxx")),
            }
        )
        .select(*keys, "alpha_hat", "beta_hat", "sigma_hat", "tau_hat", "sxx", "n",
                "var_alpha_hat", "var_beta_hat", "var_tau_hat")
    )


def cov_var_slope(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """alpha, slope = sample covariance over sample variance, and tau."""
    m = complete_pairs(df, "obs", "fcst").groupBy(*keys).agg(
        F.avg("obs").alias("alpha_hat"),
        (F.covar_samp("fcst", "obs") / nonzero(F.var_samp("fcst"))).alias("beta_hat"),
        F.var_pop("obs").alias("_vyy"),
        F.var_pop("fcst").alias("_vzz"),
        F.covar_pop("obs", "fcst").alias("_vyz"),
    )
    s2 = _residual_variance(F.col("_vyy"), F.col("_vzz"), F.col("_vyz"))
    return m.select(*keys, "alpha_hat", "beta_hat", (F.lit(0.5) * F.ln(s2)).alias("tau_hat"))


def mos_coefficients(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means, sums of squares and products, intercept at the mean, slope and residual sd."""
    m = complete_pairs(df, "obs", "fcst").groupBy(*keys).agg(
        F.avg("obs").alias("ybar"),
        F.avg("fcst").alias("xbar"),
        F.regr_sxx("obs", "fcst").alias("sxx"),
        F.regr_sxy("obs", "fcst").alias("sxy"),
        F.regr_syy("obs", "fcst").alias("_syy"),
        F.count("obs").alias("_n"),
    )
    rest = F.col("_syy") - F.col("sxy") * F.col("sxy") / nonzero(F.col("sxx"))
    return m.select(
        *keys, "ybar", "xbar", "sxx", "sxy",
        F.col("ybar").alias("beta0_hat"),
        (F.col("sxy") / nonzero(F.col("sxx"))).alias("beta1_hat"),
        F.sqrt(F.greatest(rest, F.lit(0.0)) / nonzero(F.col("_n"))).alias("sigma_hat"),
    )


def information_diagonal(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed information (negative Hessian diagonal) of the three parameters as rows (par, w)."""
    precision = lambda p: F.lit(1.0) / nonzero(F.col(f"var_{p}_hat"))
    return estimates.select(*keys, *[precision(p).alias(p) for p in ("alpha", "beta", "tau")]).unpivot(
        list(keys), ["alpha", "beta", "tau"], "par", "w"
    )


def loo_mle(
    hindcast: DataFrame,
    keys: Sequence[str] = ("long", "lat", "lead_time"),
    fold: str = "year",
    method: str = "downdate",
    folds: Sequence | None = None,
    z: str = "fcst",
) -> DataFrame:
    """``mle`` of every group with each fold left out in turn; the fold is in column ``fold``.

    ``method="downdate"``: rows are reduced to one moment row per (group, fold) on the map side; a group is then at
    most one row per fold, its totals are formed once, and leaving a fold out is a subtraction. The hindcast is shuffled
    once, however many folds there are, and read a second time for the labels of the folds unless ``folds`` names them.
    A group with no complete pair left has no row.
    ``method="join"``: every row is repeated for each fold it trains and aggregated; the direct definition.
    """
    keys = list(keys)
    if method == "join":
        return mle(expand_folds(hindcast, fold, "_fold", folds), [*keys, "_fold"], z).withColumnRenamed("_fold", fold)
    if method != "downdate":
        raise ValueError("method must be downdate or join")

    labels = F.array(*[F.lit(f) for f in folds]) if folds is not None else fold_values(hindcast, fold)
    return loo_from_moments(fold_moments(hindcast, keys, fold, z), keys, fold, labels, folds is not None)


def fold_moments(df: DataFrame, keys: Sequence[str], fold: str = "year", z: str = "fcst") -> DataFrame:
    """One moment row per group and fold: count k, means my and mz, population moments cyy, czz and cyz of the rows with both values.

    The rows of different folds merge into those of their union (``merged_moments``) and can be taken out of it again
    (``loo_from_moments``), so they can be kept in place of the hindcast. A fold without a complete pair has no row.
    """
    return complete_pairs(df, "obs", z).groupBy(*keys, fold).agg(
        F.count("obs").alias("k"),
        F.avg("obs").alias("my"),
        F.avg(z).alias("mz"),
        F.var_pop("obs").alias("cyy"),
        F.var_pop(z).alias("czz"),
        F.covar_pop("obs", z).alias("cyz"),
    ).filter("k > 0")  # a fold without a complete pair takes nothing away


def merged_moments(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moment rows of ``keys`` (as ``fold_moments``) from those of finer groups: folds, or folds and lead times.

    A group holds one row per finer group (a few for each fold, however many rows of the hindcast they stand for), so it is gathered
    and every mean is set against the merged one before it is squared: large means cost no digits, and there is one shuffle.
    """
    mean = lambda c: F.expr(f"sum(k * {c}) / sum(k)").alias(c)
    parts = F.collect_list(F.struct(F.col("k").alias("pk"), *[F.col(c).alias(f"p{c}") for c in ("my", "mz", "cyy", "czz", "cyz")]))
    held = state.groupBy(*keys).agg(F.sum("k").alias("k"), mean("my"), mean("mz"), parts.alias("parts"))
    shifted = {"cyy": "(p.pmy - my) * (p.pmy - my)", "czz": "(p.pmz - mz) * (p.pmz - mz)", "cyz": "(p.pmy - my) * (p.pmz - mz)"}
    return held.selectExpr(*keys, "k", "my", "mz", *[
        f"aggregate(parts, 0.0D, (total, p) -> total + p.pk * (p.p{c} + {shift})) / k AS {c}" for c, shift in shifted.items()])


def mle_from_moments(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``mle`` per group from kept moment rows."""
    merged = merged_moments(state, keys).withColumnsRenamed({"k": "n", "my": "ybar", "cyy": "vyy", "czz": "vzz", "cyz": "vyz"})
    return _with_estimates(merged).select(*keys, *ESTIMATES)


def mos_from_moments(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``mos_coefficients`` per group from kept moment rows."""
    k = F.col("k")
    m = merged_moments(state, keys).withColumns({"sxx": k * F.col("czz"), "sxy": k * F.col("cyz"), "_syy": k * F.col("cyy")})
    rest = F.col("_syy") - F.col("sxy") * F.col("sxy") / nonzero(F.col("sxx"))
    return m.select(
        *keys, F.col("my").alias("ybar"), F.col("mz").alias("xbar"), "sxx", "sxy", F.col("my").alias("beta0_hat"),
        (F.col("sxy") / nonzero(F.col("sxx"))).alias("beta1_hat"), F.sqrt(F.greatest(rest, F.lit(0.0)) / nonzero(k)).alias("sigma_hat"),
    )


def loo_from_moments(
    per_fold: DataFrame, keys: Sequence[str], fold: str = "year", labels: Column | None = None, only_labels: bool = False,
) -> DataFrame:
    """``loo_mle`` by subtraction from moment rows per group and fold. ``labels`` is an array of folds (by default those in the rows);
    with ``only_labels`` other folds train but are not left out."""
    keys = list(keys)
    if labels is None:
        labels = fold_values(per_fold, fold)
    totals = per_fold.groupBy(*keys).agg(
        F.expr("sum(k) AS n_all"),
        F.expr("sum(k * my) / sum(k) AS ybar_all"),
        F.expr("sum(k * mz) / sum(k) AS zbar_all"),
        F.collect_list(F.struct(F.col(fold).alias("label"), "k", "my", "mz", "cyy", "czz", "cyz")).alias("parts"),
    )
    # deviations from the group mean keep the later subtraction well conditioned; an array holds one entry per fold, and a
    # group without rows in a fold still gets that fold: nothing is taken away
    dy, dz = "(p.my - ybar_all)", "(p.mz - zbar_all)"
    present = (
        f"transform(parts, p -> struct(p.label AS {fold}, p.k AS k, p.k * {dy} AS sy, p.k * {dz} AS sz, "
        f"p.k * (p.cyy + {dy} * {dy}) AS tyy, p.k * (p.czz + {dz} * {dz}) AS tzz, p.k * (p.cyz + {dy} * {dz}) AS tyz))"
    )
    absent = (
        f"transform(array_except(labels, parts.label), l -> struct(l AS {fold}, 0L AS k, 0.0D AS sy, 0.0D AS sz, "
        "0.0D AS tyy, 0.0D AS tzz, 0.0D AS tyz))"
    )
    entries = totals.withColumn("labels", labels).withColumn("entries", F.expr(f"concat({present}, {absent})"))
    sums = {c: f"aggregate(entries, 0.0D, (acc, e) -> acc + e.{c})" for c in ("tyy", "tzz", "tyz")}
    rows = entries.selectExpr(*keys, "n_all", "ybar_all", "labels", "entries", *[f"{e} AS all_{c}" for c, e in sums.items()])
    rows = rows.selectExpr(*[c for c in rows.columns if c != "entries"], "inline(entries)")
    if only_labels:
        rows = rows.filter(F.array_contains("labels", F.col(fold)))
    own = {c: F.col(c) for c in ("k", "sy", "sz", "tyy", "tzz", "tyz")}
    rows = rows.withColumn("n", F.col("n_all") - own["k"]).filter("n > 0")
    n, a, b = F.col("n"), -own["sy"] / F.col("n"), -own["sz"] / F.col("n")
    left = rows.withColumns(
        {
            "ybar": F.col("ybar_all") + a,
            "vyy": (F.col("all_tyy") - own["tyy"]) / n - a * a,
            "vzz": (F.col("all_tzz") - own["tzz"]) / n - b * b,
            "vyz": (F.col("all_tyz") - own["tyz"]) / n - a * b,
        }
    )
    return _with_estimates(left).select(*keys, fold, *ESTIMATES)
