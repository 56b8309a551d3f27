"""Predictions from estimated and smoothed parameters: plug-in values and ensembles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.expressions import hash_normal, hash_uniform
from fieldcal.operators.joins import join_unique, leave_one_out
from fieldcal.operators.reshape import PARAMETERS


def predict(cv: DataFrame, z: str = "fcst_anom") -> DataFrame:
    """Plug-in predictions ``yhat`` (estimates) and ``ystar`` (smoothed) with their variances."""
    x, sq = F.col(z), F.col(z) * F.col(z)
    columns = {}
    for out, mean, var in (("yhat", "{}_hat", "var_{}_hat"), ("ystar", "{}_smooth", "{}_smooth_var")):
        p = lambda pattern, name: F.col(pattern.format(name))
        columns[out] = p(mean, "alpha") + p(mean, "beta") * x
        columns[f"{out}_var"] = p(var, "alpha") + p(var, "beta") * sq + F.exp(F.lit(2.0) * p(mean, "tau"))
    return cv.withColumns(columns)


def join_cv_hindcast(hindcast: DataFrame, cv: DataFrame) -> DataFrame:
    """Left-out rows with the parameters fitted without their year. One parameter row per (cell, year, lead time)."""
    return join_unique(hindcast, cv, ["long", "lat", "year", "lead_time"])


def with_normal(groups: DataFrame, mode: Sequence[float], cov: Sequence[Sequence[float]]) -> DataFrame:
    """Give every row of ``groups`` the same normal approximation (columns ``mode`` and ``root``)."""
    root = np.linalg.cholesky(np.asarray(cov, dtype=float))
    numbers = lambda values: F.array(*[F.lit(float(x)) for x in values])
    return groups.withColumns({"mode": numbers(mode), "root": F.array(*[numbers(row) for row in root])})


def modes_table(spark: SparkSession, found: list[dict], keys: DataFrame) -> DataFrame:
    """The result of ``kappa_mode`` (one entry per group) as a table; ``keys`` gives the group columns their types."""
    rows = [
        (*[f[c] for c in keys.columns], f["status"],
         *(([float(x) for x in f["mode"]], np.linalg.cholesky(f["cov"]).tolist()) if f["status"] == "ok" else (None, None))) for f in found
    ]
    schema = T.StructType([*keys.schema.fields, *T.StructType.fromDDL("status string, mode array<double>, root array<array<double>>").fields])
    return spark.createDataFrame(rows, schema)


def sample_log_kappa(normals: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws of the three log precisions for each row, from the normal approximation in ``mode`` and ``root``; none without a mode."""
    keys = [c for c in normals.columns if c not in ("mode", "root", "status")]
    rows = normals.filter("mode is not null").withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumns(
        {f"_z{k}": hash_normal(seed, *[F.col(c) for c in keys], F.col("sample"), F.lit(f"kappa{k}")) for k in range(3)}
    )
    draw = {
        f"lk_{p}": sum((F.col("root")[r][c] * F.col(f"_z{c}") for c in range(r + 1)), F.col("mode")[r])
        for r, p in enumerate(PARAMETERS)
    }
    return rows.select(*keys, "sample", *[c.alias(name) for name, c in draw.items()])


def sample_from_grid(
    points: DataFrame, groups: Sequence[str], values: Sequence[str], n: int, seed: int, log_density: str = "log_post"
) -> DataFrame:
    """``n`` draws for each group from a log density evaluated on a grid, by inverse transform: (groups, sample, values).

    Points in the order of ``values`` carry their cumulative share of the group's mass; a draw is the first point whose share reaches a
    hash uniform. Draws and points are sorted together, so no pairs are formed; a group holds its grid and its draws. The density need
    not be normalised; a point without a finite one has no mass, a group without any such point has no draws.
    """
    group = Window.partitionBy(*groups)
    usable = points.where(f"{log_density} > double('-infinity') and {log_density} < double('infinity')")
    mass = usable.withColumn("_mass", F.exp(F.col(log_density) - F.max(log_density).over(group)))
    upto = F.sum("_mass").over(group.orderBy(*values).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_mass").over(group)
    marks = mass.select(*groups, upto.alias("_at"), F.lit(None).cast("int").alias("sample"), F.struct(*values).alias("_point"))
    names = usable.select(*groups).distinct() if groups else usable.limit(1).select()
    asked = names.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    asked = asked.withColumn("_at", hash_uniform(seed, *[F.col(c) for c in groups], F.col("sample"), F.lit("uniform")))
    both = marks.unionByName(asked.withColumn("_point", F.lit(None)))
    ahead = group.orderBy("_at", F.col("sample").isNull()).rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_point", F.first("_point", ignorenulls=True).over(ahead)).where("sample is not null")
    return found.select(*groups, "sample", *[F.col("_point")[v].alias(v) for v in values])


def sample_mle(fields: DataFrame, keys: Sequence[str], n: int, seed: str | int) -> DataFrame:
    """``n`` normal draws around each estimate: (keys, par, sample, value).

    ``fields`` holds (keys, par, hat, var_hat). ``seed`` is a number or the name of a column (the left-out year).
    """
    source = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    rows = fields.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n))))
    z = hash_normal(source, *[F.col(k) for k in keys], F.col("par"), F.col("sample"))
    return rows.select(*keys, "par", "sample", (F.col("hat") + F.sqrt("var_hat") * z).alias("value"))


def parameters_wide(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameter draws with one column per parameter."""
    return samples.groupBy(*keys, "sample").agg(
        *[F.max(F.when(F.col("par") == p, F.col("value"))).alias(p) for p in PARAMETERS]
    )


def predictive_ensemble(
    samples: DataFrame,
    z: DataFrame,
    keys: Sequence[str],
    seed: str | int,
    out: str = "y_hat",
    legacy_half_tau: bool = False,
    label: str = "",
) -> DataFrame:
    """One predictive draw per parameter draw: alpha + beta z + sigma e, with sigma = exp(tau).

    ``samples`` holds (keys, sample, alpha, beta, tau), ``z`` holds (keys, z, ...). ``legacy_half_tau`` takes
    sigma = exp(tau / 2). ``label`` separates the noise of two methods.
    """
    source = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    noise = hash_normal(source, *[F.col(k) for k in keys], F.lit(f"noise{label}"), F.col("sample"))
    sigma = F.exp(F.col("tau") * F.lit(0.5 if legacy_half_tau else 1.0))
    joined = samples.join(z, list(keys))
    return joined.withColumn(out, F.col("alpha") + F.col("beta") * F.col("z") + sigma * noise).drop("alpha", "beta", "tau")


def left_out_anomaly(hindcast: DataFrame, keys: Sequence[str], fold: str = "year") -> DataFrame:
    """(keys, fold, z, y): the left-out forecast minus the mean of the other rows, with its observation.

    The hindcast holds one row per key and fold.
    """
    loo = leave_one_out(hindcast, keys, {"z": "fcst"}, {}, bounded=True)
    return loo.select(*keys, fold, "z", F.col("obs").alias("y"))


def climatology(hindcast: DataFrame, keys: Sequence[str], out: str = "fcst_clim") -> DataFrame:
    """Per-cell training mean as the forecast."""
    return hindcast.groupBy(*keys).agg(F.avg("obs").alias(out))
