"""Spatial smoothing of the parameter fields and the posterior of its precision (kappa).

The information matrix is diagonal and the prior is block diagonal in (alpha, beta, tau), so given kappa every (group, par)
field is its own linear system. Spark distributes the fields; one field is one grid and fits a task.

``est`` tables hold (groups..., par, i, j, s, n_i, n_j, value, weight), see ``estimates_on_grid``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.block_solver import solve
from fieldcal.functions.expressions import normal_quantile, nonzero
from fieldcal.operators.joins import fits_broadcast
from fieldcal.operators.reshape import PARAMETERS, stack_parameters
from fieldcal.operators.spatial import roughness, with_grid
from fieldcal.session import cut_lineage

# The log-precision axis used for the exploratory grid, and to find the mode before integration.
LOG_KAPPA_AXIS = tuple(range(-10, 21, 2))
# Points of the axis of integration, and the fall of the log posterior from the mode to its ends: 4 standard deviations of a normal density.
AXIS_POINTS, AXIS_FALL = 16, 8.0
FIELD_COLUMNS = ["par", "i", "j", "n_i", "n_j", "value", "weight"]


def estimates_on_grid(estimates: DataFrame, grid: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Wide estimates to field rows; the weight is the observed information, one over the variance."""
    rows = stack_parameters(estimates, [*groups, "long", "lat"], ["{}_hat", "var_{}_hat"])
    placed = with_grid(rows, grid)
    return placed.select(
        *groups, "par", "long", "lat", "i", "j", "s", "n_i", "n_j",
        F.col("hat").alias("value"), (F.lit(1.0) / nonzero(F.col("var_hat"))).alias("weight"),
    )


# ---- log likelihood, prior and hyperprior ----


def log_likelihood(
    params: DataFrame, moments: DataFrame, keys: Sequence[str], groups: Sequence[str] = (), n: str = "n"
) -> DataFrame:
    """Gaussian log likelihood of (alpha, beta, tau) fields from the cell moments, one row per group."""
    alpha, beta, tau = F.col("alpha"), F.col("beta"), F.col("tau")
    offset = alpha - F.col("ybar")
    square = F.col("vyy") + beta * beta * F.col("vzz") - F.lit(2.0) * beta * F.col("vyz") + offset * offset
    cells = params.join(moments, list(keys))
    term = -F.col(n) * tau - F.col(n) / F.lit(2.0) * F.exp(F.lit(-2.0) * tau) * square
    return cells.groupBy(*groups).agg(F.sum(term).alias("log_lik"))


def log_prior(fields: DataFrame, kappa: dict[str, float], groups: Sequence[str] = ()) -> DataFrame:
    """Log density of (par, i, j, value) fields under the random-walk prior.

    The rank is taken as the number of cells although constants are free; this shifts the posterior only slightly.
    """
    rough = roughness(fields, "value", [*groups, "par"])
    sizes = fields.groupBy(*groups, "par").agg(F.count("*").alias("cells"))
    by_par = F.create_map(*[F.lit(x) for pair in kappa.items() for x in pair])
    rows = rough.join(sizes, [*groups, "par"]).withColumn("k", by_par[F.col("par")].cast("double"))
    term = F.col("cells") / F.lit(2.0) * F.ln("k") - F.col("k") * F.col("roughness") / F.lit(2.0)
    return rows.groupBy(*groups).agg(F.sum(term).alias("log_prior"))


def parameter_variance(estimates: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Sample variance over all cells of each estimate."""
    return estimates.groupBy(*groups).agg(*[F.var_samp(f"{p}_hat").alias(f"var_{p}") for p in PARAMETERS])


def hyper_lambda(variance: Column, kind: str) -> Column:
    """Rate of the hyperprior from the variance of the estimates.

    Chosen so that a precision beyond that of the estimates has little prior probability.
    """
    q = F.lit(normal_quantile(0.005))
    if kind == "half_normal":
        return F.pow(variance * q, F.lit(2.0))
    if kind == "exploratory":
        return F.lit(1.0) / nonzero(variance * variance * q * q)
    if kind == "exponential":
        return F.lit(-math.log(0.01)) * variance / F.lit(0.1)
    raise ValueError(f"unknown hyperprior {kind}")


def log_hyperprior(log_kappa: Column, lam: Column, kind: str) -> Column:
    """Log prior of one log precision, up to a constant."""
    if kind == "half_normal":
        return -lam / F.lit(2.0) * F.exp(F.lit(2.0) * log_kappa)
    if kind == "exploratory":
        return -lam / F.lit(2.0) * F.exp(log_kappa)
    if kind == "exponential":
        return -lam * F.exp(log_kappa)
    raise ValueError(f"unknown hyperprior {kind}")


# ---- solves for given kappa ----


def _field(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(n_j, n_i) arrays of value and weight; a missing or unusable cell gets weight 0."""
    shape = int(rows["n_j"].iloc[0]), int(rows["n_i"].iloc[0])
    value, weight = np.zeros(shape), np.zeros(shape)
    at = rows["j"].to_numpy() - 1, rows["i"].to_numpy() - 1
    v, w = rows["value"].to_numpy(dtype=float), rows["weight"].to_numpy(dtype=float)
    usable = np.isfinite(v) & np.isfinite(w) & (w > 0)
    value[at], weight[at] = np.where(usable, v, 0.0), np.where(usable, w, 0.0)
    return value, weight


def _cells(shape: tuple[int, int]) -> dict[str, np.ndarray]:
    j, i = np.divmod(np.arange(shape[0] * shape[1], dtype=np.int32), np.int32(shape[1]))
    return {"i": i + 1, "j": j + 1, "s": j * np.int32(shape[1]) + i + 1}


def _schema(df: DataFrame, kept: Sequence[str], added: str) -> T.StructType:
    head = T.StructType([df.schema[c] for c in kept])
    return T.StructType(head.fields + T.StructType.fromDDL(added).fields)


def _by_field(rows: DataFrame, keys: Sequence[str]) -> GroupedData:
    """Group rows by field, over a fixed number of tasks.

    Fields are few bytes and much work: left alone, adaptive execution would merge them into one task by their size. A
    partition number given here is kept, and the grouping reuses the partitioning.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys).groupBy(*keys)


def _with_kappas(est: DataFrame, kappas: DataFrame, per_task: int) -> DataFrame:
    """Field rows with arrays of the kappas to solve for; each array holds at most ``per_task``."""
    on = [c for c in kappas.columns if c not in ("kappa_id", "log_kappa")]
    pairs = F.sort_array(F.collect_list(F.struct("kappa_id", "log_kappa")))
    chunks = kappas.withColumn("_chunk", F.floor(F.col("kappa_id") / per_task)).groupBy(*on, "_chunk").agg(pairs.alias("_k"))
    chunks = chunks.select(*on, "_chunk", F.col("_k.kappa_id").alias("_ids"), F.col("_k.log_kappa").alias("_logs"))
    # joined on few keys, so a shuffle would put the fields into few tasks; the table is small unless groups have many draws
    return est.join(F.broadcast(chunks) if fits_broadcast(kappas) else chunks, on)


def kappa_axis(spark: SparkSession, axis: Sequence[float] = LOG_KAPPA_AXIS) -> DataFrame:
    """(par, kappa_id, log_kappa) with the same axis for every parameter."""
    points = F.posexplode(F.array(*[F.lit(float(x)) for x in axis])).alias("kappa_id", "log_kappa")
    return spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in PARAMETERS])).alias("par")).select("par", points)


def smooth_fields(
    est: DataFrame, kappas: DataFrame, groups: Sequence[str], variance: bool = True, per_task: int = 8
) -> DataFrame:
    """Posterior mean and variance of every field for every kappa.

    ``kappas`` holds (par, kappa_id, log_kappa) and may hold some of ``groups``. Result: (groups, par, kappa_id, log_kappa,
    i, j, s, mean, var) and, repeated on each row of a field, log_det, roughness and misfit. Missing cells are filled in.
    """
    groups = list(groups)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value, weight = _field(rows)
        ids, logs = np.asarray(rows["_ids"].iloc[0]), np.asarray(rows["_logs"].iloc[0], dtype=float)
        found = solve(value, weight, np.exp(logs), variance=variance)
        parts = []
        for k in range(len(ids)):
            part = pd.DataFrame(_cells(value.shape))
            part["kappa_id"], part["log_kappa"] = ids[k], logs[k]
            part["mean"] = found["mean"][k].ravel()
            part["var"] = found["var"][k].ravel() if variance else np.nan
            for name in ("log_det", "roughness", "misfit"):
                part[name] = found[name][k]
            parts.append(part)
        out = pd.concat(parts, ignore_index=True)
        for c in [*groups, "par"]:
            out[c] = rows[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    schema = _schema(
        est, [*groups, "par"],
        "kappa_id int, log_kappa double, i int, j int, s int, mean double, var double, "
        "log_det double, roughness double, misfit double",
    )
    rows = _with_kappas(est.select(*groups, *FIELD_COLUMNS), kappas, per_task)
    out = _by_field(rows, [*groups, "par", "_chunk"]).applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in
                            ("mean", "var", "log_det", "roughness", "misfit")})


Prior = Callable[[np.ndarray], np.ndarray]


def log_gamma_prior(shape: float = 1.0, rate: float = 5e-5) -> Prior:
    """Gamma prior on the precision, as a density of its log."""
    return lambda log_kappa: shape * log_kappa - rate * np.exp(log_kappa)


def _log_posterior(found: dict, logs: np.ndarray, cells: int, prior: Prior) -> np.ndarray:
    """Unnormalised log posterior of each axis point: Gaussian marginal of the estimates times the prior.

    R leaves constants free, so its rank is one less than the number of cells. A failed point has no mass.
    """
    log_post = (
        (cells - 1) / 2 * logs
        - (found["misfit"] + np.exp(logs) * found["roughness"]) / 2
        - found["log_det"] / 2
        + prior(logs)
    )
    return np.where(np.isfinite(log_post), log_post, -np.inf)


def _normalised(log_post: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that sum to 1, and the log of the mass they were divided by."""
    top = log_post.max()
    if not np.isfinite(top):
        return np.zeros_like(log_post), -np.inf
    mass = np.exp(log_post - top)
    return mass / mass.sum(), float(top + np.log(mass.sum()))


def integration_axis(value: np.ndarray, weight: np.ndarray, prior: Prior) -> np.ndarray:
    """Even log-kappa axis of one field around the mode of its posterior, to where that has fallen by ``AXIS_FALL`` on each side.

    The mode is looked for on the coarse axis, then on finer ones around the best point so far, then by a parabola. A skew posterior gets
    a longer side. The coarse axis comes back if no point of it is finite.
    """
    def at(*points: float) -> np.ndarray:
        logs = np.array(points)
        return _log_posterior(solve(value, weight, np.exp(logs), variance=False), logs, value.size, prior)

    points = np.asarray(LOG_KAPPA_AXIS, dtype=float)
    found = at(*points)
    if not np.isfinite(found.max()):
        return points
    mode, top = points[found.argmax()], found.max()
    for step in (0.5, 0.125):
        around = mode + step * np.array([-3, -2, -1, 1, 2, 3])
        points, found = np.insert(around, 3, mode), np.insert(at(*around), 3, top)
        mode, top = points[found.argmax()], found.max()
    best = int(found.argmax())
    if 0 < best < len(points) - 1 and np.isfinite(found[best - 1 : best + 2]).all():
        left, _, right = found[best - 1 : best + 2]
        bend = left - 2 * top + right
        if bend < 0:
            mode, top = mode + step * (left - right) / (2 * bend), top - (left - right) ** 2 / (8 * bend)
    ends = []
    for side in (-1, 1):
        near, far = 0.0, 0.125
        while not (low := bool(at(mode + side * far)[0] < top - AXIS_FALL)) and far < 32:
            near, far = far, 2 * far
        for _ in range(3 if low else 0):
            middle = (near + far) / 2
            near, far = (near, middle) if at(mode + side * middle)[0] < top - AXIS_FALL else (middle, far)
        ends.append(mode + side * far)
    return np.linspace(*ends, AXIS_POINTS)


def integration_axes(fields: DataFrame, groups: Sequence[str], prior: Prior) -> DataFrame:
    """(groups, par, _axis): the axis of every field, found once and stored."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*groups, "par"]].iloc[:1].copy()
        out["_axis"] = [integration_axis(*_field(rows), prior).tolist()]
        return out

    schema = _schema(fields, [*groups, "par"], "_axis array<double>")
    return cut_lineage(_by_field(fields, [*groups, "par"]).applyInPandas(run, schema))


def smooth_integrated(
    est: DataFrame,
    groups: Sequence[str],
    log_kappas: Sequence[float] | None = None,
    prior: Prior | None = None,
    per_task: int | None = None,
) -> DataFrame:
    """Posterior mean and variance with the precision integrated out over an even log-kappa axis, by default that of ``integration_axis``.

    The axis points of a field are solved and mixed in one task, so what leaves it is one row per cell instead of one per
    cell and kappa. With few large fields, ``per_task`` cuts the axis into slices of that many points that run in
    parallel; each slice sends its mixture with its total mass, and the mixtures are merged by mass. The axis of a sliced field is found
    once, in a pass of its own, and stored.
    A field without a positive weight, or without a finite point on the axis, has null in ``smooth`` and ``smooth_var``.
    """
    groups, prior = list(groups), prior or log_gamma_prior()
    given = None if log_kappas is None else np.asarray(log_kappas, dtype=float)
    length = AXIS_POINTS if given is None else len(given)
    per_task = per_task or length
    starts = list(range(0, length, per_task))
    sliced = len(starts) > 1
    fields = est.select(*groups, *FIELD_COLUMNS)
    if sliced and given is None:
        fields = fields.join(integration_axes(fields, groups, prior), [*groups, "par"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value, weight = _field(rows)
        start = starts[int(rows["_slice"].iloc[0])]
        if given is not None:
            points = given
        elif sliced:
            points = np.asarray(rows["_axis"].iloc[0], dtype=float)
        else:
            points = integration_axis(value, weight, prior)
        points = points[start : start + per_task]
        found = solve(value, weight, np.exp(points))
        log_post = _log_posterior(found, points, value.size, prior)
        # round-off can let the factorisation of a field without weights through
        share, log_mass = _normalised(log_post if (weight > 0).any() else np.full_like(log_post, -np.inf))
        used = share > 0
        shares = share[used][:, None, None]
        mean = (shares * found["mean"][used]).sum(axis=0)
        variance = (shares * (found["var"][used] + (found["mean"][used] - mean) ** 2)).sum(axis=0)
        known = weight.ravel() > 0
        out = pd.DataFrame(_cells(value.shape))
        out["value"], out["weight"] = np.where(known, value.ravel(), np.nan), np.where(known, weight.ravel(), np.nan)
        if not used.any():
            mean = variance = np.full(value.shape, np.nan)
        out["smooth"], out["smooth_var"], out["log_mass"] = mean.ravel(), variance.ravel(), log_mass
        for c in [*groups, "par"]:
            out[c] = rows[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    schema = _schema(
        est, [*groups, "par"],
        "i int, j int, s int, value double, weight double, smooth double, smooth_var double, log_mass double",
    )
    rows = fields.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(len(starts) - 1))))
    out = _by_field(rows, [*groups, "par", "_slice"]).applyInPandas(run, schema)
    out = out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("value", "weight", "smooth", "smooth_var")})
    if not sliced:
        return out.drop("log_mass")
    # merge: a cell has one row per slice, so its array is as short as the axis
    parts = out.groupBy(*groups, "par", "i", "j", "s").agg(
        F.max("value").alias("value"), F.max("weight").alias("weight"), F.max("log_mass").alias("_top"),
        F.collect_list(F.struct("log_mass", "smooth", "smooth_var")).alias("_parts"),
    )
    # a slice without mass adds nothing
    share = "CASE WHEN p.smooth IS NULL THEN 0.0D ELSE exp(p.log_mass - _top) END"
    total = lambda e: f"aggregate(_parts, 0.0D, (acc, p) -> acc + {share} * coalesce({e}, 0.0D))"
    mass = f"nullif({total('1.0D')}, 0.0D)"
    mixed = parts.withColumn("smooth", F.expr(f"{total('p.smooth')} / {mass}"))
    spread = F.expr(f"{total('p.smooth_var + (p.smooth - smooth) * (p.smooth - smooth)')} / {mass}")
    return mixed.withColumn("smooth_var", spread).drop("_parts", "_top")


def kappa_marginal(
    est: DataFrame,
    groups: Sequence[str],
    log_kappas: Sequence[float] | None = None,
    prior: Prior | None = None,
) -> DataFrame:
    """Posterior of each precision on the axis (by default that of ``integration_axis``): the weight of the point, and the density in kappa (trapezoid rule); both are null
    for a field without a positive weight or without a finite point."""
    groups, prior = list(groups), prior or log_gamma_prior()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value, weight = _field(rows)
        logs = integration_axis(value, weight, prior) if log_kappas is None else np.asarray(log_kappas, dtype=float)
        found = solve(value, weight, np.exp(logs), variance=False)
        share, _ = _normalised(_log_posterior(found, logs, value.size, prior))
        if not share.any() or not (weight > 0).any():
            share = np.full_like(share, np.nan)
        kappa = np.exp(logs)
        density = share / kappa
        out = pd.DataFrame({"log_kappa": logs, "kappa": kappa, "probability": share,
                            "density": density / np.trapezoid(density, kappa)})
        for c in [*groups, "par"]:
            out[c] = rows[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    schema = _schema(est, [*groups, "par"], "log_kappa double, kappa double, probability double, density double")
    out = _by_field(est.select(*groups, *FIELD_COLUMNS), [*groups, "par"]).applyInPandas(run, schema)
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("probability", "density")})


def cv_table(smoothed: DataFrame, grid: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Smoothed field rows (value, weight, smooth[, smooth_var]) to one row per cell with estimates and smoothed values.

    The estimates travel with the fields, so nothing is joined back but the coordinates.
    """
    variance = "1 / nullif(weight, 0.0D)"
    # the fixed-step smoother has no variance of its own
    smooth_variance = "smooth_var" if "smooth_var" in smoothed.columns else variance
    columns = []
    for p in PARAMETERS:
        sources = {f"{p}_hat": "value", f"var_{p}_hat": variance, f"{p}_smooth": "smooth", f"{p}_smooth_var": smooth_variance}
        columns += [F.expr(f"max(CASE WHEN par = '{p}' THEN {c} END) AS {name}") for name, c in sources.items()]
    wide = smoothed.groupBy(*groups, "i", "j").agg(*columns)
    return wide.join(grid.select("i", "j", "long", "lat"), ["i", "j"]).drop("i", "j")


# ---- posterior of kappa ----


def kappa_log_posterior(
    est: DataFrame,
    moments: DataFrame,
    kappas: DataFrame,
    groups: Sequence[str] = (),
    hyperprior: str | None = "half_normal",
    lam: DataFrame | None = None,
) -> DataFrame:
    """Log posterior of (kappa_alpha, kappa_beta, kappa_tau) on all combinations of the given axis points.

    ``moments`` holds (groups, s, vyy, vzz, vyz, ybar, n); ``lam`` holds (groups, lambda_alpha, lambda_beta, lambda_tau).
    One solve per axis point and parameter serves every combination. The likelihood of a cell splits into a term in
    (tau, alpha) and one in (tau, beta), so a cell contributes two K x K tables, not K^3 points, and the tables are
    summed over cells before any combination is formed. A point that cannot be solved is null.
    """
    groups = list(groups)
    fields = cut_lineage(smooth_fields(est, kappas, groups, variance=False))

    # K entries per parameter and cell
    solved = [F.expr(f"collect_list(CASE WHEN par = '{p}' THEN struct('{p}' AS kind, kappa_id, mean) END) AS {p}") for p in PARAMETERS]
    cells = fields.groupBy(*groups, "s").agg(*solved).join(moments, [*groups, "s"])
    cells = cells.selectExpr("*", "inline(tau) AS (_kind, tau_id, tau_mean)").selectExpr(
        *groups, "n", "vyy", "vzz", "vyz", "ybar", "tau_id", "n / 2 * exp(-2 * tau_mean) AS half",
        "inline(concat(array(struct('tau' AS kind, tau_id AS kappa_id, tau_mean AS mean)), alpha, beta))",
    )
    term = (
        "CASE kind WHEN 'tau' THEN -n * mean - half * vyy WHEN 'alpha' THEN -half * (mean - ybar) * (mean - ybar) "
        "ELSE -half * (mean * mean * vzz - 2 * mean * vyz) END"
    )
    tables = (
        cells.selectExpr(*groups, "tau_id", "kind AS par", "kappa_id", f"{term} AS term")
        .groupBy(*groups, "tau_id", "par", "kappa_id")
        # a null cell (failed solve) makes the whole point null
        .agg(F.expr("CASE WHEN count(term) = count(*) THEN sum(term) END AS term"))
    )
    scalar = fields.groupBy(*groups, "par", "kappa_id").agg(
        F.expr("max(log_kappa) AS lk"),
        F.expr("count(*) / 2 * max(log_kappa) - exp(max(log_kappa)) * max(roughness) / 2 - max(log_det) / 2 AS own"),
    )
    scored = tables.join(scalar, [*groups, "par", "kappa_id"])
    sides = [F.expr(f"collect_list(CASE WHEN par = '{p}' THEN struct(lk AS lk_{p}, term + own AS score_{p}) END) AS {p}") for p in PARAMETERS]
    points = scored.groupBy(*groups, "tau_id").agg(*sides)
    for p in ("tau", "alpha", "beta"):
        points = points.selectExpr(*[c for c in points.columns if c != p], f"inline({p})")
    out = points.withColumn("log_post_y", F.expr("score_tau + score_alpha + score_beta"))
    if hyperprior is not None:
        out = out.join(lam, groups) if groups else out.withColumn(
            "_lam", lam.select(F.struct(*[f"lambda_{p}" for p in PARAMETERS])).scalar()
        ).select("*", "_lam.*").drop("_lam")
        prior = sum((log_hyperprior(F.col(f"lk_{p}"), F.col(f"lambda_{p}"), hyperprior) for p in PARAMETERS), F.lit(0.0))
        out = out.withColumn("log_hyper", prior)
    else:
        out = out.withColumn("log_hyper", F.lit(0.0))
    return out.select(
        *groups, "lk_alpha", "lk_beta", "lk_tau", "log_post_y", "log_hyper",
        (F.col("log_post_y") + F.col("log_hyper")).alias("log_post"),
    )


def lambda_table(estimates: DataFrame, kind: str, groups: Sequence[str] = ()) -> DataFrame:
    variance = parameter_variance(estimates, groups)
    return variance.select(*groups, *[hyper_lambda(F.col(f"var_{p}"), kind).alias(f"lambda_{p}") for p in PARAMETERS])


def _stencil_quadratic(values: dict[tuple, float], h: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian at the middle of a 3 x 3 x 3 stencil."""
    at = lambda **d: values[tuple(d.get(c, 0) for c in "abt")]
    axes = "abt"
    gradient = np.array([(at(**{c: 1}) - at(**{c: -1})) / (2 * h) for c in axes])
    hessian = np.empty((3, 3))
    for r, c in itertools.product(range(3), repeat=2):
        x, y = axes[r], axes[c]
        hessian[r, c] = (
            (at(**{x: 1}) - 2 * at() + at(**{x: -1})) / h**2
            if r == c
            else (at(**{x: 1, y: 1}) - at(**{x: 1, y: -1}) - at(**{x: -1, y: 1}) + at(**{x: -1, y: -1})) / (4 * h * h)
        )
    return gradient, hessian


# Spacing of the search axes of ``kappa_mode`` after the coarse grid, and their reach in steps to either side.
SEARCH_STEPS = (0.5, 0.125)
REACH = 4


def kappa_mode(
    est: DataFrame,
    moments: DataFrame,
    groups: Sequence[str] = (),
    hyperprior: str | None = "half_normal",
    lam: DataFrame | None = None,
    axis: Sequence[float] = LOG_KAPPA_AXIS,
    max_rounds: int = 40,
) -> list[dict]:
    """Normal approximation of the log-kappa posterior of every group: [{groups..., status, mode, cov, gradient}].

    ``status`` is "ok", "no finite point" (none on the coarse grid) or "no interior maximum"; the rest is None unless it is "ok".

    Starts at the best point of a coarse grid and looks at ever finer cubes of points around the best so far; a cube whose best
    point lies on its surface is moved, not refined. Solves grow with the edge of the cube, not with its volume. Each round
    is one pass over all groups; the 27 points around each group's best come to the driver, for algebra on 3 x 3 matrices.
    """
    groups = list(groups)
    spark = est.sparkSession
    est, moments = cut_lineage(est), cut_lineage(moments)
    lam = cut_lineage(lam) if lam is not None else None
    names = [f"lk_{p}" for p in PARAMETERS]
    coarse = kappa_log_posterior(est, moments, kappa_axis(spark, axis), groups, hyperprior, lam)
    best = coarse.filter("log_post is not null and not isnan(log_post)").groupBy(*groups).agg(
        F.max_by(F.struct(*names), "log_post").alias("at")).filter("at is not null").collect()
    every = [tuple(r) for r in est.select(*groups).distinct().collect()] if groups else [()]
    # group -> [centre, index of the current step, covariance, gradient]
    state = {tuple(r[g] for g in groups): [np.array(list(r["at"])), 0, None, None] for r in best}
    schema = T.StructType(
        [*[est.schema[g] for g in groups], *T.StructType.fromDDL("par string, kappa_id int, log_kappa double, step double").fields]
    )

    for _ in range(max_rounds):
        active = {g: s for g, s in state.items() if s[1] < len(SEARCH_STEPS)}
        if not active:
            break
        cubes = spark.createDataFrame(
            [
                (*g, p, k + REACH, float(s[0][n] + k * SEARCH_STEPS[s[1]]), SEARCH_STEPS[s[1]])
                for g, s in active.items() for n, p in enumerate(PARAMETERS) for k in range(-REACH, REACH + 1)
            ],
            schema,
        )
        steps = cubes.select(*groups, "step").distinct()
        rest = est.join(F.broadcast(steps.select(*groups)), groups, "left_semi") if groups else est
        points = kappa_log_posterior(rest, moments, cubes.drop("step"), groups, hyperprior, lam)
        points = points.join(F.broadcast(steps), groups) if groups else points.withColumn("step", steps.scalar())
        # a cube has (2 REACH + 1)^3 points, so the window is small
        top = F.max_by(F.struct(*names), "log_post").over(Window.partitionBy(*(groups or [F.lit(1)])))
        near = points.withColumn("top", top).filter(
            " and ".join(f"abs({c} - top.{c}) < 1.5 * step" for c in names)
        ).withColumns({f"_at{n}": F.round((F.col(c) - F.col(f"top.{c}")) / F.col("step")).cast("int") for n, c in enumerate(names)})
        found: dict[tuple, dict] = {g: {} for g in active}
        tops: dict[tuple, np.ndarray] = {}
        for r in near.collect():
            g = tuple(r[c] for c in groups)
            value = r["log_post"]
            found[g][(r["_at0"], r["_at1"], r["_at2"])] = value if value is not None else -np.inf
            tops[g] = np.array(list(r["top"]))
        for g, s in active.items():
            if g not in tops:  # no point of the cube is finite
                s[1] = len(SEARCH_STEPS)
                continue
            s[0] = tops[g]
            if len(found[g]) < 27:
                continue
            if s[1] == len(SEARCH_STEPS) - 1:
                gradient, hessian = _stencil_quadratic(found[g], SEARCH_STEPS[s[1]])
                if np.all(np.isfinite(hessian)) and np.all(np.linalg.eigvalsh(-hessian) > 0):
                    s[2], s[3] = np.linalg.inv(-hessian), gradient
                    s[0] = s[0] + np.clip(s[2] @ gradient, -SEARCH_STEPS[s[1]], SEARCH_STEPS[s[1]])
            s[1] += 1
    out = []
    for g in every:
        centre, _, cov, gradient = state.get(g, [None] * 4)
        status = "no finite point" if centre is None else "no interior maximum" if cov is None else "ok"
        out.append({**dict(zip(groups, g)), "status": status, "mode": None if cov is None else centre, "cov": cov, "gradient": gradient})
    return out


def seed_of(*parts) -> int:
    """64-bit seed from key text: the draws of a field depend on its key alone, not on where or how often it runs."""
    return int.from_bytes(hashlib.md5("|".join(map(str, parts)).encode()).digest()[:8], "big")


def sample_fields(
    est: DataFrame, kappa_samples: DataFrame, groups: Sequence[str], seed: int = 1, per_task: int = 32
) -> DataFrame:
    """One posterior draw of every field per kappa draw: (groups, par, sample, s, value).

    ``kappa_samples`` holds (sample, lk_alpha, lk_beta, lk_tau) and may hold some of ``groups``.
    """
    groups = list(groups)
    on = [c for c in groups if c in kappa_samples.columns]
    kappas = kappa_samples.unpivot([*on, "sample"], [f"lk_{p}" for p in PARAMETERS], "name", "log_kappa").select(
        *on, F.regexp_replace("name", "^lk_", "").alias("par"), F.col("sample").alias("kappa_id"), "log_kappa"
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        value, weight = _field(rows)
        ids, logs = np.asarray(rows["_ids"].iloc[0]), np.asarray(rows["_logs"].iloc[0], dtype=float)
        key = [rows[c].iloc[0] for c in [*groups, "par"]]
        noise = np.stack([np.random.default_rng(seed_of(seed, *key, k)).standard_normal(value.shape) for k in ids])
        draws = solve(value, weight, np.exp(logs), noise=noise, variance=False)["draw"]
        s = _cells(value.shape)["s"]
        out = pd.DataFrame({"sample": np.repeat(ids, value.size), "s": np.tile(s, len(ids)), "value": draws.ravel()})
        for c, k in zip([*groups, "par"], key):
            out[c] = k
        return out[[f.name for f in schema.fields]]

    schema = _schema(est, [*groups, "par"], "sample int, s int, value double")
    rows = _with_kappas(est.select(*groups, *FIELD_COLUMNS), kappas, per_task)
    return _by_field(rows, [*groups, "par", "_chunk"]).applyInPandas(run, schema)
