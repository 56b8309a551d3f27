"""Smoothing, precision posterior and draws: invariants against dense algebra on a small grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcal.functions.block_solver import laplacian, solve
from fieldcal.operators import predict, smoothing, spatial

N_J, N_I, YEARS = 5, 4, 9
PARS = ("alpha", "beta", "tau")


def path(n):
    degree = np.full(n, 2.0)
    degree[0] -= 1
    degree[-1] -= 1
    return np.diag(degree) - np.eye(n, k=1) - np.eye(n, k=-1)


def structure(n_j, n_i):
    t = np.kron(np.eye(n_j), path(n_i)) + np.kron(path(n_j), np.eye(n_i))
    return t.T @ t


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(5)
    value = {"alpha": rng.normal(10, 2, (N_J, N_I)), "beta": rng.normal(1, 0.3, (N_J, N_I)), "tau": rng.normal(0, 0.2, (N_J, N_I))}
    vzz = rng.uniform(0.5, 2, (N_J, N_I))
    precision = np.exp(-2 * value["tau"])
    weight = {"alpha": YEARS * precision, "beta": YEARS * vzz * precision, "tau": np.full((N_J, N_I), 2.0 * YEARS)}
    moments = {"vzz": vzz, "vyz": value["beta"] * vzz, "vyy": np.exp(2 * value["tau"]) + value["beta"] ** 2 * vzz, "ybar": value["alpha"]}
    return value, weight, moments


@pytest.fixture(scope="module")
def est(spark, fields):
    value, weight, _ = fields
    rows = [
        (1, p, i + 1, j + 1, j * N_I + i + 1, N_I, N_J, float(value[p][j, i]), float(weight[p][j, i]))
        for p in PARS for j in range(N_J) for i in range(N_I)
    ]
    return spark.createDataFrame(rows, "g int, par string, i int, j int, s int, n_i int, n_j int, value double, weight double").cache()


@pytest.fixture(scope="module")
def moments(spark, fields):
    _, _, m = fields
    rows = [(1, j * N_I + i + 1, YEARS, *[float(m[c][j, i]) for c in ("vyy", "vzz", "vyz", "ybar")]) for j in range(N_J) for i in range(N_I)]
    return spark.createDataFrame(rows, "g int, s int, n int, vyy double, vzz double, vyz double, ybar double").cache()


def grid_values(rows, name):
    out = np.full((N_J, N_I), np.nan)
    for r in rows:
        out[r.j - 1, r.i - 1] = r[name]
    return out


@pytest.mark.parametrize("shape", [(8, 6), (6, 8), (7, 5), (1, 6), (2, 2), (24, 11)])
@pytest.mark.parametrize("kappa", [1e-3, 1.0, 100.0])
def test_solver_equals_dense(shape, kappa):
    rng = np.random.default_rng(1)
    y, w = rng.normal(size=shape), rng.uniform(0.5, 3, shape)
    w[0, 0] = 0.0
    q = kappa * structure(*shape) + np.diag(w.ravel())
    noise = rng.normal(size=(1, *shape))
    found = solve(y, w, [kappa], noise=noise)
    exact = np.linalg.solve(q, (w * np.where(w > 0, y, 0)).ravel())
    assert np.allclose(found["mean"].ravel(), exact, atol=1e-9)
    assert np.allclose(found["var"].ravel(), np.diag(np.linalg.inv(q)), rtol=1e-6)
    assert np.isclose(found["log_det"][0], np.linalg.slogdet(q)[1])


def test_draws_have_the_posterior_covariance():
    rng = np.random.default_rng(2)
    shape, kappa = (3, 2), 2.0
    y, w = rng.normal(size=shape), rng.uniform(0.5, 3, shape)
    noise = rng.normal(size=(40000, *shape))
    found = solve(y, w, np.full(40000, kappa), noise=noise, variance=False)
    q = kappa * structure(*shape) + np.diag(w.ravel())
    assert np.allclose(np.cov(found["draw"].reshape(40000, -1).T), np.linalg.inv(q), atol=0.02)


def test_constant_field_and_vanishing_kappa():
    w = np.random.default_rng(0).uniform(1, 2, (4, 5))
    assert np.allclose(solve(np.full((4, 5), 3.0), w, [0.0, 1.0, 1e6])["mean"], 3.0, atol=1e-6)
    y = np.random.default_rng(1).normal(size=(4, 5))
    found = solve(y, w, [0.0, 0.1, 1.0, 10.0, 1e9])
    assert np.allclose(found["mean"][0], y)
    assert np.all(np.diff(found["roughness"]) <= 1e-9)
    assert np.allclose(found["mean"][-1], (w * y).sum() / w.sum(), atol=1e-3)


def test_failed_kappa_is_nan_and_spares_the_others():
    y = np.ones((3, 3))
    found = solve(y, np.zeros((3, 3)) - 1.0, [1.0])
    assert np.isnan(found["mean"]).all()


def test_smooth_fields_residual_in_dataframe_form(spark, est):
    """(kappa R + D) x - D y evaluated with two grid Laplacians, independently of the solver."""
    smooth = smoothing.smooth_fields(est, smoothing.kappa_axis(spark, [0.0, 3.0]), ["g"], per_task=1)
    assert smooth.count() == 2 * 3 * N_I * N_J
    keys = ["g", "par", "kappa_id"]
    rows = smooth.join(est.select("g", "par", "s", "value", "weight"), ["g", "par", "s"])
    rows = rows.withColumns({"k": F.exp("log_kappa")})
    carry = ["mean", "value", "weight", "k"]
    once = spatial.grid_laplacian(rows, "mean", keys, "lap", carry)
    twice = spatial.grid_laplacian(once, "lap", keys, "lap2", carry)
    rest = twice.select(F.max(F.abs(F.col("k") * F.col("lap2") + F.col("weight") * (F.col("mean") - F.col("value")))).alias("r")).first().r
    assert rest < 1e-8
    rough = spatial.roughness(rows, "mean", keys).join(smooth.select(*keys, "roughness").distinct().withColumnRenamed("roughness", "own"), keys)
    assert all(np.isclose(r.roughness, r.own) for r in rough.collect())


def test_fixed_steps_converge_to_the_solve(spark, est):
    kappa = {"alpha": 2.0, "beta": 2.0, "tau": 2.0}
    steps = spatial.smooth_fixed_steps(est.filter("par = 'alpha'"), kappa, ["g"], steps=6, checkpoint_every=2)
    few = grid_values(steps.collect(), "smooth")
    spread = spatial.smooth_fixed_steps(est.filter("par = 'alpha'"), kappa, ["g"], steps=6, field_per_task=False)
    assert np.allclose(grid_values(spread.collect(), "smooth"), few)
    value = grid_values(est.filter("par = 'alpha'").collect(), "value")
    weight = grid_values(est.filter("par = 'alpha'").collect(), "weight")
    x, w = value.copy(), 1 / (64 * 2.0 + weight.max())
    for k in range(2000):
        x = x - w * (2.0 * laplacian(laplacian(x)) + weight * (x - value))
        if k == 5:
            assert np.allclose(few, x)
    assert np.allclose(x, solve(value, weight, [2.0])["mean"][0], atol=1e-6)


def test_integrated_equals_mixture_of_fixed(spark, est, fields):
    value, weight, _ = fields
    axis = [-2.0, 0.0, 2.0, 4.0]
    got = smoothing.smooth_integrated(est, ["g"], axis).filter("par = 'beta'").collect()
    found = solve(value["beta"], weight["beta"], np.exp(axis))
    lk = np.array(axis)
    log_post = ((N_I * N_J - 1) / 2 * lk - (found["misfit"] + np.exp(lk) * found["roughness"]) / 2 - found["log_det"] / 2
                + lk - 5e-5 * np.exp(lk))
    share = np.exp(log_post - log_post.max())
    share /= share.sum()
    mean = np.tensordot(share, found["mean"], 1)
    var = np.tensordot(share, found["var"] + found["mean"] ** 2, 1) - mean**2
    assert np.allclose(grid_values(got, "smooth"), mean)
    assert np.allclose(grid_values(got, "smooth_var"), var)
    sliced = smoothing.smooth_integrated(est, ["g"], axis, per_task=3).filter("par = 'beta'").collect()
    assert np.allclose(grid_values(sliced, "smooth"), mean) and np.allclose(grid_values(sliced, "smooth_var"), var)
    assert np.allclose(grid_values(sliced, "value"), value["beta"])
    one = smoothing.smooth_integrated(est, ["g"], [1.0]).filter("par = 'tau'").collect()
    assert np.allclose(grid_values(one, "smooth"), solve(value["tau"], weight["tau"], [np.e])["mean"][0])
    weights = smoothing.kappa_marginal(est, ["g"], axis).filter("par = 'beta'").orderBy("log_kappa").collect()
    assert np.allclose([r.probability for r in weights], share)


def test_default_axis_resolves_a_narrow_posterior(spark):
    """24 x 57 cells, where the posterior of the log precision is far narrower than the coarse axis: against 601 points."""
    rng = np.random.default_rng(8)
    shape = (24, 57)
    x, y = np.meshgrid(np.arange(shape[1]), np.arange(shape[0]))
    value = np.sin(x / 6) + np.cos(y / 5) + rng.normal(0, 0.4, shape)
    weight = rng.uniform(4, 9, shape)
    rows = [("alpha", i + 1, j + 1, j * shape[1] + i + 1, shape[1], shape[0], float(value[j, i]), float(weight[j, i]))
            for j in range(shape[0]) for i in range(shape[1])]
    est = spark.createDataFrame(rows, "par string, i int, j int, s int, n_i int, n_j int, value double, weight double")
    # the fine axis is solved in parts, as a solve holds all its points
    lk = np.linspace(-4, 8, 601)
    parts = [solve(value, weight, np.exp(k), variance=False) for k in np.split(lk[:600], 6)]
    whole = {c: np.concatenate([np.asarray(f[c]) for f in parts]) for c in ("misfit", "roughness", "log_det")}
    lk = lk[:600]
    log_post = smoothing._log_posterior(whole, lk, value.size, smoothing.log_gamma_prior())
    share = np.exp(log_post - log_post.max())
    share /= share.sum()
    centre = share @ lk
    sd = np.sqrt(share @ (lk - centre) ** 2)
    assert sd < 0.5
    got = smoothing.kappa_marginal(est, []).orderBy("log_kappa").collect()
    p, at = np.array([r.probability for r in got]), np.array([r.log_kappa for r in got])
    assert len(got) >= 15 and p.sum() == pytest.approx(1.0)
    assert p @ at == pytest.approx(centre, abs=0.01) and np.sqrt(p @ (at - p @ at) ** 2) == pytest.approx(sd, rel=0.02)
    one = {r.s: (r.smooth, r.smooth_var) for r in smoothing.smooth_integrated(est, []).collect()}
    cut = {r.s: (r.smooth, r.smooth_var) for r in smoothing.smooth_integrated(est, [], per_task=5).collect()}
    assert all(np.allclose(one[s], cut[s]) for s in one) and len(one) == value.size


def test_kappa_mode_keeps_every_group(spark, est, moments):
    lost = est.filter("g = 1").withColumn("g", F.lit(2)).withColumn("weight", F.lit(0.0))
    both = est.unionByName(lost)
    found = smoothing.kappa_mode(both, moments, ["g"], None, axis=[-2.0, 0.0, 2.0, 4.0], max_rounds=1)
    assert {f["g"]: f["status"] for f in found} == {1: "no interior maximum", 2: "no finite point"}
    assert all(f["mode"] is None and f["cov"] is None for f in found)
    table = predict.modes_table(spark, found, est.select("g"))
    assert table.count() == 2 and predict.sample_log_kappa(table, 3, 1).count() == 0


def test_missing_cells_are_filled(spark, est):
    gaps = est.filter("not (i = 2 and j = 3)")
    got = smoothing.smooth_integrated(gaps, ["g"], [0.0, 2.0])
    hole = got.filter("i = 2 and j = 3").collect()
    assert len(hole) == 3 and all(r.value is None and r.smooth is not None for r in hole)


def joint_log_posterior(lk, fields):
    """The full three-block problem, solved densely."""
    value, weight, m = fields
    r = structure(N_J, N_I)
    x, total = {}, 0.0
    for p, k in zip(PARS, np.exp(lk)):
        q = k * r + np.diag(weight[p].ravel())
        x[p] = np.linalg.solve(q, (weight[p] * value[p]).ravel())
        total += N_I * N_J / 2 * np.log(k) - k / 2 * x[p] @ r @ x[p] - np.linalg.slogdet(q)[1] / 2
    c = {k: v.ravel() for k, v in m.items()}
    square = c["vyy"] + x["beta"] ** 2 * c["vzz"] - 2 * x["beta"] * c["vyz"] + (x["alpha"] - c["ybar"]) ** 2
    return total - YEARS * x["tau"].sum() - YEARS / 2 * (np.exp(-2 * x["tau"]) * square).sum()


@pytest.mark.parametrize("groups", [["g"], []])
def test_separable_posterior_equals_joint(spark, est, moments, fields, groups):
    source, table = (est, moments) if groups else (est.drop("g"), moments.drop("g"))
    got = smoothing.kappa_log_posterior(source, table, smoothing.kappa_axis(spark, [-1.0, 1.0, 3.0]), groups, None).collect()
    assert len(got) == 27
    for r in got[::5]:
        assert np.isclose(r.log_post, joint_log_posterior([r.lk_alpha, r.lk_beta, r.lk_tau], fields), rtol=1e-10)


def test_mode_is_a_maximum(spark, est, moments, fields):
    lam = spark.createDataFrame([(1, 0.02, 0.02, 0.02)], "g int, lambda_alpha double, lambda_beta double, lambda_tau double")
    found = smoothing.kappa_mode(est, moments, ["g"], "half_normal", lam, axis=[-6.0, -2.0, 2.0, 6.0])[0]
    def f(lk):
        return joint_log_posterior(lk, fields) - 0.01 * np.exp(2 * np.asarray(lk)).sum()
    at = np.asarray(found["mode"])
    assert found["g"] == 1 and np.all(np.linalg.eigvalsh(found["cov"]) > 0)
    for axis in np.eye(3):
        assert abs((f(at + 1e-3 * axis) - f(at - 1e-3 * axis)) / 2e-3) < 0.05
        assert f(at) > f(at + 0.5 * axis) and f(at) > f(at - 0.5 * axis)


def test_field_draws_match_the_solve_and_ignore_partitioning(spark, est, fields):
    value, weight, _ = fields
    draws = spark.range(1, 401).select(F.col("id").cast("int").alias("sample"), *[F.lit(1.0).alias(f"lk_{p}") for p in PARS])
    one = smoothing.sample_fields(est, draws, ["g"], seed=3, per_task=64)
    two = smoothing.sample_fields(est.repartition(5), draws, ["g"], seed=3, per_task=7)
    assert one.exceptAll(two).count() == 0
    stats = one.filter("par = 'alpha'").groupBy("s").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()
    found = solve(value["alpha"], weight["alpha"], [np.e])
    order = {r.s: r for r in stats}
    mean = np.array([order[s].m for s in range(1, N_I * N_J + 1)])
    var = np.array([order[s].v for s in range(1, N_I * N_J + 1)])
    assert np.all(np.abs(mean - found["mean"].ravel()) < 5 * np.sqrt(found["var"].ravel() / 400))
    assert np.allclose(var, found["var"].ravel(), rtol=0.35)


def test_legacy_half_tau(spark):
    samples = spark.createDataFrame([(1, 1, 2.0, 0.5, 1.0)], "s int, sample int, alpha double, beta double, tau double")
    z = spark.createDataFrame([(1, 4.0, 0.0)], "s int, z double, y double")
    full = predict.predictive_ensemble(samples, z, ["s"], 1).first().y_hat - 4.0
    half = predict.predictive_ensemble(samples, z, ["s"], 1, legacy_half_tau=True).first().y_hat - 4.0
    assert np.isclose(full / half, np.exp(0.5))


@pytest.mark.parametrize("per_task", [None, 2])
def test_field_without_weights_is_null(spark, est, per_task):
    empty = est.withColumn("weight", F.when(F.col("par") != "tau", F.col("weight")).otherwise(F.lit(0.0)))
    got = smoothing.smooth_integrated(empty, ["g"], [0.0, 1.0, 2.0, 3.0], per_task=per_task)
    whole = smoothing.smooth_integrated(est, ["g"], [0.0, 1.0, 2.0, 3.0], per_task=per_task)
    lost = got.filter("par = 'tau'").collect()
    assert len(lost) == N_J * N_I and all(r.smooth is None and r.smooth_var is None for r in lost)
    want = {(r.par, r.s): r.smooth for r in whole.filter("par != 'tau'").collect()}
    assert all(r.smooth == pytest.approx(want[r.par, r.s]) for r in got.filter("par != 'tau'").collect())
    points = smoothing.kappa_marginal(empty, ["g"], [0.0, 1.0, 2.0, 3.0]).collect()
    assert all((r.probability is None) == (r.par == "tau") for r in points)
