"""Regression estimates and their leave-one-out forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcal.operators import estimate


@pytest.fixture(scope="module")
def hindcast(spark):
    """Uneven: several rows per fold, folds missing in some cells, one cell with a constant forecast."""
    rng = np.random.default_rng(3)
    rows = []
    for cell in range(6):
        for year in range(2000, 2007):
            if cell == 1 and year in (2001, 2005):
                continue
            for _ in range(int(rng.integers(1, 5))):
                x = 280.0 if cell == 5 else 280.0 + float(rng.normal())
                rows.append((float(cell), 50.0, 3, year, 250 + 0.8 * x + float(rng.normal()), x))
    return spark.createDataFrame(rows, "long double, lat double, lead_time int, year int, obs double, fcst double").cache()


def by_key(df):
    return {(r.long, r.year): r for r in df.collect()}


def test_downdate_equals_join(hindcast):
    keys = ["long", "lat", "lead_time"]
    one = by_key(estimate.loo_mle(hindcast, keys))
    two = by_key(estimate.loo_mle(hindcast, keys, method="join"))
    # the join form has a row wherever training data exists: every cell and every fold
    assert one.keys() == two.keys() and len(one) == 6 * 7
    for key, row in one.items():
        for name in estimate.ESTIMATES:
            a, b = row[name], two[key][name]
            assert (a is None and b is None) or math.isclose(a, b, rel_tol=1e-8), (key, name)
    assert one[(5.0, 2003)].beta_hat is None and one[(5.0, 2003)].tau_hat is None


def test_direct_least_squares(hindcast):
    got = {r.long: r for r in estimate.mle(hindcast, ["long", "lat", "lead_time"]).collect()}
    pdf = hindcast.toPandas()
    for cell in (0.0, 3.0):
        part = pdf[pdf.long == cell]
        z = part.fcst - part.fcst.mean()
        design = np.column_stack([np.ones(len(z)), z])
        coef, *_ = np.linalg.lstsq(design, part.obs, rcond=None)
        rest = part.obs - design @ coef
        assert np.allclose([got[cell].alpha_hat, got[cell].beta_hat, got[cell].tau_hat],
                           [*coef, 0.5 * np.log(np.mean(rest**2))])


def test_loo_plan_has_one_pass_and_no_join(hindcast):
    plan = estimate.loo_mle(hindcast, ["long", "lat", "lead_time"], folds=range(2000, 2007))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_lm_uses_the_anomaly_origin(hindcast):
    rows = hindcast.withColumn("fcst_anom", F.col("fcst") - 279.0)
    got = {r.long: r for r in estimate.lm_per_cell(rows).collect()}
    part = hindcast.toPandas().query("long == 2")
    slope, intercept = np.polyfit(part.fcst - 279.0, part.obs, 1)
    assert np.allclose([got[2.0].alpha_hat, got[2.0].beta_hat, got[2.0].sxx], [intercept, slope, np.mean((part.fcst - 279.0) ** 2)])


def test_incomplete_pairs_count_nowhere(spark, hindcast):
    """Nulls on either side, and a cell without any pair: all estimates are those of the complete pairs."""
    hole = F.crc32(F.concat_ws("|", "year", "obs").cast("binary")) % 5
    gaps = hindcast.withColumns({
        "obs": F.when((hole != 0) & (F.col("long") != 4), F.col("obs")), "fcst": F.when(hole != 1, F.col("fcst")),
    }).cache()
    whole = gaps.dropna(subset=["obs", "fcst"])
    assert 0 < whole.count() < gaps.count()
    keys = ["long", "lat", "lead_time"]
    for run in (estimate.mle, lambda d, k: estimate.lm_per_cell(d, k, "fcst"), estimate.mos_coefficients, estimate.cov_var_slope,
                estimate.correlation_bias):
        got = {r.long: r for r in run(gaps, keys).collect()}
        want = {r.long: r for r in run(whole, keys).collect()}
        assert set(got) == set(want) | {4.0}
        assert all(got[4.0][c] is None for c in got[4.0].asDict() if c not in [*keys, "n"] and not c.startswith("var_tau"))
        for long, row in want.items():
            for c, x in row.asDict().items():
                assert got[long][c] == pytest.approx(x, rel=1e-6, abs=1e-9) if x is not None else got[long][c] is None
    for method in ("downdate", "join"):
        got = by_key(estimate.loo_mle(gaps, keys, method=method).filter("n > 0"))
        want = by_key(estimate.loo_mle(whole, keys, method=method))
        assert set(got) >= set(want)
        for key, row in want.items():
            assert got[key].n == row.n and got[key].alpha_hat == pytest.approx(row.alpha_hat, rel=1e-9)
            if key[0] != 5 and row.beta_hat is not None:  # the forecast of cell 5 is constant
                assert got[key].beta_hat == pytest.approx(row.beta_hat, rel=1e-6)
