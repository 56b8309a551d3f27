"""Conjugate gradients and posterior draws in DataFrame form against dense algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcal.operators import gradients
from fieldcal.session import cut_lineage
from tests.test_smoothing import structure

N_I, N_J = 6, 8
KAPPA = {"alpha": 2.0, "beta": 300.0}


@pytest.fixture(scope="module")
def truth():
    """(value, weight) of four fields; one has holes, one a single observed cell."""
    rng = np.random.default_rng(4)
    out = {}
    for g in (1, 2):
        for par in KAPPA:
            out[g, par] = rng.normal(3, 1, (N_J, N_I)), rng.uniform(0.5, 5, (N_J, N_I))
    out[2, "alpha"][1][2:4, 1:5] = 0.0
    out[2, "beta"][1][:] = 0.0
    out[2, "beta"][1][3, 3] = 2.0
    return out


@pytest.fixture(scope="module")
def est(spark, truth):
    rows = [(g, par, i + 1, j + 1, N_I, N_J, float(y[j, i]), float(w[j, i]))
            for (g, par), (y, w) in truth.items() for j in range(N_J) for i in range(N_I) if w[j, i] > 0 or i % 2]
    rows += [(3, "alpha", 1, 1, N_I, N_J, None, 1.0), (3, "alpha", 2, 1, N_I, N_J, 1.0, 0.0)]
    return spark.createDataFrame(rows, "g int, par string, i int, j int, n_i int, n_j int, value double, weight double").cache()


def system(y, w, kappa):
    return kappa * structure(N_J, N_I) + np.diag(w.ravel()), (w * y).ravel()


def field(rows, name):
    out = np.full((N_J, N_I), np.nan)
    for r in rows:
        assert np.isnan(out[r.j - 1, r.i - 1])
        out[r.j - 1, r.i - 1] = r[name]
    return out


def test_smooth_equals_dense(est, truth):
    rows = gradients.smooth(est, KAPPA, ["g", "par"]).collect()
    assert {(r.g, r.par) for r in rows} == set(truth)  # a field without a usable cell has no rows
    for (g, par), (y, w) in truth.items():
        own = [r for r in rows if (r.g, r.par) == (g, par)]
        a, b = system(y, w, KAPPA[par])
        assert np.allclose(field(own, "smooth").ravel(), np.linalg.solve(a, b), atol=1e-6)
        assert max(r.residual for r in own) <= gradients.TOLERANCE
        assert all((r.value is None) == (w[r.j - 1, r.i - 1] == 0) for r in own)
    assert len({r.steps for r in rows}) > 1  # fields leave at different steps


def test_a_field_spreads_over_tasks(spark, est, monkeypatch):
    """Also where the scalars of a step are joined by shuffle."""
    monkeypatch.setattr(gradients, "TILE", 3)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        keys = ["field", "par"]
        fields = gradients.whole_fields(est.where("g = 1 and par = 'alpha'").withColumnRenamed("g", "field"), KAPPA, keys)
        zero, none = F.lit(0.0), F.lit(None).cast("double")
        state = fields.withColumns({"b": F.col("d") * F.col("y"), "x": zero, "p": zero, "s": zero, "g": none, "a": none, "top": none, "steps": zero})
        state = state.withColumns({"r": F.col("b"), "done": F.lit(False)})
        first = gradients.with_product(state.withColumn("u", F.col("b")), keys)
        second = gradients.with_product(gradients._step(cut_lineage(first), keys, 1e-10).withColumn("u", F.col("r")), keys)
        for part in (fields, first, second):
            rows = part.withColumn("task", F.spark_partition_id()).collect()
            assert len({r.task for r in rows}) > 1 and len({(r.i, r.j) for r in rows}) == len(rows) == N_I * N_J
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unfinished_fields_keep_what_they_have(est, truth):
    rows = gradients.smooth(est.where("g = 1"), KAPPA, ["g", "par"], most_steps=3).collect()
    assert len(rows) == 2 * N_I * N_J and all(r.residual > gradients.TOLERANCE and r.steps == 3 for r in rows)


def test_empty_input(est):
    assert gradients.smooth(est.where("g = 9"), KAPPA, ["g", "par"]).count() == 0


def test_draws_have_the_posterior_moments(spark, est, truth):
    n, keys = 600, ["g", "par"]
    some = est.where("g = 2 and par = 'alpha'")
    drawn = gradients.sample(some, KAPPA, keys, n, 3, 1e-9)
    rows = drawn.collect()
    assert len(rows) == n * N_I * N_J
    values = np.empty((n, N_J, N_I))
    for r in rows:
        values[r["sample"] - 1, r.j - 1, r.i - 1] = r.value
    a, b = system(*truth[2, "alpha"], KAPPA["alpha"])
    inverse = np.linalg.inv(a)
    sd = np.sqrt(np.diag(inverse))
    flat = values.reshape(n, -1)
    assert np.all(np.abs(flat.mean(axis=0) - inverse @ b) < 5 * sd / np.sqrt(n))
    correlation = np.cov(flat.T) / np.outer(sd, sd)
    assert np.all(np.abs(correlation - inverse / np.outer(sd, sd)) < 5 * np.sqrt(2 / n))
    moments = gradients.moments_of_draws(drawn, keys).collect()
    assert np.allclose(field(moments, "mean"), values.mean(axis=0)) and np.allclose(field(moments, "var"), values.var(axis=0, ddof=1))
    assert {r.draws for r in moments} == {n}
    fields = gradients.whole_fields(some, KAPPA, keys)
    whole, dealt = (gradients.perturbed(f, keys, 5, 3).select("sample", "i", "j", F.round("b", 9).alias("b")) for f in (fields, fields.repartition(7)))
    assert whole.exceptAll(dealt).count() == 0  # draws do not depend on the partitioning


def test_small_fields_take_no_table_a_step(spark, est, truth, monkeypatch):
    """Same solutions, residuals and steps as by table; a field with a missing or a repeated cell goes by table."""
    keys = ["g", "par"]
    fields = gradients.whole_fields(est, KAPPA, keys).withColumn("b", F.col("d") * F.col("y")).cache()
    by_table = {(*r[:4],): r for r in gradients.solve(fields, keys, within=0).collect()}
    odd = fields.where("g = 1 and par = 'alpha' and not (i = 2 and j = 2)").withColumn("g", F.lit(7))
    odd = cut_lineage(odd)
    of_odd = {(r.i, r.j): r.x for r in gradients.solve(odd, keys, within=0).collect()}
    asked, once = [], gradients._solve_by_table
    monkeypatch.setattr(gradients, "_solve_by_table", lambda rows, *rest: asked.append(rows.select("_key0").distinct().collect()) or once(rows, *rest))
    found = gradients.solve(fields.unionByName(odd), keys).collect()
    assert [r[0] for r in asked[0]] == [7] and len(asked) == 1
    assert {(r.i, r.j): r.x for r in found if r.g == 7} == pytest.approx(of_odd)
    own = [r for r in found if r.g != 7]
    assert len(own) == len(by_table) == 4 * N_I * N_J
    for r in own:
        same = by_table[(*r[:4],)]
        assert r.x == pytest.approx(same.x, abs=1e-8) and r.residual <= gradients.TOLERANCE and abs(r.steps - same.steps) <= 1
    gradients.solve(fields, keys).collect()
    assert len(asked) == 1


def test_fields_without_right_side_rest_at_zero(spark):
    cells = spark.range(4).selectExpr("1 AS f", "cast(id % 2 + 1 AS int) AS i", "cast(floor(id / 2) + 1 AS int) AS j", "2 AS n_i", "2 AS n_j",
                                      "1.0D AS k", "1.0D AS d", "0.0D AS b")
    rows = gradients.solve(cells, ["f"]).collect()
    assert [(r.x, r.residual, r.steps) for r in rows] == [(0.0, None, 0)] * 4
