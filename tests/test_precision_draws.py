"""Inverse-transform draws from evaluated log densities against a plain version."""

import hashlib

import numpy as np

from fieldcal.operators import predict


def uniform(*keys):
    return (int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def test_draws_follow_the_cumulative_shares(spark):
    rng = np.random.default_rng(3)
    axis = [-2.0, 0.5, 3.0]
    rows = [(g, a, b, float(rng.normal(0, 2) - 800 * (g - 1))) for g in (1, 2) for a in axis for b in axis]
    rows += [(1, 9.0, 9.0, None), (2, 9.0, 9.0, float("-inf")), (2, 8.0, 9.0, float("nan")), (3, 0.5, 0.5, -5000.0), (4, 0.5, 0.5, None)]
    points = spark.createDataFrame(rows, "g int, a double, b double, log_post double")
    n = 400
    found = {(r.g, r["sample"]): (r.a, r.b) for r in predict.sample_from_grid(points, ["g"], ["a", "b"], n, 5).collect()}
    assert {g for g, _ in found} == {1, 2, 3} and len(found) == 3 * n  # a group without mass has no draws
    for g in (1, 2, 3):
        own = sorted((a, b, lp) for h, a, b, lp in rows if h == g and lp is not None and np.isfinite(lp))
        mass = np.exp(np.array([p[2] for p in own]) - max(p[2] for p in own))
        upto = np.cumsum(mass) / mass.sum()
        want = [own[int(np.searchsorted(upto, uniform(5, g, k, "uniform")))][:2] for k in range(1, n + 1)]
        assert [found[g, k] for k in range(1, n + 1)] == want
        share = np.array([sum(f == p[:2] for f in want) for p in own]) / n
        assert np.all(np.abs(share - mass / mass.sum()) < 0.12)


def test_one_group_without_a_name_and_nothing(spark):
    points = spark.createDataFrame([(1.0, 0.0), (2.0, -1.0)], "a double, log_post double")
    rows = predict.sample_from_grid(points, [], ["a"], 50, 5).collect()
    share = 1 / (1 + np.exp(-1.0))
    assert {r["sample"]: r.a for r in rows} == {k: 1.0 if uniform(5, k, "uniform") <= share else 2.0 for k in range(1, 51)}
    assert predict.sample_from_grid(points.where("a > 5"), [], ["a"], 50, 5).count() == 0
