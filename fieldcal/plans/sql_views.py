"""Common table expressions behind the SQL twins: the fixture views and the shared intermediate results."""

from fieldcal.plans.registry import view

view("fx_member", """
SELECT j, i, raw_long, CASE WHEN raw_long > 180 THEN raw_long - 360 ELSE raw_long END AS long, lat,
  make_date(year, 6, 29) AS start_date, make_date(year, 6, 29) + lead_time AS date, year, lead_time,
  CAST(row_number() OVER (PARTITION BY j, i, year, lead_time
    ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS member,
  CAST((l_orderkey % 4) * 6 AS INT) AS hour,
  l_quantity / 2.003 AS fcst,
  5.0 + 0.2 * i + (0.5 + 0.05 * j) * l_quantity / 2.003 + l_extendedprice / 20011.0 * (0.5 + 0.02 * lead_time) AS obs_raw
FROM (
  SELECT *, CAST((345 + 3 * j) % 360 AS DOUBLE) AS raw_long, CAST(36 + 6 * i AS DOUBLE) AS lat
  FROM (
    SELECT CAST(l_partkey % 8 AS INT) AS j, CAST(floor(l_partkey / 8.0) % 6 AS INT) AS i,
      CAST(year(l_shipdate) AS INT) AS year, CAST(3 * l_linenumber AS INT) AS lead_time,
      l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity
    FROM lineitem) a) b
""")

view("fx_analysis_raw", """
SELECT raw_long AS x, lat AS y, date, hour, avg(obs_raw) + 273.15 AS t2m
FROM fx_member GROUP BY raw_long, lat, date, hour
""")

view("fx_ens", """
SELECT j, i, long, lat, date, start_date, year, lead_time, avg(obs_raw) AS obs,
  avg(fcst) AS ens_mean, stddev_samp(fcst) AS ens_sd, count(*) AS members
FROM fx_member GROUP BY j, i, long, lat, date, start_date, year, lead_time
""")

view("fx_control", """
SELECT h.j, h.i, h.long, h.lat, h.date, h.start_date, h.year, h.lead_time, h.obs, m.fcst
FROM fx_ens h JOIN fx_member m
  ON h.j = m.j AND h.i = m.i AND h.year = m.year AND h.lead_time = m.lead_time AND m.member = 1
""")

view("fx_daily", "SELECT j, i, long, lat, year, lead_time, date, obs, ens_mean AS fcst FROM fx_ens")

view("fx_meta", """
SELECT CAST((year - 1995) * 7 + lead_time // 3 AS INT) AS band_id,
  'band' || CAST((year - 1995) * 7 + lead_time // 3 AS INT) AS band,
  start_date, date AS veri_date, year, lead_time
FROM (SELECT DISTINCT year, lead_time, start_date, date FROM fx_ens) d
""")

view("fx_long_bands", """
SELECT CASE WHEN c.long < 0 THEN c.long + 360 ELSE c.long END AS x, c.lat AS y, m.band_id, m.band, c.fcst
FROM fx_control c JOIN fx_meta m ON c.year = m.year AND c.lead_time = m.lead_time
""")

view("fx_wide", "SELECT x, y, " + ", ".join(
    f"max(CASE WHEN band_id = {k} THEN fcst END) AS band{k}" for k in range(1, 50)
) + " FROM fx_long_bands GROUP BY x, y")

view("fx_weekly", """
SELECT j, i, long, lat, year, avg(obs) AS obs, avg(fcst) AS fcst
FROM fx_control WHERE ceil(lead_time / 7.0) = 3 GROUP BY j, i, long, lat, year
""")

view("fx_3w", """
SELECT *, fcst - avg(fcst) OVER (PARTITION BY j, i, long, lat) AS fcst_anom FROM fx_weekly
""")

view("fx_grid", """
SELECT long, lat, i, j, CAST((j - 1) * (SELECT count(DISTINCT lat) FROM fx_ens) + i AS INT) AS s
FROM (SELECT long, CAST(dense_rank() OVER (ORDER BY long) AS INT) AS j FROM (SELECT DISTINCT long FROM fx_ens) a) p
CROSS JOIN (SELECT lat, CAST(dense_rank() OVER (ORDER BY lat) AS INT) AS i FROM (SELECT DISTINCT lat FROM fx_ens) b) q
""")


def mle_sql(source: str, keys: str, z: str = "fcst") -> str:
    """Two-pass regression estimates: centre by the group mean, then average."""
    return f"""
SELECT {keys}, ybar AS alpha_hat, vyz / nullif(vzz, 0) AS beta_hat, 0.5 * ln(s2) AS tau_hat, n,
  s2 / n AS var_alpha_hat, s2 / nullif(n * vzz, 0) AS var_beta_hat, 1.0::DOUBLE / (2.0 * n) AS var_tau_hat,
  vyy, vzz, vyz, ybar
FROM (SELECT *, CASE WHEN vyy - vyz * vyz / nullif(vzz, 0) > 0 THEN vyy - vyz * vyz / nullif(vzz, 0) END AS s2
  FROM (SELECT {keys}, avg(dy * dy) AS vyy, avg(dz * dz) AS vzz, avg(dy * dz) AS vyz, avg(obs) AS ybar, count(*) AS n
    FROM (SELECT *, obs - avg(obs) OVER w AS dy, {z} - avg({z}) OVER w AS dz FROM {source}
      WINDOW w AS (PARTITION BY {keys})) c
    GROUP BY {keys}) m) e
"""


view("fx_mle", mle_sql("fx_daily", "j, i, long, lat, lead_time"))
view("fx_folds", "SELECT DISTINCT year AS fold FROM fx_ens")
view("fx_train", "SELECT f.fold, d.* FROM fx_daily d JOIN fx_folds f ON d.year <> f.fold")
view("fx_loo", mle_sql("fx_train", "j, i, long, lat, lead_time, fold"))
view("fx_mle3w", mle_sql("fx_3w", "j, i, long, lat"))

# ---- smoothing: two fixed steps of the (kappa R + D) system ----

KAPPA = {"alpha": 8.0, "beta": 150.0, "tau": 150.0}

view("fx_est", " UNION ALL ".join(
    f"SELECT fold, lead_time, '{p}' AS par, i, j, long, lat, {p}_hat AS y, 1.0::DOUBLE / var_{p}_hat AS d, {k}::DOUBLE AS k FROM fx_loo"
    for p, k in KAPPA.items()))
view("fx_s0", "SELECT *, y AS x, 1.0::DOUBLE / (64.0 * k + max(d) OVER (PARTITION BY fold, lead_time, par)) AS w FROM fx_est")


def laplacian_sql(source: str, value: str, groups: str = "fold, lead_time, par") -> str:
    same = " AND ".join(f"a.{g.strip()} = b.{g.strip()}" for g in groups.split(",")) + " AND " if groups else ""
    keys = ", ".join([*[f"a.{g.strip()}" for g in groups.split(",") if groups], "a.i", "a.j"])
    return f"""SELECT {keys}, sum(a.{value} - b.{value}) AS v FROM {source} a JOIN {source} b
ON {same}abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY {keys}"""


for _step in (1, 2):
    view(f"fx_once{_step}", laplacian_sql(f"fx_s{_step - 1}", "x"))
    view(f"fx_twice{_step}", laplacian_sql(f"fx_once{_step}", "v"))
    view(f"fx_s{_step}", f"""
SELECT s.fold, s.lead_time, s.par, s.i, s.j, s.long, s.lat, s.y, s.d, s.k, s.w,
  s.x - s.w * (s.k * r.v + s.d * (s.x - s.y)) AS x
FROM fx_s{_step - 1} s JOIN fx_twice{_step} r
  ON s.fold = r.fold AND s.lead_time = r.lead_time AND s.par = r.par AND s.i = r.i AND s.j = r.j
""")

# ---- smoothing: conjugate gradients until the residual is small ----

#: both sides go on until rounding alone separates them
TOLERANCE = 1e-14


def laplacian_by_windows(v: str) -> str:
    """Laplacian of ``v`` on complete grids of fields ``f``, for use with the windows by_i and by_j."""
    return (f"(i > 1)::INT * ({v} - coalesce(lag({v}) OVER by_i, 0)) + (i < n_i)::INT * ({v} - coalesce(lead({v}) OVER by_i, 0)) "
            f"+ (j > 1)::INT * ({v} - coalesce(lag({v}) OVER by_j, 0)) + (j < n_j)::INT * ({v} - coalesce(lead({v}) OVER by_j, 0))")


def gradients_sql(fields: str, tolerance: float = TOLERANCE) -> str:
    """(f, i, j, x, steps, residual) with (k R + d) x = b, from (f, i, j, n_i, n_j, k, d, b) on complete grids."""
    windows = "WINDOW by_i AS (PARTITION BY f, j ORDER BY i), by_j AS (PARTITION BY f, i ORDER BY j)"
    degree = "((i > 1)::INT + (i < n_i)::INT + (j > 1)::INT + (j < n_j)::INT)"
    return f"""
WITH RECURSIVE cg AS (
  SELECT f, i, j, n_i, n_j, k, d, b, 0.0::DOUBLE AS x, b AS r, 0.0::DOUBLE AS p, 0.0::DOUBLE AS s, NULL::DOUBLE AS g, NULL::DOUBLE AS a,
    NULL::DOUBLE AS top, 0 AS steps, false AS done FROM {fields}
  UNION ALL
  SELECT f, i, j, n_i, n_j, k, d, b, CASE WHEN still THEN x ELSE x + alpha * (u + beta * p) END,
    CASE WHEN still THEN r ELSE r - alpha * (w + beta * s) END, u + beta * p, w + beta * s, gamma, alpha, now, CASE WHEN still THEN steps ELSE steps + 1 END, still
  FROM (SELECT *, coalesce(gamma / g, 0) AS beta, gamma / (delta - coalesce(gamma / g, 0) * coalesce(gamma / a, 0)) AS alpha,
      coalesce(now <= {tolerance!r}, true) AS still
    FROM (SELECT *, sum(r * u) OVER field AS gamma, sum(w * u) OVER field AS delta,
        max(abs(r)) OVER field / nullif(max(abs(b)) OVER field, 0) AS now
      FROM (SELECT *, k * ({laplacian_by_windows("lap")}) + d * u AS w
        FROM (SELECT *, {laplacian_by_windows("u")} AS lap
          FROM (SELECT *, r / (k * {degree} * ({degree} + 1) + d) AS u FROM cg WHERE NOT done) c0 {windows}) c1 {windows}) c2
      WINDOW field AS (PARTITION BY f)) c3) c4)
SELECT f, i, j, x, steps, top AS residual FROM cg WHERE done"""


#: probes and steps of the compared coefficients; on real fields a difference in rounding grows up to twentyfold a step, to 4e-10 at the fifth
PROBES, STEPS = 8, 5


def lanczos_sql(fields: str, steps: int = STEPS) -> str:
    """(f, step, alpha, beta) from (f, i, j, n_i, n_j, k, d, sign) on complete grids."""
    windows = "WINDOW by_i AS (PARTITION BY f, j ORDER BY i), by_j AS (PARTITION BY f, i ORDER BY j)"
    degree = "((i > 1)::INT + (i < n_i)::INT + (j > 1)::INT + (j < n_j)::INT)"
    return f"""
WITH RECURSIVE lz AS (
  SELECT f, i, j, n_i, n_j, k, d, sqrt(k * {degree} * ({degree} + 1) + d) AS root, sign / sqrt(n_i * n_j) AS q, 0.0::DOUBLE AS before,
    NULL::DOUBLE AS alpha, 0.0::DOUBLE AS beta, 0 AS step FROM {fields}
  UNION ALL
  SELECT f, i, j, n_i, n_j, k, d, root, (v - a * q) / nullif(b, 0), q, a, b, step + 1
  FROM (SELECT *, CASE WHEN vv - a * a > 1e-12 * vv THEN sqrt(vv - a * a) ELSE 0 END AS b
    FROM (SELECT *, sum(q * v) OVER field AS a, sum(v * v) OVER field AS vv
      FROM (SELECT *, (k * ({laplacian_by_windows("lap")}) + d * u) / root - beta * before AS v
        FROM (SELECT *, {laplacian_by_windows("u")} AS lap
          FROM (SELECT *, q / root AS u FROM lz WHERE step < {steps} AND q IS NOT NULL) c0 {windows}) c1 {windows}) c2
      WINDOW field AS (PARTITION BY f)) c3) c4)
SELECT f, step, max(alpha) AS alpha, max(beta) AS beta FROM lz WHERE step > 0 GROUP BY f, step"""


# every cell of the grid for every field; i and j are those of the grid, from 1
view("fx_fields", """
SELECT struct_pack(fold := fold, lead_time := lead_time, par := par) AS f, fold, lead_time, par, g.i, g.j, g.long, g.lat, n_i, n_j, q.k,
  coalesce(e.d, 0) AS d, e.y, coalesce(e.d * e.y, 0) AS b
FROM (SELECT fold, lead_time, par, max(k) AS k FROM fx_est WHERE y IS NOT NULL AND d > 0 GROUP BY fold, lead_time, par) q
CROSS JOIN (SELECT *, max(i) OVER () AS n_i, max(j) OVER () AS n_j FROM fx_grid) g
LEFT JOIN (SELECT fold, lead_time, par, long, lat, y, d FROM fx_est WHERE y IS NOT NULL AND d > 0) e USING (fold, lead_time, par, long, lat)
""")
view("fx_solved", gradients_sql("fx_fields"))
view("fx_cg", """
SELECT c.fold, c.lead_time, c.par, c.i, c.j, c.long, c.lat, c.y, nullif(c.d, 0) AS d, v.x, v.steps, v.residual
FROM fx_fields c JOIN fx_solved v ON c.f = v.f AND c.i = v.i AND c.j = v.j
""")

view("fx_cv", "SELECT fold AS year, lead_time, long, lat, CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, " + ", ".join(
    f"max(CASE WHEN par = '{p}' THEN y END) AS {p}_hat, max(CASE WHEN par = '{p}' THEN 1.0::DOUBLE / d END) AS var_{p}_hat, "
    f"max(CASE WHEN par = '{p}' THEN x END) AS {p}_smooth, max(CASE WHEN par = '{p}' THEN 1.0::DOUBLE / d END) AS {p}_smooth_var"
    for p in KAPPA) + " FROM fx_cg GROUP BY fold, lead_time, long, lat, i, j")

view("fx_left", """
SELECT long, lat, year, lead_time, obs,
  n / nullif(n - 1, 0) * (fcst - mz) AS fcst_anom, n / nullif(n - 1, 0) * (my - obs / n) AS ybar
FROM (SELECT *, CAST(count(*) OVER w AS DOUBLE) AS n, avg(fcst) OVER w AS mz, avg(obs) OVER w AS my
  FROM fx_daily WINDOW w AS (PARTITION BY long, lat, lead_time)) c
""")

view("fx_pred", """
SELECT c.*, h.obs, h.fcst_anom, h.ybar, cos(c.lat * pi() / 180) AS ww,
  c.alpha_hat + c.beta_hat * h.fcst_anom AS yhat, c.alpha_smooth + c.beta_smooth * h.fcst_anom AS ystar,
  c.var_alpha_hat + c.var_beta_hat * h.fcst_anom ** 2 + exp(2 * c.tau_hat) AS yhat_var,
  c.alpha_smooth_var + c.beta_smooth_var * h.fcst_anom ** 2 + exp(2 * c.tau_smooth) AS ystar_var
FROM fx_cv c JOIN fx_left h ON c.long = h.long AND c.lat = h.lat AND c.year = h.year AND c.lead_time = h.lead_time
""")


def weighted_mean_sql(x: str) -> str:
    return f"sum(ww * ({x})) / sum(CASE WHEN ({x}) IS NOT NULL THEN ww END)"


def weighted_se_sql(x: str) -> str:
    return (f"sqrt(greatest(0, {weighted_mean_sql(f'({x}) * ({x})')} - ({weighted_mean_sql(x)}) ** 2)) "
            f"/ sqrt(count({x}))")


view("fx_scores", "SELECT lead_time, " + ", ".join(
    f"{weighted_mean_sql(f'(obs - {c}) * (obs - {c})')} AS mse_{m}, {weighted_se_sql(f'(obs - {c}) * (obs - {c})')} AS mse_{m}_se"
    for m, c in (("hat", "yhat"), ("smooth", "ystar"), ("clim", "ybar"))) + " FROM fx_pred GROUP BY lead_time")

# ---- ensembles ----


def normal_sql(*keys: str) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    u = lambda start: f"CAST('0x' || substr(md5({text}), {start}, 8) AS BIGINT)"
    return f"(sqrt(-2.0 * ln(({u(1)} + 1) / 4294967297.0::DOUBLE)) * cos(2 * pi() * {u(9)} / 4294967296.0::DOUBLE))"


SAMPLES = 20

def uniform_sql(*keys: str) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


# ---- posterior draws: perturbed right sides, solved together ----

DRAWS = 500
DRAW_SEED = 7
DRAW_TOLERANCE = 1e-12

view("fx_est3w", " UNION ALL ".join(
    f"SELECT '{p}' AS par, long, lat, {p}_hat AS y, 1.0::DOUBLE / var_{p}_hat AS d, {k}::DOUBLE AS k FROM fx_mle3w WHERE {p}_hat IS NOT NULL AND var_{p}_hat > 0"
    for p, k in KAPPA.items()))
view("fx_perturbed", f"""
SELECT f, par, sample, i, j, n_i, n_j, k, d, d * y + sqrt(d) * z1 + sqrt(k) * ({laplacian_by_windows("z2")}) AS b
FROM (
  SELECT struct_pack(par := q.par, sample := sample) AS f, q.par, sample, g.i, g.j, n_i, n_j, q.k, coalesce(e.d, 0) AS d, coalesce(e.y, 0) AS y,
    {normal_sql(str(DRAW_SEED), "q.par", "g.i", "g.j", "sample", "'value'")} AS z1,
    {normal_sql(str(DRAW_SEED), "q.par", "g.i", "g.j", "sample", "'structure'")} AS z2
  FROM (SELECT par, max(k) AS k FROM fx_est3w GROUP BY par) q
  CROSS JOIN (SELECT *, max(i) OVER () AS n_i, max(j) OVER () AS n_j FROM fx_grid) g
  CROSS JOIN (SELECT CAST(unnest(range(1, {DRAWS + 1})) AS INT) AS sample) n
  LEFT JOIN fx_est3w e ON e.par = q.par AND e.long = g.long AND e.lat = g.lat) c
WINDOW by_i AS (PARTITION BY f, j ORDER BY i), by_j AS (PARTITION BY f, i ORDER BY j)
""")
view("fx_drawn", f"SELECT f.par AS par, f.sample AS sample, i, j, x AS value FROM ({gradients_sql('fx_perturbed', DRAW_TOLERANCE)}) v")

view("fx_train3w", "SELECT f.fold, d.* FROM fx_3w d JOIN fx_folds f ON d.year <> f.fold")
view("fx_loo3w", mle_sql("fx_train3w", "j, i, long, lat, fold"))
view("fx_draws_long", " UNION ALL ".join(
    f"SELECT fold, i, j, long, lat, '{p}' AS par, {p}_hat AS hat, var_{p}_hat AS var_hat FROM fx_loo3w" for p in KAPPA))
for _method, _seed in (("hat", "fold"), ("star", "fold + 1000")):
    view(f"fx_mle_draws_{_method}", f"""
SELECT fold, i, j, long, lat, par, sample, hat + sqrt(var_hat) * {normal_sql(_seed, "i", "j", "fold", "par", "sample")} AS value
FROM fx_draws_long CROSS JOIN (SELECT CAST(unnest(range(1, {SAMPLES + 1})) AS INT) AS sample) n
""")
    view(f"fx_params_{_method}", "SELECT fold, i, j, long, lat, sample, " + ", ".join(
        f"max(CASE WHEN par = '{p}' THEN value END) AS {p}" for p in KAPPA
    ) + f" FROM fx_mle_draws_{_method} GROUP BY fold, i, j, long, lat, sample")
view("fx_z3w", """
SELECT i, j, long, lat, year, obs AS y, n / nullif(n - 1, 0) * (fcst - m) AS z
FROM (SELECT *, CAST(count(*) OVER w AS DOUBLE) AS n, avg(fcst) OVER w AS m FROM fx_weekly
  WINDOW w AS (PARTITION BY i, j, long, lat)) c
""")
for _method in ("hat", "star"):
    view(f"fx_ens_{_method}", f"""
SELECT p.fold AS year, p.i, p.j, p.long, p.lat, p.sample, z.y,
  p.alpha + p.beta * z.z + exp(p.tau) * {normal_sql("p.fold", "p.i", "p.j", "p.fold", f"'noise{_method}'", "p.sample")} AS y_{_method}
FROM fx_params_{_method} p JOIN fx_z3w z ON p.i = z.i AND p.j = z.j AND p.fold = z.year
""")
    view(f"fx_err_{_method}", f"""
SELECT year, long, lat, avg(y_{_method}) AS y_{_method}_bar, max(y) AS obs,
  (avg(y_{_method}) - max(y)) ** 2 AS sqerr_{_method} FROM fx_ens_{_method} GROUP BY year, long, lat
""")

#: coordinates out of range, missing latitudes and repeated rows, planted
view("fx_misplaced", """
SELECT CASE WHEN (j + i + year) % 11 = 0 THEN long + 400 ELSE long END AS long,
  CASE WHEN i = 2 AND year = 1999 AND lead_time = 12 THEN NULL ELSE lat END AS lat, year, lead_time, obs, fcst FROM fx_daily
""")

view("fx_faulty", "SELECT * FROM fx_misplaced UNION ALL SELECT * FROM fx_misplaced WHERE lead_time = 9 AND year % 3 = 0")

view("fx_valid", "SELECT * FROM fx_faulty WHERE long BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")

view("fx_global", "SELECT CAST(-157.5 + 45 * j AS DOUBLE) AS long, CAST(-70 + 28 * i AS DOUBLE) AS lat, year, lead_time, fcst FROM fx_daily")

view("fx_mle_est", " UNION ALL ".join(
    f"SELECT lead_time, '{p}' AS par, long, lat, 1.0::DOUBLE / var_{p}_hat AS d, {k}::DOUBLE AS k FROM fx_mle WHERE {p}_hat IS NOT NULL AND var_{p}_hat > 0"
    for p, k in KAPPA.items()))
view("fx_probes", f"""
SELECT struct_pack(lead_time := q.lead_time, par := q.par, probe := probe) AS f, g.i, g.j, n_i, n_j, q.k, coalesce(e.d, 0) AS d,
  CASE WHEN {uniform_sql('5', 'q.lead_time', 'q.par', 'g.i', 'g.j', 'probe', "'probe'")} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign
FROM (SELECT lead_time, par, max(k) AS k FROM fx_mle_est GROUP BY lead_time, par) q
CROSS JOIN (SELECT *, max(i) OVER () AS n_i, max(j) OVER () AS n_j FROM fx_grid) g
CROSS JOIN (SELECT CAST(unnest(range(1, {PROBES + 1})) AS INT) AS probe) n
LEFT JOIN fx_mle_est e ON e.lead_time = q.lead_time AND e.par = q.par AND e.long = g.long AND e.lat = g.lat
""")
view("fx_lanczos", lanczos_sql("fx_probes"))
