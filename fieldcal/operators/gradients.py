"""Conjugate gradients over whole tables: (kappa R + D) x = b for every field at once, in DataFrame operations.

One row is one cell of one field. A step applies R to all fields by a single scatter of 13 stencil terms (the products of two grid
Laplacians, by arithmetic on the index), summed per cell with map-side combining, and two sums and a maximum per field. Both scalars
of a step come from the same pass (the recurrence keeps A p beside p), so a step is one scatter, one small aggregation, one join of the
per-field scalars, and one stored table. Nothing of a field has to fit a task. The system is preconditioned by its diagonal, and a
field leaves the iteration once its residual is small, so later steps touch the slow fields only.

A complete field of at most ``WITHIN`` cells takes the same steps inside one task, all such fields side by side: stored tables for each step
would cost more than its arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcal.functions.expressions import hash_normal
from fieldcal.operators.spatial import OFFSETS, grid_laplacian
from fieldcal.session import cut_lineage, scratch_path

TOLERANCE = 1e-10
MOST_STEPS = 400
#: side of the square tiles of a grid that meet the scalars of their field together
TILE = 64
#: cells of a field that is solved inside a task
WITHIN = TILE * TILE
_CARRIED = ("n_i", "n_j", "k", "d", "b", "x", "r", "p", "s", "g", "a", "u", "top", "steps")


def _degree(i: str, j: str) -> str:
    """Number of neighbours of a cell of the grid."""
    sides = (f"{i} > 1", f"{i} < n_i", f"{j} > 1", f"{j} < n_j")
    return "(" + " + ".join(f"if({side}, 1.0D, 0.0D)" for side in sides) + ")"


#: cells that two Laplacians reach: (di, dj, kind); 0 the cell itself, 1 its neighbours, 2 corners (two paths), 3 two cells away
REACH = [(0, 0, 0), *((a, b, 1) for a, b in OFFSETS), *((a, b, 2) for a in (1, -1) for b in (1, -1)), *((2 * a, 2 * b, 3) for a, b in OFFSETS)]


def diagonal() -> str:
    """Diagonal of kappa R + D as SQL over (i, j, n_i, n_j, k, d)."""
    return f"k * {_degree('i', 'j')} * ({_degree('i', 'j')} + 1.0D) + d"


def with_product(state: DataFrame, keys: Sequence[str], carried: Sequence[str] = _CARRIED) -> DataFrame:
    """``w`` = (kappa R + D) u; rows that are ``done`` send nothing. ``carried`` columns (with k, d and u) pass through."""
    reach = ", ".join(f"struct({di} AS di, {dj} AS dj, {kind} AS kind)" for di, dj, kind in REACH)
    spread = state.selectExpr("*", f"{_degree('i', 'j')} AS _own", f"inline(array({reach}))").where("kind = 0 or not done")
    spread = spread.selectExpr("*", "i + di AS _i", "j + dj AS _j")
    weight = f"CASE kind WHEN 0 THEN _own * (_own + 1.0D) WHEN 1 THEN -(_own + {_degree('_i', '_j')}) WHEN 2 THEN 2.0D ELSE 1.0D END"
    sent = spread.selectExpr(
        *keys, "_i AS i", "_j AS j", f"k * u * {weight} AS _sent", *[f"if(kind = 0, {c}, NULL) AS _{c}" for c in ("done", *carried)])
    summed = sent.groupBy(*keys, "i", "j").agg(
        F.max("_done").alias("done"), F.sum("_sent").alias("_sum"), *[F.max(f"_{c}").alias(c) for c in carried])
    return summed.where("done is not null").selectExpr(*keys, "i", "j", "done", *carried, "_sum + d * u AS w")


def every_tile() -> Column:
    """All tiles of a grid of _n_i by _n_j cells, one row each."""
    return F.expr(f"explode(sequence(0, cast((floor(_n_i / {TILE}) + 1) * (floor(_n_j / {TILE}) + 1) as int) - 1))")


def tile_of_cell() -> Column:
    return F.expr(f"cast(floor(i / {TILE}) * (floor(n_j / {TILE}) + 1) + floor(j / {TILE}) as int)")


def _laplacian(v: np.ndarray) -> np.ndarray:
    """Grid Laplacian: a cell times the number of its neighbours, less the neighbours."""
    out = np.zeros_like(v)
    for axis in (0, 1):
        rise = np.diff(v, axis=axis)
        before, after = [slice(None)] * 2, [slice(None)] * 2
        before[axis], after[axis] = slice(None, -1), slice(1, None)
        out[tuple(before)] -= rise
        out[tuple(after)] += rise
    return out


def solve_grid(k: np.ndarray, d: np.ndarray, b: np.ndarray, tolerance: float, most_steps: int) -> tuple[np.ndarray, float | None, int]:
    """The steps of ``solve`` on one field given as arrays over its grid: x, residual, steps."""
    neighbours = np.full(b.shape, 4.0)
    neighbours[0] -= 1
    neighbours[-1] -= 1
    neighbours[:, 0] -= 1
    neighbours[:, -1] -= 1
    scaling = k * neighbours * (neighbours + 1.0) + d
    x, r, p, s = np.zeros_like(b), b.copy(), np.zeros_like(b), np.zeros_like(b)
    gamma_before = alpha = residual = None
    scale = np.abs(b).max()
    for step in range(most_steps):
        residual = float(np.abs(r).max() / scale) if scale != 0 else None
        if residual is None or residual <= tolerance:
            return x, residual, step
        u = r / scaling
        w = _laplacian(_laplacian(k * u)) + d * u
        gamma, delta = (r * u).sum(), (w * u).sum()
        beta = 0.0 if gamma_before is None else gamma / gamma_before
        alpha = gamma / (delta - (0.0 if alpha is None else beta * gamma / alpha))
        p, s = u + beta * p, w + beta * s
        x, r = x + alpha * p, r - alpha * s
        gamma_before = gamma
    return x, residual, most_steps


def _solve_within(keys: Sequence[str], schema: T.StructType, tolerance: float, most_steps: int):
    def run(field: pa.Table) -> pa.Table:
        i, j = (field.column(c).to_numpy().astype(np.int64) - 1 for c in ("i", "j"))
        grid = np.empty((3, int(field.column("n_i")[0].as_py()), int(field.column("n_j")[0].as_py())))
        for plane, name in zip(grid, ("k", "d", "b")):
            plane[i, j] = field.column(name).to_numpy()
        x, residual, steps = solve_grid(*grid, tolerance, most_steps)
        n = field.num_rows
        solved = [(x[i, j], pa.float64()), (np.full(n, np.nan if residual is None else residual), pa.float64()), (np.full(n, steps), pa.int32())]
        solved = [pa.array(values, kind) for values, kind in solved]
        if residual is None:
            solved[1] = pa.nulls(n, pa.float64())
        return pa.table([*[field.column(c) for c in keys], pa.array(i + 1, pa.int32()), pa.array(j + 1, pa.int32()), *solved], names=schema.names)
    return run


def solve(
    fields: DataFrame, keys: Sequence[str], tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS, within: int | None = None
) -> DataFrame:
    """Solutions of (k R + d) x = b: (keys, i, j, x, residual, steps).

    ``fields`` holds keys, i, j, n_i, n_j, k, d, b for every cell of every field. ``residual`` is the largest entry of b - A x beside
    that of b; a field is left at ``tolerance``, or after ``most_steps`` with the residual it has reached. A field whose weights are
    all zero has no unique solution and must not be given. Keys may have any names but i, j, n_i, n_j, k, d, b, x, residual and steps.
    Complete fields of at most ``within`` cells (``WITHIN`` by default) are solved inside tasks, all others by table.
    """
    # the state has short names of its own
    given_keys, keys = list(keys), [f"_key{n}" for n in range(len(keys))]
    fields = fields.withColumnsRenamed(dict(zip(given_keys, keys)))
    fields = cut_lineage(fields.select(*keys, "i", "j", *[F.col(c).cast("double").alias(c) for c in ("n_i", "n_j", "k", "d", "b")]))
    cells = F.count("*")
    complete = [cells == F.max("n_i") * F.max("n_j"), cells == F.count_distinct("i", "j")]
    complete += [F.min(c) >= 1 for c in ("i", "j")] + [F.max(c) <= F.min(f"n_{c}") for c in ("i", "j")]
    complete += [F.min(c) == F.max(c) for c in ("n_i", "n_j")] + [cells == F.count(c) for c in ("k", "d", "b")]
    fits = cells <= (WITHIN if within is None else within)
    for rule in complete:
        fits &= rule
    # a join by the keys leaves out fields with a null key, as the steps by table do
    sizes = cut_lineage(fields.groupBy(*keys).agg(F.coalesce(fits, F.lit(False)).alias("fits")))
    schema = T.StructType([
        *[fields.schema[c] for c in keys], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("x", T.DoubleType()),
        T.StructField("residual", T.DoubleType()), T.StructField("steps", T.IntegerType())])
    small = fields.join(sizes.where("fits").drop("fits"), keys)
    solved = small.groupBy(*keys).applyInArrow(_solve_within(keys, schema, tolerance, most_steps), schema)
    solved = cut_lineage(solved)
    large = sizes.where("not fits").drop("fits")
    if not large.isEmpty():
        solved = solved.unionByName(_solve_by_table(fields.join(large, keys), keys, tolerance, most_steps))
    return solved.withColumnsRenamed(dict(zip(keys, given_keys)))


def _solve_by_table(fields: DataFrame, keys: Sequence[str], tolerance: float, most_steps: int) -> DataFrame:
    """``solve`` for fields of any size, a stored table a step."""
    spark = fields.sparkSession
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    state = fields.withColumns(
        {"x": zero, "r": F.col("b"), "p": zero, "s": zero, "g": none, "a": none, "top": none, "steps": zero, "done": F.lit(False)})
    paths = []
    for step in range(most_steps + 1):
        path, watch = scratch_path(spark, "gradients"), Observation()
        given = with_product(state.withColumn("u", F.expr(f"r / ({diagonal()})")), keys)
        given.observe(watch, F.count_if(~F.col("done")).alias("open")).write.parquet(path)
        paths.append(path)
        stored = spark.read.schema(given.schema).parquet(path)
        if not watch.get.get("open", 0) or step == most_steps:
            break
        state = _step(stored.where("not done"), keys, tolerance)
    finished = spark.read.schema(given.schema).parquet(*paths).where("done")
    if step == most_steps:
        finished = finished.unionByName(stored.where("not done"))
    return finished.select(
        *keys, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "x", F.col("top").alias("residual"),
        F.col("steps").cast("int").alias("steps"))


def _step(rows: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """One step of all fields, from the rows with u and w = A u; fields at rest keep x and are ``done``.

    The scalars of a field go to each tile of its grid. Joined by field alone, a large field would be shuffled into one task, and stay
    there for the scatter, as rows dealt by field count as dealt by field and cell.
    """
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("r") * F.col("u")).alias("gamma"), F.sum(F.col("w") * F.col("u")).alias("delta"),
        F.max(F.abs("r")).alias("_rest"), F.max(F.abs("b")).alias("_scale"), F.max("n_i").alias("_n_i"), F.max("n_j").alias("_n_j"),
    ).withColumn("_tile", every_tile())
    rows = rows.withColumn("_tile", tile_of_cell())
    top = "_rest / nullif(_scale, 0.0D)"
    still = f"coalesce({top} <= {tolerance!r}D, true)"
    beta = "coalesce(gamma / g, 0.0D)"
    now = rows.join(sums, [*keys, "_tile"]).selectExpr(
        *keys, "i", "j", "n_i", "n_j", "k", "d", "b", "x", "r", f"u + {beta} * p AS p", f"w + {beta} * s AS s", "gamma AS g",
        f"gamma / (delta - coalesce({beta} * gamma / a, 0.0D)) AS a", f"{top} AS top", "steps", f"{still} AS done")
    return now.selectExpr(
        *keys, "i", "j", "n_i", "n_j", "k", "d", "b", "if(done, x, x + a * p) AS x", "if(done, r, r - a * s) AS r", "p", "s", "g", "a", "top",
        "if(done, steps, steps + 1) AS steps", "done")


def whole_fields(est: DataFrame, kappa: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Every cell of the grid for every field that has a weight: keys, i, j, n_i, n_j, k, d, y; cells without an estimate weigh 0.

    ``est`` has (keys, i, j, n_i, n_j, value, weight); ``par`` is one of the keys.
    """
    by_par = F.create_map(*[F.lit(x) for pair in kappa.items() for x in pair])
    usable = est.where("value is not null and weight > 0").select(*keys, "i", "j", "n_i", "n_j", "value", "weight")
    shapes = usable.groupBy(*keys).agg(F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"))
    lines = shapes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_i").cast("int"))))
    # dealt by line, or the join would keep a field in one task
    cells = lines.repartition(*keys, "i").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n_j").cast("int"))))
    return cells.join(usable.drop("n_i", "n_j"), [*keys, "i", "j"], "left").select(
        *keys, "i", "j", "n_i", "n_j", F.try_element_at(by_par, F.col("par")).cast("double").alias("k"),
        F.coalesce("weight", F.lit(0.0)).alias("d"), F.coalesce("value", F.lit(0.0)).alias("y"))


def smooth(est: DataFrame, kappa: dict[str, float], keys: Sequence[str], tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> DataFrame:
    """Posterior mean of every field: (keys, i, j, value, weight, smooth, residual, steps); value null where there is no estimate."""
    fields = cut_lineage(whole_fields(est, kappa, keys))
    solved = solve(fields.withColumn("b", F.col("d") * F.col("y")), keys, tolerance, most_steps)
    shown = fields.select(
        *keys, "i", "j", F.when(F.col("d") > 0, F.col("y")).alias("value"), F.when(F.col("d") > 0, F.col("d")).alias("weight"))
    return shown.join(solved.withColumnRenamed("x", "smooth"), [*keys, "i", "j"])


def perturbed(fields: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Right sides of ``n`` posterior draws of every field: ``fields`` once per ``sample`` with b = d y + sqrt(d) z1 + sqrt(k) T z2.

    T is the grid Laplacian and R = T T, so b has mean D y and covariance D + kappa R, which makes (kappa R + D)^-1 b a draw from the
    posterior. z1 and z2 are hash normals of seed, keys, cell and sample.
    """
    cell = [*[F.col(c) for c in keys], F.col("i"), F.col("j"), F.col("sample")]
    rows = fields.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns({
        "z1": hash_normal(seed, *cell, F.lit("value")), "z2": hash_normal(seed, *cell, F.lit("structure"))})
    spread = grid_laplacian(rows, "z2", [*keys, "sample"], "_tz", ["n_i", "n_j", "k", "d", "y", "z1"])
    return spread.withColumn("b", F.expr("d * y + sqrt(d) * z1 + sqrt(k) * _tz")).drop("_tz", "z1")


def sample(
    est: DataFrame, kappa: dict[str, float], keys: Sequence[str], n: int, seed: int, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS
) -> DataFrame:
    """``n`` posterior draws of every field at fixed precisions: (keys, sample, i, j, value, residual).

    All draws of all fields are one system, solved together; nothing is factorised and no field has to fit a task.
    """
    fields = cut_lineage(whole_fields(est, kappa, keys))
    solved = solve(perturbed(fields, keys, n, seed), [*keys, "sample"], tolerance, most_steps)
    return solved.select(*keys, "sample", "i", "j", F.col("x").alias("value"), "residual")


def moments_of_draws(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Posterior mean and variance of every cell over its draws, combined on the map side."""
    return draws.groupBy(*keys, "i", "j").agg(
        F.count("value").alias("draws"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
