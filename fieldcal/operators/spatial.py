"""Second-order random-walk algebra on the index grid, as scatter-and-sum over cells.

T is the graph Laplacian of the grid, R = T'T. A cell sends its value to its neighbours and the sums are taken per cell: one
map-side-combined aggregation and no join. Fields carry the index columns ``i`` (latitude) and ``j`` (longitude).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcal.session import cut_lineage

OFFSETS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def grid_shape(grid: DataFrame) -> Column:
    """Struct (n_i, n_j) of a complete index grid, as a scalar subquery."""
    return grid.agg(F.struct(F.max("i").alias("n_i"), F.max("j").alias("n_j"))).scalar()


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Attach (i, j, s) by coordinates, and the grid's shape. The grid has one row per cell of the region."""
    return df.join(grid.select("long", "lat", "i", "j", "s"), ["long", "lat"]).withColumn(
        "_shape", grid_shape(grid)
    ).select("*", "_shape.n_i", "_shape.n_j").drop("_shape")


def neighbours(grid: DataFrame) -> DataFrame:
    """(s, s_neighbour) pairs of the 4-neighbour stencil, by arithmetic on the index."""
    near = F.array(*[F.struct((F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj")) for di, dj in OFFSETS])
    cells = grid.select("i", "j", "s", grid_shape(grid).alias("shape")).select("s", "shape", F.inline(near))
    return cells.filter(
        F.col("ni").between(1, F.col("shape.n_i")) & F.col("nj").between(1, F.col("shape.n_j"))
    ).select("s", ((F.col("nj") - 1) * F.col("shape.n_i") + F.col("ni")).cast("int").alias("s_neighbour"))


def rw2d_structure(grid: DataFrame) -> DataFrame:
    """R as triplets (row, col, value): every cell contributes the products of its own stencil row of T."""
    shape, i, j = F.col("shape"), F.col("i"), F.col("j")
    inside = {
        (di, dj): (i + di).between(1, shape["n_i"]) & (j + dj).between(1, shape["n_j"]) for di, dj in OFFSETS
    }
    degree = sum((F.when(ok, 1.0).otherwise(0.0) for ok in inside.values()), F.lit(0.0))
    index = lambda di, dj: ((j + dj - 1) * shape["n_i"] + i + di).cast("int")
    own = F.struct(index(0, 0).alias("s"), degree.alias("t"))
    others = [F.when(ok, F.struct(index(di, dj).alias("s"), F.lit(-1.0).alias("t"))) for (di, dj), ok in inside.items()]
    stencil = F.filter(F.array(own, *others), lambda e: e.isNotNull())
    rows = grid.select("i", "j", grid_shape(grid).alias("shape")).select(stencil.alias("stencil"))
    rows = rows.select("stencil", F.explode("stencil").alias("a")).select("a", F.explode("stencil").alias("b"))
    summed = rows.groupBy(F.col("a.s").alias("row"), F.col("b.s").alias("col")).agg(
        F.sum(F.col("a.t") * F.col("b.t")).alias("value")
    )
    return summed.filter("value <> 0")


def grid_laplacian(
    field: DataFrame, value: str, groups: Sequence[str] = (), out: str = "lap", carry: Sequence[str] = ()
) -> DataFrame:
    """``out`` = sum over present neighbours of (value - neighbour); ``carry`` columns (doubles) pass through.

    When the field is already partitioned by (some of) ``groups`` the aggregation needs no further shuffle.
    """
    kept = [value, *[c for c in carry if c != value]]
    own = ", ".join(f"{c} AS _own_{c}" for c in kept)
    blank = ", ".join(f"CAST(NULL AS DOUBLE) AS _own_{c}" for c in kept)
    parts = [f"struct(i, j, 1 AS _mine, CAST(NULL AS DOUBLE) AS _near, {own})"] + [
        f"struct(i + {di} AS i, j + {dj} AS j, 0 AS _mine, {value} AS _near, {blank})" for di, dj in OFFSETS
    ]
    sent = field.selectExpr(*groups, f"inline(array({', '.join(parts)}))")
    summed = sent.groupBy(*groups, "i", "j").agg(
        F.max("_mine").alias("_mine"),
        F.sum("_near").alias("_near"),
        F.count("_near").alias("_count"),
        *[F.max(f"_own_{c}").alias(c) for c in kept],
    )
    return summed.filter("_mine = 1").selectExpr(
        *groups, "i", "j", *kept, f"_count * {value} - coalesce(_near, 0.0D) AS {out}"
    )


def roughness(field: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """v' R v per group: the sum of the squared Laplacian."""
    lap = grid_laplacian(field, value, groups)
    return lap.groupBy(*groups).agg(F.sum(F.col("lap") * F.col("lap")).alias("roughness"))


def smooth_fixed_steps(
    est: DataFrame,
    kappa: dict[str, float],
    groups: Sequence[str],
    steps: int = 2,
    checkpoint_every: int = 5,
    field_per_task: bool = True,
) -> DataFrame:
    """``steps`` gradient steps towards the solution of (kappa R + D) x = D y, for all groups at once.

    ``est`` holds (groups, par, i, j, value, weight). Each step is x <- x - w (kappa R x + D (x - y)) with
    w = 1 / (64 kappa + max D): 64 bounds the largest eigenvalue of R. The result has the column ``smooth``.

    The rows are partitioned by (groups, par) once; a field is one grid, so it fits a task, and every Laplacian of every step
    then runs without a shuffle. ``field_per_task=False`` is for grids too large for that: cells of a field spread over
    all tasks and each Laplacian shuffles its partial sums.
    """
    keys = [*groups, "par"]
    by_par = F.create_map(*[F.lit(x) for pair in kappa.items() for x in pair])
    start = est.filter("value is not null and weight is not null").select(
        *keys, "i", "j", F.col("value").alias("y"), F.col("weight").alias("d"), F.col("value").alias("x"),
        F.try_element_at(by_par, F.col("par")).cast("double").alias("k"),
    )
    if field_per_task:
        start = start.repartition(*keys).withColumn("_top", F.max("d").over(Window.partitionBy(*keys)))
    else:
        start = start.join(start.groupBy(*keys).agg(F.max("d").alias("_top")), keys)
    now = start.withColumn("w", F.lit(1.0) / (F.lit(64.0) * F.col("k") + F.col("_top"))).drop("_top")
    for step in range(1, steps + 1):
        once = grid_laplacian(now, "x", keys, "lap", ["y", "d", "k", "w"])
        twice = grid_laplacian(once, "lap", keys, "lap2", ["x", "y", "d", "k", "w"])
        now = twice.selectExpr(*keys, "i", "j", "x - w * (k * lap2 + d * (x - y)) AS x", "y", "d", "k", "w")
        if step % checkpoint_every == 0 and step < steps:
            now = cut_lineage(now)
            now = now.repartition(*keys) if field_per_task else now
    return now.select(*keys, "i", "j", F.col("y").alias("value"), F.col("d").alias("weight"), F.col("x").alias("smooth"))
