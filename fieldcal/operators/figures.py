"""The tables behind the figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcal.functions.expressions import step_bin
from fieldcal.operators.filters import filter_region
from fieldcal.operators.reshape import PARAMETERS, recode

# Fixed values: (from, to, number of steps) of each map's colour scale.
STEPS = {"cor": (-1.0, 1.0, 5), "bias": (-5.0, 5.0, 10), "beta0_hat": (-10.0, 45.0, 11), "sigma_hat": (0.0, 5.0, 10),
         "beta1_hat": (-1.0, 1.0, 10)}
METHOD_LABELS = {"hat": "maximum likelihood", "smooth": "posterior mean"}


def step_binned_map(df: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_step`` for each map column."""
    return df.withColumns({f"{c}_step": step_bin(F.col(c), *STEPS[c]) for c in columns})


def interval_table(df: DataFrame, estimate: str, variance: str) -> DataFrame:
    """Estimate with limits two standard deviations away."""
    width = F.lit(2.0) * F.sqrt(variance)
    return df.withColumns({"lower": F.col(estimate) - width, "upper": F.col(estimate) + width})


def method_compare_long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both methods' parameters as (par, type, value) rows with display labels."""
    names = [f"{p}_{m}" for p in PARAMETERS for m in METHOD_LABELS]
    rows = df.select(*keys, *names).unpivot(list(keys), names, "name", "value")
    parts = F.split("name", "_")
    return rows.select(*keys, parts[0].alias("par"), recode(parts[1], METHOD_LABELS).alias("type"), "value")


def regression_lines(cv: DataFrame, hindcast: DataFrame, box: Sequence[float], year: int, lead: int) -> DataFrame:
    """Fitted lines on the raw forecast scale, for the cells of a box, one fold and one lead time.

    Both inputs are cut to the box before the join, so the mean forecasts are one row per cell of the box.
    """
    params = cv.transform(filter_region(box)).filter((F.col("year") == year) & (F.col("lead_time") == lead))
    xbar = hindcast.transform(filter_region(box)).filter(F.col("lead_time") == lead).groupBy("long", "lat").agg(
        F.avg("fcst").alias("xbar")
    )
    joined = params.join(xbar, ["long", "lat"])
    lines = {}
    for method, kind in (("hat", "hat"), ("smooth", "smooth")):
        lines[f"intercept_{method}"] = F.col(f"alpha_{kind}") - F.col(f"beta_{kind}") * F.col("xbar")
        lines[f"slope_{method}"] = F.col(f"beta_{kind}")
    return joined.select("long", "lat", "xbar", *[c.alias(n) for n, c in lines.items()])


def sd_by_method(long_parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Standard deviations of both methods side by side."""
    wide = long_parameters.groupBy(*keys).pivot("method", ["likelihood", "posterior"]).agg(F.first("variance"))
    return wide.select(*keys, F.sqrt("likelihood").alias("sd_likelihood"), F.sqrt("posterior").alias("sd_posterior"))
