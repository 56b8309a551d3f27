"""Scalar column expressions: dates, lead times, text, area weights."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(x: Column) -> Column:
    """``x``, or null where it is zero; every divisor and log argument goes through it."""
    return F.nullif(x, F.lit(0.0))


def year_of(date: Column) -> Column:
    return F.year(date)


def epoch_to_date(seconds: Column) -> Column:
    """Epoch seconds -> UTC calendar date (the session zone must be UTC)."""
    return F.to_date(F.timestamp_seconds(seconds))


def lead_time_days(date: Column, start: Column) -> Column:
    return F.datediff(date, start)


def lead_time_yday(date: Column, start: Column) -> Column:
    """Day-of-year difference; wrong across a new year, kept as a legacy option."""
    return F.dayofyear(date) - F.dayofyear(start)


def lead_week(lead_time: Column) -> Column:
    return F.ceil(lead_time / F.lit(7.0)).cast("int")


def wrap_longitude(long: Column) -> Column:
    """0..360 -> -180..180; 180 itself stays."""
    return F.when(long > 180, long - 360).otherwise(long)


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(273.15)


def coslat(lat: Column) -> Column:
    """Relative area of a cell of a regular longitude-latitude grid."""
    return F.cos(F.radians(lat))


def encode_key(start: Column, veri: Column) -> Column:
    return F.concat_ws("::", start.cast("string"), veri.cast("string"))


def decode_key(key: Column) -> tuple[Column, Column]:
    """(start date, verifying date) of an ``encode_key`` value."""
    return F.to_date(F.substring(key, 1, 10)), F.to_date(F.substring(key, 13, 10))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_log_constant(df: float) -> float:
    """Log of the normalising constant of Student's t density."""
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)


def t_quantile(p: float, df: float = 19) -> float:
    """Quantile of Student's t: bisection on the integral of the density from 0."""
    if not 0 < p < 1:
        raise ValueError("p must lie strictly between 0 and 1")
    if p < 0.5:
        return -t_quantile(1 - p, df)
    constant = math.exp(t_log_constant(df))

    def upper_half(x: float, panels: int = 2000) -> float:
        # Simpson's rule after x = tan(angle), which keeps heavy tails short
        end = math.atan(x)
        step = end / panels
        total = 0.0
        for k in range(panels + 1):
            tangent = math.tan(k * step)
            value = constant * (1 + tangent**2 / df) ** (-(df + 1) / 2) * (1 + tangent**2)
            total += value * (1 if k in (0, panels) else 4 if k % 2 else 2)
        return total * step / 3

    lo, hi = 0.0, 1.0
    while upper_half(hi) < p - 0.5:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper_half(mid) < p - 0.5 else (lo, mid)
    return (lo + hi) / 2


def t_log_density(x: Column, df: float = 19) -> Column:
    return F.lit(t_log_constant(df)) - F.lit((df + 1) / 2) * F.ln(F.lit(1.0) + x * x / F.lit(float(df)))


def hash_normal(seed: Column | int, *keys: Column) -> Column:
    """Standard normal draw that depends only on the seed and the keys.

    Two 32-bit integers from the md5 of the key text, then Box-Muller. The same row gets the same draw
    under any partitioning and after any task retry.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]))
    u1 = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    u2 = F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")
    radius = F.sqrt(F.lit(-2.0) * F.ln((u1 + F.lit(1)) / F.lit(4294967297.0)))
    return radius * F.cos(F.lit(2 * math.pi) * u2 / F.lit(4294967296.0))


def hash_uniform(seed: Column | int, *keys: Column) -> Column:
    """Uniform draw strictly between 0 and 1 that depends only on the seed and the keys."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)


def step_bin(value: Column, lo: float, hi: float, steps: int) -> Column:
    """Index 0..steps-1 of the equal step holding the value; null outside [lo, hi]."""
    width = (hi - lo) / steps
    index = F.floor((value - F.lit(float(lo))) / F.lit(width)).cast("int")
    return F.when(value.between(lo, hi), F.least(index, F.lit(steps - 1)))
