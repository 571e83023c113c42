"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A published rational approximation of the normal distribution function (double precision).
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def density(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def cdf(x: Column) -> Column:
    a = F.abs(x)
    tail = F.when(a > 7.07, density(a) / a).otherwise(F.exp(-a * a / 2) * _horner(_TOP, a) / _horner(_BOTTOM, a))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def nonnegative(mean: Column, var: Column) -> tuple[Column, Column]:
    """Mean not below 0 and variance of the normal cut at 0; (0, 0) where nearly all of it is below."""
    z = mean / F.sqrt(var)
    p = cdf(z)
    lam = density(z) / p
    gone = p < 1e-12
    keep = F.when(var > 0, var * (1 - lam * (lam + z))).otherwise(F.lit(0.0))
    return F.when(gone, 0.0).otherwise(F.greatest(mean, F.lit(0.0))), F.when(gone, 0.0).otherwise(keep)
