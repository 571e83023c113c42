"""Soft data as column expressions: a density is limits ``limi`` and ``probdens`` at them.

Type 2 densities are linear between limits, type 1 constant between them (one density fewer),
type 10 is a Gaussian of mean and variance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nodes of the polygon that stands for a Gaussian, in standard deviations.
GAUSS_NODES = (-3.719, -3.090, -2.326, -1.645, -0.524, -0.253, 0.0, 0.253, 0.524, 1.645, 2.326, 3.090, 3.719)
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
TYPE_CODES = {"h": 1, "li": 2, "g": 10, "n": 10}


def type_code(name: str | int) -> int:
    """1 histogram, 2 linear, 10 Gaussian, from a code or the beginning of a name."""
    if name in (1, 2, 10):
        return int(name)
    for k, v in TYPE_CODES.items():
        if str(name).lower().startswith(k):
            return v
    raise ValueError(f"unknown soft data type {name!r}")


def order_code(name: str | float | None) -> float | int:
    """NaN for a zero mean, 0 for a constant one."""
    if name is None or name == "Zero Mean" or (isinstance(name, float) and math.isnan(name)):
        return math.nan
    if name in ("Constant Mean", 0):
        return 0
    raise ValueError(f"unknown order {name!r}")


def _segments(limi: Column, f) -> Column:
    """Sum of f(i) over the segments 0 .. size - 2."""
    return F.aggregate(F.sequence(F.lit(0), F.size(limi) - 2), F.lit(0.0), lambda s, i: s + f(i))


def area(limi: Column, p: Column) -> Column:
    """Area below a linear density."""
    return _segments(limi, lambda i: (F.get(p, i) + F.get(p, i + 1)) * (F.get(limi, i + 1) - F.get(limi, i)) / 2)


def normalise(limi: Column, p: Column) -> Column:
    def each(q: Column) -> Column:
        return _once(_once(limi, lambda m: area(m, q)), lambda a: F.transform(q, lambda v: v / a))

    return _once(p, each)


def gaussian_limits(mean: Column, var: Column) -> Column:
    return F.transform(F.array(*map(F.lit, GAUSS_NODES)), lambda k: mean + F.sqrt(var) * k)


def gaussian_density(mean: Column, var: Column) -> Column:
    """Densities at ``gaussian_limits``, normalised as a polygon."""
    raw = F.transform(F.array(*map(F.lit, GAUSS_NODES)), lambda k: F.exp(-k * k / 2) / F.sqrt(F.lit(2 * math.pi) * var))
    return normalise(gaussian_limits(mean, var), raw)


def uniform_limits(low: Column, up: Column) -> Column:
    return F.transform(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))), lambda k: low + (up - low) * k)


def uniform_density(low: Column, up: Column) -> Column:
    limi = uniform_limits(low, up)
    return normalise(limi, F.transform(limi, lambda _: 1 / (up - low)))


def uniform_two_nodes(low: Column, up: Column) -> tuple[Column, Column]:
    return F.array(low, up), F.array(1 / (up - low), 1 / (up - low))


def _moment(limi: Column, p: Column, order: int, kind: int) -> Column:
    """E[X**order]: closed form per segment; segments of no width add nothing."""

    def one(i: Column) -> Column:
        a, b = F.get(limi, i), F.get(limi, i + 1)
        n = order
        if kind == 1:
            return F.get(p, i) * (F.pow(b, F.lit(n + 1)) - F.pow(a, F.lit(n + 1))) / (n + 1)
        slope = (F.get(p, i + 1) - F.get(p, i)) / (b - a)
        level = F.get(p, i) - slope * a
        return F.when(b > a, slope * (F.pow(b, F.lit(n + 2)) - F.pow(a, F.lit(n + 2))) / (n + 2) + level * (F.pow(b, F.lit(n + 1)) - F.pow(a, F.lit(n + 1))) / (n + 1)).otherwise(0.0)

    return _segments(limi, one)


def mean(limi: Column, p: Column, kind: int = 2) -> Column:
    return _moment(limi, p, 1, kind)


def variance(limi: Column, p: Column, kind: int = 2) -> Column:
    m = _moment(limi, p, 1, kind)
    return _moment(limi, p, 2, kind) - m * m


def _once(value: Column, f) -> Column:
    """f of a value that is computed once and then only named."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cdf(limi: Column, p: Column) -> Column:
    """Array of the distribution function at the limits, ending at 1."""
    steps = F.transform(F.sequence(F.lit(0), F.size(limi) - 2), lambda i: (F.get(p, i) + F.get(p, i + 1)) * (F.get(limi, i + 1) - F.get(limi, i)) / 2)
    sums = F.aggregate(steps, F.array(F.lit(0.0)), lambda c, s: F.array_append(c, F.element_at(c, -1) + s))
    return _once(sums, lambda c: F.transform(c, lambda v: v / F.element_at(c, -1)))


def _segment(c: Column, q: float) -> Column:
    """Number of the segment that holds a probability."""
    return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0), lambda s, k: F.when(F.get(c, k) <= q, k).otherwise(s))


def quantiles(limi: Column, p: Column, at: tuple[float, ...] = QUANTILES) -> Column:
    """Quantiles by linear interpolation of the distribution function between limits."""

    def one(c: Column, q: float) -> Column:
        def within(i: Column) -> Column:
            a, b = F.get(c, i), F.get(c, i + 1)
            return F.get(limi, i) + F.when(b > a, (q - a) / (b - a)).otherwise(0.0) * (F.get(limi, i + 1) - F.get(limi, i))

        return _once(_segment(c, q), within)

    return _once(cdf(limi, p), lambda c: F.array(*(one(c, q) for q in at)))


def inverse_cdf(limi: Column, p: Column, q: float) -> Column:
    """Exact quantile: solves the quadratic within the segment."""

    def within(c: Column, i: Column) -> Column:
        a, b = F.get(limi, i), F.get(limi, i + 1)
        p0, p1 = F.get(p, i) / area(limi, p), F.get(p, i + 1) / area(limi, p)
        slope, rest = (p1 - p0) / (b - a), q - F.get(c, i)
        return a + F.when(F.abs(slope) < 1e-12, rest / p0).otherwise((F.sqrt(F.greatest(p0 * p0 + 2 * slope * rest, F.lit(0.0))) - p0) / slope)

    return _once(cdf(limi, p), lambda c: _once(_segment(c, q), lambda i: within(c, i)))


def density_at(limi: Column, p: Column, v: Column, kind: int = 2) -> Column:
    """The density at a value, 0 outside the limits."""
    i = F.aggregate(F.sequence(F.lit(0), F.size(limi) - 2), F.lit(0), lambda s, k: F.when(F.get(limi, k) <= v, k).otherwise(s))
    a, b = F.get(limi, i), F.get(limi, i + 1)
    inside = (v >= F.get(limi, F.lit(0))) & (v <= F.get(limi, F.size(limi) - 1))
    value = F.get(p, i) if kind == 1 else F.get(p, i) + (F.get(p, i + 1) - F.get(p, i)) * (v - a) / (b - a)
    return F.when(inside, value).otherwise(0.0)


def offset(limi: Column, by: Column, kind: int = 2) -> Column:
    """Limits less a trend; those of types 3 and 4 are start, step and end, and the step stays."""
    if kind in (3, 4):
        return F.transform(limi, lambda v, i: F.when(i == 1, v).otherwise(v - by))
    return F.transform(limi, lambda v: v - by)


def even_limits(limi: Column) -> Column:
    """All limits of types 3 and 4 (start, step, end), which makes them types 1 and 2."""
    start, step, end = (F.get(limi, F.lit(i)) for i in range(3))
    return F.transform(F.sequence(F.lit(0), F.round((end - start) / step).cast("int")), lambda i: start + i * step)


def as_linear(kind: Column, limi: Column, p: Column, mean_: Column, var: Column) -> Column:
    """The normalised record of type 2 of a datum of type 2 (its limits) or 10 (its mean and variance)."""
    gaussian = record(F.lit(2), gaussian_limits(mean_, var), gaussian_density(mean_, var))
    return F.when(kind == 10, gaussian).when(kind == 2, record(F.lit(2), limi, normalise(limi, p)))


def record(kind: Column, limi: Column, p: Column) -> Column:
    """The normalised record of a soft datum."""

    def made(m: Column, q: Column) -> Column:
        return F.struct(kind.cast("int").alias("pdf_type"), F.size(m).alias("nl"), m.alias("limi"), q.alias("probdens"), mean(m, q).alias("mean"), variance(m, q).alias("var"))

    return _once(limi, lambda m: _once(p, lambda q: made(m, q)))
