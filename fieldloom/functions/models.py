"""Covariance models, as column expressions and as numpy functions.

A nested model is a list of components (sill, spatial model, spatial range, temporal model,
temporal range); one with a space-time ratio instead is a metric model of ds + ratio * dt.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Component(NamedTuple):
    sill: float
    space: str
    range_s: float
    time: str | None = None
    range_t: float | None = None
    ratio: float | None = None
    shape: float | None = None


NAMES = ("exponential", "gaussian", "spherical", "holecos", "nugget", "matern")


def full_name(name: str) -> str:
    """exponentialC, exponential or a beginning of it."""
    low = name.lower()
    for n in NAMES:
        if low.rstrip("c") and n.startswith(low.removesuffix("c")):
            return n
    raise ValueError(f"unknown covariance model {name!r}")


def parse(text: str, params: tuple) -> Component:
    """Component of a name such as exponentialC/gaussianC, exponentialCST or exponentialC."""
    if "/" in text:
        s, t = text.split("/")
        sill, rs, rt = params
        return Component(sill, full_name(s), rs, full_name(t), rt)
    if text.endswith("ST"):
        sill, r, ratio = params
        return Component(sill, full_name(text[:-2]), r, ratio=ratio)
    sill, r = params
    return Component(sill, full_name(text), r)


def check_consistent(components: list[Component]) -> None:
    kinds = {("separable" if c.time else "metric" if c.ratio is not None else "plain") for c in components}
    if len(kinds) > 1:
        raise ValueError(f"models of different kinds: {sorted(kinds)}")


def correlation(name: str, d: Column, a: float, shape: float | None = None) -> Column:
    """Correlation at a distance, as an expression."""
    if name == "exponential":
        return F.exp(-3.0 * d / a)
    if name == "gaussian":
        return F.exp(-3.0 * (d / a) * (d / a))
    if name == "spherical":
        u = d / a
        return F.when(d > a, 0.0).otherwise(1 - 1.5 * u + 0.5 * u * u * u)
    if name == "holecos":
        return F.cos(F.lit(math.pi) * d / a)
    if name == "nugget":
        return F.when(d == 0, 1.0).otherwise(0.0)
    if name == "matern":  # closed forms
        s = _matern_scale(shape) * d / a
        if shape == 0.5:
            return F.exp(-s)
        if shape == 1.5:
            return (1 + s) * F.exp(-s)
        if shape == 2.5:
            return (1 + s + s * s / 3) * F.exp(-s)
        raise ValueError("the expression has shapes 0.5, 1.5 and 2.5")
    raise ValueError(name)


def _matern_scale(shape: float) -> float:
    return math.sqrt(12 * shape) * 1.5 ** (1 / (4 * shape))


def bessel_k(nu: float, x: np.ndarray) -> np.ndarray:
    """Modified Bessel function of the second kind by quadrature of its cosh integral."""
    x = np.asarray(x, float)
    u, w = np.polynomial.legendre.leggauss(200)
    top = np.arccosh(1 + 745 / np.maximum(x, 1e-8))
    s = 0.5 * top[..., None] * (u + 1)
    return (np.exp(-x[..., None] * np.cosh(s)) * np.cosh(nu * s) * w).sum(-1) * 0.5 * top


def correlation_np(name: str, d: np.ndarray, a: float, shape: float | None = None) -> np.ndarray:
    if name == "exponential":
        return np.exp(-3 * d / a)
    if name == "gaussian":
        return np.exp(-3 * (d / a) ** 2)
    if name == "spherical":
        u = d / a
        return np.where(d > a, 0.0, 1 - 1.5 * u + 0.5 * u**3)
    if name == "holecos":
        return np.cos(np.pi * d / a)
    if name == "nugget":
        return (d == 0).astype(float)
    if name == "matern":
        s = _matern_scale(shape) * np.asarray(d, float) / a
        out = np.ones_like(s)
        on = s > 0
        out[on] = 2 ** (1 - shape) / math.gamma(shape) * s[on] ** shape * bessel_k(shape, s[on])
        return out
    raise ValueError(name)


def covariance(model: list[Component], ds: Column, dt: Column) -> Column:
    """Nested covariance at a spatial and a temporal distance."""
    check_consistent(model)
    total = F.lit(0.0)
    for c in model:
        if c.ratio is not None:
            part = correlation(c.space, ds + c.ratio * dt, c.range_s, c.shape)
        else:
            part = correlation(c.space, ds, c.range_s, c.shape)
            if c.time:
                part = part * correlation(c.time, dt, c.range_t)
        total = total + c.sill * part
    return total


def covariance_np(model: list[Component], ds: np.ndarray, dt: np.ndarray) -> np.ndarray:
    total = np.zeros(np.broadcast(ds, dt).shape)
    for c in model:
        if c.ratio is not None:
            part = correlation_np(c.space, ds + c.ratio * dt, c.range_s, c.shape)
        else:
            part = correlation_np(c.space, ds, c.range_s, c.shape)
            if c.time:
                part = part * correlation_np(c.time, dt, c.range_t)
        total = total + c.sill * part
    return total


def covariance_matrix(model: list[Component], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between points (x, y, t) of two sets."""
    ds = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    return covariance_np(model, ds, np.abs(a[:, None, 2] - b[None, :, 2]))


def anisotropic_range(a: float, ratio: float, theta: float, phi: Column) -> Column:
    """Range along azimuth phi of an ellipse with major axis theta (radians)."""
    d = phi - F.lit(theta)
    return F.lit(a * ratio) / F.sqrt(F.lit(ratio**2) * F.cos(d) * F.cos(d) + F.sin(d) * F.sin(d))


def rotate(x: Column, y: Column, degrees: float, clockwise: bool = False) -> tuple[Column, Column]:
    r = math.radians(-degrees if clockwise else degrees)
    c, s = F.lit(math.cos(r)), F.lit(math.sin(r))
    return x * c - y * s, x * s + y * c


def to_isotropic(x: Column, y: Column, degrees: float, ratio: float) -> tuple[Column, Column]:
    """Axes turned to the major direction, the minor one stretched by 1 / ratio."""
    u, v = rotate(x, y, -degrees)
    return u, v / ratio


def axes_3d(azimuth: float, dip: float, plunge: float) -> np.ndarray:
    """Rows: the principal axes after turns by azimuth about z, dip about the new y and plunge about the new x (degrees)."""
    a, d, p = map(math.radians, (azimuth, dip, plunge))
    about_z = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
    about_y = np.array([[math.cos(d), 0, -math.sin(d)], [0, 1, 0], [math.sin(d), 0, math.cos(d)]])
    about_x = np.array([[1, 0, 0], [0, math.cos(p), math.sin(p)], [0, -math.sin(p), math.cos(p)]])
    return about_x @ about_y @ about_z


def _combined(rows: np.ndarray, c: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    return tuple(sum((F.lit(float(k)) * v for k, v in zip(row[1:], c[1:], strict=True)), F.lit(float(row[0])) * c[0]) for row in rows)


def to_isotropic_3d(x: Column, y: Column, z: Column, angles: tuple[float, float, float], ratios: tuple[float, float]) -> tuple[Column, ...]:
    """Coordinates on the principal axes, the second and third stretched by 1 / their ratio to the first."""
    u, v, w = _combined(axes_3d(*angles), (x, y, z))
    return u, v / ratios[0], w / ratios[1]


def to_anisotropic_3d(u: Column, v: Column, w: Column, angles: tuple[float, float, float], ratios: tuple[float, float]) -> tuple[Column, ...]:
    """What ``to_isotropic_3d`` takes, back from what it gives."""
    return _combined(axes_3d(*angles).T, (u, v * ratios[0], w * ratios[1]))


def to_anisotropic(u: Column, v: Column, degrees: float, ratio: float) -> tuple[Column, Column]:
    return rotate(u, v * ratio, degrees)
