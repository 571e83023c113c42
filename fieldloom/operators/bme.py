"""Posterior mean, variance and third moment at a point from exact and uncertain data nearby.

Everything about one neighbourhood is small and dense, so it is numpy on rows that carry their
neighbours; finding the neighbours and everything around it is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.models import Component, covariance_matrix
from fieldloom.operators.interpolate import covariance_stack, each_or_none, krige_many, neighbour_stacks
from fieldloom.operators.neighbours import nearest

CELL = ["x", "y", "t"]
SOFT = ["pdf_type", "limi", "probdens", "mean", "var"]
TINY = 1e-12
_LEGENDRE = np.polynomial.legendre.leggauss(12)


@dataclass(frozen=True)
class Options:
    order: int | None = None  # None: zero mean; 0: mean of the neighbourhood's values
    gaussian: bool = False  # soft data as Gaussians of their mean and variance
    max_soft: int = 20  # beyond, soft data are taken as Gaussians
    max_eval: int = 10_000
    rel_tol: float = 1e-3
    abs_tol: float = 1e-4
    kept_variance: float = 0.999
    assimilate: bool = False  # merge data that add nothing of their own into those that are kept
    budget: int | None = None  # data kept at most when assimilating


def lattice_points(n: int, dim: int, skip: int = 0) -> np.ndarray:
    """Points of an additive-recurrence lattice (powers of the generalised golden ratio)."""
    g = 2.0
    for _ in range(60):
        g = (1 + g) ** (1 / (dim + 1))
    alpha = (1 / g) ** np.arange(1, dim + 1)
    return (np.arange(skip + 1, skip + n + 1)[:, None] * alpha[None, :]) % 1.0


def qmc(f: Callable[[np.ndarray], np.ndarray], dim: int, max_eval: int = 10_000, rel_tol: float = 1e-3, abs_tol: float = 1e-4, shifts: int = 8) -> tuple[np.ndarray, np.ndarray, int]:
    """(integral over the unit cube, error, evaluations) by a randomly shifted lattice, doubled until it is good enough.

    ``f`` maps points (n, dim) to values (n,) or (n, m); all values have to reach the tolerance.
    """
    move = np.random.default_rng(1).random((shifts, dim))
    top = 2 ** min(round(math.log2(max(max_eval / shifts, 32))), 20)
    n, done, total = 32, 0, None
    while True:
        p = lattice_points(n - done, dim, done)
        part = np.stack([np.asarray(f((p + m) % 1.0), float).reshape(n - done, -1).sum(0) for m in move])
        total = part if total is None else total + part
        done = n
        each = total / n
        value, error = each.mean(0), each.std(0, ddof=1) / math.sqrt(shifts)
        if (error <= np.maximum(abs_tol, rel_tol * np.abs(value))).all() or n >= top:
            return value, error, n * shifts
        n *= 2


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function: rational start, one Newton step on erfc."""
    from statistics import NormalDist

    grid = _normal_quantile.__dict__.setdefault("grid", None)
    if grid is None:
        q = np.r_[np.logspace(-14, -3, 4000), np.linspace(1e-3, 1 - 1e-3, 40_001)[1:-1], 1 - np.logspace(-3, -14, 4000)]
        inv = NormalDist().inv_cdf
        grid = _normal_quantile.__dict__["grid"] = (q, np.array([inv(float(v)) for v in q]))
    return np.interp(np.clip(u, 1e-14, 1 - 1e-14), *grid)


def soft_moments(s: dict) -> tuple[float, float]:
    """Mean and variance of a soft datum's density."""
    if s["pdf_type"] == 10:
        return s["mean"], s["var"]
    a, p = np.array(s["limi"], float), np.array(s["probdens"], float)
    m = [_polygon_moment(a, p, k, s["pdf_type"]) for k in range(3)]
    mean = m[1] / m[0]
    return mean, m[2] / m[0] - mean * mean


def _polygon_moment(a: np.ndarray, p: np.ndarray, k: int, kind: int) -> float:
    lo, hi = a[:-1], a[1:]
    on = hi > lo
    lo, hi = lo[on], hi[on]
    if kind == 1:
        return float((p[: len(on)][on] * (hi ** (k + 1) - lo ** (k + 1)) / (k + 1)).sum())
    slope = (p[1:][on] - p[:-1][on]) / (hi - lo)
    level = p[:-1][on] - slope * lo
    return float((slope * (hi ** (k + 2) - lo ** (k + 2)) / (k + 2) + level * (hi ** (k + 1) - lo ** (k + 1)) / (k + 1)).sum())


def density(s: dict, v: np.ndarray) -> np.ndarray:
    """A soft datum's normalised density at values."""
    if s["pdf_type"] == 10:
        return np.exp(-((v - s["mean"]) ** 2) / (2 * s["var"])) / math.sqrt(2 * math.pi * s["var"])
    a, p = np.array(s["limi"], float), np.array(s["probdens"], float)
    whole = _polygon_moment(a, p, 0, s["pdf_type"])
    if s["pdf_type"] == 1:
        i = np.clip(np.searchsorted(a, v, "right") - 1, 0, len(p) - 1)
        return np.where((v >= a[0]) & (v <= a[-1]), p[i], 0.0) / whole
    return np.interp(v, a, p, left=0.0, right=0.0) / whole


class Neighbourhood:
    """Conditional Gaussian quantities of one point and its data."""

    def __init__(self, model: list[Component], at: np.ndarray, hard: np.ndarray, zh: np.ndarray, softs: list[dict], order: int | None):
        stats = [soft_moments(s) for s in softs]
        exact = [i for i, (_, v) in enumerate(stats) if not v > TINY]  # soft data without variance are exact ones
        if exact:
            hard = np.concatenate([hard, [[softs[i][c] for c in CELL] for i in exact]])
            zh = np.r_[zh, [stats[i][0] for i in exact]]
            softs, stats = ([x for i, x in enumerate(own) if i not in exact] for own in (softs, stats))
        self.model, self.at, self.hard = model, at, hard
        ms = np.array([m for m, _ in stats])
        self.prior = 0.0 if order is None or not len(zh) + len(ms) else float(np.r_[zh, ms].mean())
        self.zh = zh - self.prior
        where = np.array([[s[c] for c in CELL] for s in softs], float).reshape(-1, 3)
        vs = np.array([v for _, v in stats])
        k_hh = covariance_matrix(model, hard, hard)
        if len(softs) and len(zh):  # soft data that the exact ones contradict are left out
            k_sh = covariance_matrix(model, where, hard)
            g = k_sh @ np.linalg.pinv(k_hh)
            m = g @ self.zh
            v = np.maximum(np.diag(covariance_matrix(model, where, where)) - (g * k_sh).sum(1), 0)
            keep = np.abs(m - (ms - self.prior)) <= 3 * (np.sqrt(v) + np.sqrt(vs))
            softs, where, ms, vs = [s for s, k in zip(softs, keep, strict=True) if k], where[keep], ms[keep], vs[keep]
        self.softs, self.where, self.ms, self.vs = softs, where, ms - self.prior, vs
        both = np.concatenate([hard, where])
        self.k = covariance_matrix(model, both, both)
        self.c = covariance_matrix(model, at[None], both)[0]
        self.c0 = float(covariance_matrix(model, at[None], at[None])[0, 0])
        self.n_hard = len(zh)

    def gaussian(self) -> tuple[float, float, float]:
        """Conditioning on the exact values and, with their variances as noise, on the soft means."""
        x = np.r_[self.zh, self.ms]
        inv = np.linalg.pinv(self.k + np.diag(np.r_[np.zeros(self.n_hard), self.vs]))
        w = self.c @ inv
        return self.prior + float(w @ x), max(self.c0 - float(w @ self.c), 0.0), 0.0

    def _mixture(self, o: Options):
        """(samples to conditional means, their log weights, conditional variance) as functions of the unit cube."""
        h, inv = self.n_hard, np.linalg.pinv(self.k)
        w = self.c @ inv
        var = max(self.c0 - float(w @ self.c), 0.0)
        g = self.k[h:, :h] @ np.linalg.pinv(self.k[:h, :h])
        m_s, k_s = g @ self.zh, self.k[h:, h:] - g @ self.k[:h, h:]
        precision = np.linalg.pinv(k_s) + np.diag(1 / self.vs)
        k_is = np.linalg.pinv(precision)
        m_is = k_is @ (np.linalg.pinv(k_s) @ m_s + self.ms / self.vs)
        value, axes = np.linalg.eigh((k_is + k_is.T) / 2)
        value = np.maximum(value[::-1], 0)
        axes = axes[:, ::-1]
        n = min(int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), o.kept_variance)) + 1, len(value))
        root = axes[:, :n] * np.sqrt(value[:n])

        def sample(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            x = m_is + _normal_quantile(u) @ root.T
            log = np.zeros(len(u))
            for i, s in enumerate(self.softs):
                f = density(s, x[:, i] + self.prior)
                gauss = -((x[:, i] - self.ms[i]) ** 2) / (2 * self.vs[i]) - 0.5 * math.log(2 * math.pi * self.vs[i])
                log += np.where(f > 0, np.log(np.maximum(f, 1e-300)) - gauss, -1e4)
            return self.prior + float(w[:h] @ self.zh) + x @ w[h:], np.clip(log, -500, 500)

        return sample, var, n

    def _quadrature(self) -> tuple[np.ndarray, np.ndarray, float] | None:
        """(conditional means, their weights, conditional variance) for one soft datum: Gauss-Legendre sums between
        the limits of its density and whole deviations of what the exact data say of it; None where these exclude it."""
        h, s = self.n_hard, self.softs[0]
        w = self.c @ np.linalg.pinv(self.k)
        var = max(self.c0 - float(w @ self.c), 0.0)
        g = self.k[h:, :h] @ np.linalg.pinv(self.k[:h, :h])
        m = float((g @ self.zh)[0])
        sd = math.sqrt(max(float((self.k[h:, h:] - g @ self.k[:h, h:])[0, 0]), TINY))
        a = np.array(s["limi"], float) - self.prior
        cuts = np.unique(np.clip(np.r_[a, m + sd * np.arange(-9, 10)], a[0], a[-1]))
        node, weight = _LEGENDRE
        half = np.diff(cuts)[:, None] / 2
        x = (cuts[:-1, None] + half * (1 + node)).ravel()
        log = -((x - m) ** 2) / (2 * sd * sd)
        p = density(s, x + self.prior) * (half * weight).ravel() * np.exp(log - log.max(initial=-np.inf))
        if not p.sum() > 0 or log.max() < -40:
            return None
        return self.prior + float(w[:h] @ self.zh) + x * w[h], p / p.sum(), var

    def posterior(self, o: Options) -> tuple[float, float, float]:
        """(mean, variance, third central moment)."""
        if not len(self.zh) + len(self.ms):
            return math.nan, math.nan, math.nan
        if o.gaussian or not self.softs or len(self.softs) > o.max_soft or all(s["pdf_type"] == 10 for s in self.softs):
            return self.gaussian()
        if len(self.softs) == 1:
            if (one := self._quadrature()) is None:
                return self.gaussian()
            x, p, var = one
            mean = float(p @ x)
            return mean, var + float(p @ (x - mean) ** 2), float(p @ (x - mean) ** 3)
        sample, var, n = self._mixture(o)
        centre = self.gaussian()[0]

        def moments(u: np.ndarray) -> np.ndarray:
            m, log = sample(u)
            weight = np.exp(log) * (log > -500)
            d = m - centre
            return np.stack([weight, weight * d, weight * d**2, weight * d**3], 1)

        value, error, _ = qmc(moments, n, o.max_eval, o.rel_tol, o.abs_tol)
        whole = value[0]
        if not np.isfinite(whole) or whole < max(3 * error[0], 1e-100):
            return self.gaussian()
        m1, m2, m3 = value[1:] / whole
        return centre + float(m1), var + max(float(m2 - m1**2 - (error[1] / whole) ** 2), 0.0), float(m3 - 3 * m1 * m2 + 2 * m1**3)

    def pdf(self, o: Options, points: int = 101, n: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Posterior density on a mesh of six standard deviations around the mean."""
        mean, var, _ = self.posterior(o)
        x = mean + np.linspace(-6, 6, points) * math.sqrt(max(var, 1e-12))
        if o.gaussian or not self.softs or len(self.softs) > o.max_soft or all(s["pdf_type"] == 10 for s in self.softs):
            centres, weights, spread = np.array([mean]), np.ones(1), var
        elif len(self.softs) == 1 and (one := self._quadrature()) is not None:
            centres, weights, spread = one
        else:
            sample, spread, dim = self._mixture(o)
            centres, log = sample(lattice_points(n, dim))
            weights = np.exp(log - log.max())
        spread = max(spread, 1e-12)
        p = (np.exp(-((x[:, None] - centres) ** 2) / (2 * spread)) * weights).sum(1) / weights.sum() / math.sqrt(2 * math.pi * spread)
        return x, p


def relevant(model: list[Component], at: np.ndarray, data: np.ndarray, n: int) -> list[int]:
    """The n data that, one after the other, most reduce the variance at a point (pivoted Cholesky)."""
    k, c = covariance_matrix(model, data, data), covariance_matrix(model, at[None], data)[0]
    rest, own, chosen = np.diag(k).copy(), c.copy(), []
    basis = np.zeros((len(data), 0))
    for _ in range(min(n, len(data))):
        gain = np.where(rest > 1e-10, own**2 / np.maximum(rest, 1e-10), -1.0)
        gain[chosen] = -1.0
        i = int(gain.argmax())
        if gain[i] <= 0:
            break
        column = (k[:, i] - basis @ basis[i]) / math.sqrt(rest[i])
        own = own - column * own[i] / math.sqrt(rest[i])
        rest = rest - column**2
        basis = np.column_stack([basis, column])
        chosen.append(i)
    return chosen


def kept_data(k: np.ndarray, relevance: np.ndarray, budget: int, least: float = 1e-8) -> list[int]:
    """Data in the order in which each has the largest product of relevance and variance left by those before it.

    It ends at the budget, or where the product falls below ``least`` of the first.
    """
    rest, basis, kept = np.maximum(np.diag(k), 0.0), np.zeros((len(k), 0)), []
    start = None
    while len(kept) < min(budget, len(k)):
        worth = rest * relevance
        worth[kept] = -1.0
        i = int(worth.argmax())
        start = worth[i] if start is None and worth[i] > 0 else start or 1.0
        if worth[i] < least * start:
            break
        column = (k[:, i] - basis @ basis[i]) / math.sqrt(max(rest[i], 1e-300))
        basis, rest = np.column_stack([basis, column]), np.maximum(rest - column**2, 0.0)
        kept.append(i)
    return kept


def assimilated(model: list[Component], at: np.ndarray, hard: list[dict], soft: list[dict], budget: int | None = None, least: float = 1e-6) -> tuple[list[dict], list[dict]]:
    """(exact, soft) data of a neighbourhood without those that the kept ones make redundant, which are merged into them.

    Kept are the data of ``kept_data``, relevance being the size of the covariance with the point; each
    other goes to the kept one of largest covariance.  What meets at a place becomes one datum: several exact
    values a Gaussian of their mean and population variance (``least`` more); one exact value with soft data
    the exact value; soft data the Gaussian of the moments of their even mixture.
    """
    both = [*hard, *soft]
    if len(both) < 2:
        return hard, soft
    where = np.array([[d[c] for c in CELL] for d in both], float)
    k = covariance_matrix(model, where, where)
    relevance = np.abs(covariance_matrix(model, at[None], where)[0])
    kept = kept_data(k, relevance, budget or len(both))
    if len(kept) == len(both) or not kept:
        return hard, soft
    groups = {i: [i] for i in sorted(kept)}
    for i in set(range(len(both))) - set(kept):
        groups[kept[int(np.abs(k[i, kept]).argmax())]].append(i)
    out_hard, out_soft = [], []
    for first, own in groups.items():
        exact = [both[i] for i in own if i < len(hard)]
        if len(own) == 1:
            (out_hard if exact else out_soft).append(both[first])
        elif len(exact) == 1:
            out_hard.append(exact[0])
        elif exact:
            z = np.array([d["z"] for d in exact], float)
            place = {c: exact[0][c] for c in CELL}  # the kept one's if that is exact
            out_soft.append(place | {"pdf_type": 10, "limi": None, "probdens": None, "mean": float(z.mean()), "var": float(z.var()) + least})
        else:
            moments = [soft_moments(both[i]) for i in own]
            fine = np.array([m for m in moments if np.isfinite(m).all() and m[1] > 0])
            if not len(fine):
                out_soft.append(both[first])
                continue
            mean = float(fine[:, 0].mean())
            var = float((fine[:, 1] + fine[:, 0] ** 2).mean()) - mean**2
            place = {c: both[first][c] for c in CELL}
            out_soft.append(place | {"pdf_type": 10, "limi": None, "probdens": None, "mean": mean, "var": max(var, least)})
    return out_hard, out_soft


def near_duplicate(model: list[Component], at: np.ndarray, data: np.ndarray) -> int | None:
    """The datum at the point itself, or whose covariances go with the point's all but exactly."""
    same = np.flatnonzero((data == at).all(1))
    if len(same):
        return int(same[0])
    both = np.concatenate([at[None], data])
    k = covariance_matrix(model, both, both)
    if len(data) < 2 or np.linalg.matrix_rank(k) == len(both):
        return None
    r = np.array([np.corrcoef(k[0], row)[0, 1] for row in k[1:]])
    i = int(np.nanargmax(r))
    return i if r[i] > 1 - 1e-6 else None


def _one(model: list[Component], o: Options, mesh: int | None, at: np.ndarray, hard: list, soft: list) -> tuple:
    """(moments, mesh, densities) at one point; NaN and empty where the neighbourhood cannot be solved."""
    try:
        if o.assimilate:
            hard, soft = assimilated(model, at, hard, soft, o.budget)
        known = np.array([[h[c] for c in CELL] for h in hard], float).reshape(-1, 3)
        where = np.array([[s[c] for c in CELL] for s in soft], float).reshape(-1, 3)
        if (same := near_duplicate(model, at, np.concatenate([known, where]))) is not None and same >= len(known):
            at = where[same - len(known)]  # a point all but on a soft datum stands on it, so the system keeps its rank
        n = Neighbourhood(model, at, known, np.array([h["z"] for h in hard], float), soft, o.order)
        row = n.posterior(o)
        x, p = n.pdf(o, mesh) if mesh and not math.isnan(row[0]) else ([], [])
        return row, x, p
    except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError):
        return (math.nan,) * 3, [], []


#: Values of one array when many points are integrated at a time: what stays in a core's cache.
_AT_ONCE = 1 << 16


def _polygon_stacks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(row numbers, points (m, 3), exact data (m, h, 3), their values, soft data (m, s, 3), limits and densities (m, s, l))
    of rows with equally many data, whose soft ones are linear densities between equally many rising limits."""
    at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in CELL], 1)
    start, count, parts = {}, {}, {}
    for c in ("hard", "soft"):
        count[c] = pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy().astype(np.int64)
        start[c], parts[c] = np.cumsum(count[c]) - count[c], b.column(c).flatten()
    hard = [parts["hard"].field(c).to_numpy(zero_copy_only=False).astype(float) for c in (*CELL, "z")]
    soft = [parts["soft"].field(c).to_numpy(zero_copy_only=False).astype(float) for c in CELL]
    size, other = (pc.fill_null(pc.list_value_length(parts["soft"].field(c)), 0).to_numpy().astype(np.int64) for c in ("limi", "probdens"))
    limits, heights = (parts["soft"].field(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("limi", "probdens"))
    kind = parts["soft"].field("pdf_type").to_numpy(zero_copy_only=False)
    first, first_p = np.cumsum(size) - size, np.cumsum(other) - other
    length = np.where((kind == 2) & (size > 1) & (size == other), size, 0)
    for h, n in {*zip(count["hard"].tolist(), count["soft"].tolist(), strict=True)}:
        rows = np.flatnonzero((count["hard"] == h) & (count["soft"] == n))
        if not h or not n:
            continue
        pick = start["soft"][rows][:, None] + np.arange(n)
        for width in np.unique(length[pick]).tolist():
            own = (length[pick] == width).all(1)
            if not width or not own.any():
                continue
            one, to = rows[own], pick[own]
            a, p = limits[first[to][..., None] + np.arange(width)], heights[first_p[to][..., None] + np.arange(width)]
            fine = ((np.diff(a, axis=-1) > 0).all(-1) & np.isfinite(a).all(-1) & np.isfinite(p).all(-1)).all(1)
            one, to = one[fine], to[fine]
            if len(one):
                near = start["hard"][one][:, None] + np.arange(h)
                yield one, at[one], np.stack([f[near] for f in hard[:3]], -1), hard[3][near], np.stack([f[to] for f in soft], -1), a[fine], p[fine]


def _polygon_moments(a: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Moments 0, 1 and 2 of densities (..., l), as ``_polygon_moment`` has them."""
    lo, hi = a[..., :-1], a[..., 1:]
    slope = (p[..., 1:] - p[..., :-1]) / (hi - lo)
    level = p[..., :-1] - slope * lo
    return [(slope * (hi ** (k + 2) - lo ** (k + 2)) / (k + 2) + level * (hi ** (k + 1) - lo ** (k + 1)) / (k + 1)).sum(-1) for k in range(3)]


def _heights(a: np.ndarray, p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Linear densities (m, l) at values (m, n), 0 outside the limits."""
    inside = (v >= a[:, :1]) & (v <= a[:, -1:])
    if a.shape[1] == 2 and (p[:, 0] == p[:, 1]).all():
        return p[:, :1] * inside
    i = sum(((v >= a[:, j, None]).astype(np.int8) for j in range(1, a.shape[1] - 1)), np.zeros(v.shape, np.int8)).astype(np.intp)
    slope = np.diff(p, axis=1) / np.diff(a, axis=1)
    return (np.take_along_axis(p, i, 1) + np.take_along_axis(slope, i, 1) * (v - np.take_along_axis(a, i, 1))) * inside


def _quadrature_many(m: np.ndarray, sd: np.ndarray, prior: np.ndarray, a: np.ndarray, p: np.ndarray, base: np.ndarray, w: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Moments with one soft datum each, as ``_quadrature`` has them; NaN where the exact data exclude it."""
    limits = a - prior[:, None]
    cuts = np.sort(np.clip(np.concatenate([limits, m[:, None] + sd[:, None] * np.arange(-9, 10)], 1), limits[:, :1], limits[:, -1:]), 1)
    node, weight = _LEGENDRE
    half = np.diff(cuts, axis=1)[:, :, None] / 2
    x = (cuts[:, :-1, None] + half * (1 + node)).reshape(len(m), -1)
    log = np.where(np.repeat(half[:, :, 0] > 0, len(node), 1), -((x - m[:, None]) ** 2) / (2 * sd * sd)[:, None], -np.inf)
    top = log.max(1)
    share = _heights(a, p, x + prior[:, None]) * (half * weight).reshape(x.shape) * np.exp(log - np.where(np.isfinite(top), top, 0.0)[:, None])
    whole = share.sum(1)
    good = (whole > 0) & (top >= -40)
    share = share / np.where(good, whole, 1.0)[:, None]
    x = base[:, None] + x * w[:, None]
    mean = (share * x).sum(1)
    d = x - mean[:, None]
    out = np.column_stack([mean, var + (share * d**2).sum(1), (share * d**3).sum(1)])
    out[~good] = np.nan
    return out


def _qmc_many(o: Options, dim: int, middle: np.ndarray, root: np.ndarray, ms: np.ndarray, vs: np.ndarray, prior: np.ndarray, a: np.ndarray, p: np.ndarray, base: np.ndarray, w: np.ndarray, shifts: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(values, errors) (m, 4) of the integrals that ``posterior`` takes by ``qmc``, with its points, tolerance and doubling for each row.

    ``base`` is what the conditional mean has besides the soft data's part, from the centre.
    """
    move = np.random.default_rng(1).random((shifts, dim))
    top = 2 ** min(round(math.log2(max(o.max_eval / shifts, 32))), 20)
    value, error = np.zeros((len(ms), 4)), np.zeros((len(ms), 4))
    left, total, n, done = np.arange(len(ms)), np.zeros((len(ms), shifts, 4)), 32, 0
    scale, level = 1 / (2 * vs), 0.5 * np.log(2 * np.pi * vs).sum(1)
    while len(left):
        points = (lattice_points(n - done, dim, done)[None] + move[:, None]) % 1.0
        normal = _normal_quantile(points.reshape(-1, dim)).T
        step = max(1, _AT_ONCE // normal.shape[1])
        for lo in range(0, len(left), step):
            i = left[lo : lo + step]
            log, d, inside = np.repeat(level[i][:, None], normal.shape[1], 1), np.repeat(base[i][:, None], normal.shape[1], 1), None
            for k in range(ms.shape[1]):
                x = root[i, k] @ normal
                x += middle[i, k, None]
                f = _heights(a[i, k], p[i, k], x + prior[i, None])
                on = f > 0
                inside = on if inside is None else inside & on
                log += np.log(np.maximum(f, 1e-300)) if a.shape[2] > 2 else np.log(np.maximum(p[i, k, :1], 1e-300))
                d += x * w[i, k, None]
                x -= ms[i, k, None]
                x *= x
                x *= scale[i, k, None]
                log += x
            weight = np.exp(np.minimum(log, 500.0)) * (inside & (log > -500))
            for m in range(4):
                total[i, :, m] += weight.reshape(len(i), shifts, -1).sum(2)
                weight *= d
        done = n
        each = total[left] / n
        value[left], error[left] = each.mean(1), each.std(1, ddof=1) / math.sqrt(shifts)
        if n >= top:
            break
        left = left[(error[left] > np.maximum(o.abs_tol, o.rel_tol * np.abs(value[left]))).any(1) | np.isnan(error[left]).any(1)]
        n *= 2
    return value, error


def _near_copies(k: np.ndarray) -> np.ndarray:
    """Whether the first of the points of covariances (m, n, n) may be all but one of the others, which ``near_duplicate`` decides."""
    low = np.flatnonzero(np.linalg.matrix_rank(k) < k.shape[1])
    off = k[low] - k[low].mean(2, keepdims=True)
    size = np.sqrt((off * off).sum(2))
    r = (off[:, :1] * off[:, 1:]).sum(2) / (size[:, :1] * size[:, 1:])
    out = np.zeros(len(k), bool)
    out[low] = ~(r < 1 - 1.1e-6).all(1)
    return out


def _posterior_many(model: list[Component], o: Options, at: np.ndarray, hard: np.ndarray, z: np.ndarray, soft: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Moments of points with h exact and s soft data each, by the same steps as ``Neighbourhood``; NaN for rows that need it itself."""
    out = np.full((len(at), 3), np.nan)
    with np.errstate(all="ignore"):
        whole, first, second = _polygon_moments(a, p)
        ms = first / whole
        vs = second / whole - ms * ms
        data = np.concatenate([hard, soft], 1)
        own = (vs > TINY).all(1) & np.isfinite(ms).all(1) & np.isfinite(z).all(1)
        alone = own & ~(data == at[:, None]).all(2).any(1)
        everything = np.concatenate([at[:, None], data], 1)[alone]
        own[alone] = ~_near_copies(covariance_stack(model, everything, everything))
        if not own.any():
            return out
        p = p / whole[..., None]
        if (p == p[..., :1]).all():  # a constant density has two limits
            a, p = a[..., [0, -1]], p[..., [0, -1]]
        prior = np.zeros(len(at)) if o.order is None else np.concatenate([z, ms], 1).mean(1)
        zh, ms = z - prior[:, None], ms - prior[:, None]
        k_sh, k_hh = covariance_stack(model, soft, hard), np.linalg.pinv(covariance_stack(model, hard, hard))
        g = k_sh @ k_hh
        m = (g * zh[:, None]).sum(2)
        c0 = float(covariance_matrix(model, at[:1], at[:1])[0, 0])
        v = np.maximum(c0 - (g * k_sh).sum(2), 0)
        keep = np.abs(m - ms) <= 3 * (np.sqrt(v) + np.sqrt(vs))  # soft data that the exact ones contradict are left out
        code = np.where(own, keep @ (1 << np.arange(keep.shape[1])), -1)
        for c in np.unique(code[own]).tolist():
            i, on = np.flatnonzero(code == c), np.flatnonzero(c >> np.arange(keep.shape[1]) & 1)
            cut = lambda v: v[i][:, on]  # noqa: B023, E731
            out[i] = _mixed_many(model, o, c0, at[i], hard[i], zh[i], prior[i], cut(soft), cut(a), cut(p), cut(ms), cut(vs), cut(g), cut(m))
    return out


def _mixed_many(model: list[Component], o: Options, c0: float, at, hard, zh, prior, soft, a, p, ms, vs, g, m) -> np.ndarray:
    """Moments where the soft data are those kept, ``g`` and ``m`` their weights on and means by the exact ones."""
    h, n, rows = zh.shape[1], ms.shape[1], len(at)
    both = np.concatenate([hard, soft], 1)
    k, c = covariance_stack(model, both, both), covariance_stack(model, both, at[:, None])[:, :, 0]
    noisy = k.copy()
    noisy[:, range(h, h + n), range(h, h + n)] += vs
    w = (c[:, None] @ np.linalg.pinv(noisy))[:, 0]
    out = np.column_stack([prior + (w * np.concatenate([zh, ms], 1)).sum(1), np.maximum(c0 - (w * c).sum(1), 0.0), np.zeros(rows)])
    if not n:
        return out
    w = (c[:, None] @ np.linalg.pinv(k))[:, 0]
    var = np.maximum(c0 - (w * c).sum(1), 0.0)
    k_s = k[:, h:, h:] - g @ k[:, :h, h:]
    base = prior + (w[:, :h] * zh).sum(1)
    if n == 1:
        found = _quadrature_many(m[:, 0], np.sqrt(np.maximum(k_s[:, 0, 0], TINY)), prior, a[:, 0], p[:, 0], base, w[:, h], var)
        good = ~np.isnan(found[:, 0])
        out[good] = found[good]
        return out
    inv = np.linalg.pinv(k_s)
    precision = inv.copy()
    precision[:, range(n), range(n)] += 1 / vs
    k_is = np.linalg.pinv(precision)
    middle = (k_is @ ((inv @ m[:, :, None])[:, :, 0] + ms / vs)[:, :, None])[:, :, 0]
    value, axes = np.linalg.eigh((k_is + k_is.transpose(0, 2, 1)) / 2)
    value, axes = np.maximum(value[:, ::-1], 0), axes[:, :, ::-1]
    dims = np.minimum((np.cumsum(value, 1) / np.maximum(value.sum(1), 1e-300)[:, None] < o.kept_variance).sum(1) + 1, n)
    for dim in np.unique(dims).tolist():
        i = np.flatnonzero(dims == dim)
        root = axes[i][:, :, :dim] * np.sqrt(value[i][:, None, :dim])
        centre = out[i, 0]
        got, error = _qmc_many(o, dim, middle[i], root, ms[i], vs[i], prior[i], a[i], p[i], base[i] - centre, w[i][:, h:])
        whole = got[:, 0]
        good = np.isfinite(whole) & (whole >= np.maximum(3 * error[:, 0], 1e-100))
        m1, m2, m3 = (got[:, j] / whole for j in (1, 2, 3))
        found = np.column_stack([centre + m1, var[i] + np.maximum(m2 - m1**2 - (error[:, 1] / whole) ** 2, 0.0), m3 - 3 * m1 * m2 + 2 * m1**3])
        out[i[good]] = found[good]
    return out


def _all_normal(cell: pa.Array, count: np.ndarray) -> np.ndarray:
    """Whether all soft data of a row are Gaussians with a variance."""
    parts = cell.flatten()
    bad = (parts.field("pdf_type").to_numpy(zero_copy_only=False) != 10) | ~(parts.field("var").to_numpy(zero_copy_only=False).astype(float) > TINY)
    ends = np.cumsum(count)
    sums = np.r_[0, np.cumsum(bad)]
    return sums[ends] == sums[ends - count]


def _rows(model: list[Component], o: Options, mesh: int | None):
    names = ["mean", "variance", "skewness"]
    spread = np.linspace(-6, 6, mesh or 0)

    def exact(at, known, z):
        """Exact data alone make one Gaussian: simple kriging about the prior mean, in stacks."""
        prior = np.zeros(len(z)) if o.order is None else z.mean(1)
        e, v, _ = krige_many(model, at, known, z - prior[:, None], None)
        return np.column_stack([prior + e, np.maximum(v, 0), np.zeros(len(z))])

    def normal(at, where, mean, var):
        """Soft data alone, all Gaussian: kriging of their means with their variances as noise."""
        prior = np.zeros(len(mean)) if o.order is None else mean.mean(1)
        k, c = covariance_stack(model, where, where), covariance_stack(model, where, at[:, None])[:, :, 0]
        k[:, range(k.shape[1]), range(k.shape[1])] += var
        w = np.einsum("mij,mj->mi", np.linalg.pinv(k, hermitian=True), c)
        c0 = covariance_stack(model, at[:, None], at[:, None])[:, 0, 0]
        return np.column_stack([prior + (w * (mean - prior[:, None])).sum(1), np.maximum(c0 - (w * c).sum(1), 0), np.zeros(len(mean))])

    def run(batches):
        for b in batches:
            out = np.full((b.num_rows, 3), np.nan)
            xs, ps = [[]] * b.num_rows, [[]] * b.num_rows
            count, known = (pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy() for c in ("soft", "hard"))
            soft = (count > 0) | (o.assimilate & (known > 1))
            easy = np.flatnonzero((not o.assimilate) & soft & (known == 0) & _all_normal(b.column("soft"), count))
            for rows, at, where, mean, var in neighbour_stacks(b.take(pa.array(easy)), "soft", ("mean", "var")) if len(easy) else ():
                out[easy[rows]] = each_or_none(normal, at, where, mean, var)
            for i in easy[~np.isnan(out[easy, 0])].tolist() if mesh else []:
                sd = math.sqrt(max(out[i, 1], TINY))
                xs[i], ps[i] = out[i, 0] + spread * sd, np.exp(-(spread**2) / 2) / (sd * math.sqrt(2 * math.pi))
            plain = b.filter(pa.array(~soft))
            numbers = np.flatnonzero(~soft)
            for rows, *stacks in neighbour_stacks(plain, "hard"):
                out[numbers[rows]] = each_or_none(exact, *stacks)
            for i in numbers[~np.isnan(out[numbers, 0])].tolist() if mesh else []:
                sd = math.sqrt(max(out[i, 1], TINY))
                xs[i], ps[i] = out[i, 0] + spread * sd, np.exp(-(spread**2) / 2) / (sd * math.sqrt(2 * math.pi))
            soft[easy] = False
            several = np.flatnonzero(soft & (known > 0) & (count <= o.max_soft)) if not (mesh or o.assimilate or o.gaussian) else ()
            for rows, *stacks in _polygon_stacks(b.take(pa.array(several))) if len(several) else ():
                out[several[rows]] = each_or_none(lambda *x: _posterior_many(model, o, *x), *stacks)
                soft[several[rows]] = np.isnan(out[several[rows], 0])  # what is left is done by itself
            mixed, own = b.filter(pa.array(soft)), np.flatnonzero(soft).tolist()
            for i, x, y, t, h, g in zip(own, *(mixed.column(c).to_pylist() for c in (*CELL, "hard", "soft")), strict=True):
                out[i], xs[i], ps[i] = _one(model, o, mesh, np.array([x, y, t], float), h or [], g or [])
            cols = [pa.array(c, from_pandas=True) for c in out.T]  # NaN becomes null
            more = [pa.array(xs, pa.list_(pa.float64())), pa.array(ps, pa.list_(pa.float64()))] if mesh else []
            keep = ["k_id", *CELL]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols, *more], [*keep, *names, *(["pdf_x", "pdf_p"] if mesh else [])])

    return run


def _neighbour_arrays(points: DataFrame, data: DataFrame | None, columns: list[str], name: str, nmax: int, dmax_s: float, dmax_t: float, ratio: float, exclude_same: bool) -> DataFrame:
    if data is None:
        return points
    near = nearest(points, data, nmax, dmax_s, dmax_t, ratio, exclude_same, (*CELL, *columns))
    found = near.groupBy("k_id").agg(F.array_sort(F.collect_list(F.struct("rank", *CELL, *columns))).alias(name))
    return points.join(found, "k_id", "left")


def predict(points: DataFrame, hard: DataFrame | None, soft: DataFrame | None, model: list[Component], nh: int = 10, ns: int = 3, dmax_s: float = 10.0, dmax_t: float = 10.0, ratio: float = 1.0, options: Options = Options(), exclude: str = "", mesh: int | None = None) -> DataFrame:
    """k_id, x, y, t, mean, variance, skewness (and pdf_x, pdf_p with ``mesh``) at points (k_id, x, y, t).

    ``hard`` has h_id, x, y, t, z; ``soft`` has h_id, x, y, t, pdf_type, limi, probdens, mean, var.
    ``exclude`` 'hard' or 'soft' leaves out the datum of the point's own id.  Points without neighbours
    and neighbourhoods that cannot be solved have null moments.
    """
    rows = points.select("k_id", *CELL)
    rows = _neighbour_arrays(rows, hard, ["z"], "hard", nh, dmax_s, dmax_t, ratio, exclude == "hard")
    rows = _neighbour_arrays(rows, soft, SOFT, "soft", ns, dmax_s, dmax_t, ratio, exclude == "soft")
    if hard is None:
        rows = rows.withColumn("hard", F.expr("CAST(NULL AS array<struct<rank:int,x:double,y:double,t:double,z:double>>)"))
    if soft is None:
        rows = rows.withColumn("soft", F.expr("CAST(NULL AS array<struct<rank:int,x:double,y:double,t:double,pdf_type:int,limi:array<double>,probdens:array<double>,mean:double,var:double>>)"))
    else:  # a point's integrals are much work and few bytes, so they are dealt to all cores
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k_id")
    schema = "k_id long, x double, y double, t double, mean double, variance double, skewness double" + (", pdf_x array<double>, pdf_p array<double>" if mesh else "")
    return rows.mapInArrow(_rows(model, options, mesh), schema)


def add_trend(result: DataFrame, trend: DataFrame) -> DataFrame:
    """The trend at the points goes back on the mean, and on the mean only."""
    return result.join(trend.select("k_id", "tr"), "k_id").withColumn("mean", F.col("mean") + F.col("tr")).drop("tr")
