"""Fitting of covariance models to an empirical covariance, which is at most some hundred rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.models import Component, correlation_np, covariance_matrix, covariance_np
from fieldloom.operators.interpolate import covariance_stack, each_or_none, krige_many, neighbour_stacks
from fieldloom.operators.neighbours import sphere_radius
from fieldloom.operators.rings import ring_nearest
from fieldloom.operators.stages import cut


def weights(cov: np.ndarray, n: np.ndarray, sill: float) -> np.ndarray:
    w = n / (sill**2 + cov**2)
    return w / np.nansum(w)


def objective(model: list[Component], lag_s: np.ndarray, lag_t: np.ndarray, cov: np.ndarray, n: np.ndarray, sill: float) -> float:
    """Weighted squares, weights n / (C(0,0)**2 + C**2) made to sum to 1; empty bins do not count."""
    return float(np.nansum(weights(cov, n, sill) * (covariance_np(model, lag_s, lag_t) - cov) ** 2))


def objective_frame(empirical: DataFrame, model: list[Component]) -> DataFrame:
    """The objective as a one-row DataFrame."""
    from fieldloom.functions.models import covariance

    sill = empirical.where("lag_s = 0 and lag_t = 0").agg(F.max("cov").alias("sill"))
    w = F.col("n") / (F.col("sill") ** 2 + F.col("cov") ** 2)
    miss = (covariance(model, F.col("lag_s"), F.col("lag_t")) - F.col("cov")) ** 2
    return empirical.crossJoin(F.broadcast(sill)).where("cov is not null").agg((F.sum(w * miss) / F.sum(w)).alias("objective"))


def surface(spark, model: list[Component], max_s: float, max_t: float, n: int = 30) -> DataFrame:
    """(lag_s, lag_t, cov) of a model on an n x n mesh."""
    from fieldloom.functions.models import covariance

    mesh = spark.range(n * n).select((F.col("id") % n * F.lit(max_s / (n - 1))).alias("lag_s"), (F.floor(F.col("id") / n) * F.lit(max_t / (n - 1))).alias("lag_t"))
    return mesh.select("lag_s", "lag_t", covariance(model, F.col("lag_s"), F.col("lag_t")).alias("cov"))


def aic(obj, n_models: int, n: int = 900):
    """2 k + N ln(obj / N) of a number or a column; N is the plotting mesh's 900 as the reports have it, or the number of lags."""
    return 2 * n_models + n * (F.log(obj / n) if isinstance(obj, Column) else math.log(obj / n))


def pso(f: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, particles: int = 100, rounds: int = 10, seed: int = 1, together: bool = False) -> tuple[np.ndarray, float]:
    """Particle swarm within bounds: inertia 0.3, own pull 1.0, common pull 1.3; seeded.

    With ``together`` f takes all particles, as rows, and gives a value each.
    """
    rng = np.random.default_rng(seed)
    every = f if together else lambda rows: np.array([f(p) for p in rows])
    x = low + rng.random((particles, len(low))) * (high - low)
    v = np.zeros_like(x)
    best, score = x.copy(), every(x)
    for _ in range(rounds):
        g = best[score.argmin()]
        v = 0.3 * v + 1.0 * rng.random(x.shape) * (best - x) + 1.3 * rng.random(x.shape) * (g - x)
        x = np.clip(x + v, low, high)
        now = every(x)
        better = now < score
        best[better], score[better] = x[better], now[better]
    i = int(score.argmin())
    return best[i], float(score[i])


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, max_eval: int = 3000, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Bounded derivative-free search by a simplex, in place of a quadratic-model trust region."""
    d = len(start)
    clip = lambda p: np.clip(p, low, high)
    pts = [clip(np.asarray(start, float))]
    for i in range(d):
        p = pts[0].copy()
        step = 0.1 * (high[i] - low[i])
        p[i] += step if p[i] + step <= high[i] else -step
        pts.append(clip(p))
    val = [f(p) for p in pts]
    used = len(val)
    while used < max_eval:
        order = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) <= tol * (abs(val[0]) + tol):
            break
        mid = np.mean(pts[:-1], axis=0)
        trial = clip(2 * mid - pts[-1])
        t = f(trial)
        used += 1
        if t < val[0]:
            far = clip(3 * mid - 2 * pts[-1])
            u = f(far)
            used += 1
            pts[-1], val[-1] = (far, u) if u < t else (trial, t)
        elif t < val[-2]:
            pts[-1], val[-1] = trial, t
        else:
            near = clip(0.5 * mid + 0.5 * (pts[-1] if val[-1] <= t else trial))
            u = f(near)
            used += 1
            if u < min(t, val[-1]):
                pts[-1], val[-1] = near, u
            else:
                pts = [pts[0], *(clip(0.5 * (p + pts[0])) for p in pts[1:])]
                val = [val[0], *(f(p) for p in pts[1:])]
                used += d
    i = int(np.argmin(val))
    return pts[i], float(val[i])


def fit(empirical: DataFrame, kinds: list[tuple[str, str]], method: str = "pso", seed: int = 1) -> tuple[list[Component], float]:
    """Nested separable model of the given (space, time) kinds; sills 0 to 2 times C(0,0), ranges 0.3 to 5 times the mean lag."""
    rows = empirical.select("lag_s", "lag_t", "n", "cov").collect()  # one row a lag
    ls, lt, n, c = (np.array([r[k] for r in rows], float) for k in ("lag_s", "lag_t", "n", "cov"))
    at0 = (ls == 0) & (lt == 0)
    sill = float(c[at0][0]) if at0.any() else float(np.nanmax(c))
    rs, rt = max(ls.max() / 2, 1e-6), max(lt.max() / 2, 1e-6)
    low = np.tile([1e-6 * sill, 0.3 * rs / 2, 0.3 * rt / 2], len(kinds))
    high = np.tile([2.0 * sill, 5 * rs, 5 * rt], len(kinds))

    def build(p: np.ndarray) -> list[Component]:
        return [Component(*map(float, (p[3 * i],)), s, float(p[3 * i + 1]), t, float(p[3 * i + 2])) for i, (s, t) in enumerate(kinds)]

    loss = lambda p: objective(build(p), ls, lt, c, n, sill)
    if method == "pso":
        p, v = pso(loss, low, high, seed=seed)
        p, v = simplex(loss, p, low, high)
    else:
        p, v = simplex(loss, (low + high) / 3, low, high)
    return build(p), v


def fit_anisotropic(directional: DataFrame, kind: str, seed: int = 1) -> dict:
    """sill, range, ratio, theta (radians) of one spatial model over directions (azimuth_deg, lag_s, n, cov)."""
    rows = directional.where("lag_t = 0").select("azimuth_deg", "lag_s", "n", "cov").collect()
    phi, d, n, c = (np.array([r[k] for r in rows], float) for k in ("azimuth_deg", "lag_s", "n", "cov"))
    phi, sill = np.radians(phi), float(np.nanmax(c))

    def loss(p: np.ndarray) -> float:
        s, a, ratio, theta = p
        r = a * ratio / np.sqrt(ratio**2 * np.cos(phi - theta) ** 2 + np.sin(phi - theta) ** 2)
        return float(np.nansum(weights(c, n, sill) * (s * correlation_np(kind, d / r, 1.0) - c) ** 2))

    low, high = np.array([0.3 * sill, 0.3 * d.max() / 2, 0.5, -math.pi / 2]), np.array([2 * sill, 5 * d.max() / 2, 1.0, math.pi / 2])
    p, v = pso(loss, low, high, seed=seed)
    p, v = simplex(loss, p, low, high)
    return dict(zip(("sill", "range", "ratio", "theta"), map(float, p), strict=True)) | {"objective": v}


def downscale_time(coarse_lags: np.ndarray, coarse_cov: np.ndarray, kind: str, steps: int, seed: int = 1) -> tuple[float, float]:
    """(sill, range in fine steps) whose average over blocks of ``steps`` fine steps matches a coarse covariance."""
    i = np.arange(steps)
    base = (i[:, None] - i[None, :]).ravel()

    def loss(p: np.ndarray) -> float:
        fine = np.array([correlation_np(kind, np.abs(base + lag * steps).astype(float), p[1]).mean() for lag in coarse_lags])
        return float(((p[0] * fine - coarse_cov) ** 2).sum())

    top = float(np.abs(coarse_cov).max())
    low, high = np.array([0.5 * top, 0.1]), np.array([20 * top, 20.0 * steps * max(1.0, coarse_lags.max())])
    p, _ = pso(loss, low, high, seed=seed)
    p, _ = simplex(loss, p, low, high)
    return float(p[0]), float(p[1])


def log_likelihood(model: list[Component], points: np.ndarray, z: np.ndarray, taper: float = 1e-5) -> float:
    """Gaussian log-likelihood of zero-mean values, (n,) or replicated (n, m); tiny correlations are 0."""
    k = covariance_matrix(model, points, points)
    k = np.where(np.abs(k) / k.max() < taper, 0.0, k)
    sign, det = np.linalg.slogdet(k)
    if sign <= 0:
        return -math.inf
    z = z.reshape(len(points), -1)
    return float(-0.5 * ((z * np.linalg.solve(k, z)).sum() + z.shape[1] * (det + len(points) * math.log(2 * math.pi))))


def in_blocks(cells: DataFrame, value: str, most: int) -> DataFrame:
    """(block, x, y, t, z) of all cells with a value: squares of the plane with about ``most`` cells, and
    crowded squares dealt into several blocks by a hash."""
    own = cells.where(F.col(value).isNotNull()).select("x", "y", "t", F.col(value).cast("double").alias("z"))
    box = own.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.ceil(F.sqrt(F.count("*") / most)).alias("side"))
    place = lambda c: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")) * F.col("side")), F.col("side") - 1), F.lit(0))
    own = own.crossJoin(F.broadcast(box)).select("x", "y", "t", "z", place("x").alias("i"), place("y").alias("j"))
    parts = own.groupBy("i", "j").agg(F.ceil(F.count("*") / most).alias("parts"))
    return own.join(parts, ["i", "j"]).select(F.struct("i", "j", F.pmod(F.xxhash64("x", "y", "t"), F.col("parts")).alias("k")).alias("block"), "x", "y", "t", "z")


def block_likelihood(blocks: DataFrame, models: list[list[Component]], taper: float = 1e-5) -> np.ndarray:
    """Sum over the blocks of the log-likelihood of every model, in one pass over all cells."""

    def one(table: pa.Table) -> pa.Table:
        pts = np.stack([table[c].to_numpy() for c in "xyt"], 1)
        return pa.table({"m": pa.array(range(len(models)), pa.int32()), "v": pa.array([log_likelihood(m, pts, table["z"].to_numpy(), taper) for m in models])})

    got = blocks.groupBy("block").applyInArrow(one, "m int, v double").groupBy("m").agg(F.sum("v").alias("v")).collect()
    out = np.full(len(models), -math.inf)
    for r in got:
        out[r.m] = r.v
    return out


def fit_likelihood(cells: DataFrame, kinds: list[tuple[str, str]], value: str = "residual", most: int = 400, particles: int = 20, rounds: int = 6, seed: int = 1) -> tuple[list[Component], float]:
    """Maximum composite likelihood over all cells: the sum over blocks of about ``most`` cells, which are dense within.

    A round of the swarm is one pass that tries all its particles.
    """
    blocks = in_blocks(cells, value, most).persist()
    try:
        own = blocks.agg(F.var_pop("z"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("t") - F.min("t")).first()
        sill, rs, rt = float(own[0]), max(own[1], own[2], 1e-6) / 2, float(own[3]) / 2
        low, high = np.tile([0.01 * sill, 0.01 * rs, 0.01 * max(rt, 1)], len(kinds)), np.tile([3 * sill, 4 * rs, 4 * max(rt, 1)], len(kinds))
        build = lambda p: [Component(float(p[3 * i]), s, float(p[3 * i + 1]), t, float(p[3 * i + 2])) for i, (s, t) in enumerate(kinds)]
        p, v = pso(lambda x: -block_likelihood(blocks, [build(q) for q in x]), low, high, particles=particles, rounds=rounds, seed=seed, together=True)
        return build(p), -v
    finally:
        blocks.unpersist()


def conditioned(cells: DataFrame, m: int, dmax_s: float, dmax_t: float, ratio: float, order: str | None = None) -> DataFrame:
    """(k_id, x, y, t, z, hard): every cell (h_id, x, y, t, z) with its up to ``m`` nearest among those before it.

    Cells stand in the order of the column ``order``, by default that of a hash, which scatters them; equal
    values are neither's earlier.  The search is that of growing rings, so a cell meets a bounded number of others.
    """
    own = cells.where("z is not null").select("h_id", "x", "y", "t", F.col("z").cast("double").alias("z"), (F.xxhash64("h_id", "x", "y", "t") if order is None else F.col(order)).cast("long").alias("_order"))
    points = own.select(F.col("h_id").alias("k_id"), "x", "y", "t", F.lit(-(1 << 63)).cast("long").alias("_lo"), F.col("_order").alias("_hi"))
    near = ring_nearest(points, own, m, sphere_radius(dmax_s, dmax_t, ratio), ratio, True, ("x", "y", "t", "z"), between="_order")
    hard = near.groupBy("k_id").agg(F.array_sort(F.collect_list(F.struct("rank", "x", "y", "t", "z"))).alias("hard"))
    return own.select(F.col("h_id").alias("k_id"), "x", "y", "t", "z").join(hard, "k_id", "left")


def conditional_terms(rows: DataFrame, models: list[list[Component]]) -> DataFrame:
    """(k_id, model, mean, variance, term): what each cell of ``conditioned`` adds to the log-likelihood of each model.

    The product of the conditional densities is the joint one if every cell is conditioned on all before it,
    and close to it with few, for the near ones screen the others.  Values have zero mean.
    """

    def run(batches):
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in "xyt"], 1) if b.num_rows else np.empty((0, 3))
            z = b.column("z").to_numpy()
            for i, model in enumerate(models):
                mean = np.zeros(len(z))
                var = covariance_stack(model, at[:, None], at[:, None])[:, 0, 0] if len(z) else np.zeros(0)
                for own, points, known, values in neighbour_stacks(b, "hard"):
                    found = each_or_none(lambda p, k, v, model=model: np.column_stack(krige_many(model, p, k, v, None)[:2]), points, known, values)
                    mean[own], var[own] = found.T
                var = np.maximum(var, 1e-12)
                term = -0.5 * (np.log(2 * math.pi * var) + (z - mean) ** 2 / var)
                yield pa.RecordBatch.from_arrays([b.column("k_id"), pa.array(np.full(len(z), i), pa.int32()), pa.array(mean), pa.array(var), pa.array(term, from_pandas=True)], ["k_id", "model", "mean", "variance", "term"])

    return rows.mapInArrow(run, "k_id long, model int, mean double, variance double, term double")


def conditional_likelihood(rows: DataFrame, models: list[list[Component]]) -> np.ndarray:
    """The log-likelihood of every model, in one pass over all cells of ``conditioned``."""
    out = np.full(len(models), -math.inf)
    for r in conditional_terms(rows, models).groupBy("model").agg(F.sum("term").alias("v")).collect():
        out[r.model] = r.v
    return out


def fit_conditional(cells: DataFrame, kinds: list[tuple[str, str]], m: int, dmax_s: float, dmax_t: float, ratio: float, particles: int = 20, rounds: int = 6, seed: int = 1) -> tuple[list[Component], float]:
    """Maximum likelihood over all cells (h_id, x, y, t, z), each conditioned on ``m`` earlier neighbours.

    Neighbours are searched once; a round of the swarm is one pass that tries all its particles.
    """
    rows = cut(conditioned(cells, m, dmax_s, dmax_t, ratio))
    own = rows.agg(F.var_pop("z"), F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.max("t") - F.min("t")).first()
    sill, rs, rt = float(own[0]), max(own[1], own[2], 1e-6) / 2, float(own[3]) / 2
    low, high = np.tile([0.01 * sill, 0.01 * rs, 0.01 * max(rt, 1)], len(kinds)), np.tile([3 * sill, 4 * rs, 4 * max(rt, 1)], len(kinds))
    build = lambda p: [Component(float(p[3 * i]), s, float(p[3 * i + 1]), t, float(p[3 * i + 2])) for i, (s, t) in enumerate(kinds)]
    p, v = pso(lambda x: -conditional_likelihood(rows, [build(q) for q in x]), low, high, particles=particles, rounds=rounds, seed=seed, together=True)
    return build(p), -v
