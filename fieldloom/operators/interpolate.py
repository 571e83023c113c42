"""Inverse distances, kriging and local regression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.models import Component, covariance_matrix, covariance_np
from fieldloom.operators.farfield import far_sums, inverse_power
from fieldloom.operators.neighbours import nearest

CELL = ["x", "y", "t"]


def idw(data: DataFrame, points: DataFrame, power: float = 2.0, exclude_hits: bool = False) -> DataFrame:
    """k_id, zhat from all data (x, y, z): weights 1 / (d + 1e-10)**p, or 1 / d**p without co-located data.

    Far data count through the cells of ``far_sums``, with a relative error of their weights below 1e-8.
    """
    sums = far_sums(data, points, inverse_power(power, exclude_hits)).select("x", "y", F.try_divide("wz", "w").alias("zhat"))
    return points.select("k_id", "x", "y").join(sums, ["x", "y"], "left").select("k_id", "zhat")


def idw_nearest(data: DataFrame, points: DataFrame, k: int = 10, power: float = 2.0, dmax_s: float = 1e6, dmax_t: float | None = None, ratio: float = 0.0, exclude_same: bool = False) -> DataFrame:
    """k_id, zhat, n from the k nearest data (h_id, x, y, t, z); data nearer than 1e-10 stand alone."""
    known = data.where("z is not null")
    near = nearest(points, known, k, dmax_s, dmax_t, ratio, exclude_same, ("z",))
    hit = F.col("d") < 1e-10
    w = F.when(~hit, 1 / F.pow(F.col("d"), F.lit(power)))
    got = near.groupBy("k_id").agg(F.avg(F.when(hit, F.col("z"))).alias("_hit"), (F.sum(w * F.col("z")) / F.sum(w)).alias("_w"), F.count("*").alias("n"))
    return points.select("k_id").join(got, "k_id", "left").select("k_id", F.coalesce("_hit", "_w").alias("zhat"), F.coalesce("n", F.lit(0)).alias("n"))


def with_neighbours(data: DataFrame, points: DataFrame, nmax: int, dmax_s: float, dmax_t: float | None, ratio: float, exclude_same: bool = False) -> DataFrame:
    """Points with ``hard``: their neighbours as an array of structs (rank, x, y, t, z)."""
    near = nearest(points, data, nmax, dmax_s, dmax_t, ratio, exclude_same, (*CELL, "z"))
    found = near.groupBy("k_id").agg(F.array_sort(F.collect_list(F.struct("rank", *CELL, "z"))).alias("hard"))
    return points.select("k_id", *CELL).join(found, "k_id", "left")


def design(order: int | None, n: int) -> np.ndarray:
    """Columns of the mean: none for a zero mean, ones for a constant one."""
    return np.ones((n, 1)) if order == 0 else np.empty((n, 0))


def regression(x: np.ndarray, z: np.ndarray, k: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, their covariance): generalised least squares, ordinary without ``k``."""
    inv = np.eye(len(z)) if k is None else np.linalg.pinv(k)
    cov = np.linalg.pinv(x.T @ inv @ x)
    return cov @ x.T @ inv @ z, cov


def local_mean(model: list[Component], known: np.ndarray, z: np.ndarray, noise: np.ndarray | None = None) -> tuple[float, float]:
    """(constant mean, its variance) of exact values and soft means, by generalised least squares.

    ``noise`` holds the soft data's variances, 0 for exact values.
    """
    k = covariance_matrix(model, known, known) + np.diag(np.zeros(len(z)) if noise is None else noise)
    beta, cov = regression(design(0, len(z)), z, k)
    return float(beta[0]), float(cov[0, 0])


def covariance_stack(model: list[Component], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Covariance matrices between stacks (m, n, 3) and (m, k, 3) of points."""
    d = a[:, :, None, :] - b[:, None, :, :]
    return covariance_np(model, np.hypot(d[..., 0], d[..., 1]), np.abs(d[..., 2]))


def krige_many(model: list[Component], at: np.ndarray, known: np.ndarray, z: np.ndarray, order: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates, variances, weights) at m points with n neighbours each: at (m, 3), known (m, n, 3), z (m, n).

    Order None has a zero mean, 0 an unknown constant one.
    """
    m, n = z.shape
    k, c = covariance_stack(model, known, known), covariance_stack(model, known, at[:, None])[:, :, 0]
    c0 = covariance_stack(model, at[:, None], at[:, None])[:, 0, 0]
    p = design(order, n).shape[1]
    left = np.ones((m, n + p, n + p))
    left[:, :n, :n] = k
    left[:, n:, n:] = 0
    w = (np.linalg.pinv(left, hermitian=True) @ np.concatenate([c, np.ones((m, p))], 1)[:, :, None])[:, :n, 0]
    return (w * z).sum(1), c0 - 2 * (w * c).sum(1) + np.einsum("mi,mij,mj->m", w, k, w), w


def krige(model: list[Component], at: np.ndarray, known: np.ndarray, z: np.ndarray, order: int | None) -> tuple[float, float, np.ndarray]:
    """As ``krige_many`` at one point."""
    e, v, w = krige_many(model, at[None], known[None], z[None], order)
    return float(e[0]), float(v[0]), w[0]


def factors_many(model: list[Component], at: np.ndarray, known: np.ndarray, z: np.ndarray, order: int | None) -> np.ndarray:
    """The estimates' parts of each nested component, then the local means."""
    k = np.linalg.pinv(covariance_stack(model, known, known), hermitian=True)
    mean = np.zeros(len(z))
    if order == 0:  # generalised least squares of a constant
        mean = np.einsum("mij,mj->m", k, z) / k.sum((1, 2))
    own = np.einsum("mij,mj->mi", k, z - mean[:, None])
    return np.stack([*((covariance_stack([c], at[:, None], known)[:, 0] * own).sum(1) for c in model), mean], 1)


def neighbour_stacks(b: pa.RecordBatch, column: str, values: tuple[str, ...] = ("z",)) -> Iterator[tuple[np.ndarray, ...]]:
    """(row numbers, points (m, 3), neighbours (m, n, 3), their values (m, n) each) of rows with equally many neighbours."""
    cell = b.column(column)
    off, count = cell.offsets.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(cell), 0).to_numpy()
    start, parts = off[:-1] - off[0], cell.flatten()
    fields = [parts.field(c).to_numpy(zero_copy_only=False).astype(float) for c in (*CELL, *values)]
    at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in CELL], 1) if b.num_rows else np.empty((0, 3))
    for n in np.unique(count[count > 0]).tolist():
        rows = np.flatnonzero(count == n)
        pick = start[rows][:, None] + np.arange(n)
        yield rows, at[rows], np.stack([f[pick] for f in fields[:3]], -1), *(f[pick] for f in fields[3:])


def each_or_none(f: Callable[..., np.ndarray], *stacks: np.ndarray) -> np.ndarray:
    """f of stacks; where a system of the stack fails, f of each row, NaN for the rows that fail."""
    try:
        return f(*stacks)
    except np.linalg.LinAlgError:
        out = []
        for row in zip(*stacks, strict=True):
            try:
                out.append(f(*(x[None] for x in row))[0])
            except np.linalg.LinAlgError:
                out.append(None)
        width = next((len(x) for x in out if x is not None), 2)
        return np.array([np.full(width, np.nan) if x is None else x for x in out])


def _krige_rows(model: list[Component], order: int | None, parts: bool):
    def solve(at, known, z):
        e, v, _ = krige_many(model, at, known, z, order)
        return np.column_stack([e, v, *([factors_many(model, at, known, z, order)] if parts else [])])

    def run(batches):
        for b in batches:
            out = np.full((b.num_rows, 2 + (len(model) + 1) * parts), np.nan)
            for rows, *stacks in neighbour_stacks(b, "hard"):
                out[rows] = each_or_none(solve, *stacks)
            zk, vk = (pa.array(c, from_pandas=True) for c in out[:, :2].T)  # NaN becomes null
            each = [None if not parts or np.isnan(x).any() else x for x in out[:, 2:]]
            yield pa.RecordBatch.from_arrays([b.column("k_id"), zk, vk, pa.array(each, pa.list_(pa.float64()))], ["k_id", "zk", "vk", "factors"])

    return run


def kriging(data: DataFrame, points: DataFrame, model: list[Component], nmax: int, dmax_s: float, dmax_t: float | None = None, ratio: float = 0.0, order: int | None = None, exclude_same: bool = False) -> DataFrame:
    """k_id, zk, vk from the nearest data (h_id, x, y, t, z); null without neighbours."""
    rows = with_neighbours(data, points, nmax, dmax_s, dmax_t, ratio, exclude_same)
    return rows.mapInArrow(_krige_rows(model, order, False), "k_id long, zk double, vk double, factors array<double>").drop("factors")


def factorial_kriging(data: DataFrame, points: DataFrame, model: list[Component], nmax: int, dmax_s: float, dmax_t: float | None = None, ratio: float = 0.0, order: int | None = 0) -> DataFrame:
    """k_id, zk, vk, factors: the estimate's part of every component, then the local mean."""
    rows = with_neighbours(data, points, nmax, dmax_s, dmax_t, ratio)
    return rows.mapInArrow(_krige_rows(model, order, True), "k_id long, zk double, vk double, factors array<double>")
