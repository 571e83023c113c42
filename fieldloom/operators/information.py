"""Entropy, maximum-entropy densities, moments and simulation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.models import Component, covariance_matrix


def entropy(rows: DataFrame, *cols: str) -> DataFrame:
    """-sum p ln p over the observed combinations of columns."""
    n = rows.groupBy(*cols).agg(F.count("*").alias("n"))
    return n.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin from 0, the last one closed."""
    return F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def binned(rows: DataFrame, cols: tuple[str, ...], bins: int) -> DataFrame:
    ends = rows.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    both = rows.where(" and ".join(f"{c} is not null" for c in cols)).crossJoin(F.broadcast(ends))
    return both.select(*(bin_of(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), bins).alias(f"b_{c}") for c in cols))


def histogram_entropy(rows: DataFrame, *cols: str, bins: int = 10) -> DataFrame:
    return entropy(binned(rows, cols, bins), *(f"b_{c}" for c in cols))


def mutual_information(rows: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """h_x, h_y, h_xy, h_y_given_x and mutual information of binned columns."""
    b = binned(rows, (x, y), bins)
    h = [entropy(b, *k).withColumnRenamed("entropy", n) for n, k in (("h_x", (f"b_{x}",)), ("h_y", (f"b_{y}",)), ("h_xy", (f"b_{x}", f"b_{y}")))]
    one = h[0].crossJoin(h[1]).crossJoin(h[2])
    return one.withColumn("h_y_given_x", F.col("h_xy") - F.col("h_x")).withColumn("mutual_information", F.col("h_x") + F.col("h_y") - F.col("h_xy"))


def moments(rows: DataFrame, x: str, order: int = 10, y: str | None = None) -> DataFrame:
    """m1, central c2 .. c_order, mean logarithm of positive values, and the cross moment with y."""
    mean = rows.agg(F.avg(x).alias("_m"), *([F.avg(y).alias("_my")] if y else []))
    both = rows.crossJoin(F.broadcast(mean))
    d = F.col(x) - F.col("_m")
    cross = [F.avg(d * (F.col(y) - F.col("_my"))).alias("cross")] if y else []
    return both.agg(F.first("_m").alias("m1"), *(F.avg(F.pow(d, F.lit(float(k)))).alias(f"c{k}") for k in range(2, order + 1)), F.avg(F.when(F.col(x) > 0, F.log(x))).alias("mean_log"), *cross)


def maximum_entropy(target: np.ndarray, low: float, high: float, points: int = 400, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(x, density) of most entropy on [low, high] with given raw moments 1 .. k: Newton steps with line search."""
    u, w = np.polynomial.legendre.leggauss(points)
    x, w = 0.5 * (high - low) * u + 0.5 * (high + low), 0.5 * (high - low) * w
    mid, half = 0.5 * (high + low), 0.5 * (high - low)
    raw = np.r_[1.0, target]
    k = len(target)
    scaled = np.array([sum(math.comb(j, i) * raw[i] * (-mid) ** (j - i) for i in range(j + 1)) / half**j for j in range(1, k + 1)])
    basis = np.stack([np.polynomial.legendre.Legendre.basis(j)(u) for j in range(1, k + 1)])
    goal = np.array([np.polynomial.legendre.leg2poly([0] * j + [1]) @ np.r_[1.0, scaled][: j + 1] for j in range(1, k + 1)])
    lam = np.zeros(k)

    def dual(v: np.ndarray) -> tuple[float, np.ndarray]:
        e = v @ basis
        top = e.max()
        p = np.exp(e - top) * w
        return math.log(p.sum()) + top - v @ goal, p / p.sum()

    value, p = dual(lam)
    for _ in range(rounds):
        m = basis @ p
        grad = m - goal
        if np.abs(grad).max() < 1e-12:
            break
        hess = (basis * p) @ basis.T - np.outer(m, m)
        step, size = np.linalg.solve(hess + 1e-12 * np.eye(k), grad), 1.0
        while size > 1e-8:
            new, q = dual(lam - size * step)
            if new < value:
                lam, value, p = lam - size * step, new, q
                break
            size /= 2
        else:
            break
    return x, p / w


def density_cdf(x: np.ndarray, p: np.ndarray, at: np.ndarray, low: float) -> np.ndarray:
    """Distribution function at values of a density known at sorted ``x`` above ``low``, linear between and level before the first."""
    if x[0] > low:
        x, p = np.r_[low, x], np.r_[p[0], p]
    area = np.r_[0, np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(x))]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    d = np.clip(at, x[0], x[-1]) - x[i]
    return (area[i] + d * (p[i] + d * (p[i + 1] - p[i]) / (x[i + 1] - x[i]) / 2)) / area[-1]


def maximum_entropy_pair(mean: np.ndarray, cov: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bivariate density of most entropy with given means and covariances (a Gaussian) on a mesh."""
    d = np.stack([x[:, None] - mean[0] + 0 * y[None, :], 0 * x[:, None] + y[None, :] - mean[1]], -1)
    inv = np.linalg.inv(cov)
    return np.exp(-0.5 * np.einsum("...i,ij,...j", d, inv, d)) / (2 * math.pi * math.sqrt(np.linalg.det(cov)))


def copula_pair(p: np.ndarray, q: np.ndarray, rho: float) -> np.ndarray:
    """Gaussian copula density at probabilities of two margins."""
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    a = np.array([inv(min(max(v, 1e-12), 1 - 1e-12)) for v in p])[:, None]
    b = np.array([inv(min(max(v, 1e-12), 1 - 1e-12)) for v in q])[None, :]
    s = 1 - rho**2
    return np.exp(-(rho**2 * (a**2 + b**2) - 2 * rho * a * b) / (2 * s)) / math.sqrt(s)


def conditional_density(joint: np.ndarray, x: np.ndarray, at: int) -> np.ndarray:
    """Density of the first variable given the second's mesh point ``at``."""
    p = joint[:, at]
    return p / np.trapezoid(p, x)


#: Points whose covariance matrix is factored on the driver at most.
DENSE_POINTS = 4096


def simulate(spark: SparkSession, points: np.ndarray, model: list[Component], replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, k_id, x, y, t, z): seeded Gaussian fields by a Cholesky factor, one replicate a row of work.

    For ``DENSE_POINTS`` points at most; ``simulate_spectral`` has no such bound.
    """
    if len(points) > DENSE_POINTS:
        raise ValueError(f"more than {DENSE_POINTS} points: use simulate_spectral")
    k = covariance_matrix(model, points, points)
    root = np.linalg.cholesky(k + 1e-10 * k.max() * np.eye(len(points)))
    sent = spark.sparkContext.broadcast((points, root))

    def one(frames):
        p, r = sent.value
        for f in frames:
            for i in f["id"]:
                z = r @ np.random.default_rng([seed, int(i)]).standard_normal(len(p))
                yield pd.DataFrame({"replicate": int(i), "k_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "t": p[:, 2], "z": z})

    return spark.range(replicates).mapInPandas(one, "replicate long, k_id long, x double, y double, t double, z double")


def _waves(c: Component, n: int, rng: np.random.Generator) -> np.ndarray:
    """(n, 3) frequencies in x, y and t whose spectrum is that of a component."""

    def axes(name: str, a: float, dims: int) -> np.ndarray:
        w = rng.standard_normal((n, dims))
        if name == "gaussian":
            return w * math.sqrt(6) / a
        if name == "exponential":  # the spectrum is a Cauchy distribution: a normal one over another's size
            return 3 / a * w / np.abs(rng.standard_normal((n, 1)))
        raise ValueError(f"no spectrum for {name!r}")

    time = axes(c.time, c.range_t, 1) if c.time else np.zeros((n, 1))
    return np.concatenate([axes(c.space, c.range_s, 2), time], 1)


def simulate_spectral(points: DataFrame, model: list[Component], replicates: int, waves: int = 1024, seed: int = 1) -> DataFrame:
    """(replicate, k_id, x, y, t, z): seeded Gaussian fields at ``points`` (k_id, x, y, t) as sums of ``waves`` cosines.

    Frequencies are drawn from the spectrum of each exponential or Gaussian component, so the covariance is the model's
    on average over seeds; a nugget is a normal number made of each key's hash.  Points are only mapped, so
    there may be any number of them; the fields are normal up to terms of one over ``waves``.
    """
    sent = []
    for i in range(replicates):
        rng = np.random.default_rng([seed, i])
        parts = [(c.sill, _waves(c, waves, rng), rng.uniform(0, 2 * math.pi, waves)) for c in model if c.space != "nugget"]
        sent.append((parts, sum(c.sill for c in model if c.space == "nugget")))

    def run(batches):
        for b in batches:
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyt"], 1) if b.num_rows else np.empty((0, 3))
            for i, (parts, nugget) in enumerate(sent):
                u, v = (b.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype(float) for c in "uv")
                z = math.sqrt(nugget) * np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)
                for lo in range(0, len(at), 2048):
                    for sill, w, phase in parts:
                        z[lo : lo + 2048] += math.sqrt(2 * sill / waves) * np.cos(at[lo : lo + 2048] @ w.T + phase).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), *(b.column(c) for c in ("k_id", "x", "y", "t")), pa.array(z, from_pandas=True)], ["replicate", "k_id", "x", "y", "t", "z"])

    unit = lambda n: (F.shiftrightunsigned(F.xxhash64("k_id", F.lit(seed), F.lit(n)), 11) + 1) / F.lit(float(1 << 53))
    own = points.select("k_id", *(F.col(c).cast("double").alias(c) for c in "xyt"), *(unit(2 * i + n).alias(f"{c}{i}") for i in range(replicates) for n, c in enumerate("uv")))
    kind = dict(points.dtypes)["k_id"]
    return own.mapInArrow(run, f"replicate long, k_id {kind}, x double, y double, t double, z double")
