"""Space-time trends: separable means, kernel smoothing, seasonal decomposition, regression on covariates.

Cells are (x, y, t, z); missing values do not count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.farfield import far_sums, inverse_power
from fieldloom.operators.neighbours import within
from fieldloom.operators.stages import cut

CELL = ["x", "y", "t"]


def no_trend(cells: DataFrame) -> DataFrame:
    return cells.withColumn("tr", F.when(F.col("z").isNotNull(), 0.0))


def st_means(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Site means (x, y, ms), time means (t, mt) and the grand mean (m)."""
    return cells.groupBy("x", "y").agg(F.avg("z").alias("ms")), cells.groupBy("t").agg(F.avg("z").alias("mt")), cells.agg(F.avg("z").alias("m"))


def stmean(cells: DataFrame) -> DataFrame:
    """Site mean plus time mean less grand mean, where z is present."""
    ms, mt, m = st_means(cells)
    both = cells.join(ms, ["x", "y"]).join(mt, "t").crossJoin(F.broadcast(m))  # m is one row
    return both.withColumn("tr", F.when(F.col("z").isNotNull(), F.col("ms") + F.col("mt") - F.col("m"))).drop("ms", "mt", "m")


def interpolate_times(mt: DataFrame, at: DataFrame, value: str = "mt", method: str = "linear") -> DataFrame:
    """(t, value): constant beyond the ends, and between the known times linear, that of the nearest (the
    earlier of two), or cubic: Hermite pieces whose slopes are those of the chords to both sides."""
    w = Window.orderBy("t")
    knots = mt.withColumns({"_t1": F.lead("t").over(w), "_v1": F.lead(value).over(w), "_first": F.lag("t").over(w).isNull()})
    chord = (F.col("_v1") - F.col(value)) / (F.col("_t1") - F.col("t"))
    around = (F.lead(value).over(w) - F.lag(value).over(w)) / (F.lead("t").over(w) - F.lag("t").over(w))
    knots = knots.withColumn("_m0", F.coalesce(around, chord, F.lag(chord).over(w)))
    knots = knots.withColumn("_m1", F.lead("_m0").over(w))
    a = at.select("t").distinct().withColumnRenamed("t", "_at")
    inside = (F.col("_at") >= F.col("t")) & (F.col("_t1").isNull() | (F.col("_at") < F.col("_t1"))) | (F.col("_first") & (F.col("_at") < F.col("t")))
    share = (F.col("_at") - F.col("t")) / (F.col("_t1") - F.col("t"))
    if method == "nearest":
        between = F.when(share <= 0.5, F.col(value)).otherwise(F.col("_v1"))
    elif method == "cubic":
        h, rest = F.col("_t1") - F.col("t"), 1 - share
        between = rest * rest * ((1 + 2 * share) * F.col(value) + share * h * F.col("_m0")) + share * share * ((1 + 2 * rest) * F.col("_v1") - rest * h * F.col("_m1"))
    elif method == "linear":
        between = F.col(value) + share * (F.col("_v1") - F.col(value))
    else:
        raise ValueError(f"unknown interpolation {method!r}")
    v = F.when(F.col("_t1").isNull() | (F.col("_at") <= F.col("t")), F.col(value)).otherwise(between)
    return a.join(knots, inside).select(F.col("_at").alias("t"), v.alias(value))


def idw_all(known: DataFrame, at: DataFrame, value: str, power: float = 2.0) -> DataFrame:
    """(x, y, value) at distinct sites, by weights 1 / (d + 1e-10)**power of all known sites."""
    own = known.select("x", "y", F.col(value).alias("z"))
    return far_sums(own, at, inverse_power(power)).select("x", "y", (F.col("wz") / F.col("w")).alias(value))


def stmean_at(cells: DataFrame, points: DataFrame, times: str = "linear") -> DataFrame:
    """The separable trend at new points: site part by inverse distances, time part by ``times``."""
    ms, mt, m = st_means(cells)
    both = points.join(idw_all(ms, points, "ms"), ["x", "y"]).join(interpolate_times(mt, points, method=times), "t").crossJoin(F.broadcast(m))
    return both.withColumn("tr", F.col("ms") + F.col("mt") - F.col("m")).drop("ms", "mt", "m")


def _taper(u: Column, kernel: str) -> Column:
    if kernel == "tricube":
        return F.pow(1 - F.pow(F.abs(u), F.lit(3.0)), F.lit(3.0))
    if kernel == "bicube":
        return F.pow(1 - u * u, F.lit(2.0))
    if kernel == "exp":
        return F.exp(-3 * u)
    raise ValueError(kernel)


def stmean_smoothed(cells: DataFrame, d_neib: float, t_neib: float, range_s: float, range_t: float, kernel: str = "tricube") -> tuple[DataFrame, DataFrame]:
    """(x, y, ms, mss) and (t, mt, mts): means and their weighted means of neighbours."""
    ms, mt, _ = st_means(cells)
    a = ms.select(F.col("x").alias("a_x"), F.col("y").alias("a_y"), "ms")
    b = ms.select(F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("ms").alias("b_ms"))
    d = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2)
    near = within(a, b, {"x": d_neib, "y": d_neib}).withColumn("d", d).where(F.col("d") <= d_neib).withColumn("w", _taper(F.col("d") / range_s, kernel))
    mss = near.groupBy("a_x", "a_y").agg(F.first("ms").alias("ms"), (F.sum(F.col("w") * F.col("b_ms")) / F.sum("w")).alias("mss"))
    p = mt.select(F.col("t").alias("a_t"), "mt")
    q = mt.select(F.col("t").alias("b_t"), F.col("mt").alias("b_mt"))
    near = within(p, q, {"t": t_neib}).withColumn("w", _taper(F.abs(F.col("a_t") - F.col("b_t")) / range_t, kernel))
    mts = near.groupBy("a_t").agg(F.first("mt").alias("mt"), (F.sum(F.col("w") * F.col("b_mt")) / F.sum("w")).alias("mts"))
    return mss.select(F.col("a_x").alias("x"), F.col("a_y").alias("y"), "ms", "mss"), mts.select(F.col("a_t").alias("t"), "mt", "mts")


def _kernel_weight(r2: Column, kernel: str) -> Column:
    """Gaussian exp(-3 r2), or quadratic 1 - r2 not below 0."""
    return F.exp(-3 * r2) if kernel == "gaussian" else F.greatest(1 - r2, F.lit(0.0))


def _scaled(bs: float, bt: float) -> Column:
    ds2 = (F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2
    return ds2 / F.lit(bs**2) + (F.col("a_t") - F.col("b_t")) ** 2 / F.lit(bt**2)


def _smooth(pairs: DataFrame, w: Column) -> DataFrame:
    return pairs.withColumn("w", w).groupBy("a_x", "a_y", "a_t").agg(F.try_divide(F.sum(F.col("w") * F.col("b_z")), F.sum("w")).alias("tr")).select(*(F.col(f"a_{c}").alias(c) for c in CELL), "tr")


def kernel_at(cells: DataFrame, points: DataFrame, bs: float, bt: float, kernel: str = "gaussian", error: float = 1e-12) -> DataFrame:
    """Weighted mean of all cells at points, all but a share of ``error`` of the weights.

    Gaussian weights are summed over the cells within some bandwidths first; a point is settled once all cells
    beyond could not add more than ``error`` of its sum, and else goes on with a wider ring, up to where weights are
    0 in doubles.  The quadratic kernel ends at one bandwidth; points out of reach of all cells are null.
    """
    if kernel != "gaussian":
        return kernel_cut(cells, points, bs, bt, 1.0, kernel)
    n, out, left = cells.where("z is not null").count(), None, points.select(*CELL).distinct()
    for reach in (4.0, 8.0, 16.0):
        sums = _gaussian_sums(cells, left, bs, bt, reach)
        if reach == 16.0:
            done = sums
        else:
            beyond = F.exp(F.lit(-3.0 * reach**2)) * n
            sums = cut(left.join(sums, CELL, "left"))
            settled = F.coalesce(beyond <= error * F.col("w"), F.lit(False))
            done, left = sums.where(settled), sums.where(~settled).select(*CELL)
        out = done if out is None else out.union(done)
        if reach < 16.0 and left.isEmpty():
            break
    return points.join(out.select(*CELL, F.try_divide("wz", "w").alias("tr")), CELL, "left")


def _gaussian_sums(cells: DataFrame, points: DataFrame, bs: float, bt: float, reach: float) -> DataFrame:
    """(x, y, t, wz, w) of points: a Gaussian weight is one of time times one of space, so sites first sum over time, points over sites."""
    data = cells.where("z is not null").select(*(F.col(c).alias(f"b_{c}") for c in CELL), F.col("z").alias("b_z"))
    at = points.select(*(F.col(c).alias(f"a_{c}") for c in CELL)).distinct()
    w = F.exp(-3 * (F.col("a_t") - F.col("b_t")) ** 2 / F.lit(float(bt) ** 2))
    by_time = within(at.select("a_t").distinct(), data, {"t": reach * bt}).withColumn("w", w)
    by_time = by_time.groupBy("b_x", "b_y", F.col("a_t").alias("b_t")).agg(F.sum(F.col("w") * F.col("b_z")).alias("wz"), F.sum("w").alias("w"))
    near = within(at, by_time, {"x": reach * bs, "y": reach * bs, "t": 0})
    v = F.exp(-3 * ((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2) / F.lit(float(bs) ** 2))
    near = near.withColumn("v", v).groupBy(*(F.col(f"a_{c}").alias(c) for c in CELL))
    return near.agg(F.sum(F.col("v") * F.col("wz")).alias("wz"), F.sum(F.col("v") * F.col("w")).alias("w"))


def kernel_cut(cells: DataFrame, points: DataFrame, bs: float, bt: float, reach: float = 3.5, kernel: str = "gaussian") -> DataFrame:
    """As ``kernel_at`` with cells farther than ``reach`` bandwidths on an axis left out (weights below exp(-3 reach**2)).

    A bucketed join: the work grows with the number of near pairs, not of all pairs.
    """
    data = cells.where("z is not null").select(*(F.col(c).alias(f"b_{c}") for c in CELL), F.col("z").alias("b_z"))
    at = points.select(*(F.col(c).alias(f"a_{c}") for c in CELL)).distinct()
    if kernel != "gaussian":
        near = within(at, data, {"x": reach * bs, "y": reach * bs, "t": reach * bt})
        return points.join(_smooth(near, _kernel_weight(_scaled(bs, bt), kernel)), CELL, "left")
    sums = _gaussian_sums(cells, points, bs, bt, reach)
    return points.join(sums.select(*CELL, (F.col("wz") / F.col("w")).alias("tr")), CELL, "left")


def kernel(cells: DataFrame, bs: float, bt: float, kernel: str = "gaussian") -> DataFrame:
    """Kernel trend at the occupied cells themselves, each with itself."""
    return kernel_at(cells.where("z is not null"), cells.where("z is not null"), bs, bt, kernel)


def kernel_truncated(cells: DataFrame, points: DataFrame, bs: float, bt: float, kernel: str = "gaussian") -> DataFrame:
    """Cells within bs and bt only; Gaussian weights beyond r2 = 1 are 0, quadratic ones are not clipped."""
    data = cells.where("z is not null").select(*(F.col(c).alias(f"b_{c}") for c in CELL), F.col("z").alias("b_z"))
    near = within(points.select(*(F.col(c).alias(f"a_{c}") for c in CELL)).distinct(), data, {"x": bs, "y": bs, "t": bt})
    ds2 = (F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2
    near, r2 = near.where(ds2 <= bs**2), _scaled(bs, bt)
    w = F.when(r2 <= 1, F.exp(-3 * r2)).otherwise(0.0) if kernel == "gaussian" else 1 - r2
    return points.join(_smooth(near, w), CELL, "left")


def eof_trend(cells: DataFrame, n: int) -> DataFrame:
    """Cells rebuilt from the n leading orthogonal functions of the site x time grid (no missing cells)."""
    from fieldloom.operators.decompose import eof

    return eof(cells, n)[1]


def estimate(name: str, cells: DataFrame, points: DataFrame | None = None, user=None, **params) -> DataFrame:
    """Trend by name: nd none, stm separable mean, ks kernel smoothing, ud a function of (cells, points)."""
    if name in ("nd", "none"):
        return no_trend(cells) if points is None else points.withColumn("tr", F.lit(0.0))
    if name in ("stm", "stmean"):
        return stmean(cells) if points is None else stmean_at(cells, points)
    if name in ("ks", "kernel"):
        return kernel(cells, **params) if points is None else kernel_at(cells, points, **params)
    if name in ("ud", "user"):
        return user(cells, points)
    raise ValueError(f"unknown trend {name!r}")


def _loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, q: int, degree: int, w: np.ndarray | None = None) -> np.ndarray:
    """Local regression with tricube weights over the q nearest points."""
    out = np.empty(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        k = np.argsort(d, kind="stable")[: min(q, len(x))]
        h = d[k].max() * (1 if q <= len(x) else q / len(x))
        u = np.clip(1 - (d[k] / h) ** 3, 0, 1) ** 3 if h > 0 else np.ones(len(k))
        if w is not None:
            u = u * w[k]
        m = np.vander(x[k] - a, degree + 1, increasing=True)
        g = m.T * u
        out[i] = np.linalg.lstsq(g @ m, g @ y[k], rcond=None)[0][0]
    return out


def stl_series(y: np.ndarray, period: int, seasonal: int | None = None, inner: int = 2, outer: int = 0) -> tuple[np.ndarray, ...]:
    """(seasonal, trend, remainder) by local regression; ``seasonal`` None means a strictly periodic season."""
    n = len(y)
    x, trend, rob = np.arange(n, dtype=float), np.zeros(n), np.ones(n)
    n_t = int(np.ceil(1.5 * period / (1 - 1.5 / (seasonal or (10 * n + 1))))) | 1
    n_l = period | 1
    for turn in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            season = np.empty(n + 2 * period)
            for k in range(period):
                own = np.arange(k, n, period)
                at = np.r_[own[0] - period, own, own[-1] + period].astype(float)
                if seasonal is None:
                    fit = np.full(len(at), np.average(detrended[own], weights=np.maximum(rob[own], 1e-12)))
                else:
                    fit = _loess(x[own], detrended[own], at, max(seasonal, 3) * period, 1, rob[own])
                season[(at + period).astype(int)] = fit
            low = season
            for width in (period, period, 3):
                low = np.convolve(low, np.ones(width) / width, "valid")
            low = _loess(x, low[:n], x, n_l, 1)
            s = season[period : n + period] - low
            trend = _loess(x, y - s, x, n_t, 1, rob)
        r = y - s - trend
        if turn < outer:
            h = 6 * np.median(np.abs(r))
            rob = np.where(np.abs(r) < h, (1 - (r / h) ** 2) ** 2, 0) if h > 0 else np.ones(n)
    return s, trend, y - s - trend


def stl(series: DataFrame, period: int, seasonal: int | None = None, outer: int = 0) -> DataFrame:
    """(id, t, z, seasonal, trend, remainder) of every series of (id, t, z); a series has to fit a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        if len(pdf) < 2 * period:
            return pdf.assign(seasonal=np.nan, trend=np.nan, remainder=np.nan)
        s, tr, r = stl_series(pdf["z"].to_numpy(float), period, seasonal, outer=outer)
        return pdf.assign(seasonal=s, trend=tr, remainder=r)

    return series.select("id", "t", "z").groupBy("id").applyInPandas(one, "id long, t double, z double, seasonal double, trend double, remainder double")


def spline_basis(v: Column, knots: list[float]) -> list[Column]:
    """Cubic truncated-power basis at fixed knots."""
    return [v, v * v, v * v * v, *(F.pow(F.greatest(v - float(k), F.lit(0.0)), F.lit(3.0)) for k in knots)]


def additive_fit(rows: DataFrame, target: str, linear: list[str] = (), smooth: dict[str, list[float]] | None = None, factors: dict[str, list] | None = None, ridge: float = 1e-6):
    """Additive model: linear terms, cubic splines at knots, factors as indicators; returns a predictor.

    The normal equations are sums over all rows in Spark; only the small system is solved on the driver.
    """
    terms: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in linear)]
    for c, knots in (smooth or {}).items():
        terms += spline_basis(F.col(c).cast("double"), knots)
    for c, levels in (factors or {}).items():
        terms += [(F.col(c) == level).cast("double") for level in levels[1:]]
    gram, right, _, _ = _normal_equations(rows, terms, target)
    beta = np.linalg.solve(gram + ridge * np.diag(np.diag(gram)), right)
    return beta, _predictor(beta, terms)


def _normal_equations(rows: DataFrame, terms: list[Column], target: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X, X'z, z'z, n) over the rows that have the target and all terms, in one pass."""
    k = len(terms)
    named = rows.select(*(t.alias(f"_b{i}") for i, t in enumerate(terms)), F.col(target).cast("double").alias("_z")).na.drop()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = named.agg(*(F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i, j in pairs), *(F.sum(F.col(f"_b{i}") * F.col("_z")) for i in range(k)), F.sum(F.col("_z") * F.col("_z")), F.count("*")).first()
    if not sums[-1]:
        raise ValueError("no row has the target and all terms")
    gram = np.zeros((k, k))
    for (i, j), v in zip(pairs, sums, strict=False):
        gram[i, j] = gram[j, i] = v
    return gram, np.array(sums[len(pairs) : len(pairs) + k], float), float(sums[-2]), int(sums[-1])


def _predictor(beta: np.ndarray, terms: list[Column]):
    def predict(df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        for b, t in zip(beta.tolist(), terms, strict=True):
            total = total + F.lit(b) * t
        return df.withColumn("fit", total)

    return predict


def _roughness(knots: list[float], degree: int) -> np.ndarray:
    """Penalty of a spline's terms on [0, 1]: the integral of its second derivative's square, or of degree 1 the sum of its bends' squares."""
    if degree == 1:
        return np.diag([0.0, *np.ones(len(knots))])
    at = np.unique([0.0, *(k for k in knots if 0 < k < 1), 1.0])
    node, w = np.polynomial.legendre.leggauss(3)
    half = np.diff(at)[:, None] / 2
    u, w = (at[:-1, None] + half * (1 + node)).ravel(), (half * w).ravel()
    second = np.stack([np.zeros_like(u), np.full_like(u, 2.0), 6 * u, *(6 * np.maximum(u - k, 0) for k in knots)])
    return (second * w) @ second.T


def additive_penalised(rows: DataFrame, target: str, smooth: dict[str, list[float]], linear: list[str] = (), factors: dict[str, list] | None = None, weights: dict[str, float] | None = None, degree: int = 3):
    """Additive model whose splines are penalised for their roughness; returns (coefficients, predictor, figures).

    A column of ``smooth`` is scaled to [0, 1] over the rows, as its knots are, and enters as a spline of degree 3 or
    1.  ``weights`` fixes the penalties' weights; those not given are chosen by generalised cross-validation,
    n RSS / (n - degrees of freedom)**2.  Both follow from sums over all rows that one pass makes, so
    trying a weight costs nothing but a small system.  ``figures`` has weights, edf, rss, gcv and n.
    """
    if degree not in (1, 3):
        raise ValueError("splines are of degree 1 or 3")
    ends = rows.where(F.col(target).isNotNull()).agg(*(f(F.col(c).cast("double")) for c in smooth for f in (F.min, F.max))).first()
    terms: list[Column] = [F.lit(1.0), *(F.col(c).cast("double") for c in linear)]
    blocks: dict[str, tuple[slice, np.ndarray]] = {}
    for n, (c, knots) in enumerate(smooth.items()):
        low, high = ends[2 * n] or 0.0, ends[2 * n + 1] or 0.0
        width = high - low or 1.0
        u, own = (F.col(c).cast("double") - F.lit(float(low))) / F.lit(float(width)), [(k - low) / width for k in knots]
        basis = spline_basis(u, own) if degree == 3 else [u, *(F.greatest(u - F.lit(float(k)), F.lit(0.0)) for k in own)]
        blocks[c] = slice(len(terms), len(terms) + len(basis)), _roughness(own, degree)
        terms += basis
    for c, levels in (factors or {}).items():
        terms += [(F.col(c) == level).cast("double") for level in levels[1:]]
    gram, right, square, n = _normal_equations(rows, terms, target)

    def solved(w: dict[str, float]) -> tuple[np.ndarray, float, float, float]:
        full = gram.copy()
        for c, (at, rough) in blocks.items():
            full[at, at] += w[c] * rough
        inverse = np.linalg.pinv(full, hermitian=True)
        beta = inverse @ right
        rss, edf = max(square - 2 * beta @ right + beta @ gram @ beta, 0.0), float(np.trace(inverse @ gram))
        return beta, rss, edf, n * rss / max(n - edf, 1e-9) ** 2

    own = dict(weights or {})
    free = [c for c in smooth if c not in own]
    unit = {c: max(np.trace(gram[blocks[c][0], blocks[c][0]]), 1e-12) / max(np.trace(blocks[c][1]), 1e-12) for c in free}
    own |= unit
    for _ in range(3 if len(free) > 1 else 1):  # one column after the other
        for c in free:
            own[c] = min((unit[c] * 10.0**e for e in np.arange(-10, 5, 0.5)), key=lambda v, c=c: solved(own | {c: v})[3])
    beta, rss, edf, gcv = solved(own)
    return beta, _predictor(beta, terms), {"weights": own, "edf": edf, "rss": rss, "gcv": gcv, "n": n}


def cross_basis(series: DataFrame, value: str, max_lag: int, knots: list[float], lag_degree: int = 2) -> DataFrame:
    """Distributed-lag cross-basis of each series (id, t): splines of the value times powers of the lag."""
    w = Window.partitionBy("id").orderBy("t")
    lags = [F.lag(value, k).over(w) for k in range(max_lag + 1)]
    rows = series.withColumns({f"lag{k}": c for k, c in enumerate(lags)})
    out = {}
    for j in range(lag_degree + 1):
        for i in range(3 + len(knots)):
            total = F.lit(0.0)
            for k in range(max_lag + 1):
                total = total + spline_basis(F.col(f"lag{k}").cast("double"), knots)[i] * F.lit(float((k / max(max_lag, 1)) ** j))
            out[f"cb_{i}_{j}"] = total
    return rows.withColumns(out)
