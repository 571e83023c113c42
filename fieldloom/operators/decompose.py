"""Orthogonal-function decompositions.

What grows with the rows - Gram and covariance matrices - is summed in Spark as partial sums of
outer products; what is left (columns by columns) is solved on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.stages import cut

CELL = ["x", "y", "t"]


def complete(vectors: DataFrame, column: str = "v") -> DataFrame:
    """The rows whose array has no missing component; null, empty, and NaN ones are left out."""
    v = F.col(column).cast("array<double>")
    return vectors.withColumn(column, v).where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.exists(column, lambda c: c.isNull() | F.isnan(c)))


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one length as a matrix, from its buffer; other lengths are an error."""
    n = np.diff(column.offsets.to_numpy())
    if len(n) and (n != n[0]).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(i, j, g) for i <= j: sums of products of the components (from 0) of an array column.

    Every batch of rows becomes one outer product, so what is shuffled is a few matrices a task.
    Incomplete rows do not count.
    """

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                m = _dense(b.column(0))
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "g"])

    return complete(vectors, column).select(column).mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def column_sums(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(i, s, n) of the components."""
    return complete(vectors, column).select(F.posexplode(column).alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s"), F.count("*").alias("n"))


def covariance(vectors: DataFrame, column: str = "v") -> DataFrame:
    """(i, j, c) for i <= j with divisor n - 1."""
    s = F.broadcast(column_sums(vectors, column))
    a, b = s.select("i", F.col("s").alias("si"), "n"), s.select(F.col("i").alias("j"), F.col("s").alias("sj"))
    return gram(vectors, column).join(a, "i").join(b, "j").select("i", "j", ((F.col("g") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1)).alias("c"))


def _matrix(rows: DataFrame, value: str) -> np.ndarray:
    got = rows.select("i", "j", value).toArrow()  # columns by columns
    i, j, v = (c.to_numpy() for c in got.columns)
    d = int(j.max(initial=-1)) + 1
    m = np.zeros((d, d))
    m[i, j] = m[j, i] = v
    return m


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    top = np.abs(v).argmax(0)
    return v * np.sign(v[top, np.arange(v.shape[1])])


def eof_vectors(vectors: DataFrame, column: str = "v", n: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(L, singular values, EOFs as columns) of the rows, not centred; L is divided by rows - 1."""
    m = complete(vectors, column).count()
    value, axes = np.linalg.eigh(_matrix(gram(vectors, column), "g"))
    order = np.argsort(-value, kind="stable")[: n or len(value)]
    s = np.sqrt(np.maximum(value[order], 0))
    return s**2 / max(m - 1, 1), s, fix_signs(axes[:, order])


def project(vectors: DataFrame, eofs: np.ndarray, id_col: str, column: str = "v") -> DataFrame:
    """(id, ecs): coefficients of the rows on the orthogonal functions."""
    own = vectors.sparkSession.sparkContext.broadcast(eofs)

    def run(batches):
        for b in batches:
            ecs = list(_dense(b.column(1)) @ own.value) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ecs, pa.list_(pa.float64()))], [id_col, "ecs"])

    return complete(vectors, column).select(F.col(id_col).cast("long").alias(id_col), column).mapInArrow(run, f"{id_col} long, ecs array<double>")


def grid_rows(cells: DataFrame) -> tuple[DataFrame, list[float]]:
    """((x, y, v array by time), times) of the sites that have every time."""
    ts = [r.t for r in cells.select("t").distinct().orderBy("t").collect()]
    rows = cells.where("z is not null").groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("t", "z"))).alias("_p"))
    return rows.where(F.size("_p") == len(ts)).select("x", "y", F.transform("_p", lambda p: p["z"]).alias("v")), ts


def eof(cells: DataFrame, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame]:
    """(EOF of sites by times, cells (x, y, t, tr) rebuilt from n of them)."""
    rows, ts = grid_rows(cells)
    found = eof_vectors(rows, "v", n)
    half = found[2] @ found[2].T
    at = F.array(*map(F.lit, ts))
    rebuilt = F.array(*(F.aggregate(F.zip_with("v", F.array(*map(F.lit, map(float, half[:, k]))), lambda a, b: a * b), F.lit(0.0), lambda s, q: s + q) for k in range(len(ts))))
    long = rows.select("x", "y", F.explode(F.arrays_zip(at.alias("t"), rebuilt.alias("tr"))).alias("p"))
    return found, long.select("x", "y", F.col("p.t").alias("t"), F.col("p.tr").alias("tr"))


def lag_embedding(series: DataFrame, window: int) -> DataFrame:
    """(id, t, v): each value with the window - 1 before it, oldest first; incomplete ones are left out."""
    w = Window.partitionBy("id").orderBy("t")
    v = F.array(*(F.lag("z", k).over(w) if k else F.col("z") for k in range(window - 1, -1, -1)))
    return series.select("id", "t", v.alias("v")).where(~F.exists("v", lambda c: c.isNull()))


def lag_gram(series: DataFrame, window: int) -> DataFrame:
    """(i, j, g), i <= j: the products of lags of all complete windows, summed without making the windows.

    Every value is read once with the ones after it, so the sums are plain aggregates of products at two lags.
    """
    after = Window.partitionBy("id").orderBy("t")
    whole = F.count("z").over(after.rowsBetween(0, window - 1)) == window
    ahead = series.select(*(F.lead("z", k).over(after).alias(f"_{k}") for k in range(window)), whole.alias("_whole")).where("_whole")
    pairs = [(i, j) for i in range(window) for j in range(i, window)]
    sums = ahead.agg(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"g{n}") for n, (i, j) in enumerate(pairs)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"g{n}").alias("g")) for n, (i, j) in enumerate(pairs)))).alias("p")).select("p.*")


def extended_eof(series: DataFrame, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rotated loadings, rotation) of the lag-embedded series."""
    return rotated_eof(lag_embedding(series, window), n)


def varimax_criterion(loadings: np.ndarray) -> float:
    """Sum over the columns of the variance of their squared loadings."""
    return float((loadings**2).var(0).sum())


def varimax(loadings: np.ndarray, sweeps: int = 200, gain: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(rotated loadings, rotation) of the largest criterion, by planar rotations.

    A sweep turns every pair of columns by the angle that is best for the two; sweeps end when one
    raises the criterion by no more than ``gain`` of it.
    """
    turned, turn = loadings.astype(float).copy(), np.eye(loadings.shape[1])
    best, rows = varimax_criterion(turned), len(loadings)
    for _ in range(sweeps):
        for i in range(turned.shape[1]):
            for j in range(i + 1, turned.shape[1]):
                x, y = turned[:, i], turned[:, j]
                u, v = x * x - y * y, 2 * x * y
                rise = 2 * (rows * (u @ v) - u.sum() * v.sum())
                run = rows * (u @ u - v @ v) - u.sum() ** 2 + v.sum() ** 2
                angle = np.arctan2(rise, run) / 4
                plane = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                turned[:, [i, j]] = turned[:, [i, j]] @ plane
                turn[:, [i, j]] = turn[:, [i, j]] @ plane
        now = varimax_criterion(turned)
        if now - best <= gain * now:
            break
        best = now
    return turned, turn


def rotated_eof(vectors: DataFrame, n: int, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """EOFs scaled by the root of their eigenvalue, varimax-rotated, largest loading positive."""
    value, _, axes = eof_vectors(vectors, column, n)
    turned, turn = varimax(axes * np.sqrt(value))
    return fix_signs(turned), turn


def pca(vectors: DataFrame, column: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, axes) of the covariance, largest first."""
    value, axes = np.linalg.eigh(_matrix(covariance(vectors, column), "c"))
    return value[::-1], fix_signs(axes[:, ::-1])


def ica(vectors: DataFrame, n: int, column: str = "v", rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mixing matrix, unmixing matrix) of n independent parts: whitening and fixed-point iterations
    (tanh) over all rows; an iteration's sums are one pass in Spark."""
    vectors = complete(vectors.select(column), column).persist()
    try:
        value, axes = pca(vectors, column)
        white = axes[:, :n] / np.sqrt(value[:n])
        sums = {r.i: r.s / r.n for r in column_sums(vectors, column).collect()}  # one row a column
        shift = np.array([sums[i] for i in range(len(axes))]) @ white
        w, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
        for _ in range(rounds):
            yz, slope = _tanh_means(vectors, column, white, shift, w)
            u, _, vt = np.linalg.svd(yz - np.diag(slope) @ w)
            new = u @ vt
            done = np.abs(np.abs((new * w).sum(1)) - 1).max() < 1e-8
            w = new
            if done:
                break
    finally:
        vectors.unpersist()
    return np.linalg.pinv(w @ white.T), w @ white.T


def _tanh_means(vectors: DataFrame, column: str, white: np.ndarray, shift: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of y z', mean of 1 - y^2) over all rows, for z the whitened row and y = tanh(w z)."""
    n = len(w)

    def run(batches):
        total, rows = np.zeros(n * n + n), 0
        for b in batches:
            x = b.column(0)
            if len(x):
                z = _dense(x) @ white - shift
                y = np.tanh(z @ w.T)
                total += np.r_[(y.T @ z).ravel(), (1 - y**2).sum(0)]
                rows += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n + n), pa.int32()), pa.array(total), pa.array(np.full(n * n + n, rows), pa.int64())], ["i", "s", "n"])

    got = vectors.select(column).mapInArrow(run, "i int, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    mean = np.array([r.s / r.n for r in got])
    return mean[: n * n].reshape(n, n), mean[n * n :]


def classify(values: DataFrame, column: str = "loading") -> DataFrame:
    """Rows with region 1 where the value is beyond 1.96 deviations of the wider of two Gaussians fitted to it."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[column], outputCol="_f").transform(values)
    model = GaussianMixture(featuresCol="_f", k=2, seed=1).fit(rows)
    parts = [(g.mean[0], g.cov.toArray()[0][0] ** 0.5) for g in model.gaussians]
    mean, std = min(parts, key=lambda p: abs(p[0]))
    return values.withColumn("region", (F.abs(F.col(column) - mean) > 1.96 * std).cast("int"))


def unfold(tensor: np.ndarray, mode: int) -> np.ndarray:
    """Mode-n unfolding, earlier modes fastest."""
    return np.reshape(np.moveaxis(tensor, mode, 0), (tensor.shape[mode], -1), order="F")


def fold(matrix: np.ndarray, mode: int, shape: tuple[int, ...]) -> np.ndarray:
    rest = [s for i, s in enumerate(shape) if i != mode]
    return np.moveaxis(np.reshape(matrix, (matrix.shape[0], *rest), order="F"), 0, mode)


def mode_product(tensor: np.ndarray, matrix: np.ndarray, mode: int) -> np.ndarray:
    shape = list(tensor.shape)
    shape[mode] = matrix.shape[0]
    return fold(matrix @ unfold(tensor, mode), mode, tuple(shape))


def hosvd(tensor: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(core, factors) of the higher-order singular value decomposition."""
    factors = [np.linalg.svd(unfold(tensor, k), full_matrices=False)[0] for k in range(tensor.ndim)]
    core = tensor
    for k, u in enumerate(factors):
        core = mode_product(core, u.T, k)
    return core, factors


def mode_gram(tensor: DataFrame, mode: str, value: str = "v") -> DataFrame:
    """(i, j, g) of a mode's unfolding for a tensor in long form (one index column per mode, value)."""
    rest = [c for c in tensor.columns if c not in (mode, value)]
    a, b = tensor.withColumnsRenamed({mode: "_i", value: "_a"}), tensor.withColumnsRenamed({mode: "_j", value: "_b"})
    return a.join(b, rest).where("_i <= _j").groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum(F.col("_a") * F.col("_b")).alias("g"))


#: Indices of a mode beyond which its Gram matrix is no matter for the driver.
MODE_SIZE = 4096
#: Weights below this share of the largest are none.
_NO_WEIGHT = 1e-12


def _weighty(g: np.ndarray, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a Gram matrix that have weight, largest first, n at most."""
    weight, axes = np.linalg.eigh(g)
    order = [k for k in np.argsort(-weight, kind="stable") if weight[k] > _NO_WEIGHT * max(weight.max(initial=0), 1e-300)][:n]
    return weight[order], axes[:, order]


def _fibres(tensor: DataFrame, mode: str, value: str, limit: int) -> tuple[DataFrame, list] | None:
    """((mode, v): a row an index, dense over the other modes' indices; these), or None where they are more than ``limit``."""
    rest = [c for c in tensor.columns if c not in (mode, value)]
    seen = tensor.select(*rest).distinct().limit(limit + 1).collect()
    if len(seen) > limit:
        return None
    seen = sorted(map(tuple, seen))
    kinds = dict(tensor.dtypes)
    place = tensor.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(seen)], ", ".join(f"{c} {kinds[c]}" for c in rest) + ", _p int")
    own = tensor.join(F.broadcast(place), rest).groupBy(F.col(mode).alias("_id")).agg(F.collect_list("_p").alias("_p"), F.collect_list(value).alias("_v"))

    def run(batches):
        for b in batches:
            count = np.diff(b.column(1).offsets.to_numpy())
            dense = np.zeros((b.num_rows, len(seen)))
            np.add.at(dense, (np.repeat(np.arange(b.num_rows), count), b.column(1).flatten().to_numpy()), b.column(2).flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(dense)], [mode, "v"])

    return own.mapInArrow(run, f"{mode} {kinds[mode]}, v array<double>"), seen


def _lists(m: np.ndarray) -> pa.ListArray:
    """A matrix as lists, one a row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(m.shape[0] + 1, dtype=np.int32) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _tall(tensor: DataFrame, mode: str, value: str, keep: int | None) -> tuple[DataFrame, DataFrame]:
    """(factor (mode, k, u), core) of a mode with more indices than the other modes' together.

    The other side's Gram matrix has the same weights; a row of the factor is the row's product with its
    eigenvectors over their lengths.  A second Gram matrix, of these products, makes them orthonormal to rounding.
    """
    found = _fibres(tensor, mode, value, MODE_SIZE)
    if found is None:
        raise ValueError(f"mode {mode} and the other modes have more than {MODE_SIZE} indices")
    rows, seen = cut(found[0]), found[1]
    weight, axes = _weighty(_matrix(gram(rows), "g"), keep)
    if not len(weight):
        raise ValueError("a tensor without weight")
    side, kind = axes / np.sqrt(weight), dict(tensor.dtypes)[mode]

    def products(by: np.ndarray) -> DataFrame:
        own = tensor.sparkSession.sparkContext.broadcast(by)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), _lists(_dense(b.column(1)) @ own.value)], [mode, "v"])

        return rows.mapInArrow(run, f"{mode} {kind}, v array<double>")

    size, turn = np.linalg.eigh(_matrix(gram(products(side)), "g"))
    side = side @ (turn / np.sqrt(size)) @ turn.T  # the orthonormal columns nearest to them
    top = products(side).select(F.posexplode("v").alias("k", "u")).groupBy("k").agg(F.max_by("u", F.abs("u")).alias("u")).toArrow()
    signs = np.ones(side.shape[1])
    signs[top["k"].to_numpy()] = np.sign(top["u"].to_numpy())
    side = side * signs
    factor = products(side).select(mode, F.posexplode("v").alias("k", "u"))
    own = tensor.sparkSession.sparkContext.broadcast(side)

    def share(batches):
        total = np.zeros(own.value.shape[::-1])
        for b in batches:
            if b.num_rows:
                m = _dense(b.column(1))
                total += (m @ own.value).T @ m
        k, p = (i.ravel() for i in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(p, pa.int32()), pa.array(total.ravel())], ["_k", "_p", "_v"])

    rest, kinds = [c for c in tensor.columns if c not in (mode, value)], dict(tensor.dtypes)
    place = tensor.sparkSession.createDataFrame([(n, *r) for n, r in enumerate(seen)], "_p int, " + ", ".join(f"{c} {kinds[c]}" for c in rest))
    sums = rows.mapInArrow(share, "_k int, _p int, _v double").groupBy("_k", "_p").agg(F.sum("_v").alias("_v"))
    core = sums.join(F.broadcast(place), "_p").withColumnsRenamed({"_k": mode, "_v": value}).select(*tensor.columns)
    return factor, core


def hosvd_long(tensor: DataFrame, value: str = "v", keep: dict[str, int] | None = None, tall: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(core, factors) of a tensor in long form: one index column per mode and a value; entries not listed are 0.

    A mode's factor (index, k, u) holds the eigenvectors of its Gram matrix, ``keep[mode]`` of them or all with
    weight; the core has an index column k per mode.  Each product with a factor is a join on the mode's index and a sum;
    only Gram matrices, of at most ``MODE_SIZE`` indices, leave the cluster.  With ``tall`` a mode may have any number of
    indices, if the other modes' together have no more than that: its factor and its product come from the other side.
    """
    spark, modes = tensor.sparkSession, [c for c in tensor.columns if c != value]
    factors, core, high = {}, tensor, None
    for mode in modes:
        if tensor.select(mode).distinct().limit(MODE_SIZE + 1).count() > MODE_SIZE:
            if not tall:
                raise ValueError(f"mode {mode} has more than {MODE_SIZE} indices")
            factors[mode], core = _tall(tensor, mode, value, (keep or {}).get(mode))
            core, high = cut(core), mode
            continue
        got = mode_gram(tensor, mode, value).toArrow()
        i, j, v = (got[c].to_numpy(zero_copy_only=False) for c in "ijg")
        index = np.unique(np.r_[i, j])
        at, g = lambda x: np.searchsorted(index, x), np.zeros((len(index), len(index)))  # noqa: B023, E731
        g[at(i), at(j)] = g[at(j), at(i)] = v
        axes = _weighty(g, (keep or {}).get(mode))[1]
        axes = fix_signs(axes) if axes.shape[1] else axes
        kind = dict(tensor.dtypes)[mode]
        factors[mode] = spark.createDataFrame([(x, k, float(axes[n, k])) for n, x in enumerate(index.tolist()) for k in range(axes.shape[1])], f"{mode} {kind}, k int, u double")
    for mode, factor in factors.items():
        if mode != high:
            core = times_matrix(core, factor, mode, "k", value)
    return core, factors


def times_matrix(tensor: DataFrame, factor: DataFrame, mode: str, to: str, value: str = "v") -> DataFrame:
    """The tensor times a matrix along a mode: ``factor`` (mode, to, u) sends each index to those of ``to``, which takes the mode's name."""
    rest = [c for c in tensor.columns if c not in (mode, value)]
    both = tensor.join(factor.select(F.col(mode), F.col(to).alias("_to"), "u"), mode)
    return both.groupBy(*rest, F.col("_to").alias(mode)).agg(F.sum(F.col(value) * F.col("u")).alias(value)).select(*tensor.columns)


#: Entries of a core that go to every task, where a mode has more indices than ``MODE_SIZE``.
CORE_ENTRIES = 1 << 22


def _rebuilt_tall(core: DataFrame, factor: DataFrame, mode: str, value: str) -> DataFrame | None:
    """The product with a factor of many indices, each index's row times the core as a matrix; None where that is too large."""
    rest, kinds = [c for c in core.columns if c not in (mode, value)], dict(core.dtypes)
    got = core.limit(CORE_ENTRIES + 1).toArrow()
    ks = np.unique(got[mode].to_numpy(zero_copy_only=False))
    others, place = np.unique(np.stack([got[c].to_numpy(zero_copy_only=False) for c in rest], 1), axis=0, return_inverse=True)
    if got.num_rows > CORE_ENTRIES or len(ks) * len(others) > CORE_ENTRIES:
        return None
    m = np.zeros((int(ks.max(initial=-1)) + 1, len(others)))
    np.add.at(m, (got[mode].to_numpy(zero_copy_only=False), place.ravel()), got[value].to_numpy())
    own, kind = core.sparkSession.sparkContext.broadcast((m, others)), dict(factor.dtypes)[mode]

    def run(batches):
        m, others = own.value
        for b in batches:
            step = max(1, (1 << 20) // max(len(others), 1))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                count = np.diff(part.column(1).offsets.to_numpy())
                u = np.zeros((part.num_rows, len(m)))
                k = part.column(1).flatten().to_numpy()
                known = k < len(m)
                u[np.repeat(np.arange(part.num_rows), count)[known], k[known]] = part.column(2).flatten().to_numpy()[known]
                index = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(others))))
                other = [pa.array(np.tile(o, part.num_rows)) for o in others.T]
                yield pa.RecordBatch.from_arrays([index, *other, pa.array((u @ m).ravel())], [mode, *rest, value])

    rows = factor.groupBy(mode).agg(F.collect_list("k").alias("_k"), F.collect_list("u").alias("_u"))
    schema = f"{mode} {kind}, " + ", ".join(f"{c} {kinds[c]}" for c in rest) + f", {value} double"
    return rows.mapInArrow(run, schema).select(*core.columns)


def rebuilt(core: DataFrame, factors: dict[str, DataFrame], value: str = "v") -> DataFrame:
    """The tensor in long form from its core and factors; a mode of more than ``MODE_SIZE`` indices comes last."""
    many = {m: f.select(m).distinct().limit(MODE_SIZE + 1).count() > MODE_SIZE for m, f in factors.items()}
    out = core
    for mode, factor in sorted(factors.items(), key=lambda f: many[f[0]]):
        if many[mode]:
            out = cut(out)
            if (found := _rebuilt_tall(out, factor, mode, value)) is not None:
                out = found
                continue
        back = factor.select(F.col("k").alias(mode), F.col(mode).alias("_index"), "u")
        out = times_matrix(out, back, mode, "_index", value)
    return out


def gram_schmidt(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal rows from rows, in order; dependent ones are left out."""
    out: list[np.ndarray] = []
    for v in vectors.astype(float):
        size = np.linalg.norm(v)
        for _ in range(2):
            for q in out:
                v = v - (q @ v) * q
        if np.linalg.norm(v) > 1e-10 * max(size, 1.0):
            out.append(v / np.linalg.norm(v))
    return np.array(out)


def weighted_qr(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q, r) with q' diag(w) q = 1."""
    root = np.sqrt(w)[:, None]
    q, r = np.linalg.qr(x * root)
    return q / root, r
