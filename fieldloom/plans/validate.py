"""Leave-one-out cross-validation and error statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import bme, interpolate
from fieldloom.operators.grid import bounding_box
from fieldloom.operators.stages import cut

CELL = ["x", "y", "t"]


def sample_points(data: DataFrame, n: int | None = None, seed: int = 1, box: tuple | None = None) -> DataFrame:
    """Data to estimate again: within a box, and of these n of the smallest seeded hash, if asked for."""
    chosen = bounding_box(data, *box) if box else data
    return chosen if n is None else chosen.orderBy(F.xxhash64("h_id", F.lit(seed)), "h_id").limit(n)


def loo_idw(data: DataFrame, k: int, dmax_s: float, dmax_t: float, ratio: float, power: float = 2.0, n: int | None = None, seed: int = 1, box: tuple | None = None) -> DataFrame:
    """k_id, x, y, t, z, zhat, error: every datum (h_id, x, y, t, z) from its nearest others."""
    points = sample_points(data, n, seed, box).select(F.col("h_id").alias("k_id"), *CELL, "z")
    est = interpolate.idw_nearest(data, points, k, power, dmax_s, dmax_t, ratio, exclude_same=True)
    return points.join(est, "k_id").withColumn("error", F.col("z") - F.col("zhat"))


def loo_bme(hard: DataFrame, soft: DataFrame | None, model, nh: int = 10, ns: int = 3, dmax_s: float = 10.0, dmax_t: float = 10.0, ratio: float = 1.0, options: bme.Options = bme.Options(), n: int | None = None, seed: int = 1, box: tuple | None = None) -> DataFrame:
    """k_id, x, y, t, z, zhat, variance, error: every exact datum from the others and the soft data."""
    points = sample_points(hard, n, seed, box).select(F.col("h_id").alias("k_id"), *CELL, "z")
    est = bme.predict(points, hard, soft, model, nh, ns, dmax_s, dmax_t, ratio, options, exclude="hard")
    return points.join(est.select("k_id", F.col("mean").alias("zhat"), "variance"), "k_id").withColumn("error", F.col("z") - F.col("zhat"))


def loo_stmean(cells: DataFrame) -> DataFrame:
    """The separable trend at every cell from all cells but itself, in closed form from sums and counts."""
    sums = lambda *by, s, n: cells.groupBy(*by).agg(F.sum("z").alias(s), F.count("z").alias(n))
    own = cells.join(sums("x", "y", s="_ss", n="_sn"), ["x", "y"]).join(sums("t", s="_ts", n="_tn"), "t").crossJoin(F.broadcast(sums(s="_s", n="_n")))
    mean = lambda s, n: F.try_divide(F.col(s) - F.col("z"), F.col(n) - 1)
    return own.withColumn("tr", mean("_ss", "_sn") + mean("_ts", "_tn") - mean("_s", "_n")).select(*CELL, "z", "tr")


def loo_kernel(cells: DataFrame, bs: float, bt: float, reach: float = 3.5) -> DataFrame:
    """The kernel trend at every cell from all cells but itself (weights below exp(-3 reach**2) left out)."""
    from fieldloom.operators.neighbours import within

    a = cells.where("z is not null").select(*(F.col(c).alias(f"a_{c}") for c in CELL), F.col("z").alias("a_z"))
    b = cells.where("z is not null").select(*(F.col(c).alias(f"b_{c}") for c in CELL), F.col("z").alias("b_z"))
    same = (F.col("a_x") == F.col("b_x")) & (F.col("a_y") == F.col("b_y")) & (F.col("a_t") == F.col("b_t"))
    r2 = ((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2) / bs**2 + (F.col("a_t") - F.col("b_t")) ** 2 / bt**2
    near = within(a, b, {"x": reach * bs, "y": reach * bs, "t": reach * bt}).where(~same).withColumn("w", F.exp(-3 * r2))
    return near.groupBy(*(F.col(f"a_{c}").alias(c) for c in CELL)).agg(F.first("a_z").alias("z"), (F.sum(F.col("w") * F.col("b_z")) / F.sum("w")).alias("tr"))


def _from_rank(values: DataFrame, rank: int, n: int, most: int) -> list[float]:
    """The values of ranks ``rank`` and ``rank`` + 1 (from 0) of a column v of n values.

    The range that holds them is narrowed by approximate quantiles until at most ``most`` values
    are in it, which the driver sorts.
    """
    part, below, count = values, 0, n
    while count > most:
        share, near = (rank - below) / (count - 1), 1e-3
        ends = F.array(F.lit(max(share - near, 0.0)), F.lit(min(share + near + 1 / count, 1.0)))
        low, high = part.agg(F.percentile_approx("v", ends, 10_000)).first()[0]
        under, inside = part.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below + under <= rank < below + under + inside - 1 and not (low == high and below + under <= rank < below + under + inside):
            low, high, under, inside = *part.agg(F.min("v"), F.max("v")).first(), 0, count  # the sketch was off
        if low == high and rank + 1 < below + under + inside:
            return [low, low]
        if inside == count or low == high:  # no narrower: the values of two ranks by counting those in reach
            first = part.where(F.col("v") >= low).agg(F.min("v")).first()[0]
            while below + (up := part.where(F.col("v") <= first).count()) <= rank:
                first = part.where(F.col("v") > first).agg(F.min("v")).first()[0]
            return [first, first if below + up > rank + 1 else part.where(F.col("v") > first).agg(F.min("v")).first()[0]]
        part, below, count = part.where(F.col("v").between(low, high)), below + under, inside
    own = sorted(r.v for r in part.collect())
    return own[rank - below : rank - below + 2]


def exact_quantiles(rows: DataFrame, column: str, shares: tuple[float, ...], most: int = 100_000) -> list[float | None]:
    """Quantiles, linear between ranks, without gathering the column in one place."""
    values = rows.select(F.col(column).alias("v")).where("v is not null").persist()
    try:
        n, out = values.count(), []
        for share in shares:
            if not n:
                out.append(None)
                continue
            rank = min(int(share * (n - 1)), max(n - 2, 0))
            pair = _from_rank(values, rank, n, most)
            out.append(pair[0] + (share * (n - 1) - rank) * (pair[-1] - pair[0]))
        return out
    finally:
        values.unpersist()


def error_statistics(errors: DataFrame, *by: str, most: int = 100_000) -> DataFrame:
    """rmse, mean, std (population), p25, median, p75, min, max of ``error``, over all or by columns; nulls do not count.

    By columns a group's errors meet in one task; over all, quantiles are found by ranges of values,
    of which at most ``most`` are looked at together.
    """
    e = F.col("error")
    names = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    if by:
        quantiles = {k: F.percentile(e, q) for k, q in names.items()}
    else:
        errors = cut(errors.select("error"))  # several passes read them
        quantiles = {k: F.lit(v).cast("double") for k, v in zip(names, exact_quantiles(errors, "error", tuple(names.values()), most), strict=True)}
    stats = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max")]
    order = ["rmse", "mean", "std", "p25", "median", "p75", "min", "max"]
    if by:
        return errors.groupBy(*by).agg(*stats, *(q.alias(k) for k, q in quantiles.items())).select(*by, *order)
    return errors.agg(*stats).withColumns(quantiles).select(*order)


def histogram(cells: DataFrame, bins: int = 10, value: str = "z") -> DataFrame:
    """(x, y, bin, n): per site counts in equal bins between its smallest and largest value, the last closed."""
    ends = cells.groupBy("x", "y").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col(value)
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) + 1, F.lit(bins)))
    return cells.where(v.isNotNull()).join(ends, ["x", "y"]).groupBy("x", "y", b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def series(result: DataFrame, x: float, y: float) -> DataFrame:
    return result.where((F.col("x") == x) & (F.col("y") == y)).orderBy("t")


def map_at(result: DataFrame, t: float) -> DataFrame:
    return result.where(F.col("t") == t).select("x", "y", "mean", "variance")
