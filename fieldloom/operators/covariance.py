"""Empirical space-time covariance by lag.

Pairs of sites are found first, by a bucketed self-join of the distinct ones, and get their lags
there.  Each side brings its whole series in one row, so what is exchanged grows with the pairs of
sites and not with those of cells; a task matches the series' times in arrays and passes on sums by
lag.  A pair of sites counts in the order of their coordinates, each site with itself too.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.neighbours import pairs_between_radii, within
from fieldloom.operators.stages import cut

Bins = list[tuple[float, float]]


def lag_bins(lags: list[float], tol: float | list[float]) -> Bins:
    """[(lag, tolerance)]; one tolerance for all or one each."""
    return [(float(a), float(b)) for a, b in zip(lags, [tol] * len(lags) if isinstance(tol, (int, float)) else tol, strict=True)]


def _reach(bins: Bins) -> float:
    return max(lag + tol for lag, tol in bins)


def _inside(d: Column, lag: float, tol: float, kind: str) -> Column:
    low, high = F.lit(lag - tol), F.lit(lag + tol)
    if kind == "half":  # [m - r, m + r)
        return (d >= low) & (d < high)
    if kind == "closed":
        return (d >= low) & (d <= high)
    return (d > low) & (d <= high)  # open: (m - r, m + r]


def with_lag(pairs: DataFrame, d: Column, bins: Bins, kind: str, name: str) -> DataFrame:
    """Pairs with their lag: by a chain of conditions where bins are apart, else one row for every bin that fits."""
    ends = sorted((lag - tol, lag + tol) for lag, tol in bins)
    touch = kind == "closed"
    apart = all(a[1] < b[0] or (a[1] == b[0] and not touch) for a, b in zip(ends, ends[1:], strict=False))
    if apart:
        (lag, tol), *rest = bins
        chain = F.when(_inside(d, lag, tol, kind), lag)
        for lag, tol in rest:
            chain = chain.when(_inside(d, lag, tol, kind), lag)
        return pairs.withColumn(name, chain).where(F.col(name).isNotNull())
    fits = F.array_compact(F.array(*(F.when(_inside(d, lag, tol, kind), F.lit(lag)) for lag, tol in bins)))
    return pairs.withColumn(name, F.explode(fits))


def site_pairs(cells: DataFrame, reach: float) -> DataFrame:
    """(a_x, a_y, b_x, b_y, dx, dy, ds) of sites at most so far apart, the left one first by x, then y."""
    own = cells.select("x", "y").distinct()
    a, b = (own.select(*(F.col(c).alias(f"{s}_{c}") for c in own.columns)) for s in "ab")
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    near = within(a, b, {"x": reach, "y": reach}).withColumns({"dx": dx, "dy": dy, "ds": F.sqrt(dx * dx + dy * dy)})
    return near.where((F.col("ds") <= reach) & ((F.col("dx") > 0) | ((F.col("dx") == 0) & (F.col("dy") >= 0))))


def time_pairs(cells: DataFrame, reach: float) -> DataFrame:
    """(a_t, b_t, dt) of times at most so far apart, the left one not later."""
    own = cells.select("t").distinct()
    if reach == 0:
        return own.select(F.col("t").alias("a_t"), F.col("t").alias("b_t"), F.lit(0.0).alias("dt"))
    near = within(own.select(F.col("t").alias("a_t")), own.select(F.col("t").alias("b_t")), {"t": reach})
    return near.withColumn("dt", F.col("b_t") - F.col("a_t")).where("dt >= 0")


def products(cells: DataFrame, value: str, sp: DataFrame, tp: DataFrame) -> DataFrame:
    """Columns of both pair tables with l and r, the values of the left and the right cell."""
    own = cells.where(F.col(value).isNotNull()).select("x", "y", "t", F.col(value).alias("v"))
    left, right = (own.select(*(F.col(c).alias(f"{s}_{c}") for c in "xyt"), F.col("v").alias(n)) for s, n in (("a", "l"), ("b", "r")))
    return left.join(sp, ["a_x", "a_y"]).join(tp, "a_t").join(right, ["b_x", "b_y", "b_t"])


PAIRS_AT_ONCE = 2048


def _fits(d: np.ndarray, lag: float, tol: float, kind: str) -> np.ndarray:
    if kind == "half":
        return (d >= lag - tol) & (d < lag + tol)
    return (d >= lag - tol) & (d <= lag + tol)


def _slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of an array column."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), off - off[0]


def _lag_sums(keys: list[str], bins: Bins, kind: str, both: bool):
    """Sums by keys and time lag over pairs of series (a_t, a_v, b_t, b_v, same).

    Left values count with right ones of the same time or later, with ``both`` earlier ones too, but
    not where the two sites are the same.
    """
    reach = _reach(bins)

    def part(group, same, at, av, bt, bv, out):
        """at and bt: (times, offsets); sums of some pairs."""
        n = len(group)
        pair_a, pair_b = (np.repeat(np.arange(n), np.diff(off)) for _, off in (at, bt))
        times, place = np.unique(bt[0], return_inverse=True)
        step = len(times) + 1
        where = pair_b * step + place
        back = np.where(same[pair_a] | (not both), 0.0, reach)
        first = np.searchsorted(where, pair_a * step + np.searchsorted(times, at[0] - back, "left"))
        last = np.searchsorted(where, pair_a * step + np.searchsorted(times, at[0] + reach, "right"))
        count = last - first
        i = np.repeat(np.arange(len(count)), count)
        j = np.arange(len(i)) + np.repeat(first - (np.cumsum(count) - count), count)
        dt, l, r, g = np.abs(bt[0][j] - at[0][i]), av[i], bv[j], group[pair_a[i]]
        for k, (lag, tol) in enumerate(bins):
            on = _fits(dt, lag, tol, kind)
            for m, w in enumerate((None, l[on], r[on], l[on] * r[on])):
                out[m, :, k] += np.bincount(g[on], w, out.shape[1])

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, group = np.unique(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in keys], 1), axis=0, return_inverse=True)
            same = b.column("same").to_numpy(zero_copy_only=False).astype(bool)
            (ta, oa), (tb, ob) = _slices(b.column("a_t")), _slices(b.column("b_t"))
            va, vb = _slices(b.column("a_v"))[0], _slices(b.column("b_v"))[0]
            out = np.zeros((4, len(rows), len(bins)))
            for lo in range(0, b.num_rows, PAIRS_AT_ONCE):
                hi = min(lo + PAIRS_AT_ONCE, b.num_rows)
                x, y = slice(oa[lo], oa[hi]), slice(ob[lo], ob[hi])
                part(group.ravel()[lo:hi], same[lo:hi], (ta[x], oa[lo : hi + 1] - oa[lo]), va[x], (tb[y], ob[lo : hi + 1] - ob[lo]), vb[y], out)
            g, k = np.nonzero(out[0])
            cells = [*rows[g].T, np.array([bins[i][0] for i in k.tolist()], float), out[0, g, k].astype(np.int64), *(out[m, g, k] for m in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], [*keys, "lag_t", "n", "sl", "sr", "slr"])

    return run


#: Cells of one site in a block of time, about, where sites have more.
BLOCK_CELLS = 4096


def block_width(cells: DataFrame, reach: float) -> float | None:
    """Length of blocks of time that leave some ``BLOCK_CELLS`` of the largest site in one, at least ``reach``; None where one block does."""
    counts = cells.groupBy("x", "y").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))
    most = counts.agg(F.max(F.struct("n", "span"))).first()[0]
    if most is None or most.n <= BLOCK_CELLS:
        return None
    return max(float(reach), float(most.span) * BLOCK_CELLS / most.n, 1e-300) * (1 + 1e-9)


def lag_sums(cells: DataFrame, value: str, sp: DataFrame, lags_t: Bins, kind: str, keys: list[str], both: bool = False) -> DataFrame:
    """(keys, lag_t, n, sl, sr, slr): numbers of pairs of cells, sums of the left and right values and
    of their products, over the pairs of sites ``sp`` (a_x, a_y, b_x, b_y, ds, keys).

    A site's series travels in blocks of time, none shorter than the largest lag, so that a block meets its own
    and the next of another site (with ``both`` the one before, too) and a site of many times is many rows.
    """
    own = cells.where(F.col(value).isNotNull())
    width = block_width(own, _reach(lags_t))
    block = F.lit(0) if width is None else F.floor(F.col("t") / F.lit(width)).cast("long")
    series = own.groupBy("x", "y", block.alias("_k")).agg(F.array_sort(F.collect_list(F.struct("t", F.col(value).cast("double").alias("v")))).alias("_p"))
    sides = [series.select(F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"), "_k", F.col("_p.t").alias(f"{k}_t"), F.col("_p.v").alias(f"{k}_v")) for k in "ab"]
    if width is not None:  # the left blocks that a right one meets; of one site each pair of cells counts once
        sides[0] = sides[0].withColumn("_k", F.explode(F.array(*(F.col("_k") + n for n in ((-1, 0, 1) if both else (0, 1))))))
    both_sides = sp.join(sides[0], ["a_x", "a_y"]).join(sides[1], ["b_x", "b_y", "_k"])
    if width is not None and both:
        both_sides = both_sides.where((F.col("ds") > 0) | (F.floor(F.col("a_t")[0] / F.lit(width)) <= F.col("_k")))
    rows = both_sides.select(*keys, (F.col("ds") == 0).alias("same"), "a_t", "a_v", "b_t", "b_v")
    names = ", ".join(f"{k} double" for k in keys)
    sums = rows.mapInArrow(_lag_sums(keys, lags_t, kind, both), f"{names}, lag_t double, n long, sl double, sr double, slr double")
    return sums.groupBy(*keys, "lag_t").agg(*(F.sum(c).alias(c) for c in ("n", "sl", "sr", "slr")))


def _from_sums(sums: DataFrame, *keys: str) -> DataFrame:
    m1, m2 = F.col("sl") / F.col("n"), F.col("sr") / F.col("n")
    return sums.select(*keys, "n", m1.alias("m1"), m2.alias("m2"), (F.col("slr") / F.col("n") - m1 * m2).alias("cov"))


def _covariance(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("l").alias("m1"), F.avg("r").alias("m2"), F.covar_pop("l", "r").alias("cov"))


def _azimuth_off(degrees: Column) -> Column:
    """Angle between a pair's direction and ``degrees``, modulo half a turn, from -90 to 90."""
    return F.pmod(F.degrees(F.atan2("dy", "dx")) - degrees + 90, F.lit(180.0)) - 90


def empirical_covariance(cells: DataFrame, lags_s: Bins, lags_t: Bins, value: str = "residual", bins: str = "half", azimuth: tuple[float, float] | None = None) -> DataFrame:
    """(lag_s, lag_t, n, m1, m2, cov) in one orientation; bins without pairs are absent.

    ``azimuth`` (degrees, tolerance) keeps pairs of sites of that direction, and sites with themselves.
    """
    cells = cut(cells.select("x", "y", "t", value))  # read by the pairs of sites and by both sides
    sp = site_pairs(cells, _reach(lags_s))
    if azimuth is not None:
        sp = sp.where((F.abs(_azimuth_off(F.lit(azimuth[0]))) <= azimuth[1] + 1e-9) | (F.col("ds") == 0))
    sp = with_lag(sp, F.col("ds"), lags_s, bins, "lag_s")
    return _from_sums(lag_sums(cells, value, sp, lags_t, bins, ["lag_s"]), "lag_s", "lag_t")


def annulus_covariance(cells: DataFrame, lags_s: Bins, lags_t: Bins, value: str = "residual") -> DataFrame:
    """As ``empirical_covariance`` with closed bins, the pairs of each bin searched between its two radii alone."""
    own = cells.select("x", "y").distinct().select(F.struct("x", "y").alias("si"), "x", "y")
    found = [pairs_between_radii(own, max(lag - tol, 0.0), lag + tol).withColumn("lag_s", F.lit(float(lag))) for lag, tol in lags_s]
    sp = reduce(DataFrame.union, found).select(*(F.col(f"{s}_si.{c}").alias(f"{s}_{c}") for s in "ab" for c in "xy"), "ds", "lag_s")
    return _from_sums(lag_sums(cells, value, sp, lags_t, "closed", ["lag_s"]), "lag_s", "lag_t")


def symmetric_covariance(cells: DataFrame, lags_s: Bins, lags_t: Bins, value: str = "residual") -> DataFrame:
    """Closed bins and both orientations, about the square of the pooled mean."""
    sp = with_lag(site_pairs(cells, _reach(lags_s)), F.col("ds"), lags_s, "closed", "lag_s")
    sums = lag_sums(cells, value, sp, lags_t, "closed", ["lag_s"], both=True)
    m = (F.col("sl") + F.col("sr")) / (2 * F.col("n"))
    return sums.select("lag_s", "lag_t", (2 * F.col("n")).alias("n"), m.alias("m"), (F.col("slr") / F.col("n") - m * m).alias("cov"))


def block_covariance(pairs: DataFrame, bins: dict[str, Bins]) -> DataFrame:
    """Covariance of (l, r) pairs by several delta columns, bins (lag - tol, lag + tol], two pairs at least."""
    x = pairs
    for c, table in bins.items():
        x = with_lag(x, F.col(c), table, "open", f"lag_{c}")
    return _covariance(x, *(f"lag_{c}" for c in bins)).where("n >= 2")


def directional_covariance(cells: DataFrame, lags_s: Bins, lags_t: Bins, step: float = 30.0, tol: float = 15.0, value: str = "residual") -> DataFrame:
    """Closed-bin covariance for azimuths 0, step, ... below 180 degrees, each +- tol."""
    sp = site_pairs(cells, _reach(lags_s))
    turns = [k * step for k in range(math.ceil(180 / step))]
    fits = F.array_compact(F.array(*(F.when((F.abs(_azimuth_off(F.lit(a))) <= tol + 1e-9) | (F.col("ds") == 0), F.lit(a)) for a in turns)))
    sp = with_lag(sp.withColumn("azimuth_deg", F.explode(fits)), F.col("ds"), lags_s, "closed", "lag_s")
    return _from_sums(lag_sums(cells, value, sp, lags_t, "closed", ["azimuth_deg", "lag_s"]), "azimuth_deg", "lag_s", "lag_t")


def covariance_map(cells: DataFrame, radius: float, value: str = "residual") -> DataFrame:
    """(dx, dy, product) of pairs of cells at one time, at most ``radius`` apart."""
    return products(cells, value, site_pairs(cells, radius), time_pairs(cells, 0)).select("dx", "dy", (F.col("l") * F.col("r")).alias("product"))
