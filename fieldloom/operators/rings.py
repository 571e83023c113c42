"""Nearest neighbours by growing rings over cells whose size follows the density of the data.

Space, with time scaled to a third axis, is cut into cubes; on level l their side is the radius
divided by 2**l, so the 27 cubes around a point on level 0 hold all that is within the radius.  A
point starts on the coarsest level on which its 27 cubes hold at most ``crowd`` data; levels are
found by counting, and only what is still crowded is counted again.  A round takes all points of a
level to the data of their 27 cubes and keeps the nearest: a point is settled if it has all the
neighbours it wants nearer than the side of a cube, which is the radius of the ball that these cubes
hold for sure, or if the side is at least the radius; the others go on to the level above, whose ring is
twice as wide.  So a point meets some ``crowd`` data however dense they are, not all within the radius.

Where the data are sparse for the radius, level 0 has cubes that are wider by a power of two, so that a task's
group is worth its overhead; from cubes wider than the radius a datum goes only to those that its radius reaches.

Data of equal coordinates differ only by their key, so where a level is crowded only the first
``nmax + 1`` of each place are looked at; that is exact, and bounds cells that no cut can thin out.

The data of a cube travel to the 27 around it; a cube's points meet them in one task as arrays.
A cube of more than ``GROUP_POINTS`` points is dealt to several tasks, each with the cube's data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.operators.stages import cut

#: Points of a cube that one task takes, and distances it holds at a time.
GROUP_POINTS, SLICE = 1 << 15, 1 << 21
#: Data of 27 cubes up to which they are not cut finer.
CROWD = 8192
DEEPEST = 24
XYT = ("x", "y", "t")
_SLACK = 1 + 1e-9  # keeps what lies on a border, to rounding, inside


def _cube(df: DataFrame, side: float, ratio: float | None) -> DataFrame:
    at = [F.col("x"), F.col("y")] + ([] if ratio is None else [F.col("t") * F.lit(float(ratio))])
    return df.withColumns({f"_{i}": F.floor(c / F.lit(side)).cast("long") for i, c in enumerate(at)})


def _axes(ratio: float | None) -> list[str]:
    return ["_0", "_1"] if ratio is None else ["_0", "_1", "_2"]


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row once for each of the cubes around its own."""
    for k in keys:
        df = df.withColumn(k, F.explode(F.array(F.col(k) - 1, F.col(k), F.col(k) + 1)))
    return df


def _reached(df: DataFrame, side: float, ratio: float | None, radius: float) -> DataFrame:
    """Every row once for each of the cubes, wider than the radius, that are within the radius on every axis."""
    at = [F.col("x"), F.col("y")] + ([] if ratio is None else [F.col("t") * F.lit(float(ratio))])
    index = lambda c: F.floor(c / F.lit(side)).cast("long")
    reach = F.lit(radius * _SLACK)
    for i, c in enumerate(at):
        df = df.withColumn(f"_{i}", F.explode(F.sequence(index(c - reach), index(c + reach))))
    return df


def _widening(data: DataFrame, radius: float, ratio: float | None, crowd: int) -> int:
    """Power of two by which cubes of the radius may be wider and still hold, on average, half of ``crowd`` with those around them."""
    keys = _axes(ratio)
    counts = _cube(data, radius * _SLACK, ratio).groupBy(*keys).agg(F.count("*").alias("_n"))
    cubes, n = counts.agg(F.count("*"), F.sum("_n")).first()
    power, room = 0, crowd / 2 / 3 ** len(keys)
    while cubes and power < DEEPEST and n / cubes * 2 ** (len(keys) * (power + 1)) <= room:
        power += 1
    return power


def _levels(points: DataFrame, data: DataFrame, nmax: int, radius: float, ratio: float | None, crowd: int, alike: bool) -> tuple[list[DataFrame], DataFrame]:
    """(points of each level, data without what no point can need); ``alike``: data of one place differ by their key alone."""
    keys, out, level, left = _axes(ratio), [], 0, points
    while level < DEEPEST:
        side = radius * _SLACK / 2**level
        crowded = _crowded(data, keys, side, ratio, crowd)
        if crowded.isEmpty():
            break
        if not level and alike:  # of equal coordinates the first are enough
            place = Window.partitionBy("x", "y", "t").orderBy("h_id")
            data = cut(data.withColumn("_rank", F.row_number().over(place)).where(F.col("_rank") <= nmax + 1).drop("_rank"))
            crowded = _crowded(data, keys, side, ratio, crowd)
        own = cut(_cube(left, side, ratio).join(crowded.withColumn("_full", F.lit(True)), keys, "left"))
        out.append(own.where("_full is null").select(*points.columns))
        left = own.where("_full").select(*points.columns)
        level += 1
    return [*out, left], data


def _crowded(data: DataFrame, keys: list[str], side: float, ratio: float | None, crowd: int) -> DataFrame:
    """Cubes that hold more than ``crowd`` data together with those around them."""
    counts = _cube(data, side, ratio).groupBy(*keys).agg(F.count("*").alias("_n"))
    return _spread(counts, keys).groupBy(*keys).agg(F.sum("_n").alias("_n")).where(F.col("_n") > crowd).drop("_n")


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _nearest_of(nmax: int, radius: float, ratio: float | None, same: bool, settled: float, carry: list[str], schema: pa.Schema, between: str | None = None):
    """Rows of the nearest data of each point of a cube, and whether the point is settled."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return schema.empty_table()
        ids, px, py, pt = _columns(left, ["k_id", "x", "y", "t"])
        keys, hx, hy, ht = _columns(right, ["h_id", "x", "y", "t"])
        order = np.argsort(keys, kind="stable")  # ties go to the smaller key
        keys, hx, hy, ht = keys[order], hx[order], hy[order], ht[order]
        points, data, dist, rank, done = [], [], [], [], []
        value_of, lo_of, hi_of = (None,) * 3 if between is None else (right[between].to_numpy()[order], *_columns(left, ["_lo", "_hi"]))
        step = max(1, SLICE // max(1, len(keys)))
        for lo in range(0, n, step):
            at = slice(lo, min(n, lo + step))
            dx, dy = px[at, None] - hx[None], py[at, None] - hy[None]
            square = dx * dx + dy * dy
            if ratio is not None:
                dt = pt[at, None] - ht[None]
                square = square + dt * dt * float(ratio) ** 2
            d = np.sqrt(square)
            out = ~(d < radius)
            if same:
                out |= ids[at, None] == keys[None]
            if between is not None:
                out |= ~((value_of[None] > lo_of[at, None]) & (value_of[None] < hi_of[at, None]))
            d[out] = np.inf
            m = d.shape[1]
            if m > 4 * nmax:  # all up to the distance of the last one wanted, ties too
                limit = np.partition(d, nmax - 1, axis=1)[:, nmax - 1]
                row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
            else:
                row, col = np.nonzero(np.isfinite(d))
            value = d[row, col]
            by = np.lexsort((col, value, row))
            row, col, value = row[by], col[by], value[by]
            first = np.searchsorted(row, np.arange(d.shape[0]))
            place = np.arange(len(row)) - first[row]
            keep = place < nmax
            row, col, value, place = row[keep], col[keep], value[keep], place[keep]
            full = np.bincount(row[value <= settled], minlength=d.shape[0]) >= nmax
            points.append(row + lo)
            data.append(col)
            dist.append(value)
            rank.append(place + 1)
            done.append(full)
        points, data, done = np.concatenate(points), np.concatenate(data), np.concatenate(done)
        if settled >= radius:
            done[:] = True
        rest = np.flatnonzero(~done)
        own = done[points]
        points, data = points[own], data[own]
        found = {"k_id": ids[points], "h_id": keys[data], "d": np.concatenate(dist)[own], "rank": np.concatenate(rank)[own].astype(np.int32)}
        moved = right.take(pa.array(order[data])) if carry else right
        both = pa.table({f.name: pa.array(found[f.name], f.type) if f.name in found else moved[f.name].cast(f.type) if f.name in carry else pa.nulls(len(data), f.type) for f in schema}, schema)
        if not len(rest):
            return both
        again, given = left.take(pa.array(rest)), {n: n for n in ("k_id", "_lo", "_hi")} | {f"_{c}": c for c in XYT}
        return pa.concat_tables([both, pa.table({f.name: again[given[f.name]].cast(f.type) if f.name in given else pa.nulls(len(rest), f.type) for f in schema}, schema)])

    return run


def _fine(df: DataFrame, ratio: float | None) -> DataFrame:
    """Rows whose coordinates are finite numbers."""
    ok: Column = F.lit(True)
    for c in ("x", "y") if ratio is None else ("x", "y", "t"):
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.where(ok)


def ring_nearest(points: DataFrame, data: DataFrame, nmax: int, radius: float, ratio: float | None, exclude_same: bool = False, carry: tuple[str, ...] = (), crowd: int | None = None, between: str | None = None) -> DataFrame:
    """(k_id, h_id, d, rank and ``carry``): up to ``nmax`` data nearest to each point, nearer than ``radius``.

    With ``between``, a column of the data, a point only takes data whose value is above its own ``_lo`` and
    below its ``_hi``, so neighbours can be the earlier ones in time or in any order.

    ``points`` has k_id, x, y, t, ``data`` h_id, x, y, t and the carried columns; the distance is that
    of (x, y, ratio * t), or of (x, y) where ``ratio`` is None.  Ties go to the smaller h_id.  Points without
    neighbours give no row; rows with a coordinate that is null or not finite take no part.
    """
    crowd = crowd or max(CROWD, 64 * nmax)
    axes, scale = _axes(ratio), None if ratio is None else float(ratio)
    double = lambda df, key, *more: df.select(key, *(F.col(c).cast("double").alias(c) for c in XYT), *more)
    limits = () if between is None else ("_lo", "_hi")
    more = {c for c in (*carry, *(() if between is None else (between,))) if c not in XYT}
    points, data = _fine(double(points, "k_id", *limits), ratio), _fine(double(data, "h_id", *sorted(more)), ratio)
    widest = radius * 2 ** _widening(data, radius, scale, crowd)
    levels, data = _levels(points, data, nmax, widest, scale, crowd, between is None)
    kinds = {f.name: f.dataType for f in (*points.schema.fields, *data.schema.fields)}
    schema = T.StructType([T.StructField(n, k) for n, k in (("k_id", kinds["k_id"]), ("h_id", kinds["h_id"]), ("d", T.DoubleType()), ("rank", T.IntegerType()), *((c, kinds[c]) for c in carry), *((f"_{c}", T.DoubleType()) for c in XYT), *((c, kinds[c]) for c in limits))])
    from pyspark.sql.pandas.types import to_arrow_schema

    found, waiting = [], None  # what waits is met on the next level up, which is whole if it is the last to be so
    for level in range(len(levels) - 1, -1, -1):
        side = widest * _SLACK / 2**level
        own = levels[level] if waiting is None else levels[level].union(waiting)
        whole = widest / 2**level >= radius  # the cubes around hold all within the radius
        settled = radius if whole else side / _SLACK**2
        left = _cube(own, side, scale)
        right = _reached(data, side, scale, radius) if whole else _spread(_cube(data, side, scale), axes)
        parts = F.lit(0)
        crowded = left.groupBy(*axes).agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP_POINTS)
        if level or len(levels) > 1 or not crowded.isEmpty():
            shares = crowded.select(*axes, F.ceil(F.col("_n") / GROUP_POINTS).cast("int").alias("_parts"))
            several = F.coalesce(F.col("_parts"), F.lit(1))
            left = left.join(shares, axes, "left").withColumn("_part", F.pmod(F.xxhash64("k_id"), several).cast("int")).drop("_parts")
            right = right.join(shares, axes, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), several - 1))).drop("_parts")
        else:
            left, right = left.withColumn("_part", parts), right.withColumn("_part", parts)
        keys = [*axes, "_part"]
        run = _nearest_of(nmax, radius, scale, exclude_same, settled, list(carry), to_arrow_schema(schema), between)
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
        if not whole:
            near = cut(near)
            waiting = near.where("h_id is null").select("k_id", *(F.col(f"_{c}").alias(c) for c in XYT), *limits)
        if whole:
            waiting = None
        found.append(near.where("h_id is not null").select("k_id", "h_id", "d", "rank", *carry) if not whole else near.select("k_id", "h_id", "d", "rank", *carry))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
