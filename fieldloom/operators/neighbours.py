"""Distances, pairs within a radius and nearest neighbours.

A radius becomes an equi-join: points are put in square cells of the radius, one side is
replicated to the neighbouring cells, and the exact distance is tested afterwards.  A cell's
points are never gathered; Spark may split a crowded one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.rings import ring_nearest


def distance(ax: Column, ay: Column, bx: Column, by: Column, p: float = 2) -> Column:
    if p == 2:
        return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    if p == 1:
        return F.abs(ax - bx) + F.abs(ay - by)
    return F.pow(F.pow(F.abs(ax - bx), F.lit(p)) + F.pow(F.abs(ay - by), F.lit(p)), F.lit(1 / p))


def distances(a: DataFrame, b: DataFrame, p: float = 2) -> DataFrame:
    """(a_id, b_id, d) of two sets, every row against every row.

    Pairs are not shuffled: the first set, which would be few partitions or one, is dealt to all cores.
    """
    spread = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # in turn: an exchange by columns may be left out
    left = spread.select(F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    right = b.select(F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return left.crossJoin(right).select("a_id", "b_id", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), p).alias("d"))


#: Width of the pieces that rows of a lattice are packed in.
PIECE = 16


def lattice_distances(a: DataFrame, b: DataFrame, p: float = 2) -> DataFrame:
    """(ax, ay, bx, by, d) of two sets of distinct points, every row against every row.

    Points of whole coordinates go by the difference of y: a task takes differences, and for each one row of the lattice
    after another, whose pairs have the same few distances in the same order.  So nothing is shuffled but the differences,
    and what is written of all pairs repeats itself and packs small.  Other points are paired as in ``distances``.
    """
    whole = F.coalesce((F.col("x") == F.floor("x")) & (F.col("y") == F.floor("y")) & (F.abs("y") < 2.0**51), F.lit(False))

    def rows(s: DataFrame, n: str) -> DataFrame:
        piece = s.where(whole).groupBy(F.col("y").cast("long").alias(f"{n}_row"), F.floor(F.col("x") / PIECE).alias("_piece"))
        return piece.agg(F.sort_array(F.collect_list("x")).alias(f"{n}_xs")).drop("_piece")

    def line(s: DataFrame, n: str) -> DataFrame:
        return s.where(whole).select(F.col("y").cast("long").alias(f"{n}_row")).distinct()

    def odd(left: DataFrame, right: DataFrame) -> DataFrame:
        sides = (s.select(*(F.col(c).alias(f"{n}{c}") for c in "xy")) for s, n in ((left, "a"), (right, "b")))
        return next(sides).crossJoin(next(sides))

    by_difference = line(a, "a").crossJoin(line(b, "b")).select((F.col("a_row") - F.col("b_row")).alias("_dy")).distinct()
    dealt = by_difference.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = dealt.crossJoin(F.broadcast(rows(a, "a").sort("a_row"))).withColumn("b_row", F.col("a_row") - F.col("_dy")).join(F.broadcast(rows(b, "b")), "b_row")
    each = both.select("a_row", "b_row", F.explode("a_xs").alias("ax"), "b_xs").select("ax", F.col("a_row").cast("double").alias("ay"), F.explode("b_xs").alias("bx"), F.col("b_row").cast("double").alias("by"))
    pairs = each.unionByName(odd(a.where(~whole), b)).unionByName(odd(a.where(whole), b.where(~whole)))
    return pairs.withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), p))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def within(a: DataFrame, b: DataFrame, radii: dict[str, float]) -> DataFrame:
    """Pairs whose difference on every named axis is at most its radius.

    Columns of the sides have to differ, except that axis c is ``a_c`` in a and ``b_c`` in b.
    Axes of radius 0 join on equality.
    """
    flat = {c: r for c, r in radii.items() if r > 0}
    keys = [f"_k_{c}" for c in flat]
    # pairs are many more than rows: a small side that would be one partition is dealt to all cores first,
    # by its rows and not by the cells, so that the join's own exchange may still be split where cells are crowded
    spread = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *a.columns)
    left = spread.withColumns({f"_k_{c}": _cell(F.col(f"a_{c}"), r) for c, r in flat.items()})
    right = b
    for c, r in flat.items():
        k = _cell(F.col(f"b_{c}"), r)
        right = right.withColumn(f"_k_{c}", F.explode(F.array(k - 1, k, k + 1)))
    on = [left[k] == right[k] for k in keys] + [left[f"a_{c}"] == right[f"b_{c}"] for c, r in radii.items() if r == 0]
    condition = on[0]
    for o in on[1:]:
        condition = condition & o
    for c, r in flat.items():
        condition = condition & (F.abs(left[f"a_{c}"] - right[f"b_{c}"]) <= r)
    return left.join(right, condition).drop(*keys)


def _sided(points: DataFrame, side: str) -> DataFrame:
    return points.select(*(F.col(c).alias(f"{side}_{c}") for c in points.columns))


def pairs_within(sites: DataFrame, radius: float, azimuth: bool = False) -> DataFrame:
    """(a_si, b_si, ds): unordered pairs of sites, each with itself too, at most ``radius`` apart."""
    both = within(_sided(sites, "a"), _sided(sites, "b"), {"x": radius, "y": radius}).where("a_si <= b_si")
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    found = both.withColumn("ds", F.sqrt(dx * dx + dy * dy)).where(F.col("ds") <= radius)
    out = ["a_si", "b_si", "ds"]
    if azimuth:
        found, out = found.withColumn("azimuth", F.atan2(dy, dx)), [*out, "azimuth"]
    return found.select(*out)


def pairs_between(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(a_id, b_id, ds, azimuth) of two sets, at most ``radius`` apart."""
    both = within(_sided(a, "a"), _sided(b, "b"), {"x": radius, "y": radius})
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    return both.select("a_id", "b_id", F.sqrt(dx * dx + dy * dy).alias("ds"), F.atan2(dy, dx).alias("azimuth")).where(F.col("ds") <= radius)


def ring_offsets(low: float, high: float, side: float) -> list[tuple[int, int]]:
    """Steps from a cell to those that can hold a point between ``low`` and ``high`` away from one of its own."""
    reach, out = int(high // side) + 1, []
    for i in range(-reach, reach + 1):
        for j in range(-reach, reach + 1):
            near = (max(abs(i) - 1, 0) ** 2 + max(abs(j) - 1, 0) ** 2) ** 0.5 * side
            far = ((abs(i) + 1) ** 2 + (abs(j) + 1) ** 2) ** 0.5 * side
            if near <= high and far >= low:
                out.append((i, j))
    return out


def pairs_between_radii(sites: DataFrame, low: float, high: float, cells: int = 6) -> DataFrame:
    """(a_si, b_si, ds): unordered pairs of sites (si, x, y) whose distance is ``low`` to ``high``, both included.

    Cells are ``cells`` to the larger radius, and a site meets only those that the ring between the radii
    passes, so sites nearer than the ring are not looked at.
    """
    side = high / cells
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ring_offsets(low, high, side))))
    a = sites.select(F.col("si").alias("a_si"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), _cell(F.col("x"), side).alias("_i"), _cell(F.col("y"), side).alias("_j"))
    b = sites.select(F.col("si").alias("b_si"), F.col("x").alias("b_x"), F.col("y").alias("b_y"), _cell(F.col("x"), side).alias("_ci"), _cell(F.col("y"), side).alias("_cj"), steps.alias("_s"))
    b = b.withColumns({"_i": F.col("_ci") + F.col("_s.i"), "_j": F.col("_cj") + F.col("_s.j")}).drop("_ci", "_cj", "_s")
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    ds = F.sqrt(dx * dx + dy * dy)
    return a.join(b, ["_i", "_j"]).where("a_si <= b_si").select("a_si", "b_si", ds.alias("ds")).where((F.col("ds") >= low) & (F.col("ds") <= high))


def pair_products(rows: DataFrame, keys: list[str], order: str, value: str, include: bool = True) -> DataFrame:
    """(keys, a_order, b_order, product) of all pairs of values of one key, with themselves too if ``include``.

    The pairs of a key are as many as asked for; whole tables are paired within keys by an equi-join.
    """
    a = rows.select(*keys, F.col(order).alias(f"a_{order}"), F.col(value).alias("_a"))
    b = rows.select(*keys, F.col(order).alias(f"b_{order}"), F.col(value).alias("_b"))
    low, high = F.col(f"a_{order}"), F.col(f"b_{order}")
    return a.join(b, keys).where(low <= high if include else low < high).select(*keys, low, high, (F.col("_a") * F.col("_b")).alias("product"))


def sphere_radius(dmax_s: float, dmax_t: float, ratio: float) -> float:
    return (dmax_s**2 + (dmax_t * ratio) ** 2) ** 0.5


def _ranked(pairs: DataFrame, nmax: int, order: list) -> DataFrame:
    w = Window.partitionBy("k_id").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nmax)


def nearest(points: DataFrame, data: DataFrame, nmax: int, dmax_s: float, dmax_t: float | None = None, ratio: float = 0.0, exclude_same: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(k_id, h_id, d, rank): up to nmax data nearest in (x, y, ratio * t), nearer than the sphere's radius.

    ``points`` has k_id, x, y, t, ``data`` h_id, x, y, t; ties go to the smaller h_id.
    Without ``dmax_t`` the time is left out.  ``carry`` names columns of the data that go along.
    """
    radius = dmax_s if dmax_t is None else sphere_radius(dmax_s, dmax_t, ratio)
    return ring_nearest(points, data, nmax, radius, None if dmax_t is None or ratio <= 0 else ratio, exclude_same, carry)


def nearest_prism(points: DataFrame, data: DataFrame, nmax: int, dmax_s: float, dmax_t: float, ratio: float) -> DataFrame:
    """(k_id, h_id, d, rank): up to nmax of the data within dmax_s and dmax_t (closed), by ds + ratio * dt."""
    a = points.select("k_id", *(F.col(c).alias(f"a_{c}") for c in "xyt"))
    b = data.select("h_id", *(F.col(c).alias(f"b_{c}") for c in "xyt"))
    both = within(a, b, {"x": dmax_s, "y": dmax_s, "t": dmax_t})
    dx, dy, dt = (F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyt")
    ds = F.sqrt(dx * dx + dy * dy)
    near = both.select("k_id", "h_id", ds.alias("ds"), (ds + F.lit(float(ratio)) * F.abs(dt)).alias("d")).where(F.col("ds") <= dmax_s).drop("ds")
    return _ranked(near, nmax, ["d", "h_id"])


def nearest_by_covariance(points: DataFrame, data: DataFrame, covariance, nmax: int, dmax_s: float, dmax_t: float) -> DataFrame:
    """(k_id, h_id, cov, rank): the nmax data of largest covariance to a point, within a prism."""
    a = points.select("k_id", *(F.col(c).alias(f"a_{c}") for c in "xyt"))
    b = data.select("h_id", *(F.col(c).alias(f"b_{c}") for c in "xyt"))
    dx, dy, dt = (F.col(f"a_{c}") - F.col(f"b_{c}") for c in "xyt")
    both = within(a, b, {"x": dmax_s, "y": dmax_s, "t": dmax_t})
    near = both.select("k_id", "h_id", covariance(F.sqrt(dx * dx + dy * dy), F.abs(dt)).alias("cov"))
    return _ranked(near, nmax, [F.desc("cov"), "h_id"])


def groups(neighbours: DataFrame) -> DataFrame:
    """(h_ids, k_ids): points that share one set of neighbours."""
    own = neighbours.groupBy("k_id").agg(F.array_sort(F.collect_list("h_id")).alias("h_ids"))
    return own.groupBy("h_ids").agg(F.array_sort(F.collect_list("k_id")).alias("k_ids"))


def duplicates(points: DataFrame, data: DataFrame) -> DataFrame:
    """(k_id, h_id) of equal coordinates."""
    return points.select("k_id", "x", "y", "t").join(data.select("h_id", "x", "y", "t"), ["x", "y", "t"]).select("k_id", "h_id")
