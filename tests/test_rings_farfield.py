"""Neighbours by growing rings and sums over far cells, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import farfield, interpolate, rings, trend

ROWS = "h_id long, x double, y double, t double"


def brute_nearest(points, data, nmax, radius, ratio, same):
    """Per point its neighbours (h_id, d), nearest first, ties to the smaller h_id."""
    keys, at = np.array([r[0] for r in data]), np.array([r[1:4] for r in data], float)
    out = {}
    for k, *c in points:
        if any(v is None or not np.isfinite(v) for v in c):
            continue
        d = at - np.array(c, float)
        d = np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + (0 if ratio is None else d[:, 2] * d[:, 2] * float(ratio) ** 2))
        near = np.flatnonzero((d < radius) & ((keys != k) | (not same)))
        near = near[np.lexsort((keys[near], d[near]))][:nmax]
        if len(near):
            out[k] = [(int(keys[i]), pytest.approx(d[i], rel=1e-12, abs=1e-12)) for i in near]
    return out


@pytest.mark.parametrize(("crowd", "ratio", "same"), [(200, 1.3, True), (10**6, 0.5, False), (200, None, False)])
def test_rings_by_brute_force(spark, crowd, ratio, same):
    """Clusters, places with many data, empty plane, odd coordinates; several levels and one."""
    rng = np.random.default_rng(3)
    xyt = np.r_[rng.normal(0, 0.2, (250, 3)), rng.uniform(-5, 5, (150, 3)), np.repeat([[1.0, 1.0, 1.0]], 40, 0), np.round(rng.uniform(0, 3, (100, 3)))]
    rows = [(i, *map(float, v)) for i, v in enumerate(xyt)]
    points = rows[::3] + [(10**6 + i, *map(float, v)) for i, v in enumerate(rng.uniform(-7, 7, (30, 3)))]
    odd = [(2 * 10**6, None, 0.0, 0.0), (2 * 10**6 + 1, float("nan"), 0.0, 0.0), (2 * 10**6 + 2, 0.0, float("inf"), 0.0)]
    data = spark.createDataFrame([(*r, 2.0 * r[0]) for r in rows + odd], ROWS + ", z double").withColumns({"k_id": F.lit("x"), "_0": F.lit(1), "d": F.lit(2)})
    found = rings.ring_nearest(spark.createDataFrame(points + odd, ROWS.replace("h_id", "k_id")), data, 6, 2.5, ratio, same, ("z", "x"), crowd)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.k_id, r["rank"])):
        got.setdefault(r.k_id, []).append((r.h_id, r.d))
        assert (r["rank"], r.z, r.x) == (len(got[r.k_id]), 2.0 * r.h_id, rows[r.h_id][1])
    assert got == brute_nearest(points, rows, 6, 2.5, ratio, same)


def test_rings_meet_as_many_data_however_dense(spark):
    """At a hundred times the density a point still meets no more data than asked for."""
    per_point = {}
    rng = np.random.default_rng(4)
    for n in (300, 30_000):
        places = rng.uniform(0, 10, (n, 2))
        data = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(places)], ROWS)
        points = data.limit(200).withColumnRenamed("h_id", "k_id")
        levels, kept = rings._levels(points, data, 5, 4.0, None, 500, True)
        side = 4.0 / 2 ** (len(levels) - 1)
        per_point[n] = (len(levels), n * (3 * side) ** 2 / 100)
        got = rings.ring_nearest(points, data, 5, 4.0, None, crowd=500)
        assert got.count() == 1000
    assert per_point[300][0] == 1 and per_point[30_000][0] >= 4
    assert per_point[30_000][1] <= 500 < 30_000 * (3 * 4.0) ** 2 / 100


def test_rings_of_earlier_data(spark):
    """Neighbours whose order is between a point's bounds, over several levels; what a bound leaves out is looked for farther off."""
    rng = np.random.default_rng(9)
    rows = [(i, *map(float, v), int(o)) for i, (v, o) in enumerate(zip(np.r_[rng.normal(0, 0.2, (200, 3)), rng.uniform(-4, 4, (100, 3))], rng.permutation(300), strict=True))]
    data = spark.createDataFrame(rows, ROWS + ", place long")
    points = data.select(F.col("h_id").alias("k_id"), "x", "y", "t", (F.col("place") - 150).alias("_lo"), F.col("place").alias("_hi"))
    got: dict = {}
    for r in sorted(rings.ring_nearest(points, data, 4, 3.0, 1.0, True, ("place",), 120, "place").collect(), key=lambda r: (r.k_id, r["rank"])):
        got.setdefault(r.k_id, []).append((r.h_id, r.d))
        assert r.place == rows[r.h_id][4]
    want = {}
    for k, *c, o in rows:
        want |= brute_nearest([(k, *c)], [r[:4] for r in rows if o - 150 < r[4] < o] or [(-1, 99.0, 99.0, 99.0)], 4, 3.0, 1.0, True)
    assert got == want


def test_rings_of_small_tables(spark):
    none = spark.createDataFrame([], ROWS)
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], ROWS)
    point = one.withColumnRenamed("h_id", "k_id")
    assert rings.ring_nearest(point, none, 3, 1.0, None).count() == 0
    assert rings.ring_nearest(none.withColumnRenamed("h_id", "k_id"), one, 3, 1.0, 1.0).count() == 0
    assert rings.ring_nearest(point, one, 3, 1.0, 1.0, exclude_same=True).count() == 0
    assert [tuple(r) for r in rings.ring_nearest(point, one, 3, 1.0, 1.0).collect()] == [(1, 1, 0.0, 1)]


def test_points_of_a_cube_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(rings, "GROUP_POINTS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, v)) for i, v in enumerate(rng.uniform(0, 2, (90, 3)))]
    data = spark.createDataFrame(rows, ROWS)
    got: dict = {}
    for r in sorted(rings.ring_nearest(data.withColumnRenamed("h_id", "k_id"), data, 4, 1.5, 1.0, True).collect(), key=lambda r: (r.k_id, r["rank"])):
        got.setdefault(r.k_id, []).append((r.h_id, r.d))
    assert got == brute_nearest(rows, rows, 4, 1.5, 1.0, True)


@pytest.mark.parametrize(("n", "crowd", "power"), [(20, 256, 2.0), (4000, 256, 2.0), (3000, 40, 1.5)])
def test_far_sums_by_brute_force(spark, n, crowd, power):
    """Uniform and clustered data, points inside, outside and on data: far weights within the stated 1e-8."""
    rng = np.random.default_rng(6)
    data = np.c_[np.r_[rng.uniform(0, 100, (n // 2, 2)), rng.normal(30, 0.5, (n - n // 2, 2))], rng.gamma(2, 100, n)]
    at = np.r_[rng.uniform(-10, 110, (40, 2)), data[:5, :2], [[30.0, 30.0]]]
    odd = [(None, 1.0, 5.0), (float("nan"), 1.0, 5.0), (1.0, 1.0, None)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in data] + odd, "x double, y double, z double").withColumn("sx", F.lit("x"))
    points = spark.createDataFrame([tuple(map(float, r)) for r in at], "x double, y double").withColumn("i", F.lit(3))
    for hits in (False, True):
        weight = farfield.inverse_power(power, hits)
        got = {(r.x, r.y): (r.wz, r.w) for r in farfield.far_sums(df, points, weight, crowd).collect()}
        w = weight(np.sqrt(((at[:, None] - data[None, :, :2]) ** 2).sum(-1)))
        want = np.c_[w @ data[:, 2], w.sum(1)]
        assert np.abs(np.array([got[tuple(p)] for p in at]) / want - 1).max() < 1e-8


def test_sources_stand_for_their_data():
    """Chebyshev sources of a cell give its far sums; polynomials at the nodes are whole."""
    rng = np.random.default_rng(7)
    x, y, z = rng.uniform(-1, 1, 2000), rng.uniform(-1, 1, 2000), rng.normal(size=2000)
    sx, sy, sz, sn = farfield.condensed(x, y, z, np.ones(2000), 0.0, 0.0, 1.0)
    assert len(sx) == farfield.NODES**2 and sn.sum() == pytest.approx(2000) and (sz * sx).sum() == pytest.approx((z * x).sum())
    for px, py in [(3.0, 0.3), (3.1, 3.0), (-0.5, -3.0), (9.0, 1.0)]:
        want = (1 / ((px - x) ** 2 + (py - y) ** 2)).sum()
        assert (sn / ((px - sx) ** 2 + (py - sy) ** 2)).sum() == pytest.approx(want, rel=1e-8)


def test_inverse_distances_without_data(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "k_id long, x double, y double")
    none = spark.createDataFrame([], "x double, y double, z double")
    assert {r.k_id: r.zhat for r in interpolate.idw(none, points).collect()} == {1: None, 2: None}


def test_gaussian_kernel_far_from_all_cells(spark):
    """Points whose nearest cells are many bandwidths off still get the whole mean; beyond doubles it is null."""
    rng = np.random.default_rng(8)
    cells = [(*map(float, v), float(rng.normal())) for v in rng.uniform(0, 4, (60, 3))]
    points = [(float(a), 2.0, 2.0) for a in (2, 6, 11, 16, 30, 80)]
    got = {r.x: r.tr for r in trend.kernel_at(spark.createDataFrame(cells, "x double, y double, t double, z double"), spark.createDataFrame(points, "x double, y double, t double"), 1.5, 1.5).collect()}
    c = np.array(cells)
    for p in points:
        w = np.exp(-3 * ((c[:, :3] - p) ** 2).sum(1) / 1.5**2)
        if p[0] < 25:
            assert got[p[0]] == pytest.approx((w @ c[:, 3]) / w.sum(), rel=1e-9)
    assert got[80.0] is None
