"""Functions that no named query reaches, against plain numpy; and the loaders."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import models, softdata
from fieldloom.functions.models import Component
from fieldloom.operators import bme, covariance, decompose, grid, information, interpolate, neighbours, trend
from fieldloom.plans import fit, validate
from fieldloom.sources import observations

MODEL = [Component(1.0, "exponential", 5.0, "exponential", 4.0)]


def lattice(spark, nx=5, ny=4, nt=6, seed=3):
    rng = np.random.default_rng(seed)
    pts = np.array([(x, y, t) for t in range(nt) for y in range(ny) for x in range(nx)], float)
    z = np.linalg.cholesky(models.covariance_matrix(MODEL, pts, pts)) @ rng.normal(size=len(pts))
    rows = [(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(pts, z, strict=True))]
    return pts, z, spark.createDataFrame(rows, "h_id long, x double, y double, t double, z double")


def test_varimax_is_a_rotation_of_largest_criterion():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 4)) * [3, 2, 1.5, 1]
    turned, turn = decompose.varimax(a)
    assert np.allclose(turn.T @ turn, np.eye(4)) and np.allclose(a @ turn, turned)
    best = decompose.varimax_criterion(turned)
    assert best >= decompose.varimax_criterion(a)
    for i in range(4):
        for j in range(i):
            for angle in np.linspace(-math.pi / 4, math.pi / 4, 41):
                plane = np.eye(4)
                plane[[i, i, j, j], [i, j, i, j]] = np.cos(angle), -np.sin(angle), np.sin(angle), np.cos(angle)
                assert decompose.varimax_criterion(turned @ plane) <= best + 1e-9
    simple = np.kron(np.eye(3), np.ones((5, 1)))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    back = decompose.varimax(simple @ q)[0]
    assert np.allclose(np.sort(np.abs(back), 1), np.sort(simple, 1), atol=1e-6)


def test_incomplete_vectors_do_not_count(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    g = {(r.i, r.j): r.g for r in decompose.gram(v).collect()}
    assert g == {(0, 0): 10.0, (0, 1): -1.0, (1, 1): 5.0}
    assert {r.vec_id: r.ecs for r in decompose.project(v, np.eye(2), "vec_id").collect()} == {1: [1.0, 2.0], 2: [3.0, -1.0]}
    with pytest.raises(Exception, match="different lengths"):
        decompose.gram(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, v array<double>").coalesce(1)).collect()


def test_eof_trend_extended_eof_and_classes(spark):
    pts, z, cells = lattice(spark)
    full = {(r.x, r.y, r.t): r.tr for r in trend.eof_trend(cells, 6).collect()}
    assert all(full[tuple(p)] == pytest.approx(v) for p, v in zip(pts.tolist(), z, strict=True))
    m = z.reshape(6, 20).T
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    two = (u[:, :2] * s[:2]) @ vt[:2]
    got = {(r.x, r.y, r.t): r.tr for r in trend.eof_trend(cells, 2).collect()}
    assert all(got[tuple(p)] == pytest.approx(v, abs=1e-8) for p, v in zip(pts.tolist(), two.T.ravel(), strict=True))
    series = cells.select((F.col("y") * 5 + F.col("x")).cast("long").alias("id"), "t", "z")
    loadings, turn = decompose.extended_eof(series, 3, 2)
    lagged = np.array([m[i, k : k + 3] for i in range(20) for k in range(4)])
    value, axes = np.linalg.eigh(lagged.T @ lagged)
    scaled = axes[:, ::-1][:, :2] * np.sqrt(value[::-1][:2] / (len(lagged) - 1))
    assert decompose.varimax_criterion(loadings) == pytest.approx(decompose.varimax_criterion(decompose.varimax(scaled)[0]))
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.r_[np.random.default_rng(1).normal(0, 1, 300), [40.0, 41.0, 42.0]])], "i long, loading double")
    flagged = {r.i for r in decompose.classify(values).where("region = 1").collect()}
    assert {300, 301, 302} <= flagged and len(flagged) < 40


def test_relevant_and_near_duplicate():
    data = np.array([[0, 0, 0], [5, 0, 0], [0, 1, 0], [9, 9, 0]], float)
    at = np.array([0.1, 0, 0])
    assert bme.relevant(MODEL, at, data, 2)[0] == 0

    def left(chosen):
        k = models.covariance_matrix(MODEL, data[chosen], data[chosen])
        c = models.covariance_matrix(MODEL, at[None], data[chosen])[0]
        return 1 - c @ np.linalg.solve(k, c)

    first, second = bme.relevant(MODEL, at, data, 2)
    assert left([first]) == min(left([i]) for i in range(4))
    assert left([first, second]) == pytest.approx(min(left([first, i]) for i in range(4) if i != first))
    assert bme.near_duplicate(MODEL, data[1], data) == 1 and bme.near_duplicate(MODEL, at, data) is None
    assert bme.near_duplicate([Component(1.0, "gaussian", 1e6)], np.array([1e-9, 0, 0]), np.array([[0, 0, 0], [9e5, 0, 0]], float)) == 0


def test_unsolvable_neighbourhoods_are_null_and_soft_data_without_variance_exact(spark):
    points = spark.createDataFrame([(1, 0.5, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, 900.0, 0.0, 0.0)], "k_id long, x double, y double, t double")
    hard = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 2.0)], "h_id long, x double, y double, t double, z double")
    schema = "h_id long, x double, y double, t double, pdf_type int, limi array<double>, probdens array<double>, mean double, var double"
    soft = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 10, None, None, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 10, None, None, 2.0, 0.0)], schema)
    a = {r.k_id: r for r in bme.predict(points, hard, None, MODEL, 2, 0, 5.0, 1.0, 1.0).collect()}
    b = {r.k_id: r for r in bme.predict(points, None, soft, MODEL, 0, 2, 5.0, 1.0, 1.0).collect()}
    assert a[1].mean == pytest.approx(b[1].mean) and a[1].variance == pytest.approx(b[1].variance) and a[3].mean is None is b[3].mean
    bad = np.full((2, 2, 3), np.nan)
    bad[0] = [[0, 0, 0], [1, 0, 0]]
    got = interpolate.each_or_none(lambda at, known, z: np.column_stack(interpolate.krige_many(MODEL, at, known, z, None)[:2]), np.zeros((2, 3)), bad, np.ones((2, 2)))
    assert not np.isnan(got[0]).any() and np.isnan(got[1]).all()


def test_kernel_without_own_cell_and_slices(spark):
    pts, z, cells = lattice(spark)
    got = {(r.x, r.y, r.t): r.tr for r in validate.loo_kernel(cells, 2.0, 2.0).collect()}
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(2) / 4
    w = np.exp(-3 * d2) * (1 - np.eye(len(z)))
    assert all(got[tuple(p)] == pytest.approx(v, abs=1e-9) for p, v in zip(pts.tolist(), w @ z / w.sum(1), strict=True))
    result = cells.withColumnRenamed("z", "mean").withColumn("variance", F.lit(1.0))
    assert [r.t for r in validate.series(result, 2.0, 1.0).collect()] == list(range(6))
    assert validate.map_at(result, 3.0).count() == 20
    assert grid.work_chunks(cells.withColumnRenamed("h_id", "k_id"), 7).rdd.getNumPartitions() == 7
    dirty = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "z double")
    assert [r.z for r in grid.clean_values(dirty).collect()] == [1.0, None, None]


@pytest.mark.parametrize("ties", [False, True])
def test_exact_quantiles_by_narrowing(spark, ties):
    rng = np.random.default_rng(9)
    v = rng.normal(size=5000)
    v = np.round(v, 1) if ties else np.r_[v, rng.normal(size=50) * 1e6]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "e double")
    shares = (0.0, 0.25, 0.5, 0.75, 0.9987, 1.0)
    assert validate.exact_quantiles(df, "e", shares, most=40) == pytest.approx(np.quantile(v, shares).tolist())
    assert validate.exact_quantiles(df.limit(0), "e", (0.5,)) == [None]
    assert validate.exact_quantiles(spark.createDataFrame([(3.0,)], "e double"), "e", (0.25, 1.0)) == [3.0, 3.0]


def test_numbers_of_sites_over_many_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    xy = sorted({(float(a), float(b)) for a, b in np.round(rng.normal(size=(500, 2)), 1)})
    obs = spark.createDataFrame([(x, y, 0.0) for x, y in xy], "x double, y double, t double").repartition(5)
    monkeypatch.setattr(grid, "SLICES", 16)
    assert [(r.x, r.y) for r in sorted(grid.sites(obs).collect(), key=lambda r: r.si)] == xy
    assert sorted(r.si for r in grid.sites(obs).collect()) == list(range(1, len(xy) + 1))
    assert grid.sites(obs.limit(0)).count() == 0


def test_covariance_of_uneven_series_against_all_pairs(spark):
    """Missing times, several bins that overlap, both orientations; sites far apart do not meet."""
    rng = np.random.default_rng(8)
    rows = [(float(x), float(y), float(t), float(rng.normal())) for x, y in [(0, 0), (1, 0), (1, 2), (4, 4), (30, 30)] for t in sorted(rng.choice(20, 9, replace=False))]
    cells = spark.createDataFrame(rows, "x double, y double, t double, residual double")
    bs, bt = covariance.lag_bins([0.0, 1.0, 2.0, 5.0], [0.5, 0.7, 0.8, 1.0]), covariance.lag_bins([0.0, 1.0, 3.0], [0.5, 1.0, 1.2])
    got = {(r.lag_s, r.lag_t): r for r in covariance.empirical_covariance(cells, bs, bt, bins="closed").collect()}
    both = {(r.lag_s, r.lag_t): r for r in covariance.symmetric_covariance(cells, bs, bt).collect()}
    want, two = {}, {}
    for a in rows:
        for b in rows:
            if a[:2] > b[:2]:
                continue
            ds, dt = math.hypot(a[0] - b[0], a[1] - b[1]), b[2] - a[2]
            for s, r in bs:
                for t, q in bt:
                    if abs(ds - s) <= r and abs(abs(dt) - t) <= q:
                        if dt >= 0:
                            want.setdefault((s, t), []).append((a[3], b[3]))
                        if dt >= 0 or ds > 0:
                            two.setdefault((s, t), []).append((a[3], b[3]))
    assert set(got) == set(want) and set(both) == set(two)
    for k, pairs in want.items():
        left, right = np.array(pairs).T
        assert got[k].n == len(pairs) and got[k].cov == pytest.approx(np.cov(left, right, bias=True)[0, 1], abs=1e-9) and got[k].m1 == pytest.approx(left.mean())
    for k, pairs in two.items():
        p = np.array(pairs)
        assert both[k].n == 2 * len(pairs) and both[k].cov == pytest.approx((p[:, 0] * p[:, 1]).mean() - p.mean() ** 2, abs=1e-9)


def test_anisotropic_fit_and_downscaling(spark):
    phi, lags = np.arange(0, 180, 30.0), np.arange(0, 9.0)
    ranges = 6 * 0.6 / np.sqrt(0.36 * np.cos(np.radians(phi) - 0.5) ** 2 + np.sin(np.radians(phi) - 0.5) ** 2)
    rows = [(float(p), float(d), 0.0, 50, float(4 * math.exp(-3 * d / a))) for p, a in zip(phi, ranges, strict=True) for d in lags]
    got = fit.fit_anisotropic(spark.createDataFrame(rows, "azimuth_deg double, lag_s double, lag_t double, n long, cov double"), "exponential")
    assert (got["sill"], got["range"], got["ratio"]) == pytest.approx((4, 6, 0.6), rel=0.05) and got["theta"] == pytest.approx(0.5, abs=0.1)
    steps, coarse = 4, np.arange(5.0)
    base = (np.arange(steps)[:, None] - np.arange(steps)[None]).ravel()
    cov = np.array([3 * np.exp(-3 * np.abs(base + k * steps) / 10).mean() for k in coarse])
    assert fit.downscale_time(coarse, cov, "exponential", steps) == pytest.approx((3, 10), rel=0.05)
    u, v = models.to_isotropic(F.col("x"), F.col("y"), 30.0, 0.5)
    xy = spark.createDataFrame([(1.0, 2.0)], "x double, y double").select(u.alias("u"), v.alias("v"))
    back = xy.select(*models.to_anisotropic(F.col("u"), F.col("v"), 30.0, 0.5)).first()
    assert tuple(back) == pytest.approx((1.0, 2.0))


def test_likelihood_of_all_blocks(spark):
    pts, z, cells = lattice(spark, 8, 8, 4)
    cells = cells.withColumnRenamed("z", "residual")
    blocks = fit.in_blocks(cells, "residual", 60)
    parts = {}
    for r in blocks.collect():
        parts.setdefault(tuple(r.block), []).append((r.x, r.y, r.t, r.z))
    assert len(parts) > 3 and sum(map(len, parts.values())) == len(z)
    other = [Component(2.0, "exponential", 2.0, "exponential", 1.0)]
    want = [sum(fit.log_likelihood(m, np.array(p)[:, :3], np.array(p)[:, 3]) for p in parts.values()) for m in (MODEL, other)]
    assert fit.block_likelihood(blocks, [MODEL, other]).tolist() == pytest.approx(want)
    found, value = fit.fit_likelihood(cells, [("exponential", "exponential")], most=60, particles=12, rounds=4)
    assert value > want[1] and found[0].sill > 0.2


def test_bivariate_densities():
    x, y = np.linspace(-6, 6, 241), np.linspace(-7, 7, 281)
    cov = np.array([[1.0, 0.4], [0.4, 1.5]])
    p = information.maximum_entropy_pair(np.array([0.2, -0.3]), cov, x, y)
    both = lambda f: np.trapezoid(np.trapezoid(f, y, axis=1), x)
    dx, dy = x[:, None] - 0.2, y[None, :] + 0.3
    assert both(p) == pytest.approx(1, abs=1e-5)
    assert [both(p * dx * dx), both(p * dx * dy), both(p * dy * dy)] == pytest.approx([1.0, 0.4, 1.5], abs=1e-3)
    given = information.conditional_density(p, x, 140)  # y = 0
    assert np.trapezoid(given * x, x) == pytest.approx(0.2 + 0.4 / 1.5 * 0.3, abs=1e-6)
    u = (np.arange(400) + 0.5) / 400
    c = information.copula_pair(u, u, 0.5)
    assert c.mean() == pytest.approx(1, abs=0.02) and c.mean(0)[200] == pytest.approx(1, abs=0.01) and c[10, 10] > 1 > c[10, 390]


def test_soft_loaders(spark, tmp_path):
    (tmp_path / "g.txt").write_text("x,y,t,m,v\n1,2,3,10,4\n\n5 , 6,7, 0, 1\n")
    g = {r.row_id: r for r in observations.load_soft(spark, str(tmp_path / "g.txt"), "gaussian", header=True).collect()}
    assert set(g) == {1, 3} and (g[1].x, g[1].y, g[1].t) == (1, 2, 3)
    assert g[1].pdf.pdf_type == 2 and g[1].pdf.nl == 13 and g[1].pdf["mean"] == pytest.approx(10) and g[1].pdf["var"] == pytest.approx(4.260783, abs=1e-6)
    assert g[1].quantile == pytest.approx([6.524659, 8.460737, 10, 11.539263, 13.475341], abs=1e-6)
    (tmp_path / "u.txt").write_text("0|0|0|0|1\n")
    (u,) = observations.load_soft(spark, str(tmp_path / "u.txt"), "uniform", sep="|").collect()
    assert u.pdf.nl == 5 and (u.pdf["mean"], u.pdf["var"]) == pytest.approx((0.5, 1 / 12)) and u.quantile == pytest.approx([0.05, 0.25, 0.5, 0.75, 0.95])
    (tmp_path / "r.txt").write_text("1,1,1,3,.01,.03,.2,1.0,0,1,1,0\n2,2,2,1,0,1,2,2\n")
    r = {x.row_id: x for x in observations.load_soft(spark, str(tmp_path / "r.txt"), "user").collect()}
    assert r[0].pdf.probdens == pytest.approx([0, 1.724138, 1.724138, 0], abs=1e-6) and r[0].pdf["mean"] == pytest.approx(0.355948, abs=1e-6)
    assert r[1].pdf.nl == 2 and r[1].pdf.probdens == pytest.approx([1, 1])
    with pytest.raises(ValueError):
        observations.load_soft(spark, str(tmp_path / "r.txt"), "other")


def test_lines_keep_their_places_over_files_and_blocks(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "b.csv").write_text("".join(f"h\n" if i == 0 else f"{i},{i / 2}\n" for i in range(3000)))
    (d / "a.csv").write_text("h\n7,nan\n8,\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = observations.read_delimited(spark, str(d), {"k": 0, "z": 1}, header=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.row_id: (r.k, r.z) for r in rows}
    assert got == {1: (7.0, None), 2: (8.0, None)} | {3 + i: (float(i), i / 2) for i in range(1, 3000)}
    (tmp_path / "bad.csv").write_text("1,x\n")
    with pytest.raises(Exception, match="CAST"):
        observations.read_delimited(spark, str(tmp_path / "bad.csv"), {"z": 1}).collect()


def test_export_with_leading_lines(spark, tmp_path):
    r = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, None)], "x double, y double, t double, mean double, variance double")
    observations.write_result(r, str(tmp_path / "out"), leading=["# title"])
    assert [v.value for v in spark.read.text(str(tmp_path / "out")).collect()] == ["# title", "x,y,t,mean,variance", "1.0,2.0,3.0,4.0,"]


def test_soft_record(spark):
    limi, p = F.array(*map(F.lit, (0.0, 1.0))), F.array(*map(F.lit, (1.0, 1.0)))
    r = spark.range(1).select(softdata.record(F.lit(2), limi, p).alias("r")).first().r
    assert (r.pdf_type, r.nl, r["mean"]) == (2, 2, pytest.approx(0.5))


@pytest.mark.parametrize("method", ["linear", "nearest", "cubic"])
def test_interpolation_of_time_means(spark, method):
    t, v = np.array([0.0, 1.0, 3.0, 4.0, 7.0]), np.array([1.0, 4.0, 2.0, 2.5, 9.0])
    at = np.array([-1.0, 0.0, 0.5, 0.75, 1.0, 2.0, 2.5, 3.0, 5.5, 6.9, 7.0, 8.0])
    mt = spark.createDataFrame(list(zip(t.tolist(), v.tolist(), strict=True)), "t double, mt double")
    got = {r.t: r.mt for r in trend.interpolate_times(mt, spark.createDataFrame([(a,) for a in at.tolist()], "t double"), method=method).collect()}
    slopes = np.r_[(v[1] - v[0]) / (t[1] - t[0]), (v[2:] - v[:-2]) / (t[2:] - t[:-2]), (v[-1] - v[-2]) / (t[-1] - t[-2])]
    for a in at.tolist():
        if a <= t[0] or a >= t[-1]:
            want = v[0] if a <= t[0] else v[-1]
        else:
            i = int(np.searchsorted(t, a, "right")) - 1
            h, s = t[i + 1] - t[i], (a - t[i]) / (t[i + 1] - t[i])
            want = {
                "linear": v[i] + s * (v[i + 1] - v[i]),
                "nearest": v[i] if s <= 0.5 else v[i + 1],
                "cubic": (2 * s**3 - 3 * s**2 + 1) * v[i] + (s**3 - 2 * s**2 + s) * h * slopes[i] + (3 * s**2 - 2 * s**3) * v[i + 1] + (s**3 - s**2) * h * slopes[i + 1],
            }[method]
        assert got[a] == pytest.approx(want)


def test_quadratic_kernel_meets_what_it_reaches(spark):
    pts, z, cells = lattice(spark)
    got = {(r.x, r.y, r.t): r.tr for r in trend.kernel_at(cells, cells.select("x", "y", "t"), 2.5, 2.5, "quadratic").collect()}
    w = np.maximum(1 - ((pts[:, None] - pts[None]) ** 2).sum(2) / 2.5**2, 0)
    assert all(got[tuple(p)] == pytest.approx(v, abs=1e-9) for p, v in zip(pts.tolist(), w @ z / w.sum(1), strict=True))
    far = spark.createDataFrame([(99.0, 99.0, 99.0)], "x double, y double, t double")
    assert trend.kernel_at(cells, far, 2.5, 2.5, "quadratic").first().tr is None


def test_three_dimensional_anisotropy(spark):
    angles, ratios = (30.0, 20.0, -10.0), (0.5, 0.25)
    axes = models.axes_3d(*angles)
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.allclose(models.axes_3d(30, 0, 0) @ [math.cos(math.pi / 6), 0.5, 0], [1, 0, 0])
    p = spark.createDataFrame([(1.0, -2.0, 3.0)], "x double, y double, z double")
    u = p.select(*(c.alias(n) for c, n in zip(models.to_isotropic_3d(F.col("x"), F.col("y"), F.col("z"), angles, ratios), "uvw", strict=True)))
    assert list(u.first()) == pytest.approx((axes @ [1, -2, 3] / [1, 0.5, 0.25]).tolist())
    back = u.select(*models.to_anisotropic_3d(F.col("u"), F.col("v"), F.col("w"), angles, ratios)).first()
    assert list(back) == pytest.approx([1, -2, 3])


def test_distribution_function_of_a_density():
    x = np.linspace(0.05, 1, 20)
    at = np.array([-1.0, 0.0, 0.03, 0.3, 0.77, 1.0, 2.0])
    assert information.density_cdf(x, np.full(20, 3.0), at, 0.0) == pytest.approx(np.clip(at, 0, 1))
    x = np.linspace(0.0, 1, 400)
    assert information.density_cdf(x, 2 * x, at, 0.0) == pytest.approx(np.clip(at, 0, 1) ** 2, abs=1e-9)


def test_soft_sets_of_two_types_are_refused(spark):
    a = spark.createDataFrame([(1, [0.0, 1.0])], "row_id long, limi array<double>")
    assert grid.stack_soft(a, a.limit(0), 1, 1).count() == 1
    with pytest.raises(ValueError):
        grid.stack_soft(a, a, 1, 2)


def test_pair_products_without_self(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 4, None), ("b", 1, 5.0)], "k string, t int, z double")
    got = sorted((r.k, r.a_t, r.b_t, r.product) for r in neighbours.pair_products(rows, ["k"], "t", "z", include=False).collect())
    assert got == [("a", 1, 2, 6.0), ("a", 1, 4, None), ("a", 2, 4, None)]


def test_additive_model_with_spline_factor_and_penalty_by_dense_equations(spark):
    rng = np.random.default_rng(3)
    u, v, f = rng.uniform(0, 1, 300), rng.uniform(0, 4, 300), rng.integers(0, 3, 300)
    z = 2 * u + np.sin(v) + np.array([0.0, 0.7, -0.4])[f] + rng.normal(0, 0.05, 300)
    df = spark.createDataFrame([(i, float(a), float(b), int(c), float(d)) for i, (a, b, c, d) in enumerate(zip(u, v, f, z, strict=True))], "i long, u double, v double, f int, z double")
    x = np.stack([np.ones(300), u, v, v * v, v**3, np.maximum(v - 1.5, 0) ** 3, np.maximum(v - 3, 0) ** 3, f == 1, f == 2], 1)
    g = x.T @ x
    want = np.linalg.solve(g + 0.01 * np.diag(np.diag(g)), x.T @ z)
    beta, predict = trend.additive_fit(df, "z", ["u"], {"v": [1.5, 3.0]}, {"f": [0, 1, 2]}, ridge=0.01)
    assert beta == pytest.approx(want, rel=1e-6, abs=1e-8)
    assert [r.fit for r in predict(df).orderBy("i").collect()] == pytest.approx(x @ want, rel=1e-6)
