"""Worked examples, independent formulas and invariants of the geostatistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import models, normal, softdata
from fieldloom.functions.models import Component
from fieldloom.operators import bme, covariance, decompose, grid, information, interpolate, neighbours, outliers, trend
from fieldloom.plans import fit, validate
from fieldloom.sources import observations
from fieldloom.streaming import outliers as stream_outliers
from fieldloom.streaming import site_sums


def table(spark, rows, schema="row_id long, x double, y double, t double, z double"):
    return spark.createDataFrame(rows, schema)


def cells_of(spark, sites, times, z):
    rows = [(i * len(times) + j, float(s[0]), float(s[1]), float(t), None if z[i][j] is None else float(z[i][j])) for i, s in enumerate(sites) for j, t in enumerate(times)]
    return table(spark, rows)


def test_grid_last_wins_and_lookup(spark):
    obs = table(spark, [(1, 1.0, 1.0, 1.0, 5.0), (2, 1.0, 2.0, 1.0, 4.0), (3, 1.0, 1.0, 2.0, 2.0), (4, 2.0, 2.0, 2.0, 4.0), (5, 3.0, 1.0, 2.0, 1.0), (6, 1.0, 1.0, 1.0, 9.0)])
    cells = grid.grid_last(obs)
    assert {(r.x, r.y, r.t): r.z for r in cells.collect()} == {(1, 1, 1): 9, (1, 2, 1): 4, (1, 1, 2): 2, (2, 2, 2): 4, (3, 1, 2): 1}
    assert [(r.si, r.x, r.y) for r in grid.sites(obs).orderBy("si").collect()] == [(1, 1, 1), (2, 1, 2), (3, 2, 2), (4, 3, 1)]
    found = {r.row_id: r.found for r in grid.lookup_unique(obs, cells).collect()}
    assert found[1] is None and found[6] is None and found[2] == 4


def test_stmean_example(spark):
    z = [[1, None, 3, 4, 5], [5, 6, 1, 7, 8], [1, None, 4, 2, 5], [5, 2, 6, 3, 1]]
    tr = {(r.x, r.t): r.tr for r in trend.stmean(cells_of(spark, [(1, 0), (2, 0), (3, 0), (4, 0)], [1, 2, 3, 4, 5], z)).collect()}
    assert tr[1, 1] == pytest.approx(2.416667, abs=1e-6) and tr[2, 2] == pytest.approx(5.566667, abs=1e-6) and tr[1, 2] is None and tr[4, 5] == pytest.approx(4.316667, abs=1e-6)


def test_kernel_example(spark):
    z = [[1, None, 3, 4, 5], [5, 6, 1, 7, 8], [1, None, 4, 2, 5], [5, 2, 6, 3, 1]]
    cells = cells_of(spark, [(1, 3), (1, 8), (3, 2), (4, 1)], [1, 3, 5, 7, 9], z)
    tr = {(r.x, r.y, r.t): r.tr for r in trend.kernel(cells, 8.0, 2.0).collect()}
    assert tr[1, 3, 1] == pytest.approx(2.309292, abs=1e-6) and tr[4, 1, 9] == pytest.approx(3.466080, abs=1e-6)
    cut = {(r.x, r.y, r.t): r.tr for r in trend.kernel_cut(cells.where("z is not null"), cells.where("z is not null").select("x", "y", "t"), 8.0, 2.0).collect()}
    assert all(cut[k] == pytest.approx(v, abs=1e-9) for k, v in tr.items())


def test_empirical_covariance_example(spark):
    cells = cells_of(spark, [(1, 3), (2, 4), (5, 7)], [1, 4, 6], [[1, 2, 3], [4, None, 6], [7, 8, 9]]).withColumnRenamed("z", "residual")
    s = covariance.lag_bins([0.0, 1.5, 5.0], [0.5, 0.5, 1.5])
    t = covariance.lag_bins([0.0, 2.5], [0.5, 1.0])
    got = {(r.lag_s, r.lag_t): (r.n, r.cov) for r in covariance.empirical_covariance(cells, s, t).collect()}
    want = {(0, 0): (8, 7.5), (0, 2.5): (4, 9.25), (1.5, 0): (2, 1.0), (1.5, 2.5): (1, 0.0), (5, 0): (5, 0.8), (5, 2.5): (3, -1 / 9)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-6) for k, v in want.items())


def test_simple_kriging_and_bme_agree(spark):
    model = [Component(0.05, "nugget", 1.0), Component(1.0, "exponential", 3.0)]
    data = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.4)], "h_id long, x double, y double, t double, z double")
    at = spark.createDataFrame([(7, 0.5, 0.5, 1.0), (8, 90.0, 90.0, 1.0)], "k_id long, x double, y double, t double")
    k = {r.k_id: r for r in interpolate.kriging(data, at, model, 5, 10.0).collect()}
    b = {r.k_id: r for r in bme.predict(at, data, None, model, 5, 0, 10.0, 10.0, 1.0).collect()}
    assert k[7].zk == pytest.approx(0.657425, abs=1e-6) and k[7].vk == pytest.approx(0.818460, abs=1e-6)
    assert b[7].mean == pytest.approx(k[7].zk) and b[7].variance == pytest.approx(k[7].vk)
    assert k[8].zk is None and b[8].mean is None


def test_exact_at_data_and_weights_sum_to_one():
    model = [Component(2.0, "exponential", 4.0, "exponential", 3.0)]
    pts = np.array([[0, 0, 0], [1, 0, 0], [0, 2, 1], [3, 1, 2]], float)
    z = np.array([1.0, 2.0, -1.0, 0.5])
    e, v, _ = interpolate.krige(model, pts[1], pts, z, None)
    assert e == pytest.approx(2.0) and v == pytest.approx(0, abs=1e-9)
    assert interpolate.krige(model, np.array([0.4, 0.3, 0.2]), pts, z, 0)[2].sum() == pytest.approx(1)


def test_local_mean_is_the_plain_one_without_correlation():
    model = [Component(1.0, "nugget", 1.0)]
    pts = np.array([[0, 0, 0], [1, 0, 0], [5, 5, 5]], float)
    assert interpolate.local_mean(model, pts, np.array([1.0, 2.0, 6.0])) == (pytest.approx(3.0), pytest.approx(1 / 3))
    assert interpolate.local_mean(model, pts, np.array([1.0, 1.0, 9.0]), np.array([0.0, 0.0, 1e9]))[0] == pytest.approx(1.0, abs=1e-6)


def test_soft_gaussian_is_noisy_conditioning_and_qmc_agrees():
    model = [Component(3.0, "exponential", 5.0, "exponential", 4.0)]
    at, hard, zh = np.array([0.5, 0.5, 0.0]), np.array([[0, 0, 0], [2, 1, 1]], float), np.array([0.8, -0.3])
    soft = [{"x": 1.0, "y": 1.0, "t": 0.0, "pdf_type": 10, "mean": 0.6, "var": 0.4, "limi": None, "probdens": None}]
    n = bme.Neighbourhood(model, at, hard, zh, soft, None)
    m, v, s = n.posterior(bme.Options())
    both = np.concatenate([hard, [[1, 1, 0]]])
    k = models.covariance_matrix(model, both, both) + np.diag([0, 0, 0.4])
    c = models.covariance_matrix(model, at[None], both)[0]
    assert m == pytest.approx(c @ np.linalg.solve(k, np.r_[zh, 0.6])) and v == pytest.approx(3 - c @ np.linalg.solve(k, c)) and s == 0
    x = np.linspace(0.6 - 6 * 0.4**0.5, 0.6 + 6 * 0.4**0.5, 201)
    linear = soft[0] | {"pdf_type": 2, "limi": x.tolist(), "probdens": (np.exp(-((x - 0.6) ** 2) / 0.8) / math.sqrt(2 * math.pi * 0.4)).tolist()}
    mq, vq, sq = bme.Neighbourhood(model, at, hard, zh, [linear], None).posterior(bme.Options())
    assert mq == pytest.approx(m, abs=0.01) and vq == pytest.approx(v, abs=0.02) and abs(sq) < 0.02
    px, pp = n.pdf(bme.Options())
    assert np.trapezoid(pp, px) == pytest.approx(1, abs=1e-6)


def test_qmc_sphere():
    def f(u):
        r, phi = u[:, 0], math.pi * u[:, 2]
        return 2 * math.pi**2 * r**2 * np.sin(phi)

    value, _, _ = bme.qmc(f, 3)
    assert value[0] == pytest.approx(4 * math.pi / 3, rel=2e-3)


def test_soft_records(spark):
    one = spark.range(1)
    mean, var = F.lit(10.0), F.lit(4.0)
    limi, p = softdata.gaussian_limits(mean, var), softdata.gaussian_density(mean, var)
    r = one.select(softdata.mean(limi, p).alias("m"), softdata.variance(limi, p).alias("v"), softdata.quantiles(limi, p).alias("q"), softdata.area(limi, p).alias("a")).first()
    assert (r.m, r.v, r.a) == (pytest.approx(10), pytest.approx(4.260783, abs=1e-6), pytest.approx(1))
    assert r.q == pytest.approx([6.524659, 8.460737, 10, 11.539263, 13.475341], abs=1e-6)
    l3, p3 = F.array(*map(F.lit, (0.01, 0.03, 0.2, 1.0))), F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0)))
    pn = softdata.normalise(l3, p3)
    r = one.select(pn.alias("p"), softdata.mean(l3, pn).alias("m"), softdata.variance(l3, pn).alias("v"), softdata.quantiles(l3, pn).alias("q")).first()
    assert r.p == pytest.approx([0, 1.724138, 1.724138, 0], abs=1e-6) and r.m == pytest.approx(0.355948, abs=1e-6) and r.v == pytest.approx(0.052605, abs=1e-6)
    assert r.q == pytest.approx([0.049, 0.165, 0.42, 0.71, 0.942], abs=1e-3)
    assert softdata.type_code("Linear") == 2 and softdata.type_code("hist") == 1 and math.isnan(softdata.order_code("Zero Mean"))
    with pytest.raises(ValueError):
        softdata.order_code("other")


def test_significant_digits(spark):
    df = spark.createDataFrame([(0.0,), (1234567.0,), (123.4567,), (-123.4567,)], "v double")
    assert [r[0] for r in df.select(grid.significant_digits(F.col("v"), 4)).collect()] == [0, 1235000, 123.5, -123.5]


def test_normal_functions(spark):
    xs = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal.cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rel=0.02, abs=1e-14)


def test_models():
    d = np.array([0.0, 0.5, 2.0, 9.0])
    assert models.correlation_np("matern", d, 5.0, 0.5) == pytest.approx(np.exp(-models._matern_scale(0.5) * d / 5.0), rel=1e-6)
    assert models.bessel_k(0.5, np.array([1.3]))[0] == pytest.approx(math.sqrt(math.pi / 2.6) * math.exp(-1.3), rel=1e-9)
    assert models.parse("sphericalC/gaussianC", (1.0, 2.0, 3.0)) == Component(1.0, "spherical", 2.0, "gaussian", 3.0)
    with pytest.raises(ValueError):
        models.check_consistent([Component(1, "exponential", 1, "exponential", 1), Component(1, "exponential", 1)])


def test_fit_recovers_a_known_surface(spark):
    true = [Component(2.0, "exponential", 5.0, "exponential", 4.0)]
    rows = [(float(s), float(t), 100, float(models.covariance_np(true, np.array(float(s)), np.array(float(t))))) for s in range(7) for t in range(6)]
    model, value = fit.fit(spark.createDataFrame(rows, "lag_s double, lag_t double, n long, cov double"), [("exponential", "exponential")])
    assert value < 1e-6 and model[0].range_s == pytest.approx(5, rel=0.02) and model[0].range_t == pytest.approx(4, rel=0.02)


def test_prediction_beats_the_mean_on_a_simulated_field(spark):
    model = [Component(1.0, "exponential", 8.0, "exponential", 6.0), Component(0.05, "nugget", 1.0, "nugget", 1.0)]
    pts = np.array([(x, y, t) for t in range(4) for y in range(7) for x in range(7)], float)
    field = information.simulate(spark, pts, model, 1, seed=3).withColumn("h_id", F.col("k_id"))
    again = information.simulate(spark, pts, model, 1, seed=3)
    assert field.agg(F.sum("z")).first()[0] == pytest.approx(again.agg(F.sum("z")).first()[0])
    errors = validate.loo_bme(field.select("h_id", "x", "y", "t", "z"), None, model, nh=12, dmax_s=3.1, dmax_t=1.5, ratio=1.0)
    s = validate.error_statistics(errors).first()
    assert s.rmse < 0.9 * field.agg(F.stddev_pop("z")).first()[0]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    p = rng.random((80, 3)) * 10
    data = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "h_id long, x double, y double, t double")
    at = data.withColumnRenamed("h_id", "k_id")
    got = {}
    for r in neighbours.nearest(at, data, 4, 2.5, 2.0, 0.8).collect():
        got.setdefault(r.k_id, []).append((r.rank, r.h_id))
    radius = neighbours.sphere_radius(2.5, 2.0, 0.8)
    for i in range(80):
        d = np.sqrt(((p[i, :2] - p[:, :2]) ** 2).sum(1) + (0.8 * (p[i, 2] - p[:, 2])) ** 2)
        own = [j for j in np.lexsort((np.arange(80), d)) if d[j] < radius][:4]
        assert [h for _, h in sorted(got[i])] == own
    assert neighbours.nearest(at, data.limit(0), 4, 2.5, 2.0, 0.8).count() == 0


def test_outliers():
    t = np.arange(30, dtype=float)
    z = np.sin(t)
    z[20] = 40.0
    assert np.flatnonzero(outliers.flag_series(t, z, 5.0, 15.0)).tolist() == [20]


def test_stl_separates_season_and_trend():
    t = np.arange(84, dtype=float)
    y = 0.1 * t + 3 * np.sin(2 * np.pi * t / 7)
    s, tr, r = trend.stl_series(y, 7)
    assert np.abs(r).max() < 0.2 and np.abs(s - 3 * np.sin(2 * np.pi * t / 7)).max() < 0.2


def test_decompositions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)) @ np.diag([4, 2, 1, 0.5, 0.2])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    value, s, axes = decompose.eof_vectors(df)
    assert s == pytest.approx(np.linalg.svd(x, compute_uv=False), rel=1e-6)
    assert np.abs(axes.T @ axes - np.eye(5)).max() < 1e-9
    v, _ = decompose.pca(df)
    assert v == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1], rel=1e-6)
    tensor = rng.normal(size=(3, 4, 2))
    core, factors = decompose.hosvd(tensor)
    back = core
    for k, u in enumerate(factors):
        back = decompose.mode_product(back, u, k)
    assert np.abs(back - tensor).max() < 1e-9
    assert np.abs(decompose.fold(decompose.unfold(tensor, 1), 1, tensor.shape) - tensor).max() == 0
    q = decompose.gram_schmidt(np.array([[1, 1, 0], [1, 0, 1], [2, 1, 1.0]]))
    assert q.shape == (2, 3) and np.abs(q @ q.T - np.eye(2)).max() < 1e-9
    w = np.array([1.0, 2.0, 3.0, 4.0])
    q, r = decompose.weighted_qr(rng.normal(size=(4, 2)), w)
    assert np.abs(q.T @ np.diag(w) @ q - np.eye(2)).max() < 1e-9


def test_maximum_entropy_matches_moments():
    x, p = information.maximum_entropy(np.array([0.4, 0.2]), 0.0, 1.0)
    w = np.polynomial.legendre.leggauss(len(x))[1] / 2
    assert (p * w).sum() == pytest.approx(1) and (p * x * w).sum() == pytest.approx(0.4, abs=1e-6) and (p * x * x * w).sum() == pytest.approx(0.2, abs=1e-6)


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x,y,t,z\n1,2,3,4.5\n2,3,4,-1\n")
    df = observations.read_delimited(spark, str(f), {"x": 0, "y": 1, "t": 2, "z": 3}, header=True)
    assert sorted((r.x, r.z) for r in df.collect()) == [(1, 4.5), (2, -1)]
    title, top, n = observations.sniff(spark, str(f))
    assert title and n == 2 and top[0] == ["1", "2", "3", "4.5"]
    with pytest.raises(Exception, match="CAST|cast"):
        observations.read_delimited(spark, str(f), {"x": 0}).collect()
    g = tmp_path / "s.csv"
    g.write_text("1,2,3,2,0,1,2,0.5,0.5,0.5\n4,5,6,1,7,8,1,1\n")
    rows = {r.x: r for r in observations.read_user_defined_soft(spark, str(g)).collect()}
    assert rows[1].limi == [0, 1, 2] and rows[4].probdens == [1, 1] and rows[4].nl == 2
    grid_ = observations.generate_grid(spark, (0, 1, 2), (0, 2, 3), (5, 5, 1)).withColumns({"mean": F.col("x") + F.col("y"), "variance": F.lit(1.0)})
    observations.write_result(grid_, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 6
    raster = {(r.row, r.col): r.value for r in observations.resample(grid_, 5, 3).collect()}
    assert len(raster) == 15 and raster[0, 2] == pytest.approx(3.0) and raster[4, 0] == pytest.approx(0.0) and raster[2, 1] == pytest.approx(1.5)
    observations.save_project({"cells": grid_}, {"unit": "day"}, str(tmp_path / "p"))
    tables, settings = observations.load_project(spark, str(tmp_path / "p"))
    assert tables["cells"].count() == 6 and settings == {"unit": "day"}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, float(i % 3), 0.0, float(i), float(i * i % 7)) for i in range(30)]
    table(spark, rows).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, x double, y double, t double, z double").parquet(str(tmp_path / "in"))
    q = site_sums(stream).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    want = {r.x: (r.n, r.s) for r in site_sums(table(spark, rows)).collect()}
    assert {r.x: (r.n, r.s) for r in spark.table("sums").collect()} == want
    q = stream_outliers(stream.withColumn("id", F.col("x").cast("long")), 100.0).writeStream.outputMode("append").format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("flags").count() == 30


def test_ica_takes_every_vector(spark):
    import numpy as np

    from fieldloom.operators import decompose

    rng = np.random.default_rng(4)
    source = np.c_[rng.uniform(-1, 1, 24_000), rng.laplace(size=24_000)]
    x = source @ np.array([[2.0, 1.0], [1.0, -1.5]])
    df = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").repartition(4)
    mixing, unmixing = decompose.ica(df, 2)
    value, axes = decompose.pca(df)
    white = axes / np.sqrt(value)
    z = (x - x.mean(0)) @ white
    w, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(2, 2)))
    for _ in range(200):
        y = np.tanh(z @ w.T)
        u, _, vt = np.linalg.svd(y.T @ z / len(z) - np.diag((1 - y**2).mean(0)) @ w)
        last, w = w, u @ vt
        if np.abs(np.abs((w * last).sum(1)) - 1).max() < 1e-8:
            break
    assert np.allclose(unmixing, w @ white.T, rtol=0, atol=1e-6) and np.allclose(mixing, np.linalg.pinv(w @ white.T), rtol=0, atol=1e-6)
