"""Conditional likelihood, assimilation, causal outliers, long tensors, lag products and annuli by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.models import Component, covariance_matrix
from fieldloom.operators import bme, covariance, decompose, information, neighbours, outliers, trend
from fieldloom.plans import fit

MODEL = [Component(2.0, "exponential", 3.0, "exponential", 4.0), Component(0.5, "spherical", 5.0, "gaussian", 6.0)]
CELL = "h_id long, x double, y double, t double, z double"


def field(seed, n):
    rng = np.random.default_rng(seed)
    return [(i, *map(float, rng.uniform(0, 4, 3)), float(rng.normal())) for i in range(n)]


def test_conditional_likelihood_is_the_dense_one_with_all_before(spark):
    """With as many neighbours as there are cells the product of the conditionals is the joint density."""
    rows = field(1, 60)
    cells = spark.createDataFrame([*rows, (99, 1.0, 1.0, 1.0, None)], CELL).withColumns({"k_id": F.lit(1), "_lo": F.lit("x")})
    p, z = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    other = [Component(1.0, "exponential", 9.0, "exponential", 9.0)]
    got = fit.conditional_likelihood(fit.conditioned(cells, 60, 100.0, 100.0, 1.0), [MODEL, other])
    for model, v in zip((MODEL, other), got, strict=True):
        k = covariance_matrix(model, p, p)
        want = -0.5 * (z @ np.linalg.solve(k, z) + np.linalg.slogdet(k)[1] + len(z) * math.log(2 * math.pi))
        assert v == pytest.approx(want, rel=1e-8)
    few = fit.conditional_likelihood(fit.conditioned(cells, 12, 100.0, 100.0, 1.0), [MODEL])[0]
    assert abs(few - got[0]) < 0.02 * abs(got[0])


def test_cells_are_conditioned_on_earlier_ones_alone(spark):
    rows = [(i, float(i), 0.0, 0.0, 1.0) for i in range(8)]
    cells = spark.createDataFrame(rows, CELL).withColumn("place", F.when(F.col("h_id") < 6, F.col("h_id")).otherwise(6))
    got = {r.k_id: [h.x for h in r.hard or []] for r in fit.conditioned(cells, 2, 50.0, 1.0, 1.0, "place").collect()}
    assert got == {0: [], 1: [0], 2: [1, 0], 3: [2, 1], 4: [3, 2], 5: [4, 3], 6: [5, 4], 7: [5, 4]}  # equal places are neither's earlier


def test_fit_by_conditional_likelihood(spark):
    rng = np.random.default_rng(2)
    p = np.array([(x, y, t) for x in range(7) for y in range(7) for t in range(5)], float)
    k = covariance_matrix([Component(4.0, "exponential", 5.0, "exponential", 6.0)], p, p)
    z = np.linalg.cholesky(k + 1e-9 * np.eye(len(k))) @ rng.normal(size=len(p))
    cells = spark.createDataFrame([(i, *map(float, q), float(v)) for i, (q, v) in enumerate(zip(p, z, strict=True))], CELL)
    model, value = fit.fit_conditional(cells, [("exponential", "exponential")], 6, 5.0, 4.0, 1.0, particles=8, rounds=3)
    rows = fit.conditioned(cells, 6, 5.0, 4.0, 1.0)
    assert value == pytest.approx(fit.conditional_likelihood(rows, [model])[0], rel=1e-9)
    assert 1 < model[0].sill < 12 and value > fit.conditional_likelihood(rows, [[Component(4.0, "exponential", 0.5, "exponential", 0.5)]])[0]


def soft(x, mean, var, **more):
    return {"x": x, "y": 0.0, "t": 0.0, "pdf_type": 10, "limi": None, "probdens": None, "mean": mean, "var": var} | more


def hard(x, z):
    return {"x": x, "y": 0.0, "t": 0.0, "z": z}


def test_assimilation_rules():
    at = np.array([0.5, 0.0, 0.0])
    keep = lambda h, s, n=None: bme.assimilated(MODEL, at, h, s, n)
    assert keep([hard(0, 1.0)], []) == ([hard(0, 1.0)], []) and keep([], []) == ([], [])
    apart = [hard(0, 1.0), hard(3, 2.0)], [soft(6, 1.0, 0.2)]
    assert keep(*apart) == apart
    (h, s) = keep([hard(0, 1.0), hard(0, 3.0), hard(2, 5.0)], [])
    assert h == [hard(2, 5.0)] and (s[0]["x"], s[0]["mean"], s[0]["var"]) == (0, 2.0, pytest.approx(1 + 1e-6))
    assert keep([hard(0, 1.0)], [soft(0, 9.0, 0.1)]) == ([hard(0, 1.0)], [])
    (h, s) = keep([], [soft(0, 1.0, 0.2), soft(0, 2.0, 0.4)])
    assert not h and s[0]["mean"] == 1.5 and s[0]["var"] == pytest.approx(0.3 + 0.25)
    uniform = soft(0, None, None, pdf_type=2, limi=[0.0, 6.0], probdens=[1 / 6, 1 / 6])
    (h, s) = keep([], [soft(0, 3.0, 1.0), uniform])
    assert s[0]["mean"] == pytest.approx(3.0) and s[0]["var"] == pytest.approx((1 + 3) / 2)
    (h, s) = keep([hard(0, 1.0), hard(1, 2.0), hard(9, 3.0)], [], 1)  # the nearest is kept, all go to it
    assert not h and s[0]["mean"] == 2.0 and s[0]["x"] in (0, 1)


def test_kept_data_by_brute_force():
    """The greedy choice by explicit conditional variances."""
    rng = np.random.default_rng(3)
    p = np.r_[rng.uniform(0, 5, (12, 3)), np.zeros((2, 3))]
    k, relevance = covariance_matrix(MODEL, p, p), rng.uniform(0.1, 1, 14)
    own = []
    for _ in range(9):
        rest = [k[i, i] - k[i, own] @ np.linalg.pinv(k[np.ix_(own, own)]) @ k[own, i] if own else k[i, i] for i in range(14)]
        worth = [-1 if i in own else max(v, 0) * relevance[i] for i, v in enumerate(rest)]
        own.append(int(np.argmax(worth)))
    assert bme.kept_data(k, relevance, 9) == own
    assert len(bme.kept_data(k, np.ones(14), 14)) == 13  # one of two equal places


def test_assimilation_in_predictions(spark):
    """Coinciding exact data of different value: their mean with their spread as noise; data that are apart are not touched."""
    data = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 3.0)], CELL)
    point = spark.createDataFrame([(7, 0.5, 0.0, 0.0)], "k_id long, x double, y double, t double")
    c = float(covariance_matrix(MODEL, np.array([[0.5, 0, 0]]), np.zeros((1, 3)))[0, 0])
    (row,) = bme.predict(point, data, None, MODEL, options=bme.Options(assimilate=True)).collect()
    assert row.mean == pytest.approx(2 * c / 3.500001) and row.variance == pytest.approx(2.5 - c * c / 3.500001)
    apart = spark.createDataFrame(field(5, 30), CELL)
    plain, merged = (bme.predict(point, apart, None, MODEL, options=o).first() for o in (bme.Options(), bme.Options(assimilate=True)))
    assert merged.mean == pytest.approx(plain.mean) and merged.variance == pytest.approx(plain.variance)


def test_quadrature_of_one_soft_datum():
    """Truncated normals in closed form; a density that exact data all but exclude; a point all but on the datum."""
    phi, big = (lambda v: math.exp(-v * v / 2) / math.sqrt(2 * math.pi)), (lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    model = [Component(4.0, "exponential", 3.0, "exponential", 3.0)]
    for a, b in [(-1.0, 3.0), (5.0, 9.0), (-40.0, 40.0)]:
        s = soft(0, None, None, pdf_type=2, limi=[a, b], probdens=[1 / (b - a)] * 2)
        u, v = a / 2, b / 2
        mass = big(v) - big(u)
        mean = 2 * (phi(u) - phi(v)) / mass
        var = 4 * (1 + (u * phi(u) - v * phi(v)) / mass) - mean * mean
        for x in (0.0, 1e-9, 0.5):
            rho = math.exp(-x)
            got, _, _ = bme._one(model, bme.Options(), None, np.array([x, 0.0, 0.0]), [], [s])
            assert got[0] == pytest.approx(rho * mean, rel=1e-6) and got[1] == pytest.approx(4 * (1 - rho * rho) + rho * rho * var, rel=1e-6)
    x, p = bme._one(model, bme.Options(), 201, np.array([0.5, 0.0, 0.0]), [], [s])[1:]
    assert np.trapezoid(p, x) == pytest.approx(1, abs=1e-3)


def test_gaussian_soft_data_in_stacks(spark):
    """Stacks of soft data give what one neighbourhood after the other does."""
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.uniform(0, 4, 3)), 10, None, None, float(rng.normal()), float(v)) for i, v in enumerate(rng.gamma(2, 0.3, 80))]
    rows[7] = (*rows[7][:8], 0.0)  # without variance: an exact one
    data = spark.createDataFrame(rows, "h_id long, x double, y double, t double, pdf_type int, limi array<double>, probdens array<double>, mean double, var double")
    points = data.selectExpr("h_id AS k_id", "x + 0.1 AS x", "y", "t")
    for order in (None, 0):
        o = bme.Options(order=order)
        found = bme.predict(points, None, data, MODEL, 0, 4, 1.5, 1.5, 1.0, o)
        near = {r.k_id: r.soft for r in bme._neighbour_arrays(points, data, bme.SOFT, "soft", 4, 1.5, 1.5, 1.0, False).collect()}
        for r in found.collect():
            own = [s.asDict() for s in near[r.k_id] or []]
            want = bme._one(MODEL, o, None, np.array([r.x, r.y, r.t]), [], own)[0]
            assert (r.mean, r.variance) == (pytest.approx(want[0], rel=1e-7), pytest.approx(want[1], rel=1e-7)) if own else r.mean is None


def plain_causal(rows, freq, window, nmax, radius, ratio, k, feedback):
    """Bucket after bucket, in plain Python."""
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r["z"])
    for r in rows:
        v = np.array(by[r["id"]])
        std = v.std(ddof=1) if len(v) > 1 else 0
        r["score"] = (r["z"] - v.mean()) / (std if std > 0 else 1)
    flagged, out = set(), {}
    for b in sorted({math.floor(r["t"] / freq) for r in rows}):
        own = [r for r in rows if math.floor(r["t"] / freq) == b]
        start, w = min(r["t"] for r in own), window[0]
        while True:
            w += window[1]
            pool = [r for r in rows if start - w < r["t"] < start and r["h_id"] not in flagged]
            if len(pool) >= window[3] or w > window[2]:
                break
        new = set()
        for r in own:
            d = sorted((math.sqrt((r["x"] - q["x"]) ** 2 + (r["y"] - q["y"]) ** 2 + ((r["t"] - q["t"]) * ratio) ** 2), q["h_id"], q["score"]) for q in pool)
            d = [x for x in d if x[0] < radius][:nmax]
            expected = sum(s / x**2 for x, _, s in d) / sum(1 / x**2 for x, _, _ in d) if d else None
            bad = expected is not None and abs(r["score"] - expected) > k
            out[r["h_id"]] = (expected, bad)
            new |= {r["h_id"]} if bad else set()
        flagged |= new if feedback else set()
    return out


@pytest.mark.parametrize("feedback", [False, True])
def test_causal_outliers_by_brute_force(spark, feedback):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(25):
        for t in range(9):
            if rng.random() < 0.8:
                z = float(rng.normal() + (9 if rng.random() < 0.08 else 0))
                rows.append({"h_id": len(rows), "id": i, "x": float(i % 5), "y": float(i // 5), "t": t + float(rng.choice([0.0, 0.25])), "z": z})
    window = (0.5, 1.0, 2.0, 30)
    want = plain_causal(rows, 1.0, window, 6, math.sqrt(4 + 9), 1.0, 1.5, feedback)
    data = spark.createDataFrame([tuple(r[c] for c in ("h_id", "id", "x", "y", "t", "z")) for r in rows] + [(999, 3, 0.0, 0.0, 1.0, None)], "h_id long, id long, x double, y double, t double, z double")
    got = {r.h_id: (r.expected, r.outlier) for r in outliers.causal_outliers(data, 1.0, window, 6, 2.0, 3.0, 1.0, 1.5, feedback=feedback).collect()}
    assert set(got) == set(want) and sum(b for _, b in want.values()) > 5
    for h, (e, bad) in want.items():
        assert got[h][1] == bad and (got[h][0] == pytest.approx(e, rel=1e-9) if e is not None else got[h][0] is None)
    if feedback:
        assert want != plain_causal(rows, 1.0, window, 6, math.sqrt(4 + 9), 1.0, 1.5, False)


def test_long_hosvd_against_dense(spark):
    """Core, orthogonal factors, rebuilt entries and the best part of given ranks, entries left out being 0."""
    rng = np.random.default_rng(10)
    t = rng.normal(size=(4, 3, 5)) * (rng.random((4, 3, 5)) < 0.8)
    long = spark.createDataFrame([(i, 10 * j, k + 2, float(t[i, j, k])) for i in range(4) for j in range(3) for k in range(5) if t[i, j, k]], "a int, b long, c int, v double")
    core, factors = decompose.hosvd_long(long)
    dense, own = decompose.hosvd(t)
    got = np.zeros((4, 3, 5))
    for r in core.collect():
        got[r.a, r.b, r.c] = r.v
    assert np.allclose(np.abs(got), np.abs(dense), atol=1e-8)
    back = {(r.a, r.b, r.c): r.v for r in decompose.rebuilt(core, factors).collect()}
    assert all(back.get((i, 10 * j, k + 2), 0.0) == pytest.approx(t[i, j, k], abs=1e-9) for i in range(4) for j in range(3) for k in range(5))
    core, factors = decompose.hosvd_long(long, keep={"a": 2, "b": 2, "c": 3})
    assert core.count() <= 12 and {f.count() for f in factors.values()} == {8, 6, 15}
    u = np.zeros((4, 2))
    for r in factors["a"].collect():
        u[r.a, r.k] = r.u
    assert np.allclose(u.T @ u, np.eye(2)) and np.allclose(np.abs(u.T @ own[0][:, :2]), np.eye(2), atol=1e-8)


def test_modes_too_large_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr(decompose, "MODE_SIZE", 3)
    with pytest.raises(ValueError, match="more than 3"):
        decompose.hosvd_long(spark.createDataFrame([(i, 0, 1.0) for i in range(4)], "a int, b int, v double"))


def test_lag_products_leave_out_broken_windows(spark):
    rng = np.random.default_rng(11)
    series = [(i, float(t), None if rng.random() < 0.2 else float(rng.normal())) for i in range(4) for t in range(12)]
    df = spark.createDataFrame(series, "id long, t double, z double")
    v = np.array([r.v for r in decompose.lag_embedding(df, 4).collect()])
    got = {(r.i, r.j): r.g for r in decompose.lag_gram(df, 4).collect()}
    assert len(got) == 10 and all(g == pytest.approx((v[:, i] * v[:, j]).sum()) for (i, j), g in got.items())


def test_annuli_meet_only_their_cells(spark):
    """All pairs of the ring and no others; the cells looked at are about the ring's share of the disc."""
    rng = np.random.default_rng(12)
    p = rng.uniform(0, 30, (300, 2))
    sites = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "si long, x double, y double")
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    for low, high in [(9.0, 10.0), (0.0, 2.0), (3.0, 3.0)]:
        got = {(r.a_si, r.b_si) for r in neighbours.pairs_between_radii(sites, low, high).collect()}
        assert got == {(i, j) for i in range(300) for j in range(i, 300) if low <= d[i, j] <= high}
    ring, disc = (len(neighbours.ring_offsets(low, 10.0, 10 / 6)) for low in (9.0, 0.0))
    assert ring < 0.65 * disc
    fine = len(neighbours.ring_offsets(9.5, 10.0, 0.05))  # in fine cells the ring's share of the area, 1 - 0.95**2, and its borders
    assert fine < 0.13 * len(neighbours.ring_offsets(0.0, 10.0, 0.05))


def test_spectral_fields_have_the_model_s_covariance(spark):
    """Over many seeded fields products of values average to the covariances; the same seed gives the same fields."""
    p = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.5, 2.0), (3, 4.0, 4.0, 0.0)]
    model = [Component(2.0, "exponential", 5.0, "exponential", 4.0), Component(1.0, "gaussian", 6.0, "gaussian", 5.0), Component(0.5, "nugget", 1.0)]
    points = spark.createDataFrame(p, "k_id long, x double, y double, t double")
    rows = information.simulate_spectral(points, model, 1500, waves=64).collect()
    z = np.zeros((1500, 4))
    for r in rows:
        z[r.replicate, r.k_id] = r.z
    at = np.array([q[1:] for q in p])
    want = covariance_matrix(model, at, at)
    assert np.abs(z.T @ z / 1500 - want).max() < 0.45 and np.abs(z.mean(0)).max() < 0.2
    again = {(r.replicate, r.k_id): r.z for r in information.simulate_spectral(points.repartition(3), model, 2, waves=64).collect()}
    assert all(z[i, k] == pytest.approx(v) for (i, k), v in again.items())
    with pytest.raises(ValueError, match="spectrum"):
        information.simulate_spectral(points, [Component(1.0, "spherical", 5.0)], 1)
    with pytest.raises(ValueError, match="simulate_spectral"):
        information.simulate(spark, np.zeros((information.DENSE_POINTS + 1, 3)), model, 1)


def test_penalised_splines_against_dense_algebra(spark):
    """Coefficients, degrees of freedom and the cross-validated choice by matrices of all rows."""
    rng = np.random.default_rng(13)
    x, v = rng.uniform(2, 12, 240), rng.integers(0, 3, 240)
    z = np.sin(x) + 0.5 * v + 0.2 * rng.normal(size=240)
    rows = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(x, v, z, strict=True)] + [(3.0, 1, None)], "x double, v int, z double")
    knots = [3.0, 5.0, 7.0, 9.0, 11.0]
    low, high = x.min(), x.max()
    u, k = (x - low) / (high - low), [(q - low) / (high - low) for q in knots]
    m = np.column_stack([np.ones(240), u, u**2, u**3, *(np.maximum(u - q, 0) ** 3 for q in k), v == 1, v == 2])
    fine = np.linspace(0, 1, 200_001)
    second = np.stack([0 * fine, 2 + 0 * fine, 6 * fine, *(6 * np.maximum(fine - q, 0) for q in k)])
    rough = np.zeros((11, 11))
    rough[1:9, 1:9] = np.trapezoid(second[:, None] * second[None], fine, axis=2)

    def dense(w):
        h = m @ np.linalg.pinv(m.T @ m + w * rough) @ m.T
        return h @ z, np.trace(h), 240 * ((z - h @ z) ** 2).sum() / (240 - np.trace(h)) ** 2

    factors = {"v": [0, 1, 2]}
    _, predict, figures = trend.additive_penalised(rows, "z", {"x": knots}, factors=factors, weights={"x": 1e-4})
    fit_of, edf, gcv = dense(1e-4)
    got = [r.fit for r in predict(rows.where("z is not null")).collect()]
    assert np.allclose(got, fit_of, atol=1e-6) and figures["edf"] == pytest.approx(edf, rel=1e-5) and figures["gcv"] == pytest.approx(gcv, rel=1e-6) and figures["n"] == 240
    _, _, chosen = trend.additive_penalised(rows, "z", {"x": knots}, factors=factors)
    unit = chosen["weights"]["x"]
    assert all(chosen["gcv"] <= dense(unit * 10.0**e)[2] * (1 + 1e-6) for e in (-1, -0.5, 0.5, 1))
    noise = rows.withColumn("z", F.when(F.col("z").isNotNull(), F.randn(4)))
    assert trend.additive_penalised(noise, "z", {"x": knots}, factors=factors)[2]["edf"] < chosen["edf"]  # nothing to follow: smoother
    with pytest.raises(ValueError, match="no row"):
        trend.additive_penalised(rows.limit(0), "z", {"x": knots})
    with pytest.raises(ValueError, match="degree"):
        trend.additive_penalised(rows, "z", {"x": knots}, degree=2)


@pytest.mark.parametrize("kind", ["half", "closed", "both"])
def test_covariance_in_blocks_of_time(spark, monkeypatch, kind):
    """A site with most of all times, cut into blocks, gives the sums of all pairs."""
    rng = np.random.default_rng(14)
    cells = [(0.0, 0.0, float(t), float(rng.normal())) for t in np.unique(rng.integers(0, 2000, 300)) / 4]
    cells += [(float(x), float(y), float(t), float(rng.normal())) for x in range(3) for y in range(2) for t in range(0, 500, 50) if (x, y) != (0, 0)]
    df = spark.createDataFrame(cells, "x double, y double, t double, residual double")
    run = (lambda: covariance.symmetric_covariance(df, covariance.lag_bins([0.0, 1.0, 2.0], 0.5), covariance.lag_bins([0.0, 2.0, 5.0], 1.0))) if kind == "both" else (lambda: covariance.empirical_covariance(df, covariance.lag_bins([0.0, 1.0, 2.0], 0.5), covariance.lag_bins([0.0, 2.0, 5.0], 1.0), bins=kind))
    whole = {(r.lag_s, r.lag_t): (r.n, r.cov) for r in run().collect()}
    monkeypatch.setattr(covariance, "BLOCK_CELLS", 10)
    assert 6 <= covariance.block_width(df, 6.0) < 40
    got = {(r.lag_s, r.lag_t): (r.n, r.cov) for r in run().collect()}
    assert set(got) == set(whole) and all(got[k] == (n, pytest.approx(c)) for k, (n, c) in whole.items())
