"""Every named query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from fieldloom import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple((v is not None, round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = duck.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert _rows(got) == _rows([tuple(r[at[c]] for c in cols) for r in cur.fetchall()])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def cell_values(duck):
    """Residuals of all cells by key, in plain SQL."""
    from fieldloom.plans import named

    rows = duck.execute(f"WITH {named.RESID} SELECT {named.KEY} AS h_id, x, y, t, r FROM resid ORDER BY h_id").fetchall()
    return np.array(rows, float)


@pytest.mark.parametrize("name", ["I5_kriging_ordinary", "I6_factorial_kriging", "B3_bme_qmc", "B7_pdf"])
def test_every_cell_is_a_point(spark, cell_values, name):
    got = catalog.queries()[name](spark, SF).select("k_id").collect()
    assert sorted(r.k_id for r in got) == cell_values[:, 0].astype(int).tolist()


def test_ordinary_kriging_of_every_cell_by_brute_force(spark, cell_values):
    key, xy, t, z = cell_values[:, 0], cell_values[:, 1:3], cell_values[:, 3], cell_values[:, 4]
    got = {r.k_id: (r.zk, r.vk) for r in catalog.queries()["I5_kriging_ordinary"](spark, SF).collect()}

    def cov(a, b):
        ds, dt = np.hypot(*(xy[a][:, None] - xy[b][None]).transpose(2, 0, 1)), np.abs(t[a][:, None] - t[b][None])
        sphere = np.where(ds > 9, 0, 1 - 1.5 * ds / 9 + 0.5 * (ds / 9) ** 3)
        return 1500 * np.exp(-3 * ds / 6 - 3 * dt / 4) + 800 * sphere * np.exp(-3 * (dt / 7) ** 2)

    days = set()
    for k in range(len(key)):
        d = np.sqrt(((xy - xy[k]) ** 2).sum(1) + ((t - t[k]) * 1.3) ** 2)
        near = np.flatnonzero((d < np.sqrt(3.2**2 + (2.5 * 1.3) ** 2)) & (np.arange(len(key)) != k))
        near = near[np.lexsort((key[near], np.round(d[near], 9)))][:10]
        if len(near) > 1:
            m, one = len(near), np.ones(len(near))
            left = np.block([[cov(near, near), one[:, None]], [one[None], np.zeros((1, 1))]])
            right = np.r_[cov(near, np.array([k]))[:, 0], 1]
            w = np.linalg.solve(left, right)
            assert np.allclose(got[int(key[k])], (w[:m] @ z[near], 2300 - w @ right), rtol=1e-6, atol=1e-4)
            days.add(t[k])
    assert days > {0, 29}


def test_raster_of_every_day(spark, duck):
    got = {(r.t, r.col): r.value for r in catalog.queries()["I9_raster"](spark, SF).where("row = 63 and col in (0, 63)").collect()}
    from fieldloom.plans import named

    want = duck.execute(f"WITH {named.CELLS} SELECT t, CASE WHEN x = 0 THEN 0 ELSE 63 END AS col, z FROM cells WHERE x IN (0, 14) AND y = 0").fetchall()
    assert len({t for t, _, _ in want}) > 2 and all(abs(got[t, c] - z) < 1e-9 for t, c, z in want)


def test_maximum_entropy_has_the_moments_of_all_values(spark, tmp_path):
    value = np.random.default_rng(5).gamma(2.0, 150.0, 2000)
    spark.createDataFrame([(float(v),) for v in value], "value double").write.parquet(f"{tmp_path}/events.parquet")
    u = (value - value.min()) / (value.max() - value.min())
    x, p = np.array(sorted((r.x, r.density) for r in catalog.queries()["X4_maximum_entropy"](spark, str(tmp_path)).collect())).T
    area = np.trapezoid(p, x)
    assert (value > 500).any() and abs(area - 1) < 0.02
    assert abs(np.trapezoid(p * x, x) / area - u.mean()) < 0.01 and abs(np.trapezoid(p * x * x, x) / area - (u * u).mean()) < 0.01
