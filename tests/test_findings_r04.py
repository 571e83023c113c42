"""Findings of round 4, each with the case that went wrong."""

import datetime
import math
import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from fieldloom import catalog
from fieldloom.operators import grid, neighbours
from tests.test_findings_r03 import events_of, same_as_sql


def test_all_pairs_of_a_lattice_pack_small(spark, tmp_path):
    """The pairs of 600 sites are written with less than a byte each, for they repeat themselves; none is lost."""
    path = events_of(spark, tmp_path, [(u, 1, (1.0,)) for u in range(600)])
    catalog.queries()["N1_distance"](spark, path).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == 360_000
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/out").glob("*.parquet")) < 360_000


def test_all_pairs_of_points_on_and_off_a_lattice(spark):
    """Wide rows go in pieces, far rows leave gaps; points of broken or missing coordinates are paired too."""
    a = [(float(x), float(y)) for x in (-20, -1, 0, 5, 15, 16, 40) for y in (-3, 0, 1, 10**9)] + [(0.5, 1.0), (1.0, 0.25), (None, 2.0), (3.0, None)]
    b = [(float(x), float(y)) for x in range(3) for y in range(2)] + [(2.5, 7.0), (None, None)]
    got = neighbours.lattice_distances(*(spark.createDataFrame(s, "x double, y double") for s in (a, b))).collect()
    want = {(*p, *q): None if None in p + q else math.dist(p, q) for p in a for q in b}
    assert len(got) == len(want) and set(got[0].asDict()) == {"ax", "ay", "bx", "by", "d"}
    for r in got:
        w = want[r.ax, r.ay, r.bx, r.by]
        assert r.d is None if w is None else math.isclose(r.d, w, rel_tol=1e-15)


def test_values_on_the_mean_fall_as_in_sql(spark, tmp_path):
    """Cells of three values, the second half way: their mean by the order of rows, though tasks add them in another."""
    rng, day = random.Random(5), datetime.datetime(2024, 1, 4)
    rows = []
    for i in range(300):
        a, h = rng.randrange(5000), rng.randrange(20, 5000)
        rows.append((7 + 15 * i, [a / 100, (a + h) / 100, (a + 2 * h) / 100]))
    (tmp_path / "events.parquet").mkdir()
    for j in range(3):  # later files are larger, so that tasks begin with them
        more = [(10_000 + k, 1.0) for k in range(4000 * j)]
        users, values = zip(*[(u, v[j]) for u, v in rows], *more, strict=True)
        ids = [j * 100_000 + i for i in range(len(users))]
        pq.write_table(pa.table({"event_id": ids, "ts": pa.array([day] * len(ids), pa.timestamp("us")), "user_id": users, "value": values}), tmp_path / "events.parquet" / f"{'abc'[j]}.parquet")
    assert len(same_as_sql(spark, str(tmp_path), "P8_density_histogram")) == 300


def test_classes_of_means_on_a_border(spark, tmp_path):
    """Sites whose mean is 60, 70 or 80 to the last digit are in the class that begins there."""
    rng, sites = random.Random(6), []
    for u in range(150):
        v = [rng.randrange(12000) for _ in range(19)]
        sites.append([*v, (60 + 10 * (u % 3)) * 100 * 20 - sum(v)])
    path = events_of(spark, tmp_path, [(u, day, (c / 100,)) for u, v in enumerate(sites) for day, c in enumerate(v)])
    got = {int(r.y * 15 + r.x): r["class"] for r in catalog.queries()["S19_colour_class"](spark, path).collect()}
    assert got == {u: (1, 22, 43)[u % 3] for u in range(150)}


def test_exact_mean_of_any_values(spark):
    values = [(0, 0.1), (0, 0.2), (0, 0.3), (0, None), (1, 1e300), (1, 1.0), (2, None), (3, 1e19), (3, -1e19), (3, 6.0), (4, math.inf)]
    got = {r.k: r.m for r in spark.createDataFrame(values, "k int, v double").groupBy("k").agg(grid.exact_mean("v").alias("m")).collect()}
    assert got == {0: 0.6 / 3, 1: 5e299, 2: None, 3: 2.0, 4: math.inf}
