"""Named queries over the driver's tables, each beside the SQL that gives the same rows.

Sites are users on a lattice 15 wide, times are days, values are event values.  Computed
doubles are rounded, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import models, normal, softdata
from fieldloom.functions.models import Component
from fieldloom.operators import bme, covariance, decompose, grid, information, interpolate, neighbours, outliers, trend
from fieldloom.operators.stages import shared_path
from fieldloom.plans import fit, validate
from fieldloom.sources import observations
from fieldloom.streaming import site_sums

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

OBS = "obs AS (SELECT event_id AS row_id, CAST(user_id % 15 AS DOUBLE) AS x, CAST(user_id // 15 AS DOUBLE) AS y, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS t, value AS z FROM events)"
CELLS = OBS + ", cells AS (SELECT x, y, t, arg_max(z, row_id) AS z FROM obs GROUP BY x, y, t)"
RESID = CELLS + ", resid AS (SELECT *, z - (avg(z) OVER (PARTITION BY x, y) + avg(z) OVER (PARTITION BY t) - avg(z) OVER ()) AS r FROM cells)"
SITES = CELLS + ", sites AS (SELECT x, y, avg(z) AS z FROM cells GROUP BY x, y)"
SOFT = OBS + ", soft AS (SELECT x, y, t, avg(z) AS mean, var_pop(z) AS var, min(z) AS low, max(z) AS up FROM obs GROUP BY x, y, t HAVING count(*) >= 2 AND var_pop(z) > 0.01)"
NODES = ", ".join(f"({i}, {k})" for i, k in enumerate(softdata.GAUSS_NODES))
POLYGON = SOFT + f""", nodes(i, k) AS (VALUES {NODES}),
raw AS (SELECT x, y, t, i, mean + sqrt(var) * k AS l, exp(-k * k / 2) / sqrt(2 * pi() * var) AS p FROM soft, nodes),
seg AS (SELECT *, lead(l) OVER w AS l1, lead(p) OVER w AS p1 FROM raw WINDOW w AS (PARTITION BY x, y, t ORDER BY i)),
area AS (SELECT x, y, t, sum((p + p1) * (l1 - l) / 2) AS a FROM seg GROUP BY x, y, t),
poly AS (SELECT seg.x, seg.y, seg.t, i, l, l1, p / a AS p, p1 / a AS p1 FROM seg JOIN area USING (x, y, t))"""
MODEL = [Component(1500.0, "exponential", 6.0, "exponential", 4.0), Component(800.0, "spherical", 9.0, "gaussian", 7.0)]
MODEL_SQL = "(1500.0 * exp(-3.0 * {ds} / 6.0) * exp(-3.0 * {dt} / 4.0) + 800.0 * (CASE WHEN {ds} > 9.0 THEN 0 ELSE 1 - 1.5 * ({ds} / 9.0) + 0.5 * ({ds} / 9.0) * ({ds} / 9.0) * ({ds} / 9.0) END) * exp(-3.0 * ({dt} / 7.0) * ({dt} / 7.0)))"
LAGS_S, LAGS_T = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 1.0, 2.0, 3.0, 4.0]


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else "WITH " + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(c: Column | str, name: str, digits: int = 4) -> Column:
    return F.round(c, digits).alias(name)


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def obs(spark: SparkSession, d: str) -> DataFrame:
    return observations.from_events(events(spark, d))


def cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.grid_last(obs(spark, d))


def resid(spark: SparkSession, d: str) -> DataFrame:
    return grid.residual(trend.stmean(cells(spark, d)))


def site_means(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("x", "y").agg(F.avg("z").alias("z"))


#: Variance that a cell of soft data passes, and how near to it rounding can decide.
LEAST_VARIANCE, BORDER = 0.01, 1e-6


def in_order(o: DataFrame, few: DataFrame) -> DataFrame:
    """The values of a few cells in the order of rows."""
    values = o.join(few, ["x", "y", "t"], "left_semi").where("z is not null").groupBy("x", "y", "t").agg(F.sort_array(F.collect_list(F.struct("row_id", "z"))).alias("_z"))
    return values.withColumn("_z", F.transform("_z", lambda v: v["z"]))


def soft(spark: SparkSession, d: str) -> DataFrame:
    """Cells of several values and some variance.

    Values in hundredths make variances of exactly the limit, on either side of which their sum falls by the order of
    adding.  So the few cells at the limit take the variance of their values one after another, as SQL adds them.
    """
    o = obs(spark, d)
    g = o.groupBy("x", "y", "t").agg(F.avg("z").alias("mean"), F.var_pop("z").alias("var"), F.min("z").alias("low"), F.max("z").alias("up"), F.count("*").alias("n"))
    g = g.where((F.col("n") >= 2) & (F.col("var") > LEAST_VARIANCE - BORDER))
    border = g.where(F.col("var") <= LEAST_VARIANCE + BORDER).select("x", "y", "t")
    own = in_order(o, border).select("x", "y", "t", grid.running_variance(F.col("_z")).alias("_own"))
    return g.join(own, ["x", "y", "t"], "left").where(F.coalesce("_own", "var") > LEAST_VARIANCE).drop("n", "_own")


def polygons(spark: SparkSession, d: str) -> DataFrame:
    s = soft(spark, d)
    return s.withColumns({"limi": softdata.gaussian_limits(F.col("mean"), F.col("var")), "probdens": softdata.gaussian_density(F.col("mean"), F.col("var"))})


def keyed(c: DataFrame, name: str = "h_id") -> DataFrame:
    """Cells with a key made of their place."""
    return c.withColumn(name, (F.col("t") * 100_000_000 + F.col("y") * 15 + F.col("x")).cast("long"))


KEY = "CAST(t * 100000000 + y * 15 + x AS BIGINT)"


# Grid form


@query(CELLS + " SELECT row_number() OVER (ORDER BY x, y) AS si, x, y FROM (SELECT DISTINCT x, y FROM obs)")
def R1_sites(spark, d):
    return grid.sites(obs(spark, d))


@query(CELLS + " SELECT row_number() OVER (ORDER BY t) AS ti, t FROM (SELECT DISTINCT t FROM obs)")
def R1_times(spark, d):
    return grid.times(obs(spark, d))


@query(CELLS + " SELECT * FROM cells")
def R2_grid_last_wins(spark, d):
    return cells(spark, d)


@query(OBS + " SELECT x, y, t, arg_max(z, row_id) AS z, arg_max(2 * z, row_id) AS twice FROM obs GROUP BY x, y, t")
def R3_grid_many(spark, d):
    return grid.grid_last(obs(spark, d).withColumn("twice", 2 * F.col("z")), ("z", "twice"))


@query(OBS + " SELECT x, y, t, round(avg(z), 6) AS z FROM obs GROUP BY x, y, t")
def R4_grid_mean(spark, d):
    return rounded(grid.grid_mean(obs(spark, d)), 6)


@query(CELLS + " SELECT x, y, t, z FROM cells WHERE z IS NOT NULL")
def R5_grid_to_vector(spark, d):
    return grid.to_vector(cells(spark, d)).select("x", "y", "t", "z")


@query(CELLS + ", s AS (SELECT DISTINCT x, y FROM cells), q AS (SELECT DISTINCT t FROM cells) SELECT row_number() OVER (PARTITION BY t ORDER BY x, y) AS si, x, y, t, z FROM s CROSS JOIN q LEFT JOIN cells USING (x, y, t)")
def R6_grid_to_vector_full(spark, d):
    return grid.to_vector(cells(spark, d), keep_missing=True).select("si", "x", "y", "t", "z")


@query(CELLS + " SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY x, y, t) = 1 THEN cells.z END AS found FROM obs LEFT JOIN cells USING (x, y, t)")
def R7_grid_lookup_unique(spark, d):
    return grid.lookup_unique(obs(spark, d), cells(spark, d)).select("row_id", "found")


@query(RESID + " SELECT x, y, t, round(r, 4) AS residual FROM resid")
def R8_residual(spark, d):
    return rounded(resid(spark, d).select("x", "y", "t", "residual"))


@query(POLYGON + " SELECT x, y, t, i, round(l - 10.5, 7) AS limi FROM poly")
def R9_soft_residual(spark, d):
    s = polygons(spark, d).select("x", "y", "t", F.posexplode(softdata.offset(F.col("limi"), F.lit(10.5))).alias("i", "limi"))
    return rounded(s, 7)


@query(SOFT + " SELECT x, y, t, round(low - 10.5, 6) AS start, round((up - low) / 8, 6) AS step, round(up - 10.5, 6) AS stop, 9 AS nl, round((low + up) / 2 - 10.5, 6) AS middle FROM soft")
def R15_soft_offset_even(spark, d):
    """Densities on even limits: start, step, end; all limits of the shifted ones."""
    limi = softdata.offset(F.array("low", (F.col("up") - F.col("low")) / 8, "up"), F.lit(10.5), 3)
    s = soft(spark, d).select("x", "y", "t", limi.alias("limi")).withColumn("all", softdata.even_limits(F.col("limi")))
    return rounded(s.select("x", "y", "t", *(F.get("limi", F.lit(i)).alias(n) for i, n in enumerate(("start", "step", "stop"))), F.size("all").alias("nl"), F.get("all", F.lit(4)).alias("middle")), 6)


@query(SOFT + " SELECT 1 AS part, x, y, t, 2 AS pdf_type, 13 AS nl, round(mean - 3.719 * sqrt(var), 6) AS low, round(mean + 3.719 * sqrt(var), 6) AS up FROM soft UNION ALL SELECT 2, x, y, t, 2, 5, round(low, 6), round(up, 6) FROM soft")
def R14_soft_stack(spark, d):
    """Gaussian and uniform densities of 13 and 5 limits in one set."""
    s = soft(spark, d)
    cell = ["x", "y", "t"]
    m, v, low, up = (F.col(c) for c in ("mean", "var", "low", "up"))
    a = s.select(*cell, softdata.gaussian_limits(m, v).alias("limi"), softdata.gaussian_density(m, v).alias("probdens"))
    b = s.select(*cell, softdata.uniform_limits(low, up).alias("limi"), softdata.uniform_density(low, up).alias("probdens"))
    both = grid.stack_soft(a, b, 2, 2)
    return rounded(both.select("part", *cell, "pdf_type", "nl", F.element_at("limi", 1).alias("low"), F.element_at("limi", -1).alias("up")), 6)


@query(POLYGON + " SELECT x, y, t, 10 AS was, count(*) AS nl, round(min(l), 6) AS low, round(max(l), 6) AS up, round(max(p), 6) AS peak FROM poly GROUP BY x, y, t UNION ALL SELECT x, y, t, 2, 2, round(low, 6), round(up, 6), round(1 / (up - low), 6) FROM soft")
def P10_as_linear(spark, d):
    """Gaussian data and uniform data of two limits as records of linear densities."""
    s = soft(spark, d).withColumns({"was": F.explode(F.array(F.lit(10), F.lit(2))), "limi": F.array("low", "up"), "p": F.array(F.lit(7.0), F.lit(7.0))})
    s = s.withColumn("pdf", softdata.as_linear(F.col("was"), F.col("limi"), F.col("p"), F.col("mean"), F.col("var")))
    limi = F.col("pdf.limi")
    return rounded(s.select("x", "y", "t", "was", F.col("pdf.nl").cast("long").alias("nl"), F.element_at(limi, 1).alias("low"), F.element_at(limi, -1).alias("up"), F.array_max("pdf.probdens").alias("peak")), 6)


@query(OBS + " SELECT row_id, x, y, t, z FROM obs WHERE x BETWEEN 2 AND 9 AND y BETWEEN 1 AND 6 AND t BETWEEN 3 AND 20")
def R10_bbox(spark, d):
    return grid.bounding_box(obs(spark, d), (2, 9), (1, 6), (3, 20))


@query(SOFT + ", cells AS (SELECT x, y, t, arg_max(z, row_id) AS z FROM obs GROUP BY x, y, t) SELECT x, y, t, round(z, 6) AS z, 'hard' AS kind FROM cells UNION ALL SELECT x, y, t, round(mean, 6), 'soft' FROM soft")
def R11_stack(spark, d):
    return rounded(grid.stack(cells(spark, d), soft(spark, d).select("x", "y", "t", F.col("mean").alias("z"))), 6)


@query(OBS + " SELECT a.row_id AS a_id, b.row_id AS b_id FROM obs a JOIN obs b USING (x, y, t)")
def R12_identical_pairs(spark, d):
    o = obs(spark, d)
    return grid.identical_pairs(o, o)


@query(OBS + " SELECT row_id, z, row_id % 7 = 0 AS chosen FROM obs")
def R13_split(spark, d):
    o = obs(spark, d).select("row_id", "z")
    a, b = grid.split_rows(o, o.where("row_id % 7 = 0").select("row_id"))
    return a.withColumn("chosen", F.lit(True)).union(b.withColumn("chosen", F.lit(False)))


@query("SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE round(o_totalprice * power(10.0, 3 - floor(log10(abs(o_totalprice))))) / power(10.0, 3 - floor(log10(abs(o_totalprice)))) END, 4) AS v FROM orders")
def R17_significant_digits(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", r(grid.significant_digits(F.col("o_totalprice"), 4), "v"))


@query(CELLS + " SELECT x, y, count(z) AS n, round(avg(z), 6) AS mean, round(var_pop(z), 5) AS variance FROM cells GROUP BY x, y")
def R18_site_summary(spark, d):
    return grid.site_summary(cells(spark, d)).select("x", "y", "n", r("mean", "mean", 6), r("variance", "variance", 5))


@query(CELLS + " SELECT count(DISTINCT (x, y)) AS n_sites, count(DISTINCT t) AS n_times, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(t) AS t_min, max(t) AS t_max, min(z) AS z_min, max(z) AS z_max FROM cells")
def R18_extent(spark, d):
    return grid.extent(cells(spark, d))


@query(CELLS + ", s AS (SELECT x, y, avg(z) AS mean, var_pop(z) AS v FROM cells GROUP BY x, y) SELECT x, y, round(mean - 1.96 * sqrt(v), 4) AS lower, round(mean + 1.96 * sqrt(v), 4) AS upper FROM s")
def R19_envelope(spark, d):
    return rounded(grid.envelope(grid.site_summary(cells(spark, d))).select("x", "y", "lower", "upper"))


# Sources and sinks


@query(CELLS + ", e AS (SELECT min(x) AS x0, max(x) - min(x) AS lx, min(y) AS y0, max(y) - min(y) AS ly, min(t) AS t0, max(t) - min(t) AS lt FROM cells) SELECT range AS k_id, round(x0 + range % 7 * (lx / 6), 6) AS x, round(y0 + range // 7 % 6 * (ly / 5), 6) AS y, round(t0 + range // 42 * (lt / 9), 6) AS t FROM range(420), e")
def S10_grid_generator(spark, d):
    """A grid over the extent of all cells."""
    e = grid.extent(cells(spark, d)).first()
    return rounded(observations.generate_grid(spark, (e.x_min, e.x_max, 7), (e.y_min, e.y_max, 6), (e.t_min, e.t_max, 10)), 6)


@query(SOFT + ", b AS (SELECT x, y, t, z FROM obs UNION ALL SELECT x, y, t, mean FROM soft) SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(t) AS t_min, max(t) AS t_max FROM b")
def S11_bounds(spark, d):
    both = grid.extent(obs(spark, d), soft(spark, d).select("x", "y", "t", F.col("mean").alias("z")))
    return both.select(*(f"{c}_{n}" for c in "xyt" for n in ("min", "max")))


@query(CELLS + ", s AS (SELECT DISTINCT x, y FROM cells) SELECT x, y, CAST(1.0 + 0.75 * i.range AS DOUBLE) AS t FROM s, range(5) i")
def S9_sites_by_times(spark, d):
    return observations.sites_by_times(cells(spark, d).select("x", "y").distinct(), (1, 4, 5))


@query(CELLS + ", s AS (SELECT DISTINCT x, y FROM cells) SELECT s.x, s.y, coalesce(z, -9999.0) AS mean FROM s LEFT JOIN cells ON cells.x = s.x AND cells.y = s.y AND cells.t = 4")
def S13_layer(spark, d):
    full = grid.to_vector(cells(spark, d), keep_missing=True).withColumnRenamed("z", "mean")
    return observations.layer_at(full, 4.0)


@query(SITES + " SELECT x, y, round(CASE WHEN x + y < 12.5 AND x > 1.5 AND y > 0.5 THEN z ELSE -9999.0 END, 6) AS mean FROM sites")
def S15_polygon_mask(spark, d):
    triangle = [(1.5, 0.5), (12.0, 0.5), (1.5, 11.0)]
    return rounded(observations.mask(site_means(spark, d).withColumnRenamed("z", "mean"), triangle), 6)


@query(SITES + " SELECT x, y, CASE WHEN z < 60 THEN 0 ELSE least(1 + CAST(floor((z - 60.0) / 30.0 * 63) AS BIGINT), 63) END AS class FROM sites")
def S19_colour_class(spark, d):
    """Site means below, in and above the range of the classes; those on a border are exact, for any sum would put them on either side."""
    means = cells(spark, d).groupBy("x", "y").agg(grid.exact_mean("z").alias("z"))
    return means.select("x", "y", observations.colour_class(F.col("z"), 60.0, 90.0).alias("class"))


@query(
    CELLS
    + """, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny FROM cells),
px AS (SELECT CAST(range // 64 AS INT) AS row, CAST(range % 64 AS INT) AS col, (nx - 1) * (range % 64) / 63 AS u, (ny - 1) * (1 - (range // 64) / 63) AS v, nx, ny FROM range(4096), box),
ij AS (SELECT *, greatest(0, least(CAST(floor(u) AS BIGINT), nx - 2)) AS i0, greatest(0, least(CAST(floor(v) AS BIGINT), ny - 2)) AS j0 FROM px),
c AS (SELECT row, col, i0 + a AS i, j0 + b AS j, (1 - abs(u - i0 - a)) * (1 - abs(v - j0 - b)) AS w FROM ij, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)),
lat AS (SELECT t, z, coalesce(round((x - x0) / nullif(x1 - x0, 0) * (nx - 1)), 0) AS i, coalesce(round((y - y0) / nullif(y1 - y0, 0) * (ny - 1)), 0) AS j FROM cells, box)
SELECT t, row, col, CASE WHEN sum(w) > 1 - 1e-9 THEN round(sum(w * z), 4) ELSE CAST(-9999 AS DOUBLE) END AS value FROM c JOIN lat USING (i, j) WHERE w > 0 GROUP BY t, row, col"""
)
def I9_raster(spark, d):
    """Every day's values, as rasters of 64 x 64 pixels."""
    lattice = cells(spark, d).withColumnRenamed("z", "mean")
    return rounded(observations.resample(lattice, 64, 64))


# Soft data


@query(POLYGON + " SELECT x, y, t, i, round(l, 7) AS limi, round(p, 6) AS probdens FROM poly")
def P1_gaussian_pdf(spark, d):
    s = polygons(spark, d).select("x", "y", "t", F.posexplode(F.arrays_zip("limi", "probdens")).alias("i", "p"))
    return s.select("x", "y", "t", "i", r("p.limi", "limi", 7), r("p.probdens", "probdens", 6))


@query(SOFT + " SELECT x, y, t, i.range AS i, round(low + (up - low) * i.range / 4.0, 4) AS limi, round(1 / (up - low), 6) AS probdens FROM soft, range(5) i")
def P2_uniform_pdf(spark, d):
    s = soft(spark, d).withColumns({"l": softdata.uniform_limits(F.col("low"), F.col("up")), "p": softdata.uniform_density(F.col("low"), F.col("up"))})
    s = s.select("x", "y", "t", F.posexplode(F.arrays_zip("l", "p")).alias("i", "v"))
    return s.select("x", "y", "t", F.col("i").cast("long").alias("i"), r("v.l", "limi"), r("v.p", "probdens", 6))


@query(POLYGON + " SELECT x, y, t, round(a, 6) AS area FROM area")
def P3_area(spark, d):
    raw = F.transform(F.array(*map(F.lit, softdata.GAUSS_NODES)), lambda k: F.exp(-k * k / 2) / F.sqrt(F.lit(6.283185307179586) * F.col("var")))
    return soft(spark, d).select("x", "y", "t", r(softdata.area(softdata.gaussian_limits(F.col("mean"), F.col("var")), raw), "area", 6))


MOMENT = "slope * (power(l1, {a}) - power(l, {a})) / {a} + level * (power(l1, {b}) - power(l, {b})) / {b}"


@query(POLYGON + ", lin AS (SELECT x, y, t, l, l1, (p1 - p) / (l1 - l) AS slope, p - (p1 - p) / (l1 - l) * l AS level FROM poly WHERE l1 IS NOT NULL), m AS (SELECT x, y, t, sum(" + MOMENT.format(a=3, b=2) + ") AS m1, sum(" + MOMENT.format(a=4, b=3) + ") AS m2 FROM lin GROUP BY x, y, t) SELECT x, y, t, round(m1, 5) AS mean, round(m2 - m1 * m1, 2) AS variance FROM m")
def P4_moments(spark, d):
    s = polygons(spark, d)
    return s.select("x", "y", "t", r(softdata.mean(F.col("limi"), F.col("probdens")), "mean", 5), r(softdata.variance(F.col("limi"), F.col("probdens")), "variance", 2))


CDF = POLYGON + ", c AS (SELECT *, coalesce(sum((p + p1) * (l1 - l) / 2) OVER (PARTITION BY x, y, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM poly)"


@query(CDF + ", e AS (SELECT *, lead(c) OVER (PARTITION BY x, y, t ORDER BY i) AS c1 FROM c), q(q) AS (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) SELECT x, y, t, CAST(q AS DOUBLE) AS q, round(l + (CAST(q AS DOUBLE) - c) / (c1 - c) * (l1 - l), 6) AS v FROM e, q WHERE c <= q AND q < c1")
def P5_quantiles(spark, d):
    s = polygons(spark, d).withColumn("v", softdata.quantiles(F.col("limi"), F.col("probdens")))
    at = F.array(*map(F.lit, softdata.QUANTILES)).alias("q")
    s = s.select("x", "y", "t", F.explode(F.arrays_zip(at, "v")).alias("p"))
    return s.select("x", "y", "t", F.col("p.q").alias("q"), r("p.v", "v", 6))


@query(CDF + " SELECT x, y, t, i, round(c, 6) AS cdf FROM c")
def P6_cdf(spark, d):
    return rounded(polygons(spark, d).select("x", "y", "t", F.posexplode(softdata.cdf(F.col("limi"), F.col("probdens"))).alias("i", "cdf")), 6)


@query(SOFT + " SELECT x, y, t, round(low + 0.3 * (up - low), 4) AS v FROM soft")
def P7_inverse_cdf_flat(spark, d):
    low, up = F.col("low"), F.col("up")
    return soft(spark, d).select("x", "y", "t", r(softdata.inverse_cdf(softdata.uniform_limits(low, up), softdata.uniform_density(low, up), 0.3), "v"))


@query(CDF + ", e AS (SELECT *, lead(c) OVER (PARTITION BY x, y, t ORDER BY i) AS c1, (p1 - p) / (l1 - l) AS s FROM c), q(q) AS (VALUES (0.02), (0.3), (0.9)) SELECT x, y, t, CAST(q AS DOUBLE) AS q, round(l + (sqrt(greatest(p * p + 2 * s * (CAST(q AS DOUBLE) - c), 0)) - p) / s, 3) AS v FROM e, q WHERE c <= q AND q < c1")
def P7_inverse_cdf(spark, d):
    """The root of the quadratic in sloping segments: lower tail, rising and falling part."""
    s = polygons(spark, d)
    at = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), softdata.inverse_cdf(F.col("limi"), F.col("probdens"), q).alias("v")) for q in (0.02, 0.3, 0.9))))
    return s.select("x", "y", "t", at.alias("p")).select("x", "y", "t", F.col("p.q").alias("q"), r("p.v", "v", 3))


@query(POLYGON + ", v AS (SELECT x, y, t, mean + sqrt(var) * (x - 7) AS v FROM soft) SELECT v.x, v.y, v.t, round(coalesce(p + (p1 - p) * (v - l) / (l1 - l), 0), 5) AS density FROM v LEFT JOIN poly ON poly.x = v.x AND poly.y = v.y AND poly.t = v.t AND l <= v AND v < l1")
def P8_density(spark, d):
    """Within the limits and, where the shift is large, outside them."""
    s = polygons(spark, d).withColumn("v", F.col("mean") + F.sqrt("var") * (F.col("x") - 7))
    return s.select("x", "y", "t", r(softdata.density_at(F.col("limi"), F.col("probdens"), F.col("v")), "density", 5))


@query(SOFT + ", v AS (SELECT *, low + (up - low) * (x - 2) / 10 AS v FROM soft) SELECT x, y, t, round(CASE WHEN v < low OR v > up THEN 0 WHEN v < mean THEN 0.4 / (mean - low) ELSE 0.6 / (up - mean) END, 5) AS density FROM v")
def P8_density_histogram(spark, d):
    """Type 1 densities, constant between the limits.

    Where the value falls on the mean, rounding says which side it is on; those cells add their values one after another.
    """
    low, up, mean = F.col("low"), F.col("up"), F.col("mean")
    s = soft(spark, d).withColumn("v", low + (up - low) * (F.col("x") - 2) / 10)
    at_mean = s.where(F.abs(F.col("v") - mean) <= 1e-9 * F.greatest(F.abs(low), F.abs(up))).select("x", "y", "t")
    own = in_order(obs(spark, d), at_mean).select("x", "y", "t", (F.aggregate("_z", F.lit(0.0), lambda a, z: a + z) / F.size("_z")).alias("_own"))
    s = s.join(own, ["x", "y", "t"], "left").withColumn("mean", F.coalesce("_own", mean))
    return s.select("x", "y", "t", r(softdata.density_at(F.array(low, mean, up), F.array(0.4 / (mean - low), 0.6 / (up - mean)), F.col("v"), kind=1), "density", 5))


@query(SOFT + ", m AS (SELECT x, y, t, 0.41373129 * (low + mean) / 2 + 0.58626871 * (mean + up) / 2 AS m1, 0.41373129 * (low * low + low * mean + mean * mean) / 3 + 0.58626871 * (mean * mean + mean * up + up * up) / 3 AS m2 FROM soft) SELECT x, y, t, round(m1, 5) AS mean, round(m2 - m1 * m1, 2) AS variance FROM m")
def P4_moments_histogram(spark, d):
    """Moments of type 1 densities."""
    low, up, mid = F.col("low"), F.col("up"), F.col("mid")  # a result's name would hide a column of that name
    limi, p = F.array(low, mid, up), F.array(0.41373129 / (mid - low), 0.58626871 / (up - mid))
    return soft(spark, d).withColumnRenamed("mean", "mid").select("x", "y", "t", r(softdata.mean(limi, p, 1), "mean", 5), r(softdata.variance(limi, p, 1), "variance", 2))


@query(SOFT + " SELECT x, y, t, low AS l0, up AS l1, round(1 / (up - low), 6) AS p FROM soft")
def P9_uniform_two_nodes(spark, d):
    limi, p = softdata.uniform_two_nodes(F.col("low"), F.col("up"))
    return soft(spark, d).select("x", "y", "t", limi[0].alias("l0"), limi[1].alias("l1"), r(p[0], "p", 6))


# Neighbours


@query(SITES + " SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS d FROM sites a, sites b")
def N1_distance(spark, d):
    s = site_means(spark, d).select("x", "y")
    d6 = (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("d")  # all pairs are many: as SQL rounds, without decimals
    return neighbours.lattice_distances(s, s).select("ax", "ay", "bx", F.col("by").alias("by_"), d6)


@query(SITES + ", n AS (SELECT row_number() OVER (ORDER BY x, y) AS si, x, y FROM sites) SELECT a.si AS a_si, b.si AS b_si, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS ds, round(atan2(b.y - a.y, b.x - a.x), 6) AS azimuth FROM n a, n b WHERE a.si <= b.si AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.3")
def N4_pairs_radius(spark, d):
    return rounded(neighbours.pairs_within(grid.sites(cells(spark, d)), 3.3, azimuth=True), 6)


KNN = CELLS + f", h AS (SELECT {KEY} AS h_id, x, y, t, z FROM cells), k AS (SELECT h_id AS k_id, x, y, t FROM h)"


def knn_sides(spark, d):
    """Every cell as a point and as a datum."""
    h = keyed(cells(spark, d))
    return h.select(F.col("h_id").alias("k_id"), "x", "y", "t"), h


SPHERE_SQL = "SELECT k_id, h_id, h.z AS z, sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y) + (k.t - h.t) * (k.t - h.t) * (1.3 * 1.3)) AS d FROM k JOIN h ON abs(k.x - h.x) < 4.6 AND abs(k.y - h.y) < 4.6 AND abs(k.t - h.t) < 3.6 WHERE sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y) + (k.t - h.t) * (k.t - h.t) * (1.3 * 1.3)) < sqrt(3.2 * 3.2 + 2.5 * 1.3 * 2.5 * 1.3)"


@query(KNN + f", n AS ({SPHERE_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM n) SELECT k_id, h_id, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM o WHERE rank <= 8")
def N8_knn(spark, d):
    points, data = knn_sides(spark, d)
    return rounded(neighbours.nearest(points, data, 8, 3.2, 2.5, 1.3), 6)


@query(KNN + ", n AS (SELECT k_id, h_id, sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y)) AS ds, abs(k.t - h.t) AS dt FROM k JOIN h ON abs(k.x - h.x) <= 3.2 AND abs(k.t - h.t) <= 1.5), o AS (SELECT *, ds + 1.3 * dt AS d, row_number() OVER (PARTITION BY k_id ORDER BY round(ds + 1.3 * dt, 9), h_id) AS rank FROM n WHERE ds <= 3.2 AND dt <= 1.5) SELECT k_id, h_id, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM o WHERE rank <= 8")
def N9_knn_prism(spark, d):
    points, data = knn_sides(spark, d)
    return rounded(neighbours.nearest_prism(points, data, 8, 3.2, 1.5, 1.3), 6)


@query(KNN + ", n AS (SELECT k_id, h_id, " + MODEL_SQL.format(ds="sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y))", dt="abs(k.t - h.t)") + " AS c FROM k, h WHERE abs(k.x - h.x) <= 3 AND abs(k.y - h.y) <= 3 AND abs(k.t - h.t) <= 1), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(c, 6) DESC, h_id) AS rank FROM n) SELECT k_id, h_id, round(c, 4) AS cov, CAST(rank AS INT) AS rank FROM o WHERE rank <= 6")
def N12_covariance_ranked(spark, d):
    points, data = knn_sides(spark, d)
    return rounded(neighbours.nearest_by_covariance(points, data, lambda ds, dt: F.round(models.covariance(MODEL, ds, dt), 6), 6, 3.0, 1.0))


@query(KNN + f", n AS ({SPHERE_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM n), g AS (SELECT k_id, string_agg(CAST(h_id AS VARCHAR), ',' ORDER BY h_id) AS ids FROM o WHERE rank <= 8 GROUP BY k_id) SELECT ids, count(*) AS n FROM g GROUP BY ids")
def N8_groups(spark, d):
    points, data = knn_sides(spark, d)
    g = neighbours.groups(neighbours.nearest(points, data, 8, 3.2, 2.5, 1.3))
    return g.select(F.array_join("h_ids", ",").alias("ids"), F.size("k_ids").cast("long").alias("n"))


@query(KNN + " SELECT k_id, h_id FROM k JOIN h USING (x, y, t)")
def N14_duplicates(spark, d):
    points, data = knn_sides(spark, d)
    return neighbours.duplicates(points, data)


GRID7 = "g AS (SELECT range AS k_id, 2.25 * (range % 7) AS x, 1.25 * ((range // 7) % 6) AS y, 0.6 + 3.3 * (range // 42) AS t FROM range(168))"


def grid7(spark):
    return observations.generate_grid(spark, (0, 13.5, 7), (0, 6.25, 6), (0.6, 10.5, 4))


@query(SITES + ", " + GRID7 + ", n AS (SELECT CAST(y * 15 + x AS BIGINT) AS id, x, y FROM sites) SELECT a.id AS a_id, b.k_id AS b_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS ds, round(atan2(b.y - a.y, b.x - a.x), 6) AS azimuth FROM n a, g b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.2")
def N6_pairs_between(spark, d):
    """All sites against all points of a grid."""
    s = site_means(spark, d).select((F.col("y") * 15 + F.col("x")).cast("long").alias("id"), "x", "y")
    return rounded(neighbours.pairs_between(s, grid7(spark).select(F.col("k_id").alias("id"), "x", "y"), 2.2), 6)


@query(CELLS + " SELECT x, y, a.t AS a_t, b.t AS b_t, round(a.z * b.z, 4) AS product FROM cells a JOIN cells b USING (x, y) WHERE a.t <= b.t")
def N7_pair_products(spark, d):
    """Products of the values of all pairs of days of a site, each with itself too."""
    return rounded(neighbours.pair_products(cells(spark, d), ["x", "y"], "t", "z"))


# Trends


@query(CELLS + " SELECT x, y, t, round(avg(z) OVER (PARTITION BY x, y) + avg(z) OVER (PARTITION BY t) - avg(z) OVER (), 4) AS tr FROM cells")
def T2_stmean(spark, d):
    return rounded(trend.stmean(cells(spark, d)).select("x", "y", "t", "tr"))


@query(CELLS + ", ms AS (SELECT x, y, avg(z) AS m FROM cells GROUP BY x, y), mt AS (SELECT t, avg(z) AS m, lead(t) OVER (ORDER BY t) AS t1, lead(avg(z)) OVER (ORDER BY t) AS m1 FROM cells GROUP BY t), " + GRID7 + ", w AS (SELECT k_id, sum(ms.m / power(sqrt((g.x - ms.x) ** 2 + (g.y - ms.y) ** 2) + 1e-10, 2)) / sum(1 / power(sqrt((g.x - ms.x) ** 2 + (g.y - ms.y) ** 2) + 1e-10, 2)) AS s FROM g, ms GROUP BY k_id) SELECT k_id, round(s + mt.m + (g.t - mt.t) / (mt.t1 - mt.t) * (mt.m1 - mt.m) - (SELECT avg(z) FROM cells), 4) AS tr FROM g JOIN w USING (k_id) JOIN mt ON g.t >= mt.t AND g.t < mt.t1")
def T3_stmean_est(spark, d):
    return rounded(trend.stmean_at(cells(spark, d), grid7(spark)).select("k_id", "tr"))


@query(CELLS + ", mt AS (SELECT t, avg(z) AS m, lead(t) OVER (ORDER BY t) AS t1, lead(avg(z)) OVER (ORDER BY t) AS m1 FROM cells GROUP BY t), " + GRID7 + " SELECT DISTINCT CAST(round(g.t, 6) AS DOUBLE) AS t, round(CASE WHEN (g.t - mt.t) / (mt.t1 - mt.t) <= 0.5 THEN mt.m ELSE mt.m1 END, 4) AS mt FROM g JOIN mt ON g.t >= mt.t AND g.t < mt.t1")
def T6_times_nearest(spark, d):
    """Means of the days nearest to times between them."""
    found = trend.interpolate_times(trend.st_means(cells(spark, d))[1], grid7(spark), method="nearest")
    return found.select(r("t", "t", 6), r("mt", "mt"))


@query(SITES + " SELECT a.x, a.y, round(sum(power(1 - power(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4.0, 3), 3) * b.z) / sum(power(1 - power(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4.0, 3), 3)), 4) AS mss FROM sites a, sites b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.3 GROUP BY a.x, a.y")
def T4_stmean_smoothed(spark, d):
    return rounded(trend.stmean_smoothed(cells(spark, d), 3.3, 4.0, 4.0, 5.0)[0].select("x", "y", "mss"))


@query(CELLS + ", m AS (SELECT t, avg(z) AS m FROM cells GROUP BY t) SELECT a.t, round(any_value(a.m), 4) AS mt, round(sum(power(1 - power(abs(a.t - b.t) / 5.0, 3), 3) * b.m) / sum(power(1 - power(abs(a.t - b.t) / 5.0, 3), 3)), 4) AS mts FROM m a, m b WHERE abs(a.t - b.t) <= 4 GROUP BY a.t")
def T4_time_means_smoothed(spark, d):
    return rounded(trend.stmean_smoothed(cells(spark, d), 3.3, 4.0, 4.0, 5.0)[1])


@query(SITES + " SELECT a.x, a.y, round(sum(power(1 - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 16.0, 2) * b.z) / sum(power(1 - ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 16.0, 2)), 4) AS mss FROM sites a, sites b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3.3 GROUP BY a.x, a.y")
def T4_site_means_bicube(spark, d):
    return rounded(trend.stmean_smoothed(cells(spark, d), 3.3, 4.0, 4.0, 5.0, "bicube")[0].select("x", "y", "mss"))


KERNEL_SQL = "exp(-3 * (((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 4.0 + (a.t - b.t) ** 2 / 4.0))"


@query(CELLS + f" SELECT a.x, a.y, a.t, round(sum({KERNEL_SQL} * b.z) / sum({KERNEL_SQL}), 4) AS tr FROM cells a, cells b GROUP BY a.x, a.y, a.t")
def T8_kernel(spark, d):
    c = cells(spark, d)
    return rounded(trend.kernel_cut(c, c.select("x", "y", "t"), 2.0, 2.0))


@query(CELLS + ", " + GRID7 + f", q AS (SELECT k_id, sum({KERNEL_SQL} * b.z) / sum({KERNEL_SQL}) AS tr FROM g a, cells b GROUP BY k_id) SELECT k_id, round(tr, 4) AS tr FROM q")
def T9_kernel_est(spark, d):
    return rounded(trend.kernel_at(cells(spark, d), grid7(spark), 2.0, 2.0).select("k_id", "tr"))


@query(CELLS + " SELECT a.x, a.y, a.t, round(sum((1 - (((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 9.0 + (a.t - b.t) ** 2 / 16.0)) * b.z) / sum(1 - (((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 9.0 + (a.t - b.t) ** 2 / 16.0)), 2) AS tr FROM cells a, cells b WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3 AND abs(a.t - b.t) <= 4 GROUP BY a.x, a.y, a.t")
def T10_kernel_truncated(spark, d):
    c = cells(spark, d)
    return rounded(trend.kernel_truncated(c, c.select("x", "y", "t"), 3.0, 4.0, "quadratic"), 2)


@query()
def T11_stl(spark, d):
    """Weekly season and trend of the daily means of each lattice row."""
    s = cells(spark, d).groupBy(F.col("y").cast("long").alias("id"), "t").agg(F.avg("z").alias("z"))
    return trend.stl(s, period=7)


@query(CELLS + ", f AS (SELECT regr_slope(z, t) AS b, regr_intercept(z, t) AS a FROM cells) SELECT x, y, cells.t, round(a + b * cells.t, 2) AS fit FROM cells, f")
def T15_additive_linear(spark, d):
    c = cells(spark, d)
    return rounded(trend.additive_fit(c, "z", linear=["t"], ridge=0.0)[1](c).select("x", "y", "t", "fit"), 2)


@query(CELLS + " SELECT x, y, t, round(avg(z) OVER (PARTITION BY CAST(t AS INT) % 7), 3) AS fit FROM cells")
def T15_additive_factor(spark, d):
    """One factor without penalty: the fit is the mean of its level."""
    c = cells(spark, d).withColumn("day", F.col("t").cast("int") % 7)
    return rounded(trend.additive_fit(c, "z", factors={"day": list(range(7))}, ridge=0.0)[1](c).select("x", "y", "t", "fit"), 3)


@query(
    CELLS
    + ", e AS (SELECT min(t) AS t0, max(t) - min(t) AS lt FROM cells), b AS (SELECT x, y, t, z, (t - t0) / lt AS u, greatest((t - t0) / lt - (14.5 - t0) / lt, 0) AS h FROM cells, e),"
    " g AS (SELECT count(*)::DOUBLE AS n, sum(u) AS su, sum(h) AS sh, sum(u * u) AS uu, sum(u * h) AS uh, sum(h * h) + 20 AS hh, sum(z) AS sz, sum(u * z) AS uz, sum(h * z) AS hz FROM b),"
    " d AS (SELECT *, n * (uu * hh - uh * uh) - su * (su * hh - uh * sh) + sh * (su * uh - uu * sh) AS det FROM g),"
    " c AS (SELECT (sz * (uu * hh - uh * uh) - su * (uz * hh - uh * hz) + sh * (uz * uh - uu * hz)) / det AS b0, (n * (uz * hh - uh * hz) - sz * (su * hh - uh * sh) + sh * (su * hz - uz * sh)) / det AS b1, (n * (uu * hz - uz * uh) - su * (su * hz - uz * sh) + sz * (su * uh - uu * sh)) / det AS b2 FROM d)"
    " SELECT x, y, t, round(b0 + b1 * u + b2 * h, 3) AS fit FROM b, c"
)
def T15_additive_spline(spark, d):
    """A spline of degree 1 over time with one bend, penalised with a weight of 20."""
    c = cells(spark, d)
    fit_of = trend.additive_penalised(c, "z", {"t": [14.5]}, weights={"t": 20.0}, degree=1)[1]
    return rounded(fit_of(c).select("x", "y", "t", "fit"), 3)


_BASIS_SQL = ("{v}", "{v} * {v}", "{v} * {v} * {v}", "power(greatest({v} - 0.5, 0), 3)")
_CROSS_SQL = ", ".join("round(" + " + ".join(f"{f.format(v=f'l{k}')} * {float((k / 2) ** j)}" for k in range(3)) + f", 5) AS cb_{i}_{j}" for j in range(3) for i, f in enumerate(_BASIS_SQL))


@query(CELLS + f", s AS (SELECT CAST(y * 15 + x AS BIGINT) AS id, t, z / 97.0 AS z FROM cells), l AS (SELECT id, t, z AS l0, lag(z, 1) OVER w AS l1, lag(z, 2) OVER w AS l2 FROM s WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, t, {_CROSS_SQL} FROM l WHERE l2 IS NOT NULL")
def T16_cross_basis(spark, d):
    """All twelve columns, four splines of the value by three powers of the lag; in units that leave no ties to round."""
    s = cells(spark, d).select((F.col("y") * 15 + F.col("x")).cast("long").alias("id"), "t", (F.col("z") / 97.0).alias("z"))
    return rounded(trend.cross_basis(s, "z", 2, [0.5]).where("lag2 is not null").select("id", "t", *(f"cb_{i}_{j}" for j in range(3) for i in range(4))), 5)


# Covariance


PAIRS = RESID + ", own AS (SELECT *, dense_rank() OVER (ORDER BY x, y) AS si FROM resid), pair AS (SELECT a.r AS l, b.r AS r, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS ds, b.t - a.t AS dt, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, a.si AS asi, b.si AS bsi FROM own a JOIN own b ON a.si <= b.si AND a.t <= b.t AND b.t - a.t < 4.5 AND abs(a.x - b.x) <= 5.5 AND abs(a.y - b.y) <= 5.5)"
LAGS = ", ls AS (SELECT CAST(range AS DOUBLE) AS s FROM range(6)), lt AS (SELECT CAST(range AS DOUBLE) AS q FROM range(5))"
COV = "count(*) AS n, round(avg(l), 3) AS m1, round(avg(r), 3) AS m2, round(covar_pop(l, r), 3) AS cov"


def lags():
    return covariance.lag_bins(LAGS_S, 0.5), covariance.lag_bins(LAGS_T, 0.5)


def c1(spark, d):
    return covariance.empirical_covariance(resid(spark, d), *lags())


@query(PAIRS + LAGS + f" SELECT s AS lag_s, q AS lag_t, {COV} FROM pair JOIN ls ON ds >= s - 0.5 AND ds < s + 0.5 JOIN lt ON dt >= q - 0.5 AND dt < q + 0.5 GROUP BY s, q")
def C1_empirical_covariance(spark, d):
    return rounded(c1(spark, d), 3)


@query(PAIRS + LAGS + f" SELECT s AS lag_s, q AS lag_t, {COV} FROM pair JOIN ls ON ds >= s - 0.6 AND ds <= s + 0.6 JOIN lt ON dt >= q - 0.6 AND dt <= q + 0.6 WHERE s < 5 AND q < 4 GROUP BY s, q")
def C2_closed_bins(spark, d):
    a, b = covariance.lag_bins(LAGS_S[:5], 0.6), covariance.lag_bins(LAGS_T[:4], 0.6)
    return rounded(covariance.empirical_covariance(resid(spark, d), a, b, bins="closed"), 3)


@query(SQL["C2_closed_bins"])
def C3_annulus(spark, d):
    """The same sums, the pairs of each bin searched between its radii."""
    a, b = covariance.lag_bins(LAGS_S[:5], 0.6), covariance.lag_bins(LAGS_T[:4], 0.6)
    return rounded(covariance.annulus_covariance(resid(spark, d), a, b), 3)


@query(SITES + ", n AS (SELECT row_number() OVER (ORDER BY x, y) AS si, x, y FROM sites) SELECT a.si AS a_si, b.si AS b_si, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS ds FROM n a, n b WHERE a.si <= b.si AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) BETWEEN 2.5 AND 4.1")
def C3_annulus_pairs(spark, d):
    return rounded(neighbours.pairs_between_radii(grid.sites(cells(spark, d)), 2.5, 4.1), 6)


@query(RESID + LAGS + ", own AS (SELECT *, dense_rank() OVER (ORDER BY x, y) AS si FROM resid), pair AS (SELECT a.r AS l, b.r AS r, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS ds, abs(b.t - a.t) AS dt FROM own a JOIN own b ON (a.si < b.si OR (a.si = b.si AND a.t <= b.t)) AND abs(b.t - a.t) <= 2.5 AND abs(a.x - b.x) <= 3.5 AND abs(a.y - b.y) <= 3.5) SELECT s AS lag_s, q AS lag_t, 2 * count(*) AS n, round((sum(l) + sum(r)) / (2 * count(*)), 3) AS m, round(avg(l * r) - ((sum(l) + sum(r)) / (2 * count(*))) ** 2, 3) AS cov FROM pair JOIN ls ON ds >= s - 0.5 AND ds <= s + 0.5 JOIN lt ON dt >= q - 0.5 AND dt <= q + 0.5 WHERE s < 4 AND q < 3 GROUP BY s, q")
def C5_symmetric(spark, d):
    a, b = covariance.lag_bins(LAGS_S[:4], 0.5), covariance.lag_bins(LAGS_T[:3], 0.5)
    return rounded(covariance.symmetric_covariance(resid(spark, d), a, b), 3)


@query(RESID + LAGS + ", pair AS (SELECT a.r AS l, b.r AS r, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy FROM resid a JOIN resid b ON a.t = b.t AND abs(a.x - b.x) <= 2.5 AND abs(a.y - b.y) <= 2.5) SELECT u.s AS lag_dx, v.s AS lag_dy, " + COV + " FROM pair JOIN ls u ON dx > u.s - 0.5 AND dx <= u.s + 0.5 JOIN ls v ON dy > v.s - 0.5 AND dy <= v.s + 0.5 WHERE u.s < 3 AND v.s < 3 GROUP BY u.s, v.s HAVING count(*) >= 2")
def C6_block(spark, d):
    own = resid(spark, d).select("x", "y", "t", "residual")
    a, b = (own.select(*(F.col(c).alias(f"{s}_{c}") for c in ("x", "y", "t", "residual"))) for s in "ab")
    near = neighbours.within(a, b, {"x": 2.5, "y": 2.5, "t": 0})
    pairs = near.select(F.col("a_residual").alias("l"), F.col("b_residual").alias("r"), F.abs(F.col("a_x") - F.col("b_x")).alias("dx"), F.abs(F.col("a_y") - F.col("b_y")).alias("dy"))
    bins = covariance.lag_bins(LAGS_S[:3], 0.5)
    return rounded(covariance.block_covariance(pairs, {"dx": bins, "dy": bins}), 3)


@query(PAIRS + LAGS + ", az AS (SELECT 30.0 * range AS a FROM range(6)), dir AS (SELECT *, degrees(atan2(by_ - ay, bx - ax)) AS phi FROM pair), turned AS (SELECT *, (phi - a + 90) - 180 * floor((phi - a + 90) / 180) - 90 AS off FROM dir, az) SELECT CAST(a AS DOUBLE) AS azimuth_deg, s AS lag_s, q AS lag_t, " + COV + " FROM turned JOIN ls ON ds >= s - 0.5 AND ds <= s + 0.5 JOIN lt ON dt >= q - 0.5 AND dt <= q + 0.5 WHERE s < 4 AND q < 2 AND (abs(off) <= 15 + 1e-9 OR ds = 0) GROUP BY a, s, q")
def C7_directional(spark, d):
    a, b = covariance.lag_bins(LAGS_S[:4], 0.5), covariance.lag_bins(LAGS_T[:2], 0.5)
    return rounded(covariance.directional_covariance(resid(spark, d), a, b), 3)


@query(RESID + ", own AS (SELECT *, dense_rank() OVER (ORDER BY x, y) AS si FROM resid) SELECT b.x - a.x AS dx, b.y - a.y AS dy, count(*) AS n, round(sum(a.r * b.r), 1) AS s FROM own a JOIN own b ON a.t = b.t AND a.si <= b.si AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2.2 GROUP BY 1, 2")
def C8_covariance_map(spark, d):
    m = covariance.covariance_map(resid(spark, d), 2.2)
    return m.groupBy("dx", "dy").agg(F.count("*").alias("n"), F.round(F.sum("product"), 1).alias("s"))


# Models on the lags of all near pairs of sites; a site's time is its first day
FIRST = CELLS + ", n AS (SELECT row_number() OVER (ORDER BY x, y) AS si, x, y, min(t) AS t0 FROM cells GROUP BY x, y), m AS (SELECT a.si AS a_si, b.si AS b_si, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, abs(a.t0 - b.t0) AS dt, atan2(b.y - a.y, b.x - a.x) AS phi FROM n a JOIN n b ON a.si <= b.si AND abs(a.x - b.x) <= 8.3 AND abs(a.y - b.y) <= 8.3 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 8.3)"


def near_lags(spark, d):
    """(a_si, b_si, ds, dt, azimuth) of the pairs of sites at most 8.3 apart."""
    c = cells(spark, d)
    own = grid.sites(c)
    t0 = own.join(c.groupBy("x", "y").agg(F.min("t").alias("t0")), ["x", "y"]).select("si", "t0")
    p = neighbours.pairs_within(own, 8.3, azimuth=True)
    p = p.join(t0.select(F.col("si").alias("a_si"), F.col("t0").alias("_a")), "a_si").join(t0.select(F.col("si").alias("b_si"), F.col("t0").alias("_b")), "b_si")
    return p.select("a_si", "b_si", "ds", F.abs(F.col("_a") - F.col("_b")).alias("dt"), "azimuth")


def _model_query(name: str, kind: str, sql: str, shape: float | None = None):
    def run(spark, d):
        return near_lags(spark, d).select("a_si", "b_si", r("ds", "d", 5), r(2.5 * models.correlation(kind, F.col("ds"), 7.0, shape), "c", 5))

    run.__name__ = name
    query(FIRST + f" SELECT a_si, b_si, round(d, 5) AS d, round({sql}, 5) AS c FROM m")(run)


_model_query("M1_exponential", "exponential", "2.5 * exp(-3 * d / 7)")
_model_query("M2_gaussian", "gaussian", "2.5 * exp(-3 * (d / 7) * (d / 7))")
_model_query("M3_spherical", "spherical", "CASE WHEN d > 7 THEN 0.0 ELSE 2.5 * (1 - 1.5 * d / 7 + 0.5 * power(d / 7, 3)) END")
_model_query("M4_hole_cosine", "holecos", "2.5 * cos(pi() * d / 7)")
_model_query("M5_nugget", "nugget", "CAST(CASE WHEN d = 0 THEN 2.5 ELSE 0.0 END AS DOUBLE)")
_model_query("M6_matern", "matern", "2.5 * (1 + sqrt(18.0) * power(1.5, 1 / 6.0) * d / 7) * exp(-sqrt(18.0) * power(1.5, 1 / 6.0) * d / 7)", 1.5)


@query(FIRST + " SELECT a_si, b_si, round(" + MODEL_SQL.format(ds="d", dt="dt") + ", 4) AS cov FROM m")
def M7_nested(spark, d):
    return near_lags(spark, d).select("a_si", "b_si", r(models.covariance(MODEL, F.col("ds"), F.col("dt")), "cov"))


@query(FIRST + " SELECT a_si, b_si, round(900 * exp(-3 * (d + 1.5 * dt) / 8), 4) AS cov FROM m")
def M7_metric(spark, d):
    model = [models.parse("exponentialCST", (900.0, 8.0, 1.5))]
    return near_lags(spark, d).select("a_si", "b_si", r(models.covariance(model, F.col("ds"), F.col("dt")), "cov"))


C1_SQL = PAIRS + LAGS + ", emp AS (SELECT s AS lag_s, q AS lag_t, count(*) AS n, covar_pop(l, r) AS cov FROM pair JOIN ls ON ds >= s - 0.5 AND ds < s + 0.5 JOIN lt ON dt >= q - 0.5 AND dt < q + 0.5 GROUP BY s, q)"


@query(C1_SQL + ", w AS (SELECT *, n / ((SELECT cov FROM emp WHERE lag_s = 0 AND lag_t = 0) ** 2 + cov ** 2) AS w FROM emp) SELECT round(sum(w * (" + MODEL_SQL.format(ds="lag_s", dt="lag_t") + " - cov) ** 2) / sum(w), 2) AS objective FROM w")
def F1_wls_objective(spark, d):
    return rounded(fit.objective_frame(c1(spark, d), MODEL), 2)


@query(CELLS + ", e AS (SELECT max(x) - min(x) AS ls, max(t) - min(t) AS lt FROM cells), m AS (SELECT ls / 29 * (range % 30) AS lag_s, lt / 29 * (range // 30) AS lag_t FROM range(900), e) SELECT round(lag_s, 4) AS lag_s, round(lag_t, 4) AS lag_t, round(" + MODEL_SQL.format(ds="lag_s", dt="lag_t") + ", 3) AS cov FROM m")
def F2_surface(spark, d):
    """The model over all lags up to the width and the duration of the cells."""
    e = grid.extent(cells(spark, d)).first()
    s = fit.surface(spark, MODEL, e.x_max - e.x_min, e.t_max - e.t_min)
    return s.select(r("lag_s", "lag_s"), r("lag_t", "lag_t"), r("cov", "cov", 3))


@query(C1_SQL + ", w AS (SELECT *, n / ((SELECT cov FROM emp WHERE lag_s = 0 AND lag_t = 0) ** 2 + cov ** 2) AS w FROM emp) SELECT round(sum(w * (" + MODEL_SQL.format(ds="lag_s", dt="lag_t") + " - cov) ** 2) / sum(w), 2) AS objective FROM w")
def F1_wls_objective(spark, d):
    return rounded(fit.objective_frame(c1(spark, d), MODEL), 2)


@query("WITH m AS (SELECT 12.0 / 29 * (range % 30) AS lag_s, 8.0 / 29 * (range // 30) AS lag_t FROM range(900)) SELECT round(lag_s, 4) AS lag_s, round(lag_t, 4) AS lag_t, round(" + MODEL_SQL.format(ds="lag_s", dt="lag_t") + ", 3) AS cov FROM m")
def F2_surface(spark, d):
    s = fit.surface(spark, MODEL, 12.0, 8.0)
    return s.select(r("lag_s", "lag_s"), r("lag_t", "lag_t"), r("cov", "cov", 3))


@query(C1_SQL + ", w AS (SELECT *, n / ((SELECT cov FROM emp WHERE lag_s = 0 AND lag_t = 0) ** 2 + cov ** 2) AS w FROM emp), o AS (SELECT sum(w * (" + MODEL_SQL.format(ds="lag_s", dt="lag_t") + " - cov) ** 2) / sum(w) AS v FROM w) SELECT round(4 + 900 * ln(v / 900), 3) AS aic_mesh, round(4 + 30 * ln(v / 30), 3) AS aic_lags FROM o")
def F3_aic(spark, d):
    o = fit.objective_frame(c1(spark, d), MODEL)
    return o.select(r(fit.aic(F.col("objective"), 2), "aic_mesh", 3), r(fit.aic(F.col("objective"), 2, 30), "aic_lags", 3))


@query()
def F4_fit(spark, d):
    """Components of an exponential / exponential model fitted to the empirical covariance."""
    model, value = fit.fit(c1(spark, d), [("exponential", "exponential")])
    return spark.createDataFrame([(*map(float, (c.sill, c.range_s, c.range_t)), value) for c in model], "sill double, range_s double, range_t double, objective double")


@query(FIRST + " SELECT a_si, b_si, round(6.0 * 0.6 / sqrt(0.36 * cos(phi - 0.4) ** 2 + sin(phi - 0.4) ** 2), 5) AS a FROM m")
def F8_anisotropic_range(spark, d):
    """The range in the direction of each near pair of sites."""
    return near_lags(spark, d).select("a_si", "b_si", r(models.anisotropic_range(6.0, 0.6, 0.4, F.col("azimuth")), "a", 5))


@query(SITES + " SELECT x, y, round(x * cos(radians(30)) + y * sin(radians(30)), 5) AS u, round((y * cos(radians(30)) - x * sin(radians(30))) / 0.5, 5) AS v FROM sites")
def F11_to_isotropic(spark, d):
    u, v = models.to_isotropic(F.col("x"), F.col("y"), 30.0, 0.5)
    return site_means(spark, d).select("x", "y", r(u, "u", 5), r(v, "v", 5))


@query(SITES + " SELECT x, y, round(x * cos(radians(40)) + y * sin(radians(40)), 5) AS u, round(y * cos(radians(40)) - x * sin(radians(40)), 5) AS v FROM sites")
def F12_rotate(spark, d):
    u, v = models.rotate(F.col("x"), F.col("y"), 40.0, clockwise=True)
    return site_means(spark, d).select("x", "y", r(u, "u", 5), r(v, "v", 5))


# Interpolation and prediction


@query(SITES + ", " + GRID7 + " SELECT k_id, round(sum(s.z / power(sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) + 1e-10, 2)) / sum(1 / power(sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) + 1e-10, 2)), 4) AS zhat FROM g, sites s GROUP BY k_id")
def I1_idw(spark, d):
    return rounded(interpolate.idw(site_means(spark, d), grid7(spark)))


@query(SITES + ", " + GRID7 + ", p AS (SELECT k_id, s.z, sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) AS d FROM g, sites s) SELECT k_id, round(sum(z / power(d, 2)) / sum(1 / power(d, 2)), 4) AS zhat FROM p WHERE d > 0 GROUP BY k_id")
def I2_idw_exclude(spark, d):
    return rounded(interpolate.idw(site_means(spark, d), grid7(spark), exclude_hits=True))


@query(KNN + f", n AS ({SPHERE_SQL} AND k_id <> h_id), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM n) SELECT k_id, round(sum(z / (d * d)) / sum(1 / (d * d)), 4) AS zhat, count(*) AS n FROM o WHERE rank <= 8 GROUP BY k_id")
def I3_idw_knn(spark, d):
    points, data = knn_sides(spark, d)
    return rounded(interpolate.idw_nearest(data, points, 8, 2.0, 3.2, 2.5, 1.3, exclude_same=True).where("n > 0"))


C_KH = MODEL_SQL.format(ds="ds", dt="dt")
NEAR = ", n AS (SELECT k_id, h.*, " + C_KH.replace("ds", "sqrt((k.x - h.x) ** 2 + (k.y - h.y) ** 2)").replace("dt", "abs(k.t - h.t)") + " AS c, sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y) + (k.t - h.t) * (k.t - h.t) * 1.69) AS d FROM k JOIN h ON abs(k.x - h.x) < 4.6 AND abs(k.y - h.y) < 4.6 AND abs(k.t - h.t) < 3.6{}), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM n WHERE d < sqrt(3.2 * 3.2 + 2.5 * 1.3 * 2.5 * 1.3))"
NEAR_OTHER = NEAR.format(" AND k_id <> h_id")
#: The two nearest of a point: their values, noise, covariances with the point and with each other; one where there is but one.
TWO = (
    ", pr AS (SELECT a.k_id, a.hz AS z1, b.hz AS z2, a.c AS c1, b.c AS c2, 2300 + a.var AS k1, 2300 + b.var AS k2, "
    + C_KH.replace("ds", "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)").replace("dt", "abs(a.t - b.t)")
    + " AS c12 FROM o a LEFT JOIN o b ON b.k_id = a.k_id AND b.rank = 2 WHERE a.rank = 1), wt AS (SELECT *, coalesce((k2 * c1 - c12 * c2) / (k1 * k2 - c12 * c12), c1 / k1) AS w1, coalesce((k1 * c2 - c12 * c1) / (k1 * k2 - c12 * c12), 0) AS w2 FROM pr)"
)
SIMPLE = " SELECT k_id, round(w1 * z1 + w2 * coalesce(z2, 0), 3) AS {}, round(greatest(2300 - w1 * c1 - w2 * coalesce(c2, 0), 0), 3) AS {} FROM wt"
RES_KNN = RESID + f", h AS (SELECT {KEY} AS h_id, x, y, t, r AS hz, 0 AS var FROM resid), k AS (SELECT h_id AS k_id, x, y, t FROM h)"
SOFT_KNN = SOFT + f", h AS (SELECT {KEY} AS h_id, x, y, t, mean - 75 AS hz, var FROM soft), k AS (SELECT h_id AS k_id, x, y, t FROM h)"


def all_residuals(spark, d):
    """Every cell as a point and as a datum."""
    h = keyed(resid(spark, d)).select("h_id", "x", "y", "t", F.col("residual").alias("z"))
    return h.select(F.col("h_id").alias("k_id"), "x", "y", "t"), h


ORDERED = RES_KNN.replace("0 AS var FROM resid)", f"0 AS var, CAST('0x' || substr(md5(CAST({KEY} AS VARCHAR)), 1, 15) AS BIGINT) AS place FROM resid)").replace("x, y, t FROM h)", "x, y, t, place FROM h)")


@query(ORDERED + NEAR.format(" AND k_id <> h_id AND h.place < k.place") + TWO + ", m AS (SELECT h.h_id AS k_id, h.hz, coalesce(w1 * z1 + w2 * coalesce(z2, 0), 0) AS m, coalesce(2300 - w1 * c1 - w2 * coalesce(c2, 0), 2300) AS v FROM h LEFT JOIN wt ON wt.k_id = h.h_id) SELECT k_id, round(m, 3) AS mean, round(v, 3) AS variance, round(-0.5 * (ln(2 * pi() * v) + (hz - m) * (hz - m) / v), 4) AS term FROM m")
def F10_conditional_likelihood(spark, d):
    """What each cell, given its two nearest earlier ones in a scattered order, adds to the log-likelihood of the model."""
    place = F.conv(F.substring(F.md5(F.col("h_id").cast("string")), 1, 15), 16, 10).cast("long")
    h = keyed(resid(spark, d)).select("h_id", "x", "y", "t", F.col("residual").alias("z")).withColumn("place", place)
    terms = fit.conditional_terms(fit.conditioned(h, 2, 3.2, 2.5, 1.3, "place"), [MODEL])
    return terms.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3), r("term", "term"))


@query(RES_KNN + NEAR_OTHER + " SELECT k_id, round(c / 2300 * hz, 4) AS zk, round(2300 - c * c / 2300, 3) AS vk FROM o WHERE rank = 1")
def I5_kriging_one(spark, d):
    points, data = all_residuals(spark, d)
    k = interpolate.kriging(data, points, MODEL, 1, 3.2, 2.5, 1.3, exclude_same=True).where("zk is not null")
    return k.select("k_id", r("zk", "zk"), r("vk", "vk", 3))


@query(RES_KNN + NEAR_OTHER + TWO + SIMPLE.format("zk", "vk"))
def I5_kriging_two(spark, d):
    """Simple kriging of every cell from its two nearest others: a linear system each."""
    points, data = all_residuals(spark, d)
    k = interpolate.kriging(data, points, MODEL, 2, 3.2, 2.5, 1.3, exclude_same=True).where("zk is not null")
    return k.select("k_id", r("zk", "zk", 3), r("vk", "vk", 3))


@query(RES_KNN + NEAR_OTHER + TWO + ", ok AS (SELECT *, CASE WHEN z2 IS NULL THEN 1 ELSE 0.5 + (c1 - c2) / (2 * (2300 - c12)) END AS a1 FROM wt) SELECT k_id, round(a1 * z1 + (1 - a1) * coalesce(z2, 0), 3) AS zk, round(2300 - 2 * (a1 * c1 + (1 - a1) * coalesce(c2, 0)) + 2300 * (a1 * a1 + (1 - a1) * (1 - a1)) + 2 * a1 * (1 - a1) * coalesce(c12, 0), 3) AS vk FROM ok")
def I5_kriging_ordinary_two(spark, d):
    """Ordinary kriging from the two nearest others: weights that sum to one."""
    points, data = all_residuals(spark, d)
    k = interpolate.kriging(data, points, MODEL, 2, 3.2, 2.5, 1.3, order=0, exclude_same=True).where("zk is not null")
    return k.select("k_id", r("zk", "zk", 3), r("vk", "vk", 3))


@query()
def I5_kriging_ordinary(spark, d):
    points, data = all_residuals(spark, d)
    return interpolate.kriging(data, points, MODEL, 10, 3.2, 2.5, 1.3, order=0, exclude_same=True)


@query()
def I6_factorial_kriging(spark, d):
    points, data = all_residuals(spark, d)
    return interpolate.factorial_kriging(data, points, MODEL, 8, 3.2, 2.5, 1.3)


@query(RES_KNN + NEAR_OTHER + TWO + SIMPLE.format("mean", "variance"))
def B4_bme_hard(spark, d):
    """Two exact data each."""
    points, data = all_residuals(spark, d)
    b = bme.predict(points, data, None, MODEL, 2, 0, 3.2, 2.5, 1.3, exclude="hard").where("mean is not null")
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


NEAR_FEW = NEAR_OTHER.replace("sqrt(3.2 * 3.2 + 2.5 * 1.3 * 2.5 * 1.3)", "sqrt(0.9 * 0.9 + 0.6 * 1.3 * 0.6 * 1.3)")


@query(RES_KNN + NEAR_FEW + TWO + " SELECT k.k_id, round(w1 * z1 + w2 * coalesce(z2, 0), 3) AS mean, CASE WHEN wt.k_id IS NOT NULL THEN round(greatest(2300 - w1 * c1 - w2 * coalesce(c2, 0), 0), 3) END AS variance FROM k LEFT JOIN wt ON wt.k_id = k.k_id")
def B2_null_rows(spark, d):
    """Within little more than one step some cells have no neighbour: their rows stay, without moments."""
    points, data = all_residuals(spark, d)
    b = bme.predict(points, data, None, MODEL, 2, 0, 0.9, 0.6, 1.3, exclude="hard")
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


@query(RES_KNN + NEAR_FEW + TWO + " SELECT k.k_id, round(w1 * z1 + w2 * coalesce(z2, 0), 3) AS zk, CASE WHEN wt.k_id IS NOT NULL THEN round(2300 - w1 * c1 - w2 * coalesce(c2, 0), 3) END AS vk FROM k LEFT JOIN wt ON wt.k_id = k.k_id")
def I5_null_rows(spark, d):
    """Simple kriging of the same; points without neighbours have null estimates."""
    points, data = all_residuals(spark, d)
    k = interpolate.kriging(data, points, MODEL, 2, 0.9, 0.6, 1.3, exclude_same=True)
    return k.select("k_id", r("zk", "zk", 3), r("vk", "vk", 3))


def all_gaussian_soft(spark, d):
    s = keyed(soft(spark, d))
    none = F.lit(None).cast("array<double>")
    return s.select("h_id", "x", "y", "t", F.lit(10).alias("pdf_type"), none.alias("limi"), none.alias("probdens"), (F.col("mean") - 75).alias("mean"), "var")


@query(SOFT_KNN + NEAR_OTHER + TWO + SIMPLE.format("mean", "variance"))
def B4_bme_soft(spark, d):
    """Two Gaussian soft data each."""
    s = all_gaussian_soft(spark, d)
    points = s.select(F.col("h_id").alias("k_id"), "x", "y", "t")
    b = bme.predict(points, None, s, MODEL, 0, 2, 3.2, 2.5, 1.3, exclude="soft").where("mean is not null")
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


@query(SOFT_KNN + NEAR.format("") + TWO + SIMPLE.format("mean", "variance"))
def B5_bme_at_soft(spark, d):
    """At every soft datum, from itself and the nearest other."""
    s = all_gaussian_soft(spark, d)
    points = s.select(F.col("h_id").alias("k_id"), "x", "y", "t")
    b = bme.predict(points, None, s, MODEL, 0, 2, 3.2, 2.5, 1.3)
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


MIXED = (
    RESID
    + f", soft AS (SELECT x, y, t, avg(z) AS mean, var_pop(z) AS var FROM obs GROUP BY x, y, t HAVING count(*) >= 2 AND var_pop(z) > 0.01), k AS (SELECT {KEY} AS k_id, x, y, t FROM resid), h AS (SELECT {KEY} AS h_id, x, y, t, r AS hz, 0 AS var FROM resid)"
    + NEAR_OTHER
    + f", o1 AS (SELECT * FROM o WHERE rank = 1), sd AS (SELECT {KEY} AS h_id, x, y, t, mean - 75 AS hz, var FROM soft)"
    + NEAR_OTHER.replace("n AS", "n2 AS").replace("FROM n ", "FROM n2 ").replace(" o AS", " o2 AS").replace("JOIN h ON", "JOIN sd AS h ON").replace(" AND k_id <> h_id", "")
    + ", pp AS (SELECT k.k_id, a.hz AS z1, a.c AS c1, b.hz AS zs, b.c AS cs, b.var AS vs, "
    + C_KH.replace("ds", "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)").replace("dt", "abs(a.t - b.t)")
    + " AS c12 FROM k LEFT JOIN o1 a ON a.k_id = k.k_id LEFT JOIN o2 b ON b.k_id = k.k_id AND b.rank = 1 WHERE a.k_id IS NOT NULL OR b.k_id IS NOT NULL),"
    " kp AS (SELECT *, zs IS NOT NULL AND (z1 IS NULL OR abs(c12 / 2300 * z1 - zs) <= 3 * (sqrt(greatest(2300 - c12 * c12 / 2300, 0)) + sqrt(vs))) AS on_ FROM pp),"
    " wt AS (SELECT k_id, CASE WHEN z1 IS NOT NULL THEN z1 ELSE zs END AS z1, CASE WHEN z1 IS NOT NULL THEN c1 ELSE cs END AS c1, CASE WHEN z1 IS NOT NULL THEN 2300 ELSE 2300 + vs END AS k1, CASE WHEN z1 IS NOT NULL AND on_ THEN zs END AS z2, CASE WHEN z1 IS NOT NULL AND on_ THEN cs END AS c2, 2300 + vs AS k2, c12 FROM kp)"
    " SELECT k_id, round(coalesce((k2 * c1 - c12 * c2) / (k1 * k2 - c12 * c12), c1 / k1) * z1 + coalesce((k1 * c2 - c12 * c1) / (k1 * k2 - c12 * c12) * z2, 0), 3) AS mean,"
    " round(greatest(2300 - coalesce((k2 * c1 - c12 * c2) / (k1 * k2 - c12 * c12), c1 / k1) * c1 - coalesce((k1 * c2 - c12 * c1) / (k1 * k2 - c12 * c12) * c2, 0), 0), 3) AS variance FROM wt"
)


@query(MIXED)
def B4_bme_mixed(spark, d):
    """One exact and one Gaussian soft datum; soft data that the exact one contradicts are left out."""
    points, data = all_residuals(spark, d)
    b = bme.predict(points, data, all_gaussian_soft(spark, d), MODEL, 1, 1, 3.2, 2.5, 1.3, exclude="hard").where("mean is not null")
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


@query(RES_KNN + NEAR_OTHER + TWO + ", mv AS (SELECT k_id, w1 * z1 + w2 * coalesce(z2, 0) AS m, greatest(2300 - w1 * c1 - w2 * coalesce(c2, 0), 1e-12) AS v FROM wt) SELECT k_id, i.range AS i, round(m + (i.range * 0.6 - 6) * sqrt(v), 3) AS pdf_x, round(exp(-(i.range * 0.6 - 6) * (i.range * 0.6 - 6) / 2) / sqrt(2 * pi() * v), 7) AS pdf_p FROM mv, range(21) i")
def B7_pdf_hard(spark, d):
    """Posterior densities of exact data, which are Gaussian."""
    points, data = all_residuals(spark, d)
    b = bme.predict(points, data, None, MODEL, 2, 0, 3.2, 2.5, 1.3, exclude="hard", mesh=21).where("mean is not null")
    b = b.select("k_id", F.posexplode(F.arrays_zip("pdf_x", "pdf_p")).alias("i", "p"))
    return b.select("k_id", F.col("i").cast("long").alias("i"), r("p.pdf_x", "pdf_x", 3), r("p.pdf_p", "pdf_p", 7))


COINCIDING = SOFT + f", v AS (SELECT {KEY} AS k_id, mean - 75 AS m1, var AS v1, (low + up) / 2 - 75 AS m2, (up - low) * (up - low) / 12 AS v2, low - 75 AS a, up - 75 AS b FROM soft)"


def own_soft(spark, d):
    """(points on the soft places, soft cells with their keys)"""
    s = keyed(soft(spark, d))
    return s.select(F.col("h_id").alias("k_id"), "x", "y", "t"), s


@query(COINCIDING + " SELECT k_id, round((m1 / v1 + m2 / v2) / (1 / 2300.0 + 1 / v1 + 1 / v2), 3) AS mean, round(1 / (1 / 2300.0 + 1 / v1 + 1 / v2), 3) AS variance FROM v")
def B4_bme_coinciding(spark, d):
    """Two Gaussian soft data at one place, which is the point's own."""
    points, s = own_soft(spark, d)
    none = F.lit(None).cast("array<double>")
    kind = [F.lit(10).alias("pdf_type"), none.alias("limi"), none.alias("probdens")]
    first = s.select("h_id", "x", "y", "t", *kind, (F.col("mean") - 75).alias("mean"), "var")
    second = s.select((-F.col("h_id") - 1).alias("h_id"), "x", "y", "t", *kind, ((F.col("low") + F.col("up")) / 2 - 75).alias("mean"), ((F.col("up") - F.col("low")) ** 2 / 12).alias("var"))
    b = bme.predict(points, None, first.union(second), MODEL, 0, 2, 0.5, 0.3, 1.3)
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


C_NEXT = MODEL_SQL.format(ds="0.4", dt="0.0")


@query(COINCIDING + f", w AS (SELECT k_id, (a + b) / 2 AS m, (b - a) * (b - a) / 4 + 1e-6 AS v, {C_NEXT} AS c FROM v) SELECT k_id, round(c / (2300 + v) * m, 3) AS mean, round(2300 - c * c / (2300 + v), 3) AS variance FROM w")
def B8_bme_assimilated(spark, d):
    """Two exact data at one place contradict each other; assimilated they are a Gaussian of their mean and spread."""
    points, s = own_soft(spark, d)
    both = s.select("h_id", "x", "y", "t", (F.col("low") - 75).alias("z")).union(s.select((-F.col("h_id") - 1).alias("h_id"), "x", "y", "t", (F.col("up") - 75).alias("z")))
    points = points.withColumn("x", F.col("x") + 0.4)
    b = bme.predict(points, both, None, MODEL, 2, 0, 0.5, 0.3, 1.3, options=bme.Options(assimilate=True))
    return b.select("k_id", r("mean", "mean", 3), r("variance", "variance", 3))


WIDE = [Component(250_000.0, "exponential", 6.0, "exponential", 4.0)]
SIMPSON = ", p AS (SELECT k_id, a + (b - a) * i.range / 400 AS x, (CASE WHEN i.range IN (0, 400) THEN 1 WHEN i.range % 2 = 1 THEN 4 ELSE 2 END) AS w FROM v, range(401) i), e AS (SELECT k_id, sum(w * exp(-x * x / 5e5) * x) / sum(w * exp(-x * x / 5e5)) AS m1, sum(w * exp(-x * x / 5e5) * x * x) / sum(w * exp(-x * x / 5e5)) AS m2 FROM p GROUP BY k_id)"


@query(COINCIDING + SIMPSON + " SELECT k_id, round(exp(-0.2) * m1, 2) AS mean, round((250000 * (1 - exp(-0.4)) + exp(-0.4) * (m2 - m1 * m1)) / 100, 2) AS variance FROM e")
def B3_bme_uniform(spark, d):
    """One uniform soft datum beside the point: a truncated normal passed on by the covariance."""
    points, s = own_soft(spark, d)
    low, up = F.col("low") - 75, F.col("up") - 75
    limits, density = softdata.uniform_two_nodes(low, up)
    s = s.select("h_id", "x", "y", "t", F.lit(2).alias("pdf_type"), limits.alias("limi"), density.alias("probdens"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("var"))
    b = bme.predict(points.withColumn("x", F.col("x") + 0.4), None, s, WIDE, 0, 1, 0.5, 0.3, 1.3)
    return b.select("k_id", r("mean", "mean", 2), r(F.col("variance") / 100, "variance", 2))


_PHI = "(CASE WHEN z > 0 THEN 1 - q ELSE q END)"


def _horner_sql(coefficients) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * a + {c!r})"
    return out


@query(SITES + f", s AS (SELECT x, y, z - 75 AS m, 4.0 AS v, (z - 75) / 2 AS z FROM sites), a AS (SELECT *, abs(z) AS a FROM s), q AS (SELECT *, CASE WHEN a > 7.07 THEN exp(-a * a / 2) / sqrt(2 * pi()) / a ELSE exp(-a * a / 2) * {_horner_sql(normal._TOP)} / {_horner_sql(normal._BOTTOM)} END AS q FROM a), f AS (SELECT x, y, m, v, z, {_PHI} AS p, exp(-z * z / 2) / sqrt(2 * pi()) AS g FROM q) SELECT x, y, round(CASE WHEN p < 1e-12 THEN 0 ELSE greatest(m, 0) END, 4) AS mean, round(CASE WHEN p < 1e-12 THEN 0 ELSE v * (1 - g / p * (g / p + z)) END, 3) AS variance FROM f")
def B6_nonnegative(spark, d):
    s = site_means(spark, d).select("x", "y", (F.col("z") - 75).alias("m"))
    mean, var = normal.nonnegative(F.col("m"), F.lit(4.0))
    return s.select("x", "y", r(mean, "mean"), r(var, "variance", 3))


@query()
def B3_bme_qmc(spark, d):
    """Uniform soft data and exact residuals: moments by quasi-Monte-Carlo."""
    s = keyed(soft(spark, d))
    low, up = F.col("low") - 75, F.col("up") - 75
    limi = softdata.uniform_limits(low, up)
    s = s.select("h_id", "x", "y", "t", F.lit(2).alias("pdf_type"), limi.alias("limi"), softdata.uniform_density(low, up).alias("probdens"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))
    points, data = all_residuals(spark, d)
    return bme.predict(points, data, s, MODEL, 4, 2, 3.2, 2.5, 1.3, exclude="hard")


@query()
def B7_pdf(spark, d):
    """Posterior densities on a mesh of 41 values."""
    points, data = all_residuals(spark, d)
    return bme.predict(points, data, all_gaussian_soft(spark, d), MODEL, 4, 2, 3.2, 2.5, 1.3, exclude="hard", mesh=41)


# Validation


LOO = CELLS + f", h AS (SELECT {KEY} AS h_id, x, y, t, z FROM cells), n AS (SELECT a.h_id AS k_id, b.h_id, a.x, a.y, a.t, a.z, b.z AS hz, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.t - b.t) * (a.t - b.t) * (0.7 * 0.7)) AS d FROM h a JOIN h b ON a.h_id <> b.h_id AND abs(a.x - b.x) <= 2.5 AND abs(a.y - b.y) <= 2.5 AND abs(a.t - b.t) <= 3.6), o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM n WHERE d < sqrt(2.2 * 2.2 + 1.5 * 0.7 * 1.5 * 0.7)), e AS (SELECT k_id, any_value(x) AS x, any_value(y) AS y, any_value(t) AS t, any_value(z) - sum(hz / (d * d)) / sum(1 / (d * d)) AS error FROM o WHERE rank <= 6 GROUP BY k_id)"


def loo(spark, d):
    return validate.loo_idw(keyed(cells(spark, d)), 6, 2.2, 1.5, 0.7)


@query(LOO + " SELECT k_id, round(error, 4) AS error FROM e")
def V1_loo_idw(spark, d):
    return rounded(loo(spark, d).where("error is not null").select("k_id", "error"))


@query(CELLS + ", s AS (SELECT *, sum(z) OVER (PARTITION BY x, y) AS ss, count(z) OVER (PARTITION BY x, y) AS sn, sum(z) OVER (PARTITION BY t) AS ts, count(z) OVER (PARTITION BY t) AS tn, sum(z) OVER () AS s, count(z) OVER () AS n FROM cells) SELECT x, y, t, round((ss - z) / (sn - 1) + (ts - z) / (tn - 1) - (s - z) / (n - 1), 4) AS tr FROM s WHERE sn > 1")
def V3_loo_trend(spark, d):
    return rounded(validate.loo_stmean(cells(spark, d)).where("tr is not null").select("x", "y", "t", "tr"))


STATS = "round(sqrt(avg(error * error)), 4) AS rmse, round(avg(error), 4) AS mean, round(stddev_pop(error), 4) AS std, round(quantile_cont(error, 0.25), 4) AS p25, round(quantile_cont(error, 0.5), 4) AS median, round(quantile_cont(error, 0.75), 4) AS p75, round(min(error), 4) AS min, round(max(error), 4) AS max"


@query(LOO + f" SELECT {STATS} FROM e")
def V4_error_stats(spark, d):
    return rounded(validate.error_statistics(loo(spark, d)))


@query(LOO + f" SELECT x, y, {STATS} FROM e GROUP BY x, y")
def V5_site_stats(spark, d):
    return rounded(validate.error_statistics(loo(spark, d).where("error is not null"), "x", "y"))


@query(LOO + f" SELECT t, {STATS} FROM e GROUP BY t")
def V6_time_stats(spark, d):
    return rounded(validate.error_statistics(loo(spark, d).where("error is not null"), "t"))


@query(CELLS + ", e AS (SELECT x, y, min(z) AS lo, max(z) AS hi FROM cells GROUP BY x, y) SELECT x, y, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((z - lo) / (hi - lo) * 8) + 1, 8) END AS INT) AS bin, count(*) AS n FROM cells JOIN e USING (x, y) GROUP BY 1, 2, 3")
def V7_histogram(spark, d):
    return validate.histogram(cells(spark, d), 8)


@query()
def V1_loo_bme(spark, d):
    """Residuals of all cells from their neighbours by the model."""
    data = keyed(resid(spark, d)).select("h_id", "x", "y", "t", F.col("residual").alias("z"))
    return validate.loo_bme(data, None, MODEL, nh=8, dmax_s=3.2, dmax_t=2.5, ratio=1.3)


@query(RES_KNN + NEAR_OTHER + TWO + " SELECT k_id, round(r - w1 * z1 - w2 * coalesce(z2, 0), 3) AS error FROM wt JOIN (SELECT " + KEY + " AS k_id, r FROM resid) USING (k_id)")
def V1_loo_bme_two(spark, d):
    """Errors of all cells estimated from their two nearest others."""
    data = all_residuals(spark, d)[1]
    return rounded(validate.loo_bme(data, None, MODEL, nh=2, dmax_s=3.2, dmax_t=2.5, ratio=1.3).where("error is not null").select("k_id", "error"), 3)


# Outliers


@query()
def O1_time_outliers(spark, d):
    s = obs(spark, d).select((F.col("y") * 15 + F.col("x")).cast("long").alias("id"), "t", "z")
    return outliers.time_outliers(s, 1.0, 5.0)


O2 = CELLS + f", h AS (SELECT {KEY} AS h_id, x, y, t, z FROM cells), n AS (SELECT a.h_id AS k_id, a.z, b.h_id, b.z AS bz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM h a JOIN h b ON a.t = b.t AND abs(a.x - b.x) <= 4.3 AND abs(a.y - b.y) <= 4.3), o AS (SELECT * FROM n WHERE d < 4.3), g AS (SELECT k_id, any_value(z) AS z, sum(CASE WHEN d > 0 THEN bz / power(d, 1.5) END) / sum(CASE WHEN d > 0 THEN 1 / power(d, 1.5) END) AS zhat, stddev_pop(bz) AS s, max(d) > 0 AS spread FROM o GROUP BY k_id)"


@query(O2 + " SELECT k_id AS h_id, round(zhat, 4) AS zhat, coalesce(spread AND abs(z - zhat) > 3 * s, false) AS outlier FROM g")
def O2_spatial_outliers(spark, d):
    h = keyed(cells(spark, d))
    return rounded(outliers.spatial_outliers(h, 4.3, by="t").select("h_id", "zhat", "outlier"))


@query()
def O3_space_time_outliers(spark, d):
    h = keyed(cells(spark, d)).withColumn("id", (F.col("y") * 15 + F.col("x")).cast("long"))
    return outliers.space_time_outliers(h, 1.0, 5.0, 4.3)


CAUSAL = (
    CELLS
    + f", q AS (SELECT {KEY} AS h_id, x, y, t, (z - avg(z) OVER w) / coalesce(nullif(stddev_samp(z) OVER w, 0), 1) AS score FROM cells WINDOW w AS (PARTITION BY x, y)), n AS (SELECT t, count(*) AS n FROM q GROUP BY t),"
    " wd AS (SELECT a.t AS hi, CASE WHEN coalesce(sum(b.n) FILTER (b.t > a.t - 2.5), 0) >= 400 THEN 2.5 WHEN coalesce(sum(b.n) FILTER (b.t > a.t - 3.5), 0) >= 400 THEN 3.5 ELSE 4.5 END AS w FROM n a LEFT JOIN n b ON b.t < a.t AND b.t > a.t - 4.5 GROUP BY a.t),"
    " p AS (SELECT k.h_id AS k_id, h.h_id, h.score, sqrt((k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y) + (k.t - h.t) * (k.t - h.t) * 1.0) AS d FROM q k JOIN wd ON wd.hi = k.t JOIN q h ON h.t < k.t AND h.t > k.t - wd.w AND abs(h.x - k.x) < 5 AND abs(h.y - k.y) < 5 WHERE (k.x - h.x) * (k.x - h.x) + (k.y - h.y) * (k.y - h.y) + (k.t - h.t) * (k.t - h.t) < 25),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY k_id ORDER BY round(d, 9), h_id) AS rank FROM p), e AS (SELECT k_id, sum(score / (d * d)) / sum(1 / (d * d)) AS expected FROM o WHERE rank <= 20 GROUP BY k_id)"
)


@query(CAUSAL + " SELECT q.h_id, round(score, 4) AS score, round(expected, 4) AS expected, coalesce(abs(score - expected) > 2.5, false) AS outlier FROM q LEFT JOIN e ON e.k_id = q.h_id")
def O4_causal(spark, d):
    """Scores against what earlier days say of their place, flagged data among them."""
    s = keyed(cells(spark, d)).withColumn("id", (F.col("y") * 15 + F.col("x")).cast("long"))
    found = outliers.causal_outliers(s, 1.0, (1.5, 1.0, 4.0, 400), 20, 4.0, 3.0, 1.0, 2.5, feedback=False)
    return rounded(found.select("h_id", "score", "expected", "outlier"))


@query()
def O4_causal_feedback(spark, d):
    """The same, flagged data saying nothing of later days."""
    s = keyed(cells(spark, d)).withColumn("id", (F.col("y") * 15 + F.col("x")).cast("long"))
    return outliers.causal_outliers(s, 1.0, (1.5, 1.0, 4.0, 400), 20, 4.0, 3.0, 1.0, 2.5).select("h_id", "score", "expected", "outlier")


@query(CELLS + " SELECT x, y, t, round((z - avg(z) OVER w) / coalesce(nullif(stddev_samp(z) OVER w, 0), 1), 4) AS score FROM cells WINDOW w AS (PARTITION BY x, y)")
def O4_z_scores(spark, d):
    s = cells(spark, d).withColumn("id", (F.col("y") * 15 + F.col("x")).cast("long"))
    return rounded(outliers.z_scores(s).select("x", "y", "t", "score"))


# Decomposition


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


LONG = "WITH e AS (SELECT vec_id, CAST(unnest(range(len(embedding))) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(LONG + " SELECT a.i, b.i AS j, round(sum(a.v * b.v), 5) AS g FROM e a JOIN e b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i")
def E1_gram(spark, d):
    return rounded(decompose.gram(vectors(spark, d)), 5)


@query()
def E1_eof(spark, d):
    value, s, axes = decompose.eof_vectors(vectors(spark, d), n=5)
    return spark.createDataFrame([(k, float(value[k]), float(s[k]), axes[:, k].tolist()) for k in range(5)], "k int, l double, sigma double, eof array<double>")


@query(CELLS + ", s AS (SELECT y AS id, t, avg(z) AS z FROM cells GROUP BY y, t), l AS (SELECT CAST(id AS BIGINT) AS id, t, lag(z, 2) OVER w AS v0, lag(z, 1) OVER w AS v1, z AS v2 FROM s WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, t, round(v0, 4) AS v0, round(v1, 4) AS v1, round(v2, 4) AS v2 FROM l WHERE v0 IS NOT NULL")
def E2_lag_embedding(spark, d):
    s = cells(spark, d).groupBy(F.col("y").cast("long").alias("id"), "t").agg(F.avg("z").alias("z"))
    return rounded(decompose.lag_embedding(s, 3).select("id", "t", *(F.col("v")[k].alias(f"v{k}") for k in range(3))))


@query()
def E4_rotated_eof(spark, d):
    loadings, _ = decompose.rotated_eof(vectors(spark, d), 4)
    return spark.createDataFrame([(k, loadings[:, k].tolist()) for k in range(4)], "k int, loadings array<double>")


@query(LONG + ", s AS (SELECT i, sum(v) AS s, count(*) AS n FROM e GROUP BY i), g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM e a JOIN e b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i) SELECT g.i, g.j, round((g - p.s * q.s / p.n) / (p.n - 1), 6) AS c FROM g JOIN s p ON p.i = g.i JOIN s q ON q.i = g.j")
def E5_covariance(spark, d):
    return rounded(decompose.covariance(vectors(spark, d)), 6)


@query()
def E6_ica(spark, d):
    mixing, _ = decompose.ica(vectors(spark, d), 3)
    return spark.createDataFrame([(k, mixing[:, k].tolist()) for k in range(3)], "k int, mixing array<double>")


@query(CELLS + " SELECT CAST(a.x AS INT) AS i, CAST(b.x AS INT) AS j, round(sum(a.z * b.z), 4) AS g FROM cells a JOIN cells b USING (y, t) WHERE a.x <= b.x GROUP BY 1, 2")
def E9_mode_gram(spark, d):
    t = cells(spark, d).select(F.col("x").cast("int").alias("x"), "y", "t", F.col("z").alias("v"))
    return rounded(decompose.mode_gram(t, "x"), 4)


def tensor(spark, d):
    return cells(spark, d).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("t").cast("int").alias("t"), F.col("z").alias("v"))


@query(LONG + " SELECT vec_id, round(sum(v * v), 6) AS size FROM e GROUP BY vec_id")
def E1_projected(spark, d):
    """Coefficients on all orthogonal functions keep every vector's length."""
    own = vectors(spark, d)
    _, _, eofs = decompose.eof_vectors(own)
    found = decompose.project(own, eofs, "vec_id")
    return found.select("vec_id", r(F.aggregate("ecs", F.lit(0.0), lambda s, c: s + c * c), "size", 6))


@query(CELLS + " SELECT CAST(x AS INT) % 2 AS x, CAST(y AS INT) AS y, CAST(t AS INT) AS t, round(sum(z * (x + 1)), 3) AS v FROM cells GROUP BY 1, 2, 3")
def E8_mode_product(spark, d):
    """Cells times a matrix along x, which sums even and odd columns with weights."""
    own = tensor(spark, d)
    factor = own.select("x").distinct().select("x", (F.col("x") % 2).alias("k"), (F.col("x") + 1.0).alias("u"))
    return rounded(decompose.times_matrix(own, factor, "x", "k"), 3)


@query(CELLS + " SELECT round(sum(z * z), 2) AS total FROM cells")
def E9_hosvd_core(spark, d):
    """The core holds the weight of all cells."""
    core, _ = decompose.hosvd_long(tensor(spark, d), tall=True)
    return core.agg(r(F.sum(F.col("v") * F.col("v")), "total", 2))


@query(CELLS + " SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(t AS INT) AS t, round(z, 4) AS v FROM cells")
def E9_hosvd_rebuilt(spark, d):
    """Core times factors gives the cells again."""
    own = tensor(spark, d)
    core, factors = decompose.hosvd_long(own, tall=True)
    return rounded(decompose.rebuilt(core, factors).join(own.select("x", "y", "t"), ["x", "y", "t"]).select("x", "y", "t", "v"))


@query(CELLS + ", s AS (SELECT y AS id, t, avg(z) AS z FROM cells GROUP BY y, t), l AS (SELECT lag(z, 2) OVER w AS v0, lag(z, 1) OVER w AS v1, z AS v2 FROM s WINDOW w AS (PARTITION BY id ORDER BY t)), g AS (SELECT * FROM l WHERE v0 IS NOT NULL) SELECT 0 AS i, 0 AS j, round(sum(v0 * v0), 3) AS g FROM g UNION ALL SELECT 0, 1, round(sum(v0 * v1), 3) FROM g UNION ALL SELECT 0, 2, round(sum(v0 * v2), 3) FROM g UNION ALL SELECT 1, 1, round(sum(v1 * v1), 3) FROM g UNION ALL SELECT 1, 2, round(sum(v1 * v2), 3) FROM g UNION ALL SELECT 2, 2, round(sum(v2 * v2), 3) FROM g")
def E2_lag_gram(spark, d):
    """Products of lags of the daily means of lattice rows, without their windows."""
    s = cells(spark, d).groupBy(F.col("y").cast("long").alias("id"), "t").agg(F.avg("z").alias("z"))
    return rounded(decompose.lag_gram(s, 3), 3)


# Files: tables written to the shared folder and read back


def written(spark, df, sep: str, name: str) -> str:
    path = shared_path(spark, name)
    df.write.csv(path, sep=sep, header=True)
    return path


@query(OBS + " SELECT x, y, t, round(z, 6) AS z FROM obs")
def S1_delimited(spark, d):
    """All observations as text between bars, each file with a header."""
    path = written(spark, obs(spark, d).select("z", "x", "y", "t"), "|", "delimited")
    return rounded(observations.read_delimited(spark, path, {"x": 1, "y": 2, "t": 3, "z": 0}, sep="|", header=True).drop("row_id"), 6)


@query(OBS + " SELECT x, y, t, round(z, 6) AS z FROM obs")
def S7_start_row(spark, d):
    """The same between blanks, from the second line of every file."""
    path = written(spark, obs(spark, d).select("x", "y", "t", "z"), " ", "blanks")
    return rounded(observations.read_delimited(spark, path, {"x": 0, "y": 1, "t": 2, "z": 3}, sep=" ", skip=1).drop("row_id"), 6)


@query(OBS + " SELECT true AS title, count(*) AS n FROM obs")
def S6_sniff(spark, d):
    title, _, n = observations.sniff(spark, written(spark, obs(spark, d).select("x", "y", "t", "z"), ",", "sniff"))
    return spark.createDataFrame([(title, n)], "title boolean, n long")


def soft_moments(loaded: DataFrame) -> DataFrame:
    return loaded.select("x", "y", "t", r("pdf.mean", "mean", 5), r("pdf.var", "variance", 2))


@query(SQL["P4_moments"])
def S4_soft_gaussian(spark, d):
    """Means and variances from a file, as normalised densities."""
    path = written(spark, soft(spark, d).select("x", "y", "t", "mean", "var"), ",", "gaussian")
    return soft_moments(observations.load_soft(spark, path, "gaussian", header=True))


@query(SOFT + " SELECT x, y, t, round((low + up) / 2, 5) AS mean, round((up - low) * (up - low) / 12, 2) AS variance FROM soft")
def S4_soft_uniform(spark, d):
    path = written(spark, soft(spark, d).select("x", "y", "t", "low", "up"), ";", "uniform")
    return soft_moments(observations.load_soft(spark, path, "uniform", sep=";", header=True))


@query(SQL["P4_moments"])
def S5_soft_ragged(spark, d):
    """Limits and densities in lines of their own length."""
    s, path = polygons(spark, d), shared_path(spark, "ragged")
    s.select(F.concat_ws(",", *(F.col(c).cast("string") for c in "xyt"), (F.size("limi") - 1).cast("string"), F.col("limi").cast("array<string>"), F.col("probdens").cast("array<string>"))).write.text(path)
    return soft_moments(observations.load_soft(spark, path, "user"))


def soft_result(spark, d):
    return soft(spark, d).select("x", "y", "t", "mean", F.col("var").alias("variance"))


@query(SOFT + " SELECT x, y, t, round(mean, 6) AS mean, round(var, 6) AS variance FROM soft")
def S12_export(spark, d):
    path = shared_path(spark, "export")
    observations.write_result(soft_result(spark, d), path)
    return rounded(observations.read_delimited(spark, path, {c: i for i, c in enumerate(("x", "y", "t", "mean", "variance"))}, header=True).drop("row_id"), 6)


@query(CELLS + " SELECT x, y, t, round(z, 6) AS z, 'day' AS unit FROM cells")
def S17_project(spark, d):
    """Tables and settings of a saved project."""
    path = shared_path(spark, "project")
    observations.save_project({"cells": cells(spark, d), "soft": soft(spark, d)}, {"unit": "day"}, path)
    tables, settings = observations.load_project(spark, path)
    return rounded(tables["cells"].select("x", "y", "t", "z", F.lit(settings["unit"]).alias("unit")), 6)


@query(OBS + " SELECT x, y, count(z) AS n, round(sum(z), 4) AS s, round(sum(z * z), 2) AS ss FROM obs GROUP BY x, y")
def ST1_site_sums(spark, d):
    """The running sums of sites after all events have streamed by."""
    table, out = spark.read.parquet(f"{d}/events.parquet"), shared_path(spark, "stream")
    stream = observations.from_events(spark.readStream.schema(table.schema).parquet(f"{d}/events.parque[t]"))
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/sums")
    run = site_sums(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/sums").select("x", "y", "n", r("s", "s"), r("ss", "ss", 2))


# Trends by name, maps


@query(CELLS + " SELECT x, y, t, CAST(0 AS DOUBLE) AS tr FROM cells")
def T1_none(spark, d):
    return trend.estimate("nd", cells(spark, d)).select("x", "y", "t", "tr")


@query(SQL["T3_stmean_est"])
def T13_by_name(spark, d):
    """The separable trend at points, chosen by its name."""
    return rounded(trend.estimate("stm", cells(spark, d), grid7(spark)).select("k_id", "tr"))


@query(CELLS + " SELECT x, y, t, round(avg(z) OVER (PARTITION BY x), 4) AS tr FROM cells")
def T12_user(spark, d):
    """A trend of the user's own: the mean of each lattice column."""
    own = lambda c, p: c.join(c.groupBy("x").agg(F.avg("z").alias("tr")), "x")
    return rounded(trend.estimate("ud", cells(spark, d), user=own).select("x", "y", "t", "tr"))


@query(CELLS + " SELECT x, y, t, round(z, 5) AS z FROM cells")
def F11_round_trip(spark, d):
    """To the principal axes of an ellipsoid and back."""
    turned = models.to_isotropic_3d(F.col("x"), F.col("y"), F.col("t"), (30.0, 20.0, 10.0), (0.5, 0.25))
    c = cells(spark, d).select(*(v.alias(n) for v, n in zip(turned, "uvw", strict=True)), "z")
    back = models.to_anisotropic_3d(F.col("u"), F.col("v"), F.col("w"), (30.0, 20.0, 10.0), (0.5, 0.25))
    return c.select(*((F.round(v, 5) + 0.0).alias(n) for v, n in zip(back, "xyt", strict=True)), r("z", "z", 5))


@query(SOFT + " SELECT x, y, round(mean, 4) AS mean, round(var, 3) AS variance FROM soft WHERE t = 10")
def V8_map(spark, d):
    """The map of one day."""
    return validate.map_at(soft_result(spark, d), 10.0).select("x", "y", r("mean", "mean"), r("variance", "variance", 3))


@query(SOFT + " SELECT t, round(mean, 4) AS mean, round(var, 3) AS variance FROM soft WHERE x = 7 AND y = 0")
def V8_series(spark, d):
    """The series of one site."""
    return validate.series(soft_result(spark, d), 7.0, 0.0).select("t", r("mean", "mean"), r("variance", "variance", 3))


# Information


@query("WITH n AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT round(-sum(n / (SELECT sum(n) FROM n) * ln(n / (SELECT sum(n) FROM n))), 6) AS entropy FROM n")
def X1_entropy(spark, d):
    return rounded(information.entropy(spark.read.parquet(f"{d}/lineitem.parquet"), "l_returnflag", "l_linestatus"), 6)


@query("WITH e AS (SELECT least(floor((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 10), 9) AS b FROM events), n AS (SELECT b, count(*) AS n FROM e GROUP BY b) SELECT round(-sum(n / (SELECT sum(n) FROM n) * ln(n / (SELECT sum(n) FROM n))), 6) AS entropy FROM n")
def X2_histogram_entropy(spark, d):
    return rounded(information.histogram_entropy(events(spark, d), "value"), 6)


_BIN = "least(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 20), 19)"


@query("WITH b AS (SELECT " + _BIN.format(c="l_quantity") + " AS x, " + _BIN.format(c="l_extendedprice") + " AS y FROM lineitem), t AS (SELECT count(*) AS n FROM b), hx AS (SELECT -sum(c / n * ln(c / n)) AS h FROM (SELECT x, count(*) AS c FROM b GROUP BY x), t), hy AS (SELECT -sum(c / n * ln(c / n)) AS h FROM (SELECT y, count(*) AS c FROM b GROUP BY y), t), hxy AS (SELECT -sum(c / n * ln(c / n)) AS h FROM (SELECT x, y, count(*) AS c FROM b GROUP BY x, y), t) SELECT round(hx.h, 5) AS h_x, round(hy.h, 5) AS h_y, round(hxy.h, 5) AS h_xy, round(hxy.h - hx.h, 5) AS h_y_given_x, round(hx.h + hy.h - hxy.h, 5) AS mutual_information FROM hx, hy, hxy")
def X3_mutual_information(spark, d):
    return rounded(information.mutual_information(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice"), 5)


@query("WITH m AS (SELECT avg(l_quantity) AS m, avg(l_tax) AS my FROM lineitem) SELECT round(any_value(m), 5) AS m1, round(avg(power(l_quantity - m, 2)), 4) AS c2, round(avg(power(l_quantity - m, 3)), 2) AS c3, round(avg(power(l_quantity - m, 4)), 1) AS c4, round(avg(CASE WHEN l_quantity > 0 THEN ln(l_quantity) END), 5) AS mean_log, round(avg((l_quantity - m) * (l_tax - my)), 5) AS \"cross\" FROM lineitem, m")
def X5_moments(spark, d):
    m = information.moments(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", 4, "l_tax")
    return m.select(r("m1", "m1", 5), r("c2", "c2"), r("c3", "c3", 2), r("c4", "c4", 1), r("mean_log", "mean_log", 5), r("cross", "cross", 5))


@query("WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT " + ", ".join(f"round(avg(power((l_quantity - m) / s, {k})), 4) AS s{k}" for k in range(3, 11)) + " FROM lineitem, m")
def X5_moments_to_ten(spark, d):
    """Central moments 3 to 10 in units of the standard deviation."""
    m = information.moments(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity")
    return m.select(*(r(F.col(f"c{k}") / F.pow("c2", F.lit(k / 2)), f"s{k}") for k in range(3, 11)))


@query()
def X4_maximum_entropy(spark, d):
    """Density of most entropy with the first two moments of event values, scaled to their own range."""
    import numpy as np

    e = events(spark, d)
    low, high = e.agg(F.min("value"), F.max("value")).first()
    u = (F.col("value") - low) / (high - low)
    m = e.agg(F.avg(u), F.avg(u * u)).first()
    x, p = information.maximum_entropy(np.array(m[:2], float), 0.0, 1.0, points=100)
    return spark.createDataFrame(list(zip(x.tolist(), p.tolist(), strict=True)), "x double, density double")


@query()
def X6_simulation(spark, d):
    """Four seeded fields at every cell."""
    points = keyed(cells(spark, d), "k_id").select("k_id", "x", "y", "t")
    return information.simulate_spectral(points, [Component(1.0, "exponential", 5.0, "exponential", 4.0), Component(0.1, "nugget", 1.0)], 4)
