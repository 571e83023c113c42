"""Observations in vector form (row_id, x, y, t, z) and in sparse grid form (si, ti, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE, CELL = ["x", "y"], ["x", "y", "t"]
SLICES = 128


def clean_values(obs: DataFrame, *cols: str) -> DataFrame:
    """NaN becomes NULL, so that aggregates leave missing values out."""
    return obs.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in cols or ("z",)})


def _numbered(keys: DataFrame, major: str, minor: str | None, name: str) -> DataFrame:
    """Dense 1-based number in the order (major, minor).

    Keys are parted into ``SLICES`` by approximate quantiles of ``major`` and numbered within their
    part; the only global window runs over the counts of the parts.
    """
    ends = keys.agg(F.percentile_approx(major, F.array(*(F.lit(k / SLICES) for k in range(1, SLICES))), 10 * SLICES).alias("_ends"))
    parted = keys.crossJoin(F.broadcast(ends))  # one row
    parted = parted.withColumn("_part", F.size(F.filter("_ends", lambda e: e < F.col(major)))).drop("_ends")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*([major, minor] if minor else [major])))
    numbered = parted.withColumn("_own", own).join(F.broadcast(counts), "_part")  # at most SLICES rows
    return numbered.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_before", "_own", "_part")


def sites(obs: DataFrame) -> DataFrame:
    """(si, x, y): distinct exact coordinates in the order x, then y."""
    return _numbered(obs.select(*SITE).distinct(), "x", "y", "si").select("si", "x", "y")


def times(obs: DataFrame) -> DataFrame:
    """(ti, t): distinct times in order."""
    return _numbered(obs.select("t").distinct(), "t", None, "ti").select("ti", "t")


def grid_last(obs: DataFrame, values: tuple[str, ...] = ("z",)) -> DataFrame:
    """(x, y, t, values): of repeated cells the row of the largest row_id stands."""
    if len(values) == 1:  # a plain value aggregates by hash, a struct by sort
        return obs.groupBy(*CELL).agg(F.max_by(values[0], "row_id").alias(values[0]))
    one = F.max_by(F.struct(*values), "row_id").alias("_v")
    return obs.groupBy(*CELL).agg(one).select(*CELL, *(F.col(f"_v.{v}").alias(v) for v in values))


def grid_mean(obs: DataFrame) -> DataFrame:
    """(x, y, t, z): repeated cells hold their mean."""
    return obs.groupBy(*CELL).agg(F.avg("z").alias("z"))


def indexed(cells: DataFrame) -> DataFrame:
    """(si, ti, x, y, t, ...) of cells."""
    return cells.join(sites(cells), SITE).join(times(cells), "t")


def to_vector(cells: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Cells as rows; with ``keep_missing`` every site at every time, absent ones null."""
    if not keep_missing:
        return cells.where("z is not null")
    return sites(cells).crossJoin(times(cells)).join(cells.select(*CELL, "z"), CELL, "left").select("si", "ti", *CELL, "z")


def lookup_unique(raw: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell's value at each raw point, null where several raw rows share the cell."""
    alone = F.count("*").over(Window.partitionBy(*CELL)) == 1
    return raw.withColumn("_alone", alone).join(cells.select(*CELL, F.col("z").alias("_z")), CELL, "left").withColumn("found", F.when(F.col("_alone"), F.col("_z"))).drop("_alone", "_z")


def residual(cells: DataFrame) -> DataFrame:
    return cells.withColumn("residual", F.col("z") - F.col("tr"))


def bounding_box(obs: DataFrame, x: tuple[float, float], y: tuple[float, float], t: tuple[float, float]) -> DataFrame:
    """Inclusive on every side."""
    return obs.where(F.col("x").between(*x) & F.col("y").between(*y) & F.col("t").between(*t))


def stack(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """Hard rows, then soft rows; ``kind`` tells them apart and orders equal row ids."""
    return hard.withColumn("kind", F.lit("hard")).unionByName(soft.withColumn("kind", F.lit("soft")), allowMissingColumns=True)


def stack_soft(a: DataFrame, b: DataFrame, kind_a: int, kind_b: int) -> DataFrame:
    """Two sets of soft data of one type, first ``a``; arrays keep their own width, which ``nl`` tells."""
    if kind_a != kind_b:
        raise ValueError(f"soft data of types {kind_a} and {kind_b} cannot be one set")
    both = a.withColumn("part", F.lit(1)).unionByName(b.withColumn("part", F.lit(2)))
    return both.withColumns({"pdf_type": F.lit(kind_a), "nl": F.size("limi")})


def identical_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of rows of equal coordinates in two sets."""
    return a.select(F.col("row_id").alias("a_id"), *CELL).join(b.select(F.col("row_id").alias("b_id"), *CELL), CELL).select("a_id", "b_id")


def split_rows(rows: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the chosen row_ids, the rest)."""
    return rows.join(chosen, "row_id", "left_semi"), rows.join(chosen, "row_id", "left_anti")


def work_chunks(points: DataFrame, d: int) -> DataFrame:
    """Points dealt into d partitions by their key."""
    return points.repartition(d, "k_id")


def significant_digits(v: Column, digits: int) -> Column:
    """Rounded to so many significant digits, half away from zero; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * scale) / scale)


def exact_mean(c: str) -> Column:
    """Mean of values as they are written in decimals, whatever the order of adding; the plain one where these don't hold them."""
    written = F.col(c).try_cast("decimal(38,18)")
    exact = F.try_divide(F.try_sum(written).cast("double"), F.count(c))
    return F.coalesce(F.when(F.count(written) == F.count(c), exact), F.avg(c))


def site_summary(cells: DataFrame) -> DataFrame:
    """Per site: occupied cells, mean and population variance."""
    return cells.groupBy(*SITE).agg(F.count("z").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("variance"))


def running_variance(values: Column) -> Column:
    """Population variance of an array, by updates of the mean and the squares in the order of the array."""

    def add(s: Column, v: Column) -> Column:
        n, off = s["n"] + 1, v - s["mean"]
        mean = s["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + off * (v - mean)).alias("squares"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, none, add, lambda s: F.try_divide(s["squares"], s["n"]))


def extent(*parts: DataFrame) -> DataFrame:
    """One row: numbers of sites and times, extents of x, y, t and z over all parts."""
    both = parts[0].select(*CELL, "z")
    for p in parts[1:]:
        both = both.unionByName(p.select(*CELL, "z"))
    low_high = [f(c).alias(f"{c}_{n}") for c in (*CELL, "z") for n, f in (("min", F.min), ("max", F.max))]
    return both.agg(F.countDistinct("x", "y").alias("n_sites"), F.countDistinct("t").alias("n_times"), *low_high)


def envelope(rows: DataFrame) -> DataFrame:
    """mean -/+ 1.96 standard deviations, negative variances as 0."""
    half = 1.96 * F.sqrt(F.greatest("variance", F.lit(0.0)))
    return rows.withColumn("lower", F.col("mean") - half).withColumn("upper", F.col("mean") + half)
