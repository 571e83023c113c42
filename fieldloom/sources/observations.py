"""Reading, generating and writing observations, locations and results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import softdata

#: Fixed value: what missing values become in tables for maps.
NO_DATA = -9999.0


def from_events(events: DataFrame) -> DataFrame:
    """(row_id, x, y, t, z) of the event table: users on a lattice 15 wide, days since 2024-01-01."""
    u = F.col("user_id")
    return events.select(F.col("event_id").alias("row_id"), (u % 15).cast("double").alias("x"), F.floor(u / 15).cast("double").alias("y"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("double").alias("t"), F.col("value").alias("z"))


def lines_of(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(row_id, value): non-blank lines in the order of file names and of places in a file.

    row_id counts all lines from 0; the first ``skip`` of every file are left out.  A block of a file
    is read in order, so a line's place is that in its block and the lines of the blocks before,
    which are counted first: one small row a block.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid"))
    blocks = raw.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("_n").over(w), F.lit(0))
    blocks = blocks.select("_file", "_block", "_first", before(order).alias("_before"), before(in_file).alias("_above"))
    at = F.col("_mid") - F.col("_first")
    lines = raw.join(F.broadcast(blocks), ["_file", "_block"])  # a row a block of the files
    kept = lines.where((at + F.col("_above") >= skip) & (F.trim("value") != ""))
    return kept.select((at + F.col("_before")).alias("row_id"), "value")


def numbers_of(token: Column) -> Column:
    """A number, null for NaN and empty tokens; any other token is an error."""
    text = F.trim(token)
    v = F.when(text != "", text).cast("double")
    return F.when(~F.isnan(v), v)


def read_delimited(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ",", header: bool = False, skip: int = 0) -> DataFrame:
    """Chosen columns, by position from 0, of delimited numbers; any other token is an error.

    row_id is the line's place in the files, in the order of their names.  ``skip`` lines and then
    the header are left out of every file.
    """
    parts = F.split("value", _pattern(sep))
    return lines_of(spark, path, skip + int(header)).select("row_id", *(numbers_of(parts[i]).alias(c) for c, i in columns.items()))


def _pattern(sep: str) -> str:
    return r"\s+" if sep == " " else rf"\s*{_quoted(sep)}\s*"


def _quoted(sep: str) -> str:
    return "\\" + sep if sep in "|.+*?^$()[]{}\\" else sep


def sniff(spark: SparkSession, path: str, sep: str = ",") -> tuple[bool, list[list[str]], int]:
    """(whether the first line is a title, its first 50 rows, number of rows); a title may stand in every file."""
    lines = spark.read.text(path)
    top = [r.value.split(sep) for r in lines.limit(51).collect()]

    def number(s: str) -> bool:
        try:
            float(s)
        except ValueError:
            return False
        return True

    title = bool(top) and not number(top[0][0])
    rows = lines.where(F.col("value") != sep.join(top[0])) if title else lines
    return title, top[int(title) :][:50], rows.count()


def read_user_defined_soft(spark: SparkSession, path: str, sep: str = ",", header: bool = False, skip: int = 0) -> DataFrame:
    """Ragged rows x, y, t, k, then k + 1 limits, then k + 1 densities."""
    p = F.split(F.trim("value"), _pattern(sep))
    k = p[3].cast("int")
    number = lambda a: F.transform(a, numbers_of)
    rows = lines_of(spark, path, skip + int(header))
    return rows.select("row_id", *(numbers_of(p[i]).alias(c) for i, c in enumerate("xyt")), (k + 1).alias("nl"), number(F.slice(p, F.lit(5), k + 1)).alias("limi"), number(F.slice(p, k + 6, k + 1)).alias("probdens"))


def load_soft(spark: SparkSession, path: str, kind: str, sep: str = ",", header: bool = False, skip: int = 0) -> DataFrame:
    """(row_id, x, y, t, pdf, quantile) of a file of soft data: the normalised record and its quantiles.

    ``kind`` is gaussian (x, y, t, mean, variance), uniform (x, y, t, low, up) or user (ragged rows of
    limits and densities, which are made to sum to one).
    """
    if kind == "user":
        rows = read_user_defined_soft(spark, path, sep, header, skip)
        rows = rows.withColumn("p", softdata.normalise(F.col("limi"), F.col("probdens")))
    elif kind in ("gaussian", "uniform"):
        rows = read_delimited(spark, path, {"x": 0, "y": 1, "t": 2, "a": 3, "b": 4}, sep, header, skip)
        limits, density = (softdata.gaussian_limits, softdata.gaussian_density) if kind == "gaussian" else (softdata.uniform_limits, softdata.uniform_density)
        rows = rows.withColumns({"limi": limits(F.col("a"), F.col("b")), "p": density(F.col("a"), F.col("b"))})
    else:
        raise ValueError(f"unknown kind of soft data {kind!r}")
    limi, p = F.col("limi"), F.col("p")
    return rows.select("row_id", "x", "y", "t", softdata.record(F.lit(2), limi, p).alias("pdf"), softdata.quantiles(limi, p).alias("quantile"))


def generate_grid(spark: SparkSession, x: tuple[float, float, int], y: tuple[float, float, int], t: tuple[float, float, int]) -> DataFrame:
    """(k_id, x, y, t): equally spaced points, ends included; x runs fastest, then y, then t."""
    i = F.col("k_id")

    def axis(spec: tuple[float, float, int], at) -> object:
        low, high, n = spec
        return F.lit(float(low)) + at * F.lit((high - low) / (n - 1) if n > 1 else 0.0)

    nx, ny, nt = x[2], y[2], t[2]
    return spark.range(nx * ny * nt).select(F.col("id").alias("k_id")).select("k_id", axis(x, i % nx).alias("x"), axis(y, F.floor(i / nx) % ny).alias("y"), axis(t, F.floor(i / (nx * ny))).alias("t"))


def sites_by_times(sites: DataFrame, t: tuple[float, float, int]) -> DataFrame:
    """Every site at each of n equally spaced times."""
    low, high, n = t
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return sites.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit(step))))


def write_result(result: DataFrame, path: str, sep: str = ",", leading: list[str] = ()) -> None:
    """x, y, t, mean, variance as delimited text, every file after its header; ``leading`` lines go before
    the header, for which the result is written as one file of text."""
    names = ["x", "y", "t", "mean", "variance"]
    if not leading:
        result.select(*names).write.csv(path, header=True, sep=sep, mode="overwrite")
        return
    head = result.sparkSession.createDataFrame([(i, v) for i, v in enumerate([*leading, sep.join(names)])], "i int, value string")
    body = result.select(F.lit(len(leading) + 1).alias("i"), F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names)).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def layer_at(result: DataFrame, t: float) -> DataFrame:
    """One row per site at a time; missing means are NO_DATA."""
    return result.where(F.col("t") == t).select("x", "y", F.coalesce("mean", F.lit(NO_DATA)).alias("mean"))


def resample(lattice: DataFrame, rows: int, cols: int) -> DataFrame:
    """(t, row, col, value): each time of a regular lattice (x, y, t, mean) at rows x cols pixels.

    Bilinear between lattice points, in place of a cubic surface over a triangulation; pixels
    whose lattice cell has a missing corner are NO_DATA.  Row 0 is the northern edge.
    """
    spark = lattice.sparkSession
    box = lattice.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("0", F.min), ("1", F.max))), F.countDistinct("x").alias("nx"), F.countDistinct("y").alias("ny"))
    pixel = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    pixel = pixel.crossJoin(F.broadcast(box)).select(
        "row", "col",
        ((F.col("nx") - 1) * F.col("col") / max(cols - 1, 1)).alias("u"),
        ((F.col("ny") - 1) * (1 - F.col("row") / max(rows - 1, 1))).alias("v"),
    )
    i = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), n - 2))
    pixel = pixel.crossJoin(F.broadcast(box)).select("row", "col", "u", "v", i(F.col("u"), F.col("nx")).alias("i"), i(F.col("v"), F.col("ny")).alias("j"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    pixel = pixel.withColumn("c", corner).select("row", "col", (F.col("i") + F.col("c.a")).alias("i"), (F.col("j") + F.col("c.b")).alias("j"), ((1 - F.abs(F.col("u") - F.col("i") - F.col("c.a"))) * (1 - F.abs(F.col("v") - F.col("j") - F.col("c.b")))).alias("w"))
    place = lambda c: F.coalesce(F.round(F.try_divide(F.col(c) - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")) * (F.col(f"n{c}") - 1)), F.lit(0)).cast("long")
    cell = lattice.crossJoin(F.broadcast(box)).select("t", "mean", place("x").alias("i"), place("y").alias("j"))
    got = pixel.where("w > 0").join(cell, ["i", "j"]).groupBy("t", "row", "col").agg(F.sum(F.col("w") * F.col("mean")).alias("s"), F.sum(F.when(F.col("mean").isNotNull(), F.col("w"))).alias("w"))
    return got.select("t", "row", "col", F.when(F.col("w") > 1 - 1e-9, F.col("s")).otherwise(F.lit(NO_DATA)).alias("value"))


def inside_polygon(x, y, ring: list[tuple[float, float]]):
    """Whether points lie in a polygon, by crossings of a ray to the right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((x2 - x1) / (y2 - y1))
        crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1


def mask(rows: DataFrame, ring: list[tuple[float, float]], value: str = "mean") -> DataFrame:
    """Values outside the polygon become NO_DATA."""
    return rows.withColumn(value, F.when(inside_polygon(F.col("x"), F.col("y"), ring), F.col(value)).otherwise(F.lit(NO_DATA)))


def colour_class(v, low: float, high: float, classes: int = 63):
    """Class 1 to ``classes`` of a value, the top value in the last; 0 below ``low``, none for what is no number.

    The value's share of the range comes first and then the classes, for on a border the order of rounding decides.
    """
    share = (v - F.lit(float(low))) / F.lit(float(high - low))
    own = F.when(v < low, F.lit(0).cast("long")).otherwise(F.least(F.floor(share * classes) + 1, F.lit(classes).cast("long")))
    return F.when(v.isNotNull() & ~F.isnan(v), own)


def save_project(tables: dict[str, DataFrame], settings: dict, path: str) -> None:
    """Tables as Parquet and a JSON manifest of names and settings."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), "settings": settings}),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def load_project(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    spec = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in spec["tables"]}, spec["settings"]
