"""Outliers in time, in space, and in both."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.neighbours import within
from fieldloom.operators.rings import ring_nearest
from fieldloom.operators.stages import cut


def flag_series(t: np.ndarray, z: np.ndarray, freq: float, bandwidth: float, k: float = 3.0) -> np.ndarray:
    """Flags of one series in time order.

    Bucket by bucket from the first time's: the values of [start - bandwidth, start + freq) that
    are not flagged yet make mean and population deviation; the bucket's values farther than k
    deviations off are flagged, and count no more in later buckets.
    """
    flagged = np.zeros(len(t), bool)
    start = np.floor(t / freq) * freq
    for s in np.unique(start):
        own = np.arange(*np.searchsorted(t, (s, s + freq)))
        pool = np.arange(*np.searchsorted(t, (s - bandwidth, s + freq)))
        v = z[pool[~flagged[pool]]]
        flagged[own[np.abs(z[own] - v.mean()) > k * v.std()]] = True
    return flagged


def time_outliers(series: DataFrame, freq: float, bandwidth: float, k: float = 3.0) -> DataFrame:
    """(id, t, z, outlier) of every series (id, t, z); a series' buckets follow each other, so it is one task's."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "z"], kind="stable")
        return pdf.assign(outlier=flag_series(pdf["t"].to_numpy(float), pdf["z"].to_numpy(float), freq, bandwidth, k))

    return series.select("id", "t", "z").where("z is not null").groupBy("id").applyInPandas(one, "id long, t double, z double, outlier boolean")


def spatial_outliers(data: DataFrame, bandwidth: float, nmax: int = 100, k: float = 3.0, power: float = 1.5, by: str | None = None) -> DataFrame:
    """Data (h_id, x, y, z) with zhat and outlier.

    Each datum against the inverse-distance mean of its up to nmax neighbours nearer than
    ``bandwidth``, itself among the neighbours but without weight, and k of their population
    deviations.  Where all neighbours stand at one place nothing is flagged.  ``by`` compares
    only data of equal value in that column.
    """
    same = [by] if by else []
    a = data.select(F.col("h_id").alias("k_id"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), *(F.col(c).alias(f"a_{c}") for c in same))
    b = data.select("h_id", F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("z").alias("b_z"), *(F.col(c).alias(f"b_{c}") for c in same))
    both = within(a, b, {"x": bandwidth, "y": bandwidth} | {c: 0 for c in same})
    d = F.sqrt((F.col("a_x") - F.col("b_x")) ** 2 + (F.col("a_y") - F.col("b_y")) ** 2)
    near = both.withColumn("d", d).where(F.col("d") < bandwidth)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("k_id").orderBy("d", "h_id"))).where(F.col("_r") <= nmax)
    w = F.when(F.col("d") == 0, 0.0).otherwise(1 / F.pow(F.col("d"), F.lit(power)))
    got = near.withColumn("w", w).groupBy("k_id").agg(F.try_divide(F.sum(F.col("w") * F.col("b_z")), F.sum("w")).alias("zhat"), F.stddev_pop("b_z").alias("_std"), (F.max("d") > 0).alias("_spread"))
    out = data.join(got.withColumnRenamed("k_id", "h_id"), "h_id", "left")
    flag = F.coalesce(F.col("_spread") & (F.abs(F.col("z") - F.col("zhat")) > k * F.col("_std")), F.lit(False))
    return out.withColumn("outlier", flag).drop("_std", "_spread")


def space_time_outliers(data: DataFrame, t_freq: float, t_bandwidth: float, bandwidth: float, nmax: int = 100, k: float = 3.0, power: float = 1.5) -> DataFrame:
    """Data (h_id, id, x, y, t, z) with outlier_s, outlier_t and outlier, which asks for both."""
    bucketed = data.withColumn("_bucket", F.floor(F.col("t") / t_freq).cast("double"))
    in_space = spatial_outliers(bucketed, bandwidth, nmax, k, power, by="_bucket").withColumnRenamed("outlier", "outlier_s").drop("zhat", "_bucket")
    in_time = time_outliers(data, t_freq, t_bandwidth, k).groupBy("id", "t", "z").agg(F.max("outlier").alias("outlier_t"))
    return in_space.join(in_time, ["id", "t", "z"]).withColumn("outlier", F.col("outlier_s") & F.col("outlier_t"))


def z_scores(series: DataFrame) -> DataFrame:
    """(z - mean) / sample deviation per id, a deviation of 0 or null as 1."""
    w = Window.partitionBy("id")
    std = F.coalesce(F.nullif(F.stddev_samp("z").over(w), F.lit(0.0)), F.lit(1.0))
    return series.withColumn("score", (F.col("z") - F.avg("z").over(w)) / std)


def past_windows(data: DataFrame, freq: float, first: float, step: float, last: float, enough: int, flagged: DataFrame | None = None) -> DataFrame:
    """(bucket, _lo, _hi): the past that each bucket of times may use, everything after ``_lo`` and before ``_hi``.

    ``_hi`` is the bucket's earliest time.  The window grows from ``first`` by ``step`` until it holds
    ``enough`` unflagged data or has passed ``last``.  Counts are made per time, and joined per bucket.
    """
    bucket = F.floor(F.col("t") / freq).cast("long")
    heads = data.groupBy(bucket.alias("bucket")).agg(F.min("t").alias("_hi"))
    widths, w = [], first
    while True:  # at least one step is made
        w += step
        widths.append(w)
        if w > last:
            break
    pool = data if flagged is None else data.join(flagged, "h_id", "left_anti")
    times = pool.groupBy("t").agg(F.count("*").alias("_n")).select(F.col("t").alias("b_t"), "_n")
    near = within(heads.select(F.col("_hi").alias("a_t")), times, {"t": widths[-1]}).where("b_t < a_t")
    held = near.groupBy("a_t").agg(*(F.sum(F.when(F.col("b_t") > F.col("a_t") - v, F.col("_n"))).alias(f"_{i}") for i, v in enumerate(widths)))
    width = F.lit(float(widths[-1]))
    for i in range(len(widths) - 2, -1, -1):
        width = F.when(F.coalesce(F.col(f"_{i}"), F.lit(0)) >= enough, F.lit(float(widths[i]))).otherwise(width)
    return heads.join(held.withColumnRenamed("a_t", "_hi"), "_hi", "left").select("bucket", (F.col("_hi") - width).alias("_lo"), "_hi")


def _causal(data: DataFrame, flagged: DataFrame | None, freq: float, window: tuple[float, float, float, int], nmax: int, dmax_s: float, dmax_t: float, ratio: float, k: float, power: float) -> DataFrame:
    limits = past_windows(data, freq, *window, flagged)
    points = data.withColumn("bucket", F.floor(F.col("t") / freq).cast("long")).join(limits, "bucket").select(F.col("h_id").alias("k_id"), "x", "y", "t", "_lo", "_hi")
    pool = data if flagged is None else data.join(flagged, "h_id", "left_anti")
    radius = (dmax_s**2 + (dmax_t * ratio) ** 2) ** 0.5
    near = ring_nearest(points, pool, nmax, radius, ratio, carry=("t", "score"), between="t")
    w = 1 / F.pow(F.greatest("d", F.lit(1e-10)), F.lit(power))
    found = near.groupBy("k_id").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("expected"))
    out = data.join(found.withColumnRenamed("k_id", "h_id"), "h_id", "left")
    return out.withColumn("outlier", F.coalesce(F.abs(F.col("score") - F.col("expected")) > k, F.lit(False)))


def causal_outliers(data: DataFrame, freq: float, window: tuple[float, float, float, int], nmax: int, dmax_s: float, dmax_t: float, ratio: float, k: float = 3.0, power: float = 2.0, feedback: bool = True) -> DataFrame:
    """Data (id, h_id, x, y, t, z) with ``score``, ``expected`` and ``outlier``: each against what the past says of its place.

    Values are scores within their id.  A datum of a bucket of ``freq`` is expected to be the inverse-distance mean of
    its ``nmax`` nearest data in (x, y, ratio * t) that are earlier than its bucket, within the past of
    ``window`` (first, step, last, enough); it is flagged where it is more than ``k`` off, and not where nothing is near.

    With ``feedback`` flagged data say nothing of later ones.  As flags only act forward in time, repeating the
    whole with the flags found last, until none changes, gives what bucket after bucket would: after n
    rounds the first n buckets are right, and few chains of flags are long.
    """
    own = z_scores(data.where("z is not null"))
    if feedback:
        own = cut(own)  # every round reads the scores several times
    flagged = None
    while True:
        found = cut(_causal(own, flagged, freq, window, nmax, dmax_s, dmax_t, ratio, k, power)) if feedback else _causal(own, None, freq, window, nmax, dmax_s, dmax_t, ratio, k, power)
        if not feedback:
            return found
        now = found.where("outlier").select("h_id")
        changed = now if flagged is None else now.join(flagged, "h_id", "left_anti").union(flagged.join(now, "h_id", "left_anti"))
        if changed.isEmpty():
            return found
        flagged = now
