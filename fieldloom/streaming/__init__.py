"""The grid, its lag sums and the outlier rule over streams of observations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def grid_last(obs: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming last-wins grid: (x, y, day, z) of observations (row_id, x, y, ts, z), final once the watermark passes."""
    day = F.window("ts", "1 day")
    return obs.withWatermark("ts", delay).groupBy(day, "x", "y").agg(F.max_by("z", "row_id").alias("z")).select("x", "y", F.col("window.start").alias("day"), "z")


def site_sums(obs: DataFrame) -> DataFrame:
    """Running sufficient statistics of sites (n, sum, sum of squares), for update or complete output."""
    z = F.col("z")
    return obs.groupBy("x", "y").agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("ss"))


def lag_sums(products: DataFrame) -> DataFrame:
    """Running n, sums and products of (lag_s, lag_t, l, r) rows; the covariance follows from them."""
    return products.groupBy("lag_s", "lag_t").agg(F.count("*").alias("n"), F.sum("l").alias("sl"), F.sum("r").alias("sr"), F.sum(F.col("l") * F.col("r")).alias("slr"))


def outliers(series: DataFrame, bandwidth: float, k: float = 3.0) -> DataFrame:
    """(id, t, z, outlier) per arriving batch: each value against the unflagged ones of the last ``bandwidth``.

    State per id is what the window holds; values later than the newest of an earlier batch by
    more than the window are judged without it.
    """

    def step(key, frames, state: GroupState):
        kept: list[tuple[float, float]] = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            f = f.sort_values(["t", "z"], kind="stable")
            own = list(zip(f["t"], f["z"], strict=True))
            newest = max(t for t, _ in own)
            pool = [z for t, z in kept if t >= newest - bandwidth] + [z for _, z in own]
            mean, std = pd.Series(pool).mean(), pd.Series(pool).std(ddof=0)
            flags = [bool(abs(z - mean) > k * std) for _, z in own]
            kept = [p for p in kept if p[0] >= newest - bandwidth] + [p for p, bad in zip(own, flags, strict=True) if not bad]
            yield pd.DataFrame({"id": key[0], "t": [t for t, _ in own], "z": [z for _, z in own], "outlier": flags})
        state.update(([t for t, _ in kept], [z for _, z in kept]))

    return series.select("id", "t", "z").groupBy("id").applyInPandasWithState(step, "id long, t double, z double, outlier boolean", "ts array<double>, zs array<double>", "append", GroupStateTimeout.NoTimeout)
