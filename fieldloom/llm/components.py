"""Connected components of an edge table, in Spark, by alternating large and small stars.

Each round hangs every neighbourhood on its smallest member; hubs only ever meet a partial
aggregate and a join whose large side Spark may split.  Each round is a written table, so a
lost executor costs one round at most.

Edge cases: edges with a null end are left out; nodes that only meet themselves are not listed; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.shared import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, what: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable; nodes without edges are not listed.

    ``edges`` has u and v (long); self edges and repeated edges do no harm.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()  # no null passes
    e = scratch.table(e, f"{what}-0")
    turn, before = 0, None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, turn = tuple(state), turn + 1
        e = scratch.table(_small_star(_large_star(e)), f"{what}-{turn}")
        scratch.drop(f"{what}-{turn - 1}")
