"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.functions.storage import written


def _nearest(edges: DataFrame) -> DataFrame:
    """Every (u, v) with ``m``, the smallest of u and its v. Minima are combined before the shuffle, and a hot u splits in the join.

    Edges of few different nodes take far less room in their files than in memory, so Spark must not broadcast them by that size.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.hint("merge").join(least, "u")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` (the smallest node that can be reached) of every node that has an edge to another.

    Rounds go on until a round changes nothing: about the logarithm of the
    longest path. Every round is written to the shared folder, so the plan
    stays short and a lost executor costs one round. No edges give no rows.
    """
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "components"
    )
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        joined = _nearest(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), "components")
