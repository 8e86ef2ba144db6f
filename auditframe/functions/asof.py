"""Backward as-of match with a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_last_event(
    left: DataFrame,
    events: DataFrame,
    key: str,
    left_time: str,
    event_time: str,
    payload: list[str],
    tie: list[str],
    within_seconds: int,
) -> DataFrame:
    """As-of join: each left row with the latest event of its key at most ``within_seconds`` earlier.

    Both sides are unioned and read in time order, so no pair of rows is ever
    built. Time is cut into slices of the tolerance and each event is placed in
    its own and the next slice: a slice holds all a left row can match, and a
    hot key spreads over its slices. On equal times the smallest ``tie`` wins.
    Left rows without a match are dropped.
    """
    slice_of = lambda c: F.floor(F.unix_timestamp(c) / within_seconds)
    lcols = [c for c in left.columns if c != key]
    lrows = left.select(
        F.col(key).alias("_k"),
        F.col(left_time).alias("_t"),
        slice_of(F.col(left_time)).alias("_s"),
        F.lit(1).alias("_side"),
        F.struct(*lcols).alias("_l"),
    )
    ev = events.select(
        F.col(key).alias("_k"),
        F.col(event_time).alias("_t"),
        F.explode(
            F.array(slice_of(F.col(event_time)), slice_of(F.col(event_time)) + 1)
        ).alias("_s"),
        F.lit(0).alias("_side"),
        F.struct(F.col(event_time).alias("_et"), *dict.fromkeys([*payload, *tie])).alias("_e"),
    )
    both = lrows.unionByName(ev, allowMissingColumns=True)
    w = (
        Window.partitionBy("_k", "_s")
        .orderBy("_t", "_side", *[F.col(f"_e.{t}").desc() for t in tie])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = both.withColumn("_m", F.last("_e", ignorenulls=True).over(w)).filter("_side = 1")
    limit = F.expr(f"_t - INTERVAL {within_seconds} SECONDS")
    return seen.filter(F.col("_m._et") >= limit).select(
        F.col("_k").alias(key), "_l.*", *[F.col(f"_m.{p}").alias(p) for p in payload]
    )
