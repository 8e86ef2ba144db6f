"""Row numbers and neighbours within groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.storage import written


def number_rows(df: DataFrame, keys: list[str], part: Column, order: list[Column], name: str = "rn") -> DataFrame:
    """``row_number()`` per key, computed in parts so that a hot key spreads over many tasks.

    ``part`` is an integer that grows with the order (a day, a block of ids).
    Rows are numbered inside (key, part), and each part adds the number of rows
    of the key's earlier parts, taken from the small table of part sizes. The
    result is the exact row number. NULL keys are a key like others, and rows
    of a NULL part come before those of all others.
    """
    cut = df.withColumn("_part", part)
    by = [*keys, "_part"]
    w_all = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_part")).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*by)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(w_all), F.lit(0)))
        .drop("_n")
    )
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    sizes = before.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(by)], "_before")
    same = [local[c].eqNullSafe(sizes[f"_{k}"]) for k, c in enumerate(by)]
    numbered = local.join(sizes, same).withColumn(name, F.col("_local") + F.col("_before"))
    return numbered.select(*df.columns, name)


def ntile(df: DataFrame, tiles: int, value: str, tie: str, name: str = "tile") -> DataFrame:
    """Exact ``NTILE(tiles)`` over the whole frame by descending value, ties by ascending ``tie``.

    A plain window without a partition would move every row into one task.
    Here the rows are range-partitioned by (value, tie), so even a value that
    fills a third of the table is split, and written with the number of their
    part; a row's place is its place in the part plus the sizes of earlier parts.
    """
    ranged = df.withColumn("_neg", -F.col(value)).repartitionByRange("_neg", tie)
    cut = written(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    # One row per part: the ordered windows here are over that small table.
    upto = Window.orderBy("_part")
    before = cut.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part",
        F.coalesce(F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy("_neg", tie)))
    pos = F.col("_local") + F.col("_before") - 1
    small, extra = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    head = extra * (small + 1)
    tile = F.when(pos < head, F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - head) / F.greatest(small, F.lit(1))))
    return local.join(before, "_part").withColumn(name, (tile + 1).cast("int")).drop(
        "_neg", "_part", "_local", "_before", "_total"
    )


def next_time(rows: DataFrame, events: DataFrame, key: str, row_time: str, event_time: str, part_seconds: int) -> DataFrame:
    """Add ``next_time``: the first event of the row's key at or after the row's time, NULL if none.

    Both sides are unioned and read backwards in time inside slices of
    ``part_seconds``; a row with no later event in its slice takes the first
    event of the key's next slice that has one. No pair of rows is built and a
    hot key spreads over its slices.
    """
    cut = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / part_seconds)
    left = rows.select(
        F.col(key).alias("_k"), F.col(row_time).alias("_t"), cut(row_time).alias("_s"),
        F.lit(0).alias("_side"), F.struct(*rows.columns).alias("_row"),
    )
    right = events.select(
        F.col(key).alias("_k"), F.col(event_time).alias("_t"), cut(event_time).alias("_s"),
        F.lit(1).alias("_side"), F.col(event_time).alias("_e"),
    )
    # Backwards in time, events first on equal times: a growing frame costs one step per
    # row, where a frame to the end of the group would be summed anew for each row.
    w = (
        Window.partitionBy("_k", "_s")
        .orderBy(F.desc("_t"), F.desc("_side"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_in", F.min("_e").over(w)).filter("_side = 0")
    slices = (
        left.select("_k", "_s", F.lit(None).cast(events.schema[event_time].dataType).alias("_e"))
        .unionByName(right.select("_k", "_s", "_e"))
        .groupBy("_k", "_s")
        .agg(F.min("_e").alias("_first"))
    )
    later = Window.partitionBy("_k").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.withColumn("_after", F.min("_first").over(later)).drop("_first")
    return both.join(carry, ["_k", "_s"], "left").select("_row.*", F.coalesce("_in", "_after").alias("next_time"))


def kth_free(
    rows: DataFrame, taken: DataFrame, keys: list[str], k: str, number: str, name: str, start: int = 1, block: int = 65536
) -> DataFrame:
    """Add ``name``: the ``k``-th integer from ``start`` on that ``taken`` does not hold for the row's key.

    Of the taken numbers in order, the j-th leaves ``number - start + 1 - j``
    free ones below it, so the answer is ``start - 1 + k`` plus the taken
    numbers that leave fewer than ``k``. They and the rows are unioned and
    counted along that scale, in parts of ``block`` that add the counts of
    earlier parts: no pairs are built, and a hot key spreads over its parts.
    Numbers are BIGINT. NULL keys are a key like others.
    """
    used = taken.filter(F.col(number) >= start).select(*keys, F.col(number).cast("long").alias("_u")).distinct()
    ranked = number_rows(used, keys, F.floor(F.col("_u") / block), [F.col("_u")], "_j")
    free = (F.col("_u") - start + 1 - F.col("_j")).alias("_at")
    # Consecutive taken numbers leave equally many free ones: one row with their number.
    scale = ranked.groupBy(*keys, free).agg(F.count("*").alias("_w"))
    asked = rows.select(*keys, F.col(k).cast("long").alias("_at"), F.lit(0).cast("long").alias("_w"), F.struct(*rows.columns).alias("_row"))
    # A taken number with fewer than k free ones below it counts: on equal places the row comes first.
    both = scale.unionByName(asked, allowMissingColumns=True).withColumn("_part", F.floor(F.col("_at") / block))
    by = [*keys, "_part"]
    within = Window.partitionBy(*by).orderBy("_at", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = both.groupBy(*by).agg(F.sum("_w").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_before")
    counted = both.withColumn("_in", F.sum("_w").over(within)).filter("_row IS NOT NULL")
    same = [counted[c].eqNullSafe(parts[f"_{i}"]) for i, c in enumerate(by)]
    answer = F.lit(start - 1) + F.col("_at") + F.col("_in") + F.col("_before")
    return counted.join(parts, same).select("_row.*", answer.alias(name))
