"""Column profiles as mergeable sketches, stored per part of a table.

A part is read once; profiles of any parts together come from their sketches,
so a table that grows by parts is profiled again without reading what is old.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.columns import LONG_VALUE, batches, numeric_columns, quoted, scalar_columns, time_columns, union_all

# Standard error of the distinct counts, items that a quantile sketch keeps per level (rank error 0.7 per cent; exact
# up to so many values), frequent items tracked.
ERROR, LEVEL, TRACKED = 0.01, 400, 1000
MAX_AGGREGATES = 200


def distinct_sketch(value: Column, error: float = ERROR) -> Column:
    """Of as many registers as the standard error takes. Sketches of different errors merge to the coarser one."""
    registers = min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))
    return F.call_function("hll_sketch_agg", value, F.lit(registers))


def quantile_sketch(value: Column) -> Column:
    return F.call_function("kll_sketch_agg_double", value.cast("double"), F.lit(LEVEL))


def merged_distinct(sketch: str) -> Column:
    return F.call_function("hll_union_agg", F.col(sketch), F.lit(True))


def merged_quantiles(sketch: str) -> Column:
    return F.call_function("kll_merge_agg_double", F.col(sketch))


def distinct_estimate(sketch: str) -> Column:
    return F.call_function("hll_sketch_estimate", F.col(sketch))


def quantile_estimate(sketch: str, share: float) -> Column:
    """The least kept value that so large a share of all values does not exceed; null where there are no values."""
    some = F.call_function("kll_sketch_get_n_double", F.col(sketch)) > 0
    return F.when(some, F.call_function("kll_sketch_get_quantile_double", F.col(sketch), F.lit(float(share))))


def column_sketches(df: DataFrame, error: float = ERROR) -> DataFrame:
    """One row per scalar column: counts of rows and nulls, a sketch of its distinct values, of its frequent ones, and
    for numbers and times (as microseconds) a range and a sketch of quantiles.

    One scan for as many columns as one aggregate takes, and no shuffle of
    values. Values meet as text, long ones as digests; negative zero is zero.
    """
    number, time = set(numeric_columns(df)), set(time_columns(df))
    out = []
    for names in batches(scalar_columns(df), MAX_AGGREGATES // 7):
        aggregates, cells = [F.count(F.lit(1)).alias("rows")], []
        for k, c in enumerate(names):
            own = quoted(c) + F.lit(0.0) if dict(df.dtypes)[c] in ("double", "float") else quoted(c)
            text = own.cast("string")
            text = F.when(F.length(text) > LONG_VALUE, F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))).otherwise(text)
            as_time = F.unix_micros(own.cast("timestamp")) if c in time else own
            as_number = as_time.cast("double") if c in number | time else F.lit(None).cast("double")
            aggregates += [
                F.count(own).alias(f"n{k}"), distinct_sketch(text, error).alias(f"d{k}"), F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias(f"f{k}"),
                quantile_sketch(as_number).alias(f"q{k}"), F.min(as_number).alias(f"l{k}"), F.max(as_number).alias(f"h{k}"),
            ]
            kind = "number" if c in number else "time" if c in time else "label"
            cells.append(
                F.struct(
                    F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col("rows").alias("n_rows"), (F.col("rows") - F.col(f"n{k}")).alias("n_nulls"),
                    F.col(f"d{k}").alias("distinct"), F.col(f"f{k}").alias("frequent"), F.col(f"q{k}").alias("quantiles"), F.col(f"l{k}").alias("low"), F.col(f"h{k}").alias("high"),
                )
            )
        out.append(df.agg(*aggregates).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*"))
    return union_all(out)


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of several parts as those of all of them together."""
    return sketches.groupBy(*keys, "column", "kind").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), merged_distinct("distinct").alias("distinct"),
        F.call_function("approx_top_k_combine", F.col("frequent")).alias("frequent"), merged_quantiles("quantiles").alias("quantiles"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def profile(sketches: DataFrame, *keys: str, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), frequent: int = 3) -> DataFrame:
    """The numbers that sketches stand for: counts, distinct values, range and quantiles of numbers or times, frequent values."""
    own = {f"p{round(100 * q)}": quantile_estimate("quantiles", q) for q in quantiles}
    ranged = {"min": F.col("low"), "max": F.col("high"), **own}
    numbers = [F.when(F.col("kind") == "number", c).alias(f"{n}_number") for n, c in ranged.items()]
    times = [F.when(F.col("kind") == "time", F.timestamp_micros(c.cast("long"))).alias(f"{n}_time") for n, c in ranged.items()]
    # Nulls are counted among the items, and are none here.
    top = F.transform(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(frequent + 1)), lambda x: x["item"])
    top = F.slice(F.filter(top, lambda x: x.isNotNull()), 1, frequent)
    return sketches.select(*keys, "column", "n_rows", "n_nulls", distinct_estimate("distinct").alias("distinct_count"), *numbers, *times, top.alias("frequent_values"))


def append_part(df: DataFrame, path: str, part: str) -> None:
    """Store the sketches of one part of a table; a part stored again replaces itself."""
    column_sketches(df).write.mode("overwrite").parquet(f"{path}/part={part}")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The sketches of all stored parts together."""
    return merge_sketches(spark.read.parquet(path))
