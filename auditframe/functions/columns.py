"""Column-wise reshaping shared by comparison, profiling and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_VALUE = 64


def typed(df: DataFrame, *kinds: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return typed(df, T.NumericType)


def time_columns(df: DataFrame) -> list[str]:
    return typed(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def string_columns(df: DataFrame) -> list[str]:
    return typed(df, T.StringType, T.VarcharType, T.CharType)


def is_complex(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_complex(f.dataType)]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unpivot_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with every value as a string, NULLs kept: one scan whatever the column count.

    Negative zero is the number zero, as everywhere but in text.
    """
    floating = set(typed(df, T.FloatType, T.DoubleType))
    value = lambda c: (quoted(c) + F.lit(0.0) if c in floating else quoted(c)).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*")


def value_counts(df: DataFrame, columns: list[str], whole_values: bool = True) -> DataFrame:
    """(column, value, n), partially aggregated before the shuffle.

    Without ``whole_values`` long strings travel as their SHA-256, which keeps
    whole documents out of the shuffle when only distinctness matters. Blank
    values stay as they are, so that they can still be told from others.
    """
    cells = unpivot_values(df, columns)
    if not whole_values:
        digest = F.concat(F.lit("sha256:"), F.sha2(F.col("value").cast("binary"), 256))
        cells = cells.withColumn("value", F.when((F.length("value") > LONG_VALUE) & (F.trim("value") != ""), digest).otherwise(F.col("value")))
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def first_values(counts: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct non-null values of each column in value order.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so no task
    holds more than ``limit`` values of a column.
    """
    w = Window.partitionBy("column").orderBy("value")
    return (
        counts.filter("value IS NOT NULL")
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .drop("_rn")
    )


def columns_within(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """The columns with between 1 and ``limit`` distinct values.

    One pass over all columns, in which long strings travel as digests; only
    the names of the chosen columns reach the driver. A second pass can then
    read just those columns.
    """
    if not columns:
        return []
    counts = value_counts(df, columns, whole_values=False).groupBy("column").agg(F.count("value").alias("k"))
    return [r["column"] for r in counts.filter(F.col("k").between(1, limit)).select("column").collect()]


def low_cardinality(df: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """(column, value, n) of the columns that have between 1 and ``limit`` distinct values, NULLs left out."""
    kept = columns_within(df, columns, limit)
    if not kept:
        return df.sparkSession.createDataFrame([], "column STRING, value STRING, n BIGINT")
    return value_counts(df, kept).filter("value IS NOT NULL")


def batches(items: list, size: int) -> list[list]:
    return [items[k : k + size] for k in range(0, len(items), size)]


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out
