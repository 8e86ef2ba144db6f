"""Table reads and writes: filtered scans, guarded writes, upserts over an append log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_filtered(
    spark: SparkSession, path: str, filters: dict[str, object], schema: T.StructType | None = None
) -> DataFrame:
    """Rows of a parquet table that equal every given value; a missing table reads as empty.

    The filters are plain equalities, so they reach the scan as pushed filters.
    """
    try:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND" or schema is None:
            raise
        return spark.createDataFrame([], schema)
    for name, value in filters.items():
        df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; a column the frame lacks becomes NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def append(df: DataFrame, path: str, schema: T.StructType) -> None:
    conform(df, schema).write.mode("append").parquet(path)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def overwrite_unique(df: DataFrame, path: str, keys: list[str]) -> None:
    """Overwrite a table, refusing a frame whose key repeats."""
    clash = duplicate_keys(df, keys).limit(5).collect()
    if clash:
        raise ValueError(f"duplicate key {keys}: {[tuple(r) for r in clash]}")
    df.write.mode("overwrite").parquet(path)


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key in ``order``: the reader's side of an upsert over an append log.

    ``row_number() == 1`` lets Spark prune every task's rows to one per key
    before the shuffle (WindowGroupLimit), so a hot key never gathers whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def stamp(df: DataFrame, flag: str, predicate: Column) -> DataFrame:
    """Set a flag on every row from one predicate; NULL counts as false."""
    return df.withColumn(flag, F.coalesce(predicate, F.lit(False)))


def with_hash(df: DataFrame, column: str, hash_column: str = "content_hash") -> DataFrame:
    return df.withColumn(hash_column, F.sha2(F.col(column).cast("binary"), 256))


def hash_mismatches(df: DataFrame, column: str, hash_column: str = "content_hash") -> DataFrame:
    """Rows whose stored hash is missing or is not the hash of the column."""
    actual = F.sha2(F.col(column).cast("binary"), 256)
    return df.filter(~F.col(hash_column).eqNullSafe(actual))


def parse_json_column(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Replace a JSON string column by a typed struct; malformed text becomes NULL fields."""
    return df.withColumn(column, F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"}))


def preview(df: DataFrame, order: list[str], columns: int = 20, rows: int = 5) -> DataFrame:
    """First columns and rows in a stated order."""
    return df.orderBy(*order).limit(rows).select(*df.columns[:columns])
