"""Tables stored with digests of their hash ranges, compared without reading the ranges that agree.

A stored table lies under one folder: ``rows/batch=*/range=*`` holds its
different rows with their ``copies``, ``digests/batch=*`` one line per range.
A digest is the number of rows and two sums of independent 64-bit hashes of the
rows. Sums do not depend on order, count copies and add up over batches, so a
batch that arrives later is digested alone and nothing old is read again.
Ranges of the same hash are compared; only those that differ are read and
subtracted.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditframe.operators.equivalence import _direction, _positional

RANGES = 256
DIGEST = "range INT, ranges INT, types STRING, n DECIMAL(38, 0), low DECIMAL(38, 0), high DECIMAL(38, 0), batch STRING"
# The line that stands for a batch as a whole, so that an empty one is there too.
WHOLE = -1


def _cells(df: DataFrame, columns: list[str]) -> list[Column]:
    """What is hashed of each column: whether it is NULL, then its value.

    Spark's hash passes over NULL and over the borders of nested values, so
    columns say whether they are NULL and nested values are hashed as JSON.
    """
    out = []
    for name in columns:
        nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType))
        out += [F.col(name).isNull(), F.to_json(name) if nested else F.col(name)]
    return out


def put(df: DataFrame, folder: str, batch: str = "0", keys: list[str] | None = None, ranges: int = RANGES) -> None:
    """Add the rows of ``df`` to the stored table as a batch; the first one creates it.

    Rows fall into ranges by the hash of ``keys`` (all columns by default), so
    with keys a changed row stays in its range. A batch has a file or more per
    range, so ``ranges`` should leave each some hundred megabytes. All batches, and all tables to
    be compared, must have the same column types, keys and ``ranges``. The
    batch counts from the moment its digests are written: rows left by an
    attempt that failed before are not read and the next attempt replaces them.
    A batch that is there already is refused.
    """
    spark = df.sparkSession
    known = digests(spark, folder)
    if not known.filter(F.col("batch") == batch).isEmpty():
        raise ValueError(f"batch {batch} is in {folder} already")
    plain = _positional(df)
    types = plain.schema.toNullable().json()
    if not known.filter((F.col("ranges") != ranges) | (F.col("types") != types)).isEmpty():
        raise ValueError(f"{folder} has other columns or another number of ranges")
    by = [f"c{df.columns.index(k)}" for k in keys] if keys else plain.columns
    bag = plain.groupBy(*plain.columns).agg(F.count("*").alias("copies"))
    placed = bag.withColumn("range", F.pmod(F.xxhash64(*_cells(plain, by)), F.lit(ranges)).cast("int"))
    path = f"{folder}/rows/batch={batch}"
    placed.hint("rebalance", "range").write.mode("overwrite").partitionBy("range").parquet(path)

    stored = spark.read.schema(placed.schema).parquet(path)
    cells = _cells(plain, plain.columns)
    copies = F.col("copies").cast("DECIMAL(13, 0)")
    hashed = lambda *first: F.sum(F.xxhash64(*first, *cells).cast("DECIMAL(19, 0)") * copies).cast("DECIMAL(38, 0)")
    zero = F.lit(0).cast("DECIMAL(38, 0)")
    whole = spark.range(1).select(F.lit(WHOLE).alias("range"), zero.alias("n"), zero.alias("low"), zero.alias("high"))
    lines = stored.groupBy("range").agg(F.sum("copies").cast("DECIMAL(38, 0)").alias("n"), hashed().alias("low"), hashed(F.lit(1)).alias("high"))
    lines = lines.unionByName(whole).select("range", F.lit(ranges).alias("ranges"), F.lit(types).alias("types"), "n", "low", "high")
    lines.coalesce(1).write.mode("overwrite").parquet(f"{folder}/digests/batch={batch}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The digests of a stored table per batch and range; no lines where nothing is stored."""
    try:
        return spark.read.schema(DIGEST).parquet(f"{folder}/digests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DIGEST)


def differing_ranges(spark: SparkSession, a: str, b: str) -> DataFrame:
    """The ranges in which two stored tables differ, with their numbers of rows; from the digests alone."""

    def side(folder: str, mark: str) -> DataFrame:
        per = digests(spark, folder).filter(F.col("range") != WHOLE).groupBy("range").agg(*[F.sum(c).cast("DECIMAL(38, 0)").alias(f"{mark}_{c}") for c in ("n", "low", "high")])
        return per.withColumnRenamed("range", f"{mark}_range")

    both = side(a, "a").join(side(b, "b"), F.col("a_range") == F.col("b_range"), "full")
    agree = F.col("a_n").eqNullSafe(F.col("b_n")) & F.col("a_low").eqNullSafe(F.col("b_low")) & F.col("a_high").eqNullSafe(F.col("b_high"))
    rows = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.filter(~agree).select(F.coalesce("a_range", "b_range").alias("range"), rows("a_n").alias("a_rows"), rows("b_n").alias("b_rows"))


def stored_equal(spark: SparkSession, a: str, b: str) -> DataFrame:
    """One row ``equivalent``: do two stored tables hold the same bag of rows? No row of theirs is read.

    Different tables pass for equal only if both 64-bit sums of a range collide.
    """
    return differing_ranges(spark, a, b).agg((F.count("*") == 0).alias("equivalent"))


def rows_of(spark: SparkSession, folder: str, ranges: list[int]) -> DataFrame:
    """The different rows in the given ranges with their ``copies``, of the batches whose digests are written."""
    lines = digests(spark, folder).filter(F.col("range") == WHOLE)
    first = lines.first()
    if first is None:
        raise ValueError(f"nothing is stored in {folder}")
    schema = T.StructType.fromJson(json.loads(first.types)).add("copies", T.LongType()).add("range", T.IntegerType()).add("batch", T.StringType())
    rows = spark.read.schema(schema).parquet(f"{folder}/rows").filter(F.col("range").isin(ranges))
    return rows.join(lines.select("batch"), "batch", "left_semi").drop("batch", "range")


def stored_surplus(spark: SparkSession, a: str, b: str) -> DataFrame:
    """The rows that two stored tables hold in different numbers, with ``surplus`` = copies in ``a`` minus copies in ``b``.

    Columns are named ``c0``, ``c1`` and so on. At most ``ranges`` numbers of
    ranges reach the driver, and they prune the files that are read.
    """
    kinds = digests(spark, a).union(digests(spark, b)).groupBy("ranges").agg(F.count_distinct("types").alias("types"))
    found = kinds.limit(2).collect()
    if len(found) != 1 or found[0].types != 1:
        raise ValueError("the tables differ in column types or in the number of their ranges, or are not stored")
    different = [r.range for r in differing_ranges(spark, a, b).select("range").collect()]
    signed = [rows_of(spark, f, different).withColumn("_d", F.col("copies") * sign).drop("copies") for sign, f in ((1, a), (-1, b))]
    both = signed[0].unionByName(signed[1])
    return both.groupBy(*[c for c in both.columns if c != "_d"]).agg(F.sum("_d").alias("surplus")).filter("surplus <> 0")


def stored_setdiff_counts(spark: SparkSession, a: str, b: str) -> DataFrame:
    """One row: how many rows of each stored table the other lacks, copies included."""
    return stored_surplus(spark, a, b).agg(_direction(1).alias("a_minus_b"), _direction(-1).alias("b_minus_a"))
