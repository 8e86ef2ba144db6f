"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: the white space of ASCII, which separates words throughout.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; Spark opens the path, which may be one that only Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of a table as the struct ``row``, next to the given ones, so that no name can clash; ``row.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key's text modulo a number; null keys stay null."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


# Strata that a sample draws from: the largest ones.
MOST_STRATA = 512


def bounded_sample(df: DataFrame, stratum: str | None, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` different rows of every stratum (without one, of all rows), those of the smallest seeded hash.

    Only hashes are ranked. A hash below four times the share that ``rows``
    is of the different rows of its stratum (as a sketch counts them) passes first, so that ranks are taken of about four times
    ``rows`` hashes, however large a stratum; the chance that fewer than
    ``rows`` pass is beyond notice. Of many strata the MOST_STRATA largest are
    drawn from, so the chosen hashes number at most ``rows`` times that, which
    bounds their broadcast and that of the strata's sizes.
    """
    of = F.lit(0) if stratum is None else F.col(stratum)
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(df.columns)]))
    marks = hashed.select(of.alias("_of"), "_h")
    sizes = marks.groupBy("_of").agg(F.approx_count_distinct("_h").alias("_n"))
    sizes = sizes.orderBy(F.desc("_n"), "_of").limit(MOST_STRATA)
    share = F.col("_h") / F.lit(float(1 << 64)) + 0.5
    low = marks.join(F.broadcast(sizes), "_of").filter(share * F.col("_n") <= 4 * rows).select("_of", "_h").distinct()
    rank = F.row_number().over(Window.partitionBy("_of").orderBy("_h"))
    chosen = low.withColumn("_r", rank).filter(F.col("_r") <= rows).select("_h")
    return hashed.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"]).drop("_h")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts take about ``most_bytes`` or are one row."""
    texts = batch.column(column)
    start = size = 0
    for row, length in enumerate(_lengths(texts)):
        if row > start and size + length > most_bytes:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(texts: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()
