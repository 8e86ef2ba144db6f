"""Shards by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditframe.functions.storage import written
from auditframe.llm._table import packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKET_BYTES = 16 << 20


def text_size(text: str) -> Column:
    """UTF-8 bytes of a text, null being none, plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _fisher_yates(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        n = bucket.num_rows
        # The order that a bucket arrives in is not fixed, so it starts from the order of the row hashes.
        start = np.argsort(bucket.column("_row").to_numpy(), kind="stable")
        order = start[np.random.default_rng([seed, bucket.column("_bucket")[0].as_py()]).permutation(n)]
        shuffled = bucket.take(pa.array(order)).drop_columns(["_row"])
        return shuffled.append_column("_place", pa.array(np.arange(n, dtype=np.int64)))

    return run


def external_shuffle(docs: DataFrame, size: Column, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in a seeded random order, given by ``_bucket`` and ``_place`` (gapless from 0 in a bucket).

    First pass: a seeded hash of the whole row picks one of as many buckets as
    keep their sum of ``size`` near ``bucket_bytes``; the exchange writes them
    out. Second pass: each bucket is loaded, shuffled by Fisher-Yates from a
    seed of its own and written to the shared folder. Rows of one key differ
    somewhere and scatter; rows that repeat in all columns and would fill an
    eighth of a bucket are scattered by row number instead, being
    interchangeable. Memory is bounded by a bucket, or by the longest row.
    """
    # Maps have no hash; their text has one.
    whole = [F.col(f"`{c}`") if "map<" not in kind else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in docs.dtypes]
    hashed = docs.withColumn("_row", F.xxhash64(F.lit(seed), *whole))
    rows, total = hashed.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    # At most 8 * buckets hashes can be that frequent, which bounds the broadcast.
    heavy = hashed.groupBy("_row").count().filter(F.col("count") > max(1, rows / buckets / 8)).select("_row", F.lit(True).alias("_heavy"))
    salted = hashed.withColumn("_id", F.monotonically_increasing_id()).join(F.broadcast(heavy), "_row", "left")
    salt = F.when(F.col("_heavy"), F.col("_id")).otherwise(F.lit(0))
    scattered = salted.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_row", salt), F.lit(buckets)).cast("int"))
    rows = scattered.select(*[F.col(f"`{c}`") for c in docs.columns], "_bucket", "_row")
    schema = StructType([*rows.schema.fields[:-1], StructField("_place", LongType())])
    return written(rows.groupBy("_bucket").applyInArrow(_fisher_yates(seed), schema), "shuffled")


def deal(docs: DataFrame, shards: int = 8, text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows with ``shard`` and ``slot`` (gapless from 0 in a shard): the shuffled order dealt out in turn.

    Row counts of shards differ by one at most (law `rows`). Null texts, empty
    tables and repeated rows are rows like others. Columns of the input called
    ``shard`` or ``slot`` are replaced. Equal texts are no unit here: the
    method scatters records one by one.
    """
    shuffled = external_shuffle(packed(docs.drop("shard", "slot")), text_size(f"row.{text_col}"), seed, bucket_bytes)
    before = F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # One row a bucket: the table of buckets is small against the rows.
    starts = shuffled.groupBy("_bucket").agg(F.count("*").alias("n")).select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    position = F.col("_start") + F.col("_place")
    shard, slot = F.pmod(position, F.lit(shards)).cast("int"), F.floor(position / shards).cast("long")
    return shuffled.join(starts, "_bucket").select("row.*", shard.alias("shard"), slot.alias("slot"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """One folder a shard, rows of a file in slot order."""
    dealt.sortWithinPartitions("shard", "slot").write.mode("errorifexists").partitionBy("shard").parquet(path)
