"""A stored index of vectors by random hyperplanes, for approximate best matches by cosine.

Every vector has a signature of ``bits`` sides of random hyperplanes in each of
several tables. A query looks into the buckets of its own signature and of those
that flip the sides it is nearest to, and what it meets is scored exactly. The
index is a parquet table of one row per vector; batches are appended without
reading what is there.
"""

from __future__ import annotations

import json
import math
import sys
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The sides that a query may flip are chosen among so many nearest ones, at most so many at once.
NEAREST_SIDES, MOST_FLIPS = 8, 4


@lru_cache(maxsize=8)
def _planes(dims: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, tables * bits))


def _margins(values: pd.Series, shape: tuple[int, int, int, int]) -> np.ndarray:
    """(row, table, bit): how far each vector lies on which side of each plane."""
    dims, bits, tables, _ = shape
    m = np.stack([np.asarray(v, dtype="float64") for v in values]) if len(values) else np.zeros((0, dims))
    return (m @ _planes(*shape)).reshape(-1, tables, bits)


def _buckets(margins: np.ndarray) -> np.ndarray:
    return (margins > 0) @ (np.int64(1) << np.arange(margins.shape[2], dtype=np.int64))


def signatures(vector: Column, shape: tuple[int, int, int, int]) -> Column:
    """The bucket of each table."""
    return F.pandas_udf(lambda v: pd.Series(list(_buckets(_margins(v, shape)))), "array<long>")(vector)


def probes(vector: Column, shape: tuple[int, int, int, int], number: int) -> Column:
    """Per table the ``number`` buckets most likely to hold near vectors: own sides first, then those the vector is nearest to flipped."""

    def run(values: pd.Series) -> pd.Series:
        margins = _margins(values, shape)
        near = min(NEAREST_SIDES, margins.shape[2])
        sets = np.array([[i in c for i in range(near)] for n in range(min(MOST_FLIPS, near) + 1) for c in combinations(range(near), n)])
        low = np.argsort(np.abs(margins), axis=2)[:, :, :near]
        cost = np.take_along_axis(margins, low, 2) ** 2 @ sets.T
        chosen = np.argsort(cost, axis=2, kind="stable")[:, :, :number]
        flips = sets[chosen] @ (np.int64(1) << low.astype(np.int64))[..., None]
        found = _buckets(margins)[..., None] ^ flips[..., 0]
        return pd.Series([row.ravel() for row in found])

    return F.pandas_udf(run, "array<long>")(vector)


def _distinct(df: DataFrame, id_: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(id, key) of all rows that have a direction, and one row per distinct vector: least id, unit vector."""
    rows = df.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    )
    rows = rows.withColumn("key", F.sha2(F.to_json("v").cast("binary"), 256))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    texts = rows.groupBy("key").agg(F.min("id").alias("id"), F.any_value("v").alias("v"))
    return rows.select("id", "key"), texts.select("key", "id", F.transform("v", lambda x: x / norm).alias("v"))


def _meta(spark: SparkSession, path: str) -> tuple[int, int, int, int]:
    told = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return told["dims"], told["bits"], told["tables"], told["seed"]


def append_vectors(vectors: DataFrame, path: str, batch: str, id_: str, vector: str = "embedding") -> None:
    """File one batch. Nothing that is already in the index is read; a batch written again replaces itself.

    Vectors of another dimension than the index are refused.
    """
    shape = _meta(vectors.sparkSession, path)
    _, distinct = _distinct(vectors, id_, vector)
    v = F.when(F.size("v") == shape[0], F.col("v")).otherwise(F.raise_error(F.lit(f"the index holds vectors of {shape[0]} dimensions")))
    distinct = distinct.withColumn("v", v)
    distinct.withColumn("buckets", signatures(F.col("v"), shape)).write.mode("overwrite").parquet(f"{path}/vectors/batch={batch}")


def create_index(
    vectors: DataFrame, path: str, id_: str, vector: str = "embedding", bits: int | None = None, tables: int = 4, seed: int = 7, batch: str = "0"
) -> None:
    """Write an index of a first batch.

    ``bits`` defaults to the logarithm of the number of vectors and five more,
    which keeps buckets small; an index that has grown many times over is
    created anew.
    """
    spark = vectors.sparkSession
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dims")).first()
    bits = bits or min(60, math.ceil(math.log2(max(seen["n"], 2))) + 5)
    told = json.dumps({"dims": max(seen["dims"] or 1, 1), "bits": bits, "tables": tables, "seed": seed})
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    append_vectors(vectors, path, batch, id_, vector)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Indexed vectors; those that came in several batches count once, under the least id."""
    return spark.read.parquet(f"{path}/vectors").select("key", "id", "v", "buckets")


def candidates(left: DataFrame, path: str, number: int = 32) -> DataFrame:
    """(l, r): keys of the vectors of ``left`` (``key``, ``v``) and of the indexed ones that share a bucket, each pair once."""
    shape = _meta(left.sparkSession, path)
    table = lambda name, own: F.posexplode(own).alias("t", name)
    opened = left.select(F.col("key").alias("l"), probes(F.col("v"), shape, number).alias("p"))
    # The probes of a table follow each other.
    asked = opened.select("l", (F.size("p") / shape[2]).cast("int").alias("each"), table("bucket", F.col("p")))
    asked = asked.select("l", F.expr("cast(t div each AS int)").alias("t"), "bucket")
    filed = _read(left.sparkSession, path).select(F.col("key").alias("r"), table("bucket", F.col("buckets")))
    return asked.join(filed, ["t", "bucket"]).select("l", "r").distinct()


def best_in_index(left: DataFrame, path: str, threshold: float, left_id: str, vector: str = "embedding", number: int = 32) -> DataFrame:
    """(left_id, match, score): of the indexed vectors that a row meets, the most similar with cosine >= ``threshold``.

    Scores are exact; what may be missed are matches in buckets that none of
    the ``number`` probes per table opens. Equal vectors collapse on both
    sides, the match of equal ones is the least id. Vectors without a
    direction (null, zero, not finite) match nothing.
    """
    rows, distinct = _distinct(left, left_id, vector)
    shape = _meta(left.sparkSession, path)
    distinct = distinct.filter(F.size("v") == shape[0])
    found = candidates(distinct, path, number)
    filed = _read(left.sparkSession, path).groupBy("key").agg(F.min("id").alias("match"), F.any_value("v").alias("w"))
    both = found.join(filed.withColumnRenamed("key", "r"), "r").join(distinct.select(F.col("key").alias("l"), "v"), "l")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("l", "match", score.alias("score")).filter(F.col("score") >= threshold)
    best = scored.groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("s"), "match")).alias("m"))
    return rows.join(best, rows["key"] == best["l"]).select(F.col("id").alias(left_id), F.col("m.match").alias("match"), (-F.col("m.s")).alias("score"))
