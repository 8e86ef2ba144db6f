"""Documents to shards: quality, near copies, benchmark leaks, mix, shards; each stage is written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.functions.storage import session_folder
from auditframe.llm import decontaminate, gam, raking, sharding, simhash
from auditframe.llm._table import fold, packed, read
from auditframe.llm.queries import MIX

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it learns from labels outside the held-out fifth."""
    model = gam.learn(docs, read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0))
    return gam.score(packed(docs, text=F.col("text")), model).filter("predicted = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.drop_leaking(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to the target marginals."""
    keyed = packed(docs, **{c: F.col(c) for c in ("doc_id", "text", "lang", "source")})
    return raking.mix(keyed, MIX).filter("sampled").select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it."""
    return sharding.deal(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", leaks),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

# SQL has no fitted model and no XXH64; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns lies in the shared folder before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{session_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
