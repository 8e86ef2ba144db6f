"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: tempfile.TemporaryDirectory | None = None
_to_clear: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where it is unset, a temporary folder serves in local mode, where one
    machine is the cluster. A real cluster has no such folder that all can
    read, so there the setting is demanded.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="auditframe-")
    return _local_folder.name


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; it is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/auditframe/{spark.sparkContext.applicationId}"
    if folder not in _to_clear:
        _to_clear.add(folder)
        atexit.register(clear, spark)
    return folder


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames that read them can no longer be computed."""
    # At the end of the program the session may be gone, and then nothing can be deleted through it.
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/auditframe/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, spread_by: str | None = None) -> DataFrame:
    """Write a frame once and read it back: later steps start from the table, also after executors are lost.

    For frames that several later steps read; the table keeps column pruning.
    ``spread_by`` writes one file per shuffle partition by that column. Without
    it Spark merges small partitions, which leaves a table that is small in
    bytes but costly to process to a few tasks.
    """
    spark = df.sparkSession
    if spread_by:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), spread_by)
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
