"""Usage rollups kept fresh by Structured Streaming.

Each job has a batch twin: on a finished stream, the closed hours of
:func:`hourly_usage` and the latest rows of :func:`daily_rollup` equal the
same aggregate over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import merge
from auditframe.operators.io import latest_wins


def hourly_usage(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Agent traffic per hour; an hour is final once the stream is ``late`` past its end. Later rows are dropped."""
    timed = log.filter("space_id IS NOT NULL").withColumn("start_time", F.col("start_time").cast("timestamp"))
    return (
        timed.withWatermark("start_time", late)
        .groupBy(F.window("start_time", "1 hour").alias("w"), "space_id")
        .agg(
            F.count("*").alias("queries"),
            F.sum("task_ms").alias("task_ms"),
            F.count_if(F.col("execution_status") == "FAILED").alias("errors"),
        )
        .select(F.col("w.start").alias("hr"), F.col("w.end").alias("hr_end"), "space_id", "queries", "task_ms", "errors")
    )


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived and append the final rows to a parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def daily_usage(log: DataFrame, late: str | None = None) -> DataFrame:
    """Running totals per agent and day. ``late`` bounds the state: days further back take no more rows."""
    timed = log.filter("space_id IS NOT NULL").withColumn("start_time", F.col("start_time").cast("timestamp"))
    if late:
        timed = timed.withWatermark("start_time", late)
    return (
        timed.groupBy(F.window("start_time", "1 day").alias("w"), "space_id")
        .agg(F.count("*").alias("queries"), F.sum("task_ms").alias("task_ms"), F.max("start_time").alias("last_query_at"))
        .select(F.to_date("w.start").alias("day"), "space_id", "queries", "task_ms", "last_query_at")
    )


def upsert_available(totals: DataFrame, log_path: str, checkpoint: str) -> None:
    """Append the totals that each micro-batch changed to a log, one folder per batch.

    A batch that is run again overwrites its own folder, so the log holds each
    batch once.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    query = (
        totals.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def merge_available(totals: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 16) -> None:
    """Process what has arrived and merge the totals that each micro-batch changed into a table (``operators.merge``).

    The table remembers the last batch of the stream, so a batch that is run
    again after a failure changes nothing.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            done = merge.read_version(spark, path).marks.get(checkpoint, -1)
        except ValueError:
            merge.create_table(batch, path, keys, buckets=buckets, marks={checkpoint: batch_id})
            return
        if batch_id > done:
            merge.merge(batch, path, marks={checkpoint: batch_id})
        else:
            # The state of the stream is kept by computing the batch, even where its rows are merged already.
            batch.write.format("noop").mode("overwrite").save()

    query = totals.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_upserted(spark: SparkSession, log_path: str, keys: list[str]) -> DataFrame:
    """The newest row per key of an upsert log."""
    return latest_wins(spark.read.parquet(log_path), keys, [F.desc("batch_id")]).drop("batch_id")
