"""Streaming queries: the events table replayed as a stream into a table, which is the result."""

import uuid


from auditframe.functions.storage import session_folder
from auditframe.operators import merge
from auditframe.plans import Family
from auditframe.sources import VIEWS, oracle
from auditframe.streaming import usage as s

FAMILY = Family()


def _folder(i, name: str) -> str:
    return f"{session_folder(i.spark)}/{name}-{uuid.uuid4().hex}"


def _query_log(i, events):
    return i.spark.sql(VIEWS["query_log"], events=events)


@FAMILY.add(
    "st_hourly_usage",
    oracle(
        """SELECT date_trunc('hour', start_time) AS hr, space_id, count(*) AS queries, CAST(sum(task_ms) AS BIGINT) AS task_ms,
                  count(*) FILTER (WHERE execution_status = 'FAILED') AS errors
           FROM query_log WHERE space_id IS NOT NULL
           GROUP BY 1, 2
           HAVING date_trunc('hour', start_time) + INTERVAL 1 HOUR
                  <= (SELECT max(start_time) FROM query_log WHERE space_id IS NOT NULL) - INTERVAL 10 MINUTE""",
        "query_log",
    ),
)
def hourly_usage(i):
    events = i.spark.readStream.schema(i.events.schema).option("pathGlobFilter", "events.parquet").parquet(i.sf_dir)
    out = _folder(i, "hourly")
    s.append_available(s.hourly_usage(_query_log(i, events)), f"{out}/table", f"{out}/checkpoint")
    return i.spark.read.parquet(f"{out}/table").drop("hr_end")


@FAMILY.add(
    "st_daily_rollup",
    oracle(
        """SELECT CAST(start_time AS DATE) AS day, space_id, count(*) AS queries, CAST(sum(task_ms) AS BIGINT) AS task_ms,
                  max(start_time) AS last_query_at
           FROM query_log WHERE space_id IS NOT NULL GROUP BY 1, 2""",
        "query_log",
    ),
)
def daily_rollup(i):
    out = _folder(i, "daily")
    # The events arrive in several files, so that days are updated by several micro-batches.
    i.events.repartition(4, "event_id").write.parquet(f"{out}/arrivals")
    events = i.spark.readStream.schema(i.events.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/arrivals")
    totals = s.daily_usage(_query_log(i, events))
    s.merge_available(totals, f"{out}/table", ["day", "space_id"], f"{out}/checkpoint")
    return merge.read_table(i.spark, f"{out}/table")
