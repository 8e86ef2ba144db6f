"""Usage, cost and feedback queries. Windows cover the whole log (30 days to 2024-01-31)."""

import datetime as dt

from pyspark.sql import functions as F

from auditframe.functions.storage import written
from auditframe.operators import usage as u
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()
AS_OF = dt.date(2024, 1, 31)
DAYS = 31

_SINCE = "TIMESTAMP '2023-12-31 00:00:00'"

# Written from the definition, query by query: no pre-aggregation, plain joins.
_HOUR_COST = f"""
  hour_cost AS (
    SELECT b.warehouse_id, date_trunc('hour', b.usage_start_time) AS hr,
           sum(b.usage_quantity) AS dbus,
           sum(b.usage_quantity * coalesce(p.list_price, 0)) AS usd
    FROM billing_usage b LEFT JOIN list_prices p
      ON p.sku_name = b.sku_name AND p.cloud = b.cloud AND b.usage_start_time >= p.price_start_time
     AND b.usage_start_time < coalesce(p.price_end_time, TIMESTAMP '9999-01-01 00:00:00')
    WHERE b.warehouse_id IS NOT NULL AND b.usage_start_time >= {_SINCE}
    GROUP BY ALL)"""
_PER_QUERY = f"""
  timed AS (SELECT *, date_trunc('hour', start_time) AS hr FROM query_log
            WHERE start_time >= {_SINCE} AND task_ms > 0),
  busy AS (SELECT warehouse_id, hr, sum(task_ms) AS ms FROM timed GROUP BY ALL),
  per_query AS (
    SELECT t.*, t.task_ms / busy.ms * coalesce(c.dbus, 0) AS q_dbus,
           t.task_ms / busy.ms * coalesce(c.usd, 0) AS q_usd
    FROM timed t JOIN busy USING (warehouse_id, hr)
    LEFT JOIN hour_cost c USING (warehouse_id, hr)
    WHERE t.space_id IS NOT NULL)"""
_COST_VIEWS = ("query_log", "billing_usage", "list_prices")


def _cost_oracle(select: str, *more_views: str) -> str:
    return oracle(f"WITH {_HOUR_COST}, {_PER_QUERY} {select}", *_COST_VIEWS, *more_views)


@FAMILY.add(
    "uc_hourly_cost",
    oracle(
        f"""WITH {_HOUR_COST}
        SELECT warehouse_id, hr, round(dbus, 6) AS dbus, round(usd, 6) AS usd FROM hour_cost""",
        "billing_usage", "list_prices",
    ),
)
def hourly_cost(i):
    usage = i.billing_usage.filter(u.since("usage_start_time", AS_OF, DAYS))
    return u.hourly_cost(usage, i.list_prices).select(
        "warehouse_id", "hr", F.round("dbus", 6).alias("dbus"), F.round("usd", 6).alias("usd")
    )


_DAILY = """SELECT space_id, CAST(start_time AS DATE) AS day, warehouse_id,
                   CAST(count(*) AS BIGINT) AS query_count,
                   round(sum(q_dbus), 6) AS approx_dbus, round(sum(q_usd), 6) AS approx_usd
            FROM per_query GROUP BY ALL"""


def _daily_cost(i):
    return u.cost_daily(i.query_log, i.billing_usage, i.list_prices, AS_OF, DAYS)


@FAMILY.add("uc_cost_per_space", _cost_oracle(_DAILY))
def cost_per_space(i):
    return _daily_cost(i)


@FAMILY.add(
    "uc_top_spenders",
    _cost_oracle(
        """SELECT space_id, workspace_id, count(*) AS query_count, round(sum(q_usd), 6) AS approx_usd
           FROM per_query GROUP BY ALL ORDER BY approx_usd DESC NULLS LAST, space_id, workspace_id LIMIT 10"""
    ),
)
def top_spenders(i):
    return u.top_spenders(i.query_log, i.billing_usage, i.list_prices, AS_OF, DAYS, 10)


@FAMILY.add(
    "uc_cost_per_conversation",
    _cost_oracle(
        """, candidates_ AS (
             SELECT q.space_id, q.statement_id, q.start_time, q.q_usd, a.conversation_id, a.user_email,
                    row_number() OVER (PARTITION BY q.statement_id
                                       ORDER BY a.event_time DESC, a.conversation_id, a.user_email) AS nearest
             FROM per_query q JOIN audit_events a
               ON a.space_id = q.space_id AND a.event_time <= q.start_time
              AND a.event_time >= q.start_time - INTERVAL 600 SECOND
             WHERE a.conversation_id IS NOT NULL),
           per_conversation AS (
             SELECT space_id, conversation_id, min(user_email) AS user_email,
                    min(start_time) AS first_query_at, max(start_time) AS last_query_at,
                    count(*) AS query_count, round(sum(q_usd), 8) AS approx_usd
             FROM candidates_ WHERE nearest = 1 GROUP BY ALL)
           SELECT * FROM per_conversation
           QUALIFY row_number() OVER (PARTITION BY space_id
                                      ORDER BY approx_usd DESC NULLS LAST, conversation_id) <= 50""",
        "audit_events",
    ),
)
def cost_per_conversation(i):
    return u.cost_per_conversation(
        i.query_log, i.billing_usage, i.list_prices, i.audit_events, AS_OF, DAYS, 50, digits=8
    )


@FAMILY.add(
    "uc_cost_by_warehouse",
    _cost_oracle(
        f""", daily AS ({_DAILY})
        SELECT space_id, coalesce(warehouse_id, '(unknown)') AS warehouse_id,
               CAST(sum(query_count) AS BIGINT) AS query_count,
               round(sum(approx_dbus), 4) AS approx_dbus, round(sum(approx_usd), 4) AS approx_usd
        FROM daily GROUP BY 1, 2
        UNION ALL
        SELECT space_id, '(all)', CAST(sum(query_count) AS BIGINT),
               round(sum(approx_dbus), 4), round(sum(approx_usd), 4)
        FROM daily GROUP BY 1"""
    ),
)
def cost_by_warehouse(i):
    return u.cost_by_warehouse(_daily_cost(i))


_DAILY_USAGE = f"""
  SELECT space_id, CAST(start_time AS DATE) AS day, count(*) AS queries,
         quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms,
         count(*) FILTER (WHERE execution_status = 'FAILED') AS errors,
         count(DISTINCT executed_by) AS distinct_users
  FROM query_log WHERE space_id IS NOT NULL AND start_time >= {_SINCE} GROUP BY 1, 2"""


@FAMILY.add("uc_daily_usage", oracle(_DAILY_USAGE, "query_log"))
def daily_usage(i):
    return u.daily_usage(i.query_log, AS_OF, DAYS)


# The durations of an agent's day fit its sketch at the scale of the comparison, where it is exact.
@FAMILY.add(
    "uc_daily_sketch",
    oracle(
        """SELECT space_id, CAST(start_time AS DATE) AS day, count(*) AS queries,
                  quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms,
                  count(*) FILTER (WHERE execution_status = 'FAILED') AS errors, count(DISTINCT executed_by) AS distinct_users
           FROM query_log WHERE space_id IS NOT NULL GROUP BY 1, 2""",
        "query_log",
    ),
)
def daily_sketch(i):
    """Daily usage from sketches that two halves of the log leave behind."""
    half = F.coalesce(F.hash("statement_id") % 2 == 0, F.lit(True))
    parts = written(u.usage_sketches(i.query_log.filter(half)).union(u.usage_sketches(i.query_log.filter(~half))), "usage-sketches")
    return u.merged_usage(parts, "space_id", "day")


@FAMILY.add(
    "uc_usage_totals",
    oracle(
        f"""SELECT space_id, CAST(sum(queries) AS BIGINT) AS queries, CAST(sum(errors) AS BIGINT) AS errors,
                   max(distinct_users) AS max_daily_users FROM ({_DAILY_USAGE}) GROUP BY 1""",
        "query_log",
    ),
)
def usage_totals(i):
    return u.usage_totals(u.daily_usage(i.query_log, AS_OF, DAYS))


@FAMILY.add(
    "uc_usage_summary",
    oracle(
        f"""SELECT space_id, count(*) AS queries, count(DISTINCT executed_by) AS distinct_users,
                   max(start_time) AS last_query_at
            FROM query_log WHERE space_id IS NOT NULL AND start_time >= {_SINCE} GROUP BY 1""",
        "query_log",
    ),
)
def usage_summary(i):
    return u.usage_summary(i.query_log, AS_OF, DAYS)


@FAMILY.add(
    "uc_kpis",
    _cost_oracle(
        f"""SELECT count(DISTINCT space_id) AS active_spaces, count(*) AS total_queries,
                   count(DISTINCT executed_by) AS distinct_users, round(sum(q_usd), 2) AS approx_usd,
                   (SELECT count(*) FROM audit_events
                    WHERE feedback_rating = 'THUMBS_UP' AND event_time >= {_SINCE}) AS pos_feedback,
                   (SELECT count(*) FROM audit_events
                    WHERE feedback_rating = 'THUMBS_DOWN' AND event_time >= {_SINCE}) AS neg_feedback
            FROM per_query""",
        "audit_events",
    ),
)
def kpis(i):
    return u.kpis(i.query_log, i.billing_usage, i.list_prices, i.audit_events, AS_OF, DAYS)


@FAMILY.add(
    "uc_daily_zero_fill",
    oracle(
        f"""SELECT d.day, count(q.start_time) AS queries
            FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-31', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE)
                         AS day) d
            LEFT JOIN query_log q ON CAST(q.start_time AS DATE) = d.day AND q.space_id IS NOT NULL
            GROUP BY 1""",
        "query_log",
    ),
)
def daily_zero_fill(i):
    return u.daily_volume(i.query_log, AS_OF, DAYS)


@FAMILY.add(
    "uc_top_queries",
    types={"rank": "INTEGER"},
    oracle_sql=oracle(
        f"""SELECT space_id, row_number() OVER (PARTITION BY space_id
                                               ORDER BY duration_ms DESC NULLS LAST, statement_id) AS rank,
                  statement_id, executed_by, start_time, duration_ms, execution_status, statement_text
           FROM query_log WHERE space_id IS NOT NULL AND start_time >= {_SINCE} QUALIFY rank <= 20""",
        "query_log",
    ),
)
def top_queries(i):
    return u.top_queries(i.query_log, AS_OF, DAYS, 20)


_RATED = f"""
  rated AS (SELECT event_time, user_email, space_id,
                   CASE feedback_rating WHEN 'THUMBS_UP' THEN 'POSITIVE' WHEN 'THUMBS_DOWN' THEN 'NEGATIVE'
                        ELSE feedback_rating END AS rating, comment, message_id, conversation_id
            FROM audit_events
            WHERE feedback_rating IS NOT NULL AND space_id IS NOT NULL AND event_time >= {_SINCE})"""
_PER_SPACE = """
  SELECT space_id, sum((rating = 'POSITIVE')::INT)::BIGINT AS positive,
         sum((rating = 'NEGATIVE')::INT)::BIGINT AS negative, count(*) AS total,
         max(event_time) AS last_feedback_at,
         round(100.0 * sum((rating = 'NEGATIVE')::INT) / count(*), 1) AS neg_rate_pct
  FROM rated GROUP BY 1"""


@FAMILY.add(
    "uc_feedback_events",
    oracle(
        f"""WITH {_RATED} SELECT * FROM rated
            QUALIFY row_number() OVER (PARTITION BY space_id ORDER BY event_time DESC, message_id) <= 200""",
        "audit_events",
    ),
)
def feedback_events(i):
    return u.latest_feedback(i.audit_events, AS_OF, DAYS, 200)


@FAMILY.add("uc_feedback_per_space", oracle(f"WITH {_RATED} {_PER_SPACE}", "audit_events"))
def feedback_per_space(i):
    return u.feedback_per_space(i.audit_events, AS_OF, DAYS)


@FAMILY.add(
    "uc_feedback_trend",
    oracle(
        f"""WITH {_RATED}
        SELECT d.day, count(*) FILTER (WHERE rating = 'POSITIVE') AS positive,
               count(*) FILTER (WHERE rating = 'NEGATIVE') AS negative
        FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE)
                     AS day) d
        LEFT JOIN rated r ON CAST(r.event_time AS DATE) = d.day GROUP BY 1""",
        "audit_events",
    ),
)
def feedback_trend(i):
    return u.feedback_trend(i.audit_events, AS_OF, DAYS)


@FAMILY.add(
    "uc_feedback_summary",
    oracle(
        f"""WITH {_RATED}
        SELECT count(*) FILTER (WHERE rating = 'POSITIVE') AS positive,
               count(*) FILTER (WHERE rating = 'NEGATIVE') AS negative,
               count(*) AS total,
               round(100.0 * count(*) FILTER (WHERE rating = 'NEGATIVE') / count(*), 1) AS neg_rate_pct
        FROM rated WHERE rating IN ('POSITIVE', 'NEGATIVE')""",
        "audit_events",
    ),
)
def feedback_summary(i):
    return u.feedback_summary(u.feedback_per_space(i.audit_events, AS_OF, DAYS))


@FAMILY.add(
    "uc_space_listing",
    _cost_oracle(
        f""", {_RATED}, fb AS ({_PER_SPACE}),
        traffic AS (SELECT space_id, count(*) AS queries, max(start_time) AS last_query_at
                    FROM query_log WHERE space_id IS NOT NULL AND start_time >= {_SINCE} GROUP BY 1),
        by_workspace AS (SELECT space_id, workspace_id, round(sum(q_usd), 6) AS usd FROM per_query GROUP BY ALL),
        spend AS (SELECT space_id, round(sum(usd), 4) AS cost_usd FROM by_workspace GROUP BY 1)
        SELECT a.space_id, a.title, coalesce(t.queries, 0) AS queries, t.last_query_at,
               coalesce(s.cost_usd, 0) AS cost_usd, coalesce(fb.positive, 0) AS positive,
               coalesce(fb.negative, 0) AS negative
        FROM agents a LEFT JOIN traffic t USING (space_id) LEFT JOIN spend s USING (space_id)
        LEFT JOIN fb USING (space_id)""",
        "audit_events", "agents",
    ),
)
def space_listing(i):
    spend = u.attributed_cost(i.query_log, i.billing_usage, i.list_prices, AS_OF, DAYS)
    spend = spend.groupBy("space_id", "workspace_id").agg(F.round(F.sum("usd"), 6).alias("approx_usd"))
    return u.space_listing(
        i.agents,
        u.usage_summary(i.query_log, AS_OF, DAYS),
        spend,
        u.feedback_per_space(i.audit_events, AS_OF, DAYS),
    )


@FAMILY.add(
    "uc_fail_closed_scope",
    oracle(
        """SELECT 'ws0' AS scope, count(*) AS n FROM query_log WHERE workspace_id = 'ws0'
           UNION ALL SELECT '(unresolved)', 0""",
        "query_log",
    ),
)
def fail_closed_scope(i):
    def n(label, workspace):
        return u.scope(i.query_log, workspace).agg(F.count("*").alias("n")).select(F.lit(label).alias("scope"), "n")

    return n("ws0", "ws0").unionByName(n("(unresolved)", None))


@FAMILY.add(
    "uc_dedup_comments",
    oracle(
        """WITH clean AS (SELECT message_id, trim(content) AS content, ordinal, created_at, user_id
                          FROM message_comments WHERE trim(content) <> ''),
           firsts AS (SELECT * FROM clean
                      QUALIFY row_number() OVER (PARTITION BY message_id, content ORDER BY ordinal) = 1)
           SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY ordinal) <= 20""",
        "message_comments",
    ),
)
def dedup_comments(i):
    return u.dedup_comments(i.message_comments, 20)


@FAMILY.add(
    "uc_conversations",
    oracle(
        """SELECT conversation_id, count(*) AS message_count, max(created_at) AS last_message_at,
                  bool_or(status IN ('COMPLETED', 'QUERY_RESULT_EXPIRED')) AS has_sql
           FROM messages GROUP BY 1 ORDER BY last_message_at DESC, conversation_id LIMIT 50""",
        "messages",
    ),
)
def conversations(i):
    has_sql = F.col("status").isin("COMPLETED", "QUERY_RESULT_EXPIRED")
    return u.conversation_rollup(i.messages.withColumn("has_sql", has_sql), 50)
