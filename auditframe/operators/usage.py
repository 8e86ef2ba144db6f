"""Usage, cost and feedback analytics over a query log, billing rows and audit events.

Windows end at an explicit ``as_of`` date. Cost is attributed by a query's
share of the task time of its warehouse and hour, over *all* traffic there.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions import sketches
from auditframe.functions.asof import match_last_event

UNKNOWN_WAREHOUSE = "(unknown)"
ALL = "(all)"

# Rating names of the audit log and their normal form.
RATING_NAMES = {"THUMBS_UP": "POSITIVE", "THUMBS_DOWN": "NEGATIVE"}


def scope(df: DataFrame, workspace_id: str | None, column: str = "workspace_id") -> DataFrame:
    """Rows of one workspace; an unresolved workspace yields no rows at all."""
    if not workspace_id:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) == workspace_id)


def since(column: str, as_of: dt.date, days: int) -> Column:
    """Rows at or after the midnight ``days`` before ``as_of``; reaches the scan as a filter."""
    return F.col(column) >= F.lit(dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=days))


def _hour(column: str) -> Column:
    return F.date_trunc("hour", F.col(column))


# ---- cost ------------------------------------------------------------------


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage rows with the list price in force at their start; NULL price when none applies.

    Usage is reduced to one row per (warehouse, sku, cloud, start) first. The
    price list joins on (sku, cloud) with half-open validity as a residual, so
    it is a hash or sort-merge join whatever its size.
    """
    units = usage.groupBy("warehouse_id", "sku_name", "cloud", "usage_start_time").agg(
        F.sum("usage_quantity").alias("dbus")
    )
    start = F.col("u.usage_start_time")
    in_force = (start >= F.col("p.price_start_time")) & (
        F.col("p.price_end_time").isNull() | (start < F.col("p.price_end_time"))
    )
    same = (F.col("u.sku_name") == F.col("p.sku_name")) & (F.col("u.cloud") == F.col("p.cloud"))
    return (
        units.alias("u")
        .join(prices.alias("p"), same & in_force, "left")
        .select("u.*", F.col("p.list_price"))
    )


def hourly_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(warehouse_id, hr) -> dbus, usd. Unpriced usage costs 0; rows without a warehouse are dropped."""
    priced = price_usage(usage.filter(F.col("warehouse_id").isNotNull()), prices)
    return priced.groupBy("warehouse_id", _hour("usage_start_time").alias("hr")).agg(
        F.sum("dbus").alias("dbus"),
        F.sum(F.col("dbus") * F.coalesce("list_price", F.lit(0.0))).alias("usd"),
    )


def hourly_share(log: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (space, workspace, warehouse, hour[, extra]) with its share of the hour's task time.

    One scan: the log is pre-aggregated, and the hour total is a window over
    the small aggregate instead of a second read and join.
    """
    keys = ["space_id", "workspace_id", "warehouse_id", *(extra or [])]
    part = (
        log.filter(F.col("task_ms") > 0)
        .groupBy(*keys, _hour("start_time").alias("hr"))
        .agg(F.sum("task_ms").alias("task_ms"), F.count("*").alias("n"))
    )
    hour_total = F.sum("task_ms").over(Window.partitionBy("warehouse_id", "hr"))
    return part.withColumn("share", F.try_divide("task_ms", hour_total))


def attributed_cost(log: DataFrame, usage: DataFrame, prices: DataFrame, as_of, days) -> DataFrame:
    """Hourly shares of agent traffic with their part of the hour's cost."""
    shares = hourly_share(log.filter(since("start_time", as_of, days))).filter("space_id IS NOT NULL")
    cost = hourly_cost(usage.filter(since("usage_start_time", as_of, days)), prices)
    part = lambda c: F.col("share") * F.coalesce(F.col(c), F.lit(0.0))
    return shares.join(cost, ["warehouse_id", "hr"], "left").select(
        "space_id", "workspace_id", "warehouse_id", "hr", "n", part("dbus").alias("dbus"), part("usd").alias("usd")
    )


def _cost_sums() -> list[Column]:
    return [
        F.sum("n").alias("query_count"),
        F.round(F.sum("dbus"), 6).alias("approx_dbus"),
        F.round(F.sum("usd"), 6).alias("approx_usd"),
    ]


def cost_daily(log, usage, prices, as_of, days: int = 7, space_id: str | None = None) -> DataFrame:
    """Cost per agent, day and warehouse; of one agent when ``space_id`` is given."""
    cost = attributed_cost(log, usage, prices, as_of, days)
    if space_id is not None:
        cost = cost.filter(F.col("space_id") == space_id)
    return cost.groupBy("space_id", F.to_date("hr").alias("day"), "warehouse_id").agg(*_cost_sums())


def cost_by_warehouse(daily: DataFrame) -> DataFrame:
    """Per agent: a row per warehouse and one ``(all)`` row, from the daily frame."""
    named = daily.withColumn("warehouse_id", F.coalesce("warehouse_id", F.lit(UNKNOWN_WAREHOUSE)))
    return (
        named.rollup("space_id", "warehouse_id")
        .agg(
            F.sum("query_count").alias("query_count"),
            F.round(F.sum("approx_dbus"), 4).alias("approx_dbus"),
            F.round(F.sum("approx_usd"), 4).alias("approx_usd"),
            F.grouping_id().alias("_g"),
        )
        .filter("_g < 3")
        .withColumn("warehouse_id", F.coalesce("warehouse_id", F.lit(ALL)))
        .drop("_g")
    )


def top_spenders(log, usage, prices, as_of, days=7, limit=10, workspace_id=None) -> DataFrame:
    """Agents by attributed cost, highest first. Shares are taken before the workspace filter."""
    cost = attributed_cost(log, usage, prices, as_of, days)
    if workspace_id is not None:
        cost = scope(cost, workspace_id)
    return (
        cost.groupBy("space_id", "workspace_id")
        .agg(F.sum("n").alias("query_count"), F.round(F.sum("usd"), 6).alias("approx_usd"))
        .orderBy(F.desc_nulls_last("approx_usd"), "space_id", "workspace_id")
        .limit(limit)
    )


def cost_per_conversation(
    log, usage, prices, audit, as_of, days: int = 7, limit: int = 50, within_seconds: int = 600, digits: int = 4
) -> DataFrame:
    """Each agent's costliest conversations: every query goes to the agent's latest audit event before it."""
    recent = log.filter(since("start_time", as_of, days)).filter("task_ms > 0")
    hours = recent.groupBy("warehouse_id", _hour("start_time").alias("hr")).agg(F.sum("task_ms").alias("hour_ms"))
    cost = hourly_cost(usage.filter(since("usage_start_time", as_of, days)), prices)
    rate = hours.join(cost, ["warehouse_id", "hr"], "left").select(
        "warehouse_id", "hr", F.try_divide(F.coalesce("usd", F.lit(0.0)), F.col("hour_ms")).alias("usd_per_ms")
    )
    queries = (
        recent.filter("space_id IS NOT NULL")
        .withColumn("hr", _hour("start_time"))
        .join(rate, ["warehouse_id", "hr"])
        .select("space_id", "start_time", (F.col("task_ms") * F.col("usd_per_ms")).alias("query_usd"))
    )
    events = audit.filter(since("event_time", as_of, days + 1)).filter("conversation_id IS NOT NULL")
    matched = match_last_event(
        queries, events, "space_id", "start_time", "event_time",
        ["conversation_id", "user_email"], ["conversation_id", "user_email"], within_seconds,
    )
    per = matched.groupBy("space_id", "conversation_id").agg(
        F.min("user_email").alias("user_email"),
        F.min("start_time").alias("first_query_at"),
        F.max("start_time").alias("last_query_at"),
        F.count("*").alias("query_count"),
        F.round(F.sum("query_usd"), digits).alias("approx_usd"),
    )
    w = Window.partitionBy("space_id").orderBy(F.desc_nulls_last("approx_usd"), "conversation_id")
    return per.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("rank")


# ---- usage -----------------------------------------------------------------


def daily_usage(log, as_of, days: int = 30) -> DataFrame:
    """Per agent and day: queries, median and 95th percentile duration, failures, distinct users.

    Percentiles are exact: the smallest duration that so many queries do not
    exceed. Durations are counted per value first, so a busy agent shuffles its
    different durations, and its windows run over those and not over queries.
    """
    keys = ["space_id", "day"]
    recent = (
        log.filter(since("start_time", as_of, days))
        .filter("space_id IS NOT NULL")
        .withColumn("day", F.to_date("start_time"))
    )
    counts = recent.groupBy(*keys, "duration_ms").agg(
        F.count("*").alias("_n"), F.count_if(F.col("execution_status") == "FAILED").alias("_failed")
    )
    timed = F.when(F.col("duration_ms").isNotNull(), F.col("_n")).otherwise(0)
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("duration_ms")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum(timed).over(upto)).withColumn("_of", F.sum(timed).over(Window.partitionBy(*keys)))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_of") * F.lit(p).cast("decimal(3,2)")), F.col("duration_ms")))
    timing = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("queries"), at("0.5").alias("p50_ms"), at("0.95").alias("p95_ms"), F.sum("_failed").alias("errors")
    )
    users = recent.groupBy(*keys).agg(F.countDistinct("executed_by").alias("distinct_users"))
    return timing.join(users, keys)


def usage_sketches(log) -> DataFrame:
    """Per agent and day: exact counts, and durations and users as sketches that :func:`merged_usage` puts together."""
    days = log.filter("space_id IS NOT NULL").withColumn("day", F.to_date("start_time"))
    return days.groupBy("space_id", "day").agg(
        F.count("*").alias("queries"), F.count_if(F.col("execution_status") == "FAILED").alias("errors"),
        sketches.quantile_sketch(F.col("duration_ms")).alias("durations"), sketches.distinct_sketch(F.col("executed_by")).alias("users"),
    )


def merged_usage(parts: DataFrame, *keys: str) -> DataFrame:
    """As :func:`daily_usage` at any grain (days, weeks, agents) from stored sketches; no query is read again.

    Durations are exact up to as many queries as a sketch keeps, within its
    rank error beyond; users are estimates.
    """
    merged = parts.groupBy(*keys).agg(
        F.sum("queries").alias("queries"), F.sum("errors").alias("errors"),
        sketches.merged_quantiles("durations").alias("durations"), sketches.merged_distinct("users").alias("users"),
    )
    at = lambda p: sketches.quantile_estimate("durations", p).cast("long")
    return merged.select(*keys, "queries", at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), "errors", sketches.distinct_estimate("users").alias("distinct_users"))


def usage_totals(daily: DataFrame) -> DataFrame:
    """Totals over the daily frame; users are the largest daily count, a lower bound of the true one."""
    return daily.groupBy("space_id").agg(
        F.sum("queries").alias("queries"),
        F.sum("errors").alias("errors"),
        F.max("distinct_users").alias("max_daily_users"),
    )


def usage_summary(log, as_of, days: int = 7) -> DataFrame:
    return (
        log.filter(since("start_time", as_of, days))
        .filter("space_id IS NOT NULL")
        .groupBy("space_id")
        .agg(
            F.count("*").alias("queries"),
            F.countDistinct("executed_by").alias("distinct_users"),
            F.max("start_time").alias("last_query_at"),
        )
    )


def kpis(log, usage, prices, audit, as_of, days: int = 7, workspace_id=None) -> DataFrame:
    """One row: active agents, queries, users, cost, thumbs up and down.

    The three one-row aggregates meet by union and a final aggregate.
    """
    only = (lambda d: scope(d, workspace_id)) if workspace_id is not None else (lambda d: d)
    traffic = only(
        log.filter(since("start_time", as_of, days)).filter("space_id IS NOT NULL AND task_ms > 0")
    ).agg(
        F.countDistinct("space_id").alias("active_spaces"),
        F.count("*").alias("total_queries"),
        F.countDistinct("executed_by").alias("distinct_users"),
    )
    cost = only(attributed_cost(log, usage, prices, as_of, days)).agg(F.round(F.sum("usd"), 2).alias("approx_usd"))
    thumbs = only(audit.filter(since("event_time", as_of, days))).agg(
        F.count_if(F.col("feedback_rating") == "THUMBS_UP").alias("pos_feedback"),
        F.count_if(F.col("feedback_rating") == "THUMBS_DOWN").alias("neg_feedback"),
    )
    rows = traffic.unionByName(cost, allowMissingColumns=True).unionByName(thumbs, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def day_spine(spark, last_day: dt.date, days: int) -> DataFrame:
    """``days`` consecutive dates ending at ``last_day``."""
    first = F.lit(last_day - dt.timedelta(days=days - 1))
    return spark.range(1).select(F.explode(F.sequence(first, F.lit(last_day))).alias("day"))


def daily_volume(log, as_of, days: int = 30) -> DataFrame:
    """Agent queries per day over ``days + 1`` dates, zero where none."""
    volume = (
        log.filter(since("start_time", as_of, days))
        .filter("space_id IS NOT NULL")
        .groupBy(F.to_date("start_time").alias("day"))
        .agg(F.count("*").alias("queries"))
    )
    spine = day_spine(log.sparkSession, as_of, days + 1)
    return spine.join(volume, "day", "left").fillna(0, ["queries"])


def top_queries(log, as_of, days: int = 7, limit: int = 20) -> DataFrame:
    """The longest statements of each agent."""
    w = Window.partitionBy("space_id").orderBy(F.desc_nulls_last("duration_ms"), "statement_id")
    return (
        log.filter(since("start_time", as_of, days))
        .filter("space_id IS NOT NULL")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
        .select(
            "space_id", "rank", "statement_id", "executed_by", "start_time",
            "duration_ms", "execution_status", "statement_text",
        )
    )


# ---- feedback --------------------------------------------------------------


def _rating() -> Column:
    raw = F.col("feedback_rating")
    out = raw
    for name, normal in RATING_NAMES.items():
        out = F.when(raw == name, normal).otherwise(out)
    return out


def feedback_events(audit, as_of, days: int = 7) -> DataFrame:
    """Rated events with the rating in its normal form."""
    return audit.filter(since("event_time", as_of, days)).filter(
        "space_id IS NOT NULL AND feedback_rating IS NOT NULL"
    ).withColumn("rating", _rating())


def latest_feedback(audit, as_of, days: int = 30, limit: int = 200) -> DataFrame:
    """The newest rated events of each agent."""
    w = Window.partitionBy("space_id").orderBy(F.desc("event_time"), "message_id")
    return (
        feedback_events(audit, as_of, days)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
        .select("event_time", "user_email", "space_id", "rating", "comment", "message_id", "conversation_id")
    )


def feedback_per_space(audit, as_of, days: int = 7) -> DataFrame:
    """Per agent: up, down, all ratings, share of down, last rated; most negative first."""
    return (
        feedback_events(audit, as_of, days)
        .groupBy("space_id")
        .agg(
            F.count_if(F.col("rating") == "POSITIVE").alias("positive"),
            F.count_if(F.col("rating") == "NEGATIVE").alias("negative"),
            F.count("*").alias("total"),
            F.max("event_time").alias("last_feedback_at"),
        )
        .withColumn("neg_rate_pct", F.round(F.col("negative") * 100.0 / F.col("total"), 1))
        .orderBy(F.desc("negative"), F.desc("total"), "space_id")
    )


def feedback_trend(audit, as_of, days: int = 7) -> DataFrame:
    """Up and down votes per day over exactly ``days`` dates ending at ``as_of``."""
    daily = (
        feedback_events(audit, as_of, days)
        .groupBy(F.to_date("event_time").alias("day"))
        .agg(
            F.count_if(F.col("rating") == "POSITIVE").alias("positive"),
            F.count_if(F.col("rating") == "NEGATIVE").alias("negative"),
        )
    )
    spine = day_spine(audit.sparkSession, as_of, days)
    return spine.join(daily, "day", "left").fillna(0, ["positive", "negative"])


def feedback_summary(per_space: DataFrame) -> DataFrame:
    """Grand totals of the per-agent frame; ``total`` counts up and down only."""
    sums = per_space.agg(
        F.coalesce(F.sum("positive"), F.lit(0)).alias("positive"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"),
    ).withColumn("total", F.col("positive") + F.col("negative"))
    rate = F.try_divide(F.col("negative") * 100.0, F.col("total"))
    return sums.withColumn("neg_rate_pct", F.round(F.coalesce(rate, F.lit(0.0)), 1))


def space_listing(agents, summary, spend, feedback) -> DataFrame:
    """Every agent with its usage, cost and feedback; absent numbers are 0."""
    spent = spend.groupBy("space_id").agg(F.round(F.sum("approx_usd"), 4).alias("cost_usd"))
    return (
        agents.join(summary.select("space_id", "queries", "last_query_at"), "space_id", "left")
        .join(spent, "space_id", "left")
        .join(feedback.select("space_id", "positive", "negative"), "space_id", "left")
        .fillna(0, ["queries", "cost_usd", "positive", "negative"])
    )


def dedup_comments(comments: DataFrame, limit: int = 20) -> DataFrame:
    """Distinct non-empty comments per message, the first ``limit`` to arrive, read oldest first."""
    text = F.trim("content")
    first = (
        comments.withColumn("content", text)
        .filter("content <> ''")
        .groupBy("message_id", "content")
        .agg(
            F.min("ordinal").alias("ordinal"),
            F.min_by(F.struct("created_at", "user_id"), "ordinal").alias("_first"),
        )
    )
    w = Window.partitionBy("message_id").orderBy("ordinal")
    return (
        first.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .select("message_id", "content", "ordinal", "_first.created_at", "_first.user_id")
        .orderBy("message_id", "created_at", "ordinal")
    )


def conversation_rollup(messages: DataFrame, limit: int = 50) -> DataFrame:
    """Conversations with message count, last message and whether any message carries a query; newest first."""
    return (
        messages.filter("conversation_id <> ''")
        .groupBy("conversation_id")
        .agg(
            F.count("*").alias("message_count"),
            F.max("created_at").alias("last_message_at"),
            F.bool_or("has_sql").alias("has_sql"),
        )
        .orderBy(F.desc_nulls_last("last_message_at"), "conversation_id")
        .limit(limit)
    )
