"""Business-mart and verification query shapes as reusable DataFrame operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.functions.asof import match_last_event
from auditframe.functions.ranking import next_time, ntile


def pct(part, whole, digits: int = 1) -> Column:
    """``part`` as a percentage of ``whole``; NULL when the whole is 0."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.round(F.try_divide(part * 100.0, whole), digits)


def share_of_total(df: DataFrame, group: Column, name: str = "period") -> DataFrame:
    """Rows per group and their share of all rows. The window runs over the grouped rows only."""
    counts = df.groupBy(group.alias(name)).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.round(F.col("n") / total, 4))


def quarterly_average(df: DataFrame, when: str, value: str) -> DataFrame:
    return df.groupBy(F.year(when).alias("yr"), F.quarter(when).alias("qtr")).agg(
        F.round(F.avg(value), 2).alias("avg_value"), F.count("*").alias("cnt")
    )


def share_by(df: DataFrame, group: Column, condition: Column, name: str) -> DataFrame:
    """Per group: the percentage of rows that meet a condition."""
    return (
        df.groupBy(group.alias(name))
        .agg(F.count("*").alias("n"), F.count_if(condition).alias("_hits"))
        .select(name, pct("_hits", "n").alias("share_pct"), "n")
    )


def decile_concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Volume and share of the top tenth of keys by summed value. ``key`` is an integer."""
    totals = df.groupBy(key).agg(F.round(F.sum(value), 2).alias("total"))
    ranked = ntile(totals, 10, "total", key)
    segment = F.when(F.col("tile") == 1, "Top 10%").otherwise("Other 90%")
    volumes = ranked.groupBy(segment.alias("segment")).agg(F.round(F.sum("total"), 2).alias("volume"))
    return volumes.withColumn("pct", pct(F.col("volume"), F.sum("volume").over(Window.partitionBy())))


def month_counts(df: DataFrame, when: str, months: list[tuple[int, int]], condition: Column) -> DataFrame:
    """Rows and conditional rows in chosen (year, month) pairs; the filter is a date range per month."""
    span = F.lit(False)
    for y, m in months:
        start = F.make_date(F.lit(y), F.lit(m), F.lit(1))
        span = span | ((F.col(when) >= start) & (F.col(when) < F.add_months(start, 1)))
    return (
        df.filter(span)
        .groupBy(F.year(when).alias("yr"), F.month(when).alias("mo"))
        .agg(F.count_if(condition).alias("hits"), F.count("*").alias("total"))
    )


def per_month_average(df: DataFrame, when: str, group: Column, value: str, condition: Column) -> DataFrame:
    """Per group: counts, value and conditional counts, each also per calendar month that occurs."""
    monthly = df.groupBy(group.alias("period"), F.month(when).alias("_m")).agg(
        F.count("*").alias("n"), F.sum(value).alias("v"), F.count_if(condition).alias("h")
    )
    return (
        monthly.groupBy("period")
        .agg(F.sum("n").alias("rows"), F.sum("v").alias("_v"), F.sum("h").alias("hits"), F.count("*").alias("months"))
        .select(
            "period", "rows", F.round("_v", 2).alias("value"), "hits", "months",
            F.round(F.col("rows") / F.col("months"), 1).alias("rows_per_month"),
            F.round(F.col("_v") / F.col("months"), 2).alias("value_per_month"),
            F.round(F.col("hits") / F.col("months"), 1).alias("hits_per_month"),
        )
    )


def event_rate(entities: DataFrame, events: DataFrame, group: str, key: str, event_id: str, scale: float = 100.0, digits: int = 1) -> DataFrame:
    """Per group: distinct entities, distinct events that join to them, and events per entity times ``scale``.

    The two distinct counts are taken apart, so the joined rows are not
    expanded once per distinct column.
    """
    members = entities.select(group, key).distinct()
    n = members.groupBy(group).agg(F.count(key).alias("entities"))
    hits = (
        members.join(events.select(key, event_id).distinct(), key)
        .select(group, event_id)
        .distinct()
        .groupBy(group)
        .agg(F.count(event_id).alias("events"))
    )
    return (
        n.join(hits, group, "left")
        .fillna(0, ["events"])
        .withColumn("rate", F.round(F.try_divide(F.col("events") * scale, F.col("entities")), digits))
    )


def before_after(facts: DataFrame, owners: DataFrame, owner: str, when: str, start: str) -> DataFrame:
    """Facts of the owners with a start date, marked by the side of it they fall on."""
    dated = facts.join(owners.filter(F.col(start).isNotNull()).select(owner, start), owner)
    side = F.when(F.col(when) >= F.col(start), "After").otherwise("Before")
    return dated.withColumn("period", side).drop(start)


def banded(df: DataFrame, bands: list[tuple[str, Column]], otherwise: str, averages: dict[str, tuple[str, int]]) -> DataFrame:
    """Averages per band; the first band whose condition holds takes the row."""
    band = F.lit(otherwise)
    for name, cond in reversed(bands):
        band = F.when(cond, name).otherwise(band)
    return df.groupBy(band.alias("band")).agg(
        *[F.round(F.avg(c), d).alias(n) for n, (c, d) in averages.items()], F.count("*").alias("rows")
    )


def days_to_next(rows: DataFrame, events: DataFrame, key: str, when: str, event_when: str, part_days: int = 90) -> DataFrame:
    """Add ``days_to_next``: days until the key's next event, 0 on the same day, NULL with none."""
    dated = next_time(rows, events, key, when, event_when, part_days * 86400)
    return dated.withColumn("days_to_next", F.datediff("next_time", when)).drop("next_time")


def with_recent_event(rows: DataFrame, events: DataFrame, key: str, when: str, event_when: str, days: int = 90) -> DataFrame:
    """Rows whose key had an event on the row's day or up to ``days`` days before it."""
    r = rows.withColumn("_t", F.col(when).cast("timestamp"))
    e = events.select(key, F.col(event_when).cast("timestamp").alias("_et0")).distinct()
    return match_last_event(r, e, key, "_t", "_et0", [], [], days * 86400).drop("_t")


def average_of_counts(parents: DataFrame, children: DataFrame, key: str, group: str, condition: Column) -> DataFrame:
    """Children counted per key first, then averaged over the parents of each group that have any."""
    counts = children.groupBy(key).agg(F.count_if(condition).alias("_c"))
    return parents.join(counts, key).groupBy(group).agg(
        F.round(F.avg("_c"), 2).alias("avg_count"), F.count("*").alias("rows")
    )


def trailing_mean(df: DataFrame, key: str, order: list[Column], value: str, n: int = 6) -> DataFrame:
    """Mean of up to the last ``n`` rows per key. Earlier rows are pruned before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    last = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return last.groupBy(key).agg(F.round(F.avg(value), 6).alias("trailing_mean"), F.count("*").alias("rows_used"))


def yearly_metric_events(metric: DataFrame, events: DataFrame, year: str = "yr", zero: list[str] | None = None) -> DataFrame:
    """A yearly metric frame with yearly event sums, zero in years without events."""
    fill = zero or [c for c in events.columns if c != year]
    return metric.join(events, year, "left").fillna(0, fill)


def segment_maximum(facts: DataFrame, flags: DataFrame, maxima: DataFrame, keys: list[str], segment: Column, value: str) -> DataFrame:
    """Rows of two facts and a yearly maximum joined on their keys, averaged by segment."""
    joined = facts.join(flags, keys).join(maxima, keys)
    return joined.groupBy(segment.alias("segment")).agg(
        F.count("*").alias("rows"), F.round(F.avg(value), 6).alias("avg_max")
    )


def monthly_snapshot(intervals: DataFrame, unit: str, start: str, end: str, first=None, months: int | None = None) -> DataFrame:
    """Per unit and month: active at month end, active at month start, joins, exits and the exit rate.

    Every interval adds one start and one end to a per-day tally; head counts
    are running sums of the tally by month. No interval meets the month spine,
    so work and shuffle grow with units and days, not with interval lengths.
    Active at the end: started by it and not ended by it. Active at the start:
    started before it and not ended before it. Months with nothing are dropped.
    Without ``first`` and ``months`` the spine covers all dates of the table,
    which one scan finds before the plan is built.
    """
    if first is None or months is None:
        low, high = intervals.agg(F.least(F.min(start), F.min(end)), F.greatest(F.max(start), F.max(end))).first()
        first = first or (dt.date(low.year, low.month, 1) if low else dt.date(1970, 1, 1))
        months = months or (max(1, (high.year - first.year) * 12 + high.month - first.month + 1) if high else 1)
    month = lambda c: F.to_date(F.date_trunc("month", c))
    starts = intervals.groupBy(unit, month(start).alias("month")).agg(F.count("*").alias("joins"))
    ended = intervals.filter(F.col(end).isNotNull())
    ends = ended.groupBy(unit, month(end).alias("month")).agg(F.count("*").alias("exits"))
    tally = starts.unionByName(ends, allowMissingColumns=True)
    # Months outside the spine still count towards the running sums.
    units = intervals.select(unit).distinct()
    spine = F.sequence(F.lit(first), F.add_months(F.lit(first), months - 1), F.expr("INTERVAL 1 MONTH"))
    frame = units.withColumn("month", F.explode(spine))
    grid = tally.unionByName(frame.withColumn("shown", F.lit(True)), allowMissingColumns=True)
    monthly = grid.groupBy(unit, "month").agg(
        F.coalesce(F.sum("joins"), F.lit(0)).alias("joins"),
        F.coalesce(F.sum("exits"), F.lit(0)).alias("exits"),
        F.max("shown").alias("shown"),
    )
    upto = Window.partitionBy(unit).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    net = F.col("joins") - F.col("exits")
    running = monthly.withColumn("active", F.sum(net).over(upto)).withColumn("active_at_start", F.col("active") - net)
    return (
        running.filter("shown AND active + joins + exits > 0")
        .select(
            F.col(unit).alias("unit"), "month", "active", "active_at_start", "joins", "exits",
            F.coalesce(pct("exits", "active_at_start", 2), F.lit(0.0)).alias("exit_rate_pct"),
        )
    )


def annual_population(intervals: DataFrame, unit: str, start: str, end: str, years: list[int]) -> DataFrame:
    """Per unit and year: intervals that overlap the year, from yearly tallies of starts and ends."""
    starts = intervals.groupBy(unit, F.year(start).alias("yr")).agg(F.count("*").alias("s"))
    ends = intervals.filter(F.col(end).isNotNull()).groupBy(unit, F.year(end).alias("yr")).agg(F.count("*").alias("e"))
    frame = intervals.select(unit).distinct().withColumn("yr", F.explode(F.array(*map(F.lit, years)))).withColumn("shown", F.lit(True))
    grid = starts.unionByName(ends, allowMissingColumns=True).unionByName(frame, allowMissingColumns=True)
    yearly = grid.groupBy(unit, "yr").agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.max("shown").alias("shown")
    )
    w = Window.partitionBy(unit).orderBy("yr")
    started = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended_before = F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = yearly.withColumn("population", started - ended_before)
    return rows.filter("shown AND population > 0").select(F.col(unit).alias("unit"), "yr", "population")


def funnel(parents: DataFrame, children: DataFrame, key: str, stages: dict[str, Column], value: Column, value_name: str) -> DataFrame:
    """Every parent with its children counted per stage and a mean; no children gives zeros and a NULL mean."""
    grouped = children.groupBy(key).agg(
        F.count("*").alias("children"),
        *[F.count_if(cond).alias(n) for n, cond in stages.items()],
        F.round(F.avg(value), 6).alias(value_name),
    )
    return parents.join(grouped, key, "left").fillna(0, ["children", *stages])


def multi_fact(spine: DataFrame, facts: list[DataFrame], grain: list[str], zero: list[str]) -> DataFrame:
    """Facts already aggregated to one grain, joined to a spine; joining raw facts would multiply counts."""
    out = spine
    for fact in facts:
        out = out.join(fact, grain, "left")
    return out.fillna(0, zero)


def coverage(df: DataFrame, groups: list[str], position: str, covered: Column, ready: Column) -> DataFrame:
    """Distinct positions per group and how many are covered or ready, from one pass per position."""
    per = df.groupBy(*groups, position).agg(F.bool_or(covered).alias("c"), F.bool_or(ready).alias("r"))
    return per.groupBy(*groups).agg(
        F.count(position).alias("positions"), F.count_if("c").alias("covered"), F.count_if("r").alias("ready")
    ).withColumn("coverage_pct", F.coalesce(pct("covered", "positions", 2), F.lit(0.0)))


def reaggregate_ratio(mart: DataFrame, group: Column, part: str, whole: str) -> DataFrame:
    """A mart rolled up to wider groups: the ratio of the sums, not the mean of the ratios."""
    return (
        mart.groupBy(group.alias("grp"))
        .agg(F.sum(whole).alias(whole), F.sum(part).alias(part))
        .withColumn("ratio_pct", pct(part, whole))
    )
