"""Business-mart queries on the star schema."""

import datetime as dt

from pyspark.sql import functions as F

from auditframe.operators import marts as m
from auditframe.operators import profile
from auditframe.plans import Family
from auditframe.sources import oracle
from auditframe.sources.inputs import TABLES

FAMILY = Family()


def _holiday(c="o_orderdate"):
    return F.when(F.month(c).isin(11, 12), "Nov/Dec").otherwise("Other")


_HOLIDAY = "CASE WHEN month(o_orderdate) IN (11, 12) THEN 'Nov/Dec' ELSE 'Other' END"


@FAMILY.add(
    "mq_period_share",
    f"SELECT {_HOLIDAY} AS period, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1",
)
def period_share(i):
    return m.share_of_total(i.orders, _holiday())


@FAMILY.add(
    "mq_quarter_avg",
    types={"yr": "INTEGER", "qtr": "INTEGER"},
    oracle_sql="""SELECT year(o_orderdate) AS yr, quarter(o_orderdate) AS qtr, round(avg(o_totalprice), 2) AS avg_value, count(*) AS cnt
       FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""",
)
def quarter_avg(i):
    return m.quarterly_average(i.orders.filter("o_orderstatus = 'F'"), "o_orderdate", "o_totalprice")


@FAMILY.add(
    "mq_share_by_year",
    types={"yr": "INTEGER"},
    oracle_sql="""SELECT year(o_orderdate) AS yr, count(*) AS n,
              round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 1) AS share_pct
       FROM orders GROUP BY 1""",
)
def share_by_year(i):
    return m.share_by(i.orders, F.year("o_orderdate"), F.col("o_orderpriority") == "1-URGENT", "yr")


@FAMILY.add(
    "mq_decile_concentration",
    """WITH t AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
       r AS (SELECT total, ntile(10) OVER (ORDER BY total DESC, o_custkey) AS d FROM t)
       SELECT CASE WHEN d = 1 THEN 'Top 10%' ELSE 'Other 90%' END AS segment, round(sum(total), 2) AS volume,
              round(100.0 * round(sum(total), 2) / (SELECT sum(total) FROM r), 1) AS pct
       FROM r GROUP BY 1""",
)
def decile_concentration(i):
    return m.decile_concentration(i.orders, "o_custkey", "o_totalprice")


@FAMILY.add(
    "mq_month_spike",
    types={"yr": "INTEGER", "mo": "INTEGER"},
    oracle_sql="""SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo,
              count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS hits, count(*) AS total
       FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-12', '1996-01', '1996-02', '1996-03') GROUP BY ALL""",
)
def month_spike(i):
    months = [(1995, 12), (1996, 1), (1996, 2), (1996, 3)]
    return m.month_counts(i.orders, "o_orderdate", months, F.col("o_orderpriority") == "1-URGENT")


@FAMILY.add(
    "mq_per_month_avg",
    f"""SELECT {_HOLIDAY} AS period, count(*) AS rows, round(sum(o_totalprice), 2) AS value,
               count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS hits,
               count(DISTINCT month(o_orderdate)) AS months,
               round(count(*) / count(DISTINCT month(o_orderdate)), 1) AS rows_per_month,
               round(sum(o_totalprice) / count(DISTINCT month(o_orderdate)), 2) AS value_per_month,
               round(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) / count(DISTINCT month(o_orderdate)), 1)
                 AS hits_per_month
        FROM orders GROUP BY 1""",
)
def per_month_avg(i):
    return m.per_month_average(i.orders, "o_orderdate", _holiday(), "o_totalprice", F.col("o_orderstatus").isin("F", "P"))


def _returned_lines(i):
    return i.lineitem.filter("l_returnflag = 'R'").select(
        "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("return_id")
    )


@FAMILY.add(
    "mq_event_rate",
    """SELECT c_mktsegment, count(DISTINCT o_orderkey) AS entities,
              count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) AS events,
              round(100.0 * count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END)
                    / count(DISTINCT o_orderkey), 1) AS rate
       FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def event_rate(i):
    orders = i.orders.join(i.customer, i.orders.o_custkey == i.customer.c_custkey).select(
        "c_mktsegment", F.col("o_orderkey").alias("l_orderkey")
    )
    return m.event_rate(orders, _returned_lines(i), "c_mktsegment", "l_orderkey", "return_id")


@FAMILY.add(
    "mq_before_after",
    """WITH p AS (SELECT c_custkey, TIMESTAMP '1996-01-01 00:00:00' + INTERVAL 30 DAY * c_nationkey AS start_at
                  FROM customer WHERE c_acctbal > 0)
       SELECT CASE WHEN o_orderdate >= start_at THEN 'After' ELSE 'Before' END AS period,
              count(DISTINCT o_orderkey) AS entities,
              count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) AS events,
              round(100.0 * count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END)
                    / count(DISTINCT o_orderkey), 1) AS rate
       FROM orders JOIN p ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def before_after(i):
    start = F.date_add(F.lit(dt.date(1996, 1, 1)), F.col("c_nationkey") * 30).cast("timestamp")
    owners = i.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), start.alias("start_at"))
    marked = m.before_after(i.orders, owners, "o_custkey", "o_orderdate", "start_at")
    entities = marked.select("period", F.col("o_orderkey").alias("l_orderkey"))
    return m.event_rate(entities, _returned_lines(i), "period", "l_orderkey", "return_id")


@FAMILY.add(
    "mq_banded_avg",
    """SELECT CASE WHEN l_quantity <= 10 THEN 'small' WHEN l_quantity <= 30 THEN 'medium' ELSE 'large' END AS band,
              round(avg(l_discount), 4) AS avg_discount, round(avg(l_extendedprice), 2) AS avg_price, count(*) AS rows
       FROM lineitem GROUP BY 1""",
)
def banded_avg(i):
    bands = [("small", F.col("l_quantity") <= 10), ("medium", F.col("l_quantity") <= 30)]
    return m.banded(i.lineitem, bands, "large", {"avg_discount": ("l_discount", 4), "avg_price": ("l_extendedprice", 2)})


@FAMILY.add(
    "mq_events_per_entity",
    """SELECT p_brand, count(DISTINCT p_partkey) AS entities,
              count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END) AS events,
              round(1.0 * count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey * 10 + l_linenumber END)
                    / count(DISTINCT p_partkey), 2) AS rate
       FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""",
)
def events_per_entity(i):
    parts = i.part.select("p_brand", F.col("p_partkey").alias("l_partkey"))
    returned = i.lineitem.filter("l_returnflag = 'R'").select(
        "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("return_id")
    )
    return m.event_rate(parts, returned, "p_brand", "l_partkey", "return_id", 1.0, 2)


@FAMILY.add(
    "mq_days_to_next",
    """WITH r AS (SELECT DISTINCT o_custkey, CAST(l_shipdate AS DATE) AS d
                  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
       SELECT o.o_orderkey, CAST(min(r.d) - CAST(o.o_orderdate AS DATE) AS INT) AS days_to_next
       FROM orders o LEFT JOIN r ON r.o_custkey = o.o_custkey AND r.d >= CAST(o.o_orderdate AS DATE)
       GROUP BY o.o_orderkey, o.o_orderdate""",
)
def days_to_next(i):
    rows = i.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    returned = i.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("ship_day")
    )
    events = returned.join(i.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_custkey", "ship_day").distinct()
    return m.days_to_next(rows, events, "o_custkey", "day", "ship_day").select("o_orderkey", "days_to_next")


@FAMILY.add(
    "mq_recent_event",
    """SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND EXISTS (
         SELECT 1 FROM orders u WHERE u.o_custkey = o.o_custkey AND u.o_orderpriority = '1-URGENT'
           AND CAST(u.o_orderdate AS DATE) BETWEEN CAST(o.o_orderdate AS DATE) - INTERVAL 90 DAY AND CAST(o.o_orderdate AS DATE))""",
)
def recent_event(i):
    day = F.to_date("o_orderdate").alias("day")
    rows = i.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", day)
    urgent = i.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", day)
    return m.with_recent_event(rows, urgent, "o_custkey", "day", "day", 90).select("o_orderkey")


@FAMILY.add(
    "mq_agg_join",
    """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY 1)
       SELECT o_orderstatus, round(avg(k), 2) AS avg_count, count(*) AS rows
       FROM orders JOIN c ON l_orderkey = o_orderkey GROUP BY 1""",
)
def agg_join(i):
    parents = i.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return m.average_of_counts(parents, i.lineitem, "l_orderkey", "o_orderstatus", F.col("l_returnflag") == "R")


@FAMILY.add(
    "mq_trailing_mean",
    """WITH l AS (SELECT * FROM orders
                  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 6),
       t AS (SELECT o_custkey, round(avg(o_totalprice), 6) AS trailing_mean, count(*) AS rows_used FROM l GROUP BY 1)
       SELECT *, CASE WHEN trailing_mean < 100000 THEN 'low' WHEN trailing_mean < 200000 THEN 'middle' ELSE 'high' END AS band
       FROM t""",
)
def trailing_mean(i):
    df = m.trailing_mean(i.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", 6)
    mean = F.col("trailing_mean")
    return df.withColumn("band", F.when(mean < 100000, "low").when(mean < 200000, "middle").otherwise("high"))


@FAMILY.add(
    "mq_metric_events",
    types={"yr": "INTEGER"},
    oracle_sql="""WITH a AS (SELECT year(o_orderdate) AS yr, round(avg(o_totalprice), 2) AS avg_price,
                         count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1),
       e AS (SELECT year(l_shipdate) AS yr, count(*) FILTER (WHERE l_quantity > 45) AS large_returns
             FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
       SELECT a.*, coalesce(large_returns, 0) AS large_returns FROM a LEFT JOIN e USING (yr)""",
)
def metric_events(i):
    metric = i.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("avg_price"), F.countDistinct("o_custkey").alias("customers")
    )
    events = (
        i.lineitem.filter("l_returnflag = 'R'")
        .groupBy(F.year("l_shipdate").alias("yr"))
        .agg(F.count_if(F.col("l_quantity") > 45).alias("large_returns"))
    )
    return m.yearly_metric_events(metric, events)


@FAMILY.add(
    "mq_segment_risk",
    """WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, avg(o_totalprice) AS mean, max(o_totalprice) AS top,
                         bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY ALL)
       SELECT CASE WHEN urgent AND mean < 150000 THEN 'urgent, small' WHEN urgent THEN 'urgent, large' ELSE 'other' END AS segment,
              count(*) AS rows, round(avg(top), 6) AS avg_max FROM y GROUP BY 1""",
)
def segment_risk(i):
    keys = ["o_custkey", "yr"]
    yearly = i.orders.withColumn("yr", F.year("o_orderdate"))
    facts = yearly.groupBy(*keys).agg(F.avg("o_totalprice").alias("mean"))
    flags = yearly.groupBy(*keys).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    maxima = yearly.groupBy(*keys).agg(F.max("o_totalprice").alias("top"))
    segment = (
        F.when(F.col("urgent") & (F.col("mean") < 150000), "urgent, small").when(F.col("urgent"), "urgent, large").otherwise("other")
    )
    return m.segment_maximum(facts, flags, maxima, keys, segment, "top")


@FAMILY.add(
    "mq_monthly_snapshot",
    oracle(
        """WITH span AS (SELECT least(min(start_date), min(end_date)) AS low, greatest(max(start_date), max(end_date)) AS high FROM memberships),
        spine AS (SELECT CAST(unnest(generate_series(date_trunc('month', low), date_trunc('month', high), INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
        grid AS (SELECT unit, month, CAST(last_day(month) AS DATE) AS month_end
                 FROM (SELECT DISTINCT unit FROM memberships) u, spine),
        counts AS (
          SELECT g.unit, g.month,
                 count(*) FILTER (WHERE start_date <= month_end AND (end_date IS NULL OR end_date > month_end)) AS active,
                 count(*) FILTER (WHERE start_date < month AND (end_date IS NULL OR end_date >= month)) AS active_at_start,
                 count(*) FILTER (WHERE date_trunc('month', start_date) = month) AS joins,
                 count(*) FILTER (WHERE date_trunc('month', end_date) = month) AS exits
          FROM grid g JOIN memberships m ON m.unit = g.unit GROUP BY ALL)
        SELECT *, CASE WHEN active_at_start = 0 THEN 0 ELSE round(100.0 * exits / active_at_start, 2) END AS exit_rate_pct
        FROM counts WHERE active + joins + exits > 0""",
        "memberships",
    ),
)
def monthly_snapshot(i):
    return m.monthly_snapshot(i.memberships, "unit", "start_date", "end_date")


@FAMILY.add(
    "mq_funnel",
    """SELECT c_custkey, c_mktsegment, count(o_orderkey) AS children,
              count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
              count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS urgent,
              round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 6) AS avg_finished,
              CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 0.0
                   ELSE round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
                              / count(*) FILTER (WHERE o_orderstatus = 'F'), 2) END AS urgent_pct
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def funnel(i):
    finished = F.col("o_orderstatus") == "F"
    stages = {"finished": finished, "urgent": finished & (F.col("o_orderpriority") == "1-URGENT")}
    parents = i.customer.select("c_custkey", "c_mktsegment")
    children = i.orders.withColumnRenamed("o_custkey", "c_custkey")
    df = m.funnel(parents, children, "c_custkey", stages, F.when(finished, F.col("o_totalprice")), "avg_finished")
    return df.withColumn("urgent_pct", F.coalesce(m.pct("urgent", "finished", 2), F.lit(0.0)))


@FAMILY.add(
    "mq_multi_fact",
    types={"yr": "INTEGER", "qtr": "INTEGER"},
    oracle_sql="""WITH o AS (SELECT year(o_orderdate) AS yr, quarter(o_orderdate) AS qtr, c_mktsegment, o_orderkey, o_custkey, o_totalprice
                  FROM orders JOIN customer ON c_custkey = o_custkey),
       l AS (SELECT year(l_shipdate) AS yr, quarter(l_shipdate) AS qtr, c_mktsegment, l_returnflag, l_quantity
             FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
       SELECT yr, qtr, c_mktsegment, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 2) AS avg_price,
              (SELECT count(*) FROM l WHERE l.yr = o.yr AND l.qtr = o.qtr AND l.c_mktsegment = o.c_mktsegment
                 AND l_returnflag = 'R') AS returned,
              (SELECT round(avg(l_quantity), 2) FROM l
               WHERE l.yr = o.yr AND l.qtr = o.qtr AND l.c_mktsegment = o.c_mktsegment) AS avg_shipped
       FROM o GROUP BY yr, qtr, c_mktsegment""",
)
def multi_fact(i):
    grain = ["yr", "qtr", "c_mktsegment"]

    def at_grain(df, when):
        return df.withColumn("yr", F.year(when)).withColumn("qtr", F.quarter(when))

    owners = i.orders.join(
        i.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey"
    )
    spine = at_grain(owners, "o_orderdate").groupBy(*grain).agg(
        F.countDistinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("avg_price")
    )
    lines = at_grain(
        i.lineitem.join(owners.select(F.col("o_orderkey").alias("l_orderkey"), "c_mktsegment"), "l_orderkey"), "l_shipdate"
    )
    shipped = lines.groupBy(*grain).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.avg("l_quantity"), 2).alias("avg_shipped")
    )
    return m.multi_fact(spine, [shipped], grain, ["returned"])


@FAMILY.add(
    "mq_annual_population",
    oracle(
        """WITH grid AS (SELECT unit, yr FROM (SELECT DISTINCT unit FROM memberships) u,
                          (SELECT CAST(unnest(range(1995, 2002)) AS INT) AS yr) y),
        pop AS (SELECT g.unit, g.yr, count(*) AS population FROM grid g JOIN memberships m
                  ON m.unit = g.unit AND start_date <= make_date(g.yr, 12, 31)
                 AND (end_date IS NULL OR end_date >= make_date(g.yr, 1, 1)) GROUP BY ALL),
        f AS (SELECT c_mktsegment AS unit, year(o_orderdate) AS yr, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
                     round(avg(o_totalprice), 2) AS avg_price
              FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
        SELECT pop.*, coalesce(finished, 0) AS finished, avg_price FROM pop LEFT JOIN f USING (unit, yr)""",
        "memberships",
    ),
)
def annual_population(i):
    pop = m.annual_population(i.memberships, "unit", "start_date", "end_date", list(range(1995, 2002)))
    owners = i.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("unit"))
    facts = (
        i.orders.join(owners, "o_custkey")
        .groupBy("unit", F.year("o_orderdate").alias("yr"))
        .agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    )
    return m.multi_fact(pop, [facts], ["unit", "yr"], ["finished"])


@FAMILY.add(
    "mq_joined_mart",
    types={"yr": "INTEGER"},
    oracle_sql="""WITH y AS (SELECT o_custkey, year(o_orderdate) AS yr, max(o_totalprice) AS top FROM orders GROUP BY ALL),
       j AS (SELECT c_mktsegment, n_name, y.yr, y.o_custkey, o_totalprice, o_orderpriority, top
             FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
             JOIN y ON y.o_custkey = orders.o_custkey AND y.yr = year(o_orderdate))
       SELECT yr, c_mktsegment, n_name, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 6) AS avg_price,
              count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
              count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice < 100000) AS urgent_small,
              count(DISTINCT CASE WHEN top >= 300000 THEN o_custkey END) AS high_customers
       FROM j GROUP BY ALL""",
)
def joined_mart(i):
    yearly = i.orders.withColumn("yr", F.year("o_orderdate"))
    # One row per customer and year first: the distinct counts then need no expansion.
    urgent = F.col("o_orderpriority") == "1-URGENT"
    per = yearly.groupBy("o_custkey", "yr").agg(
        F.max("o_totalprice").alias("top"), F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"),
        F.count_if(urgent).alias("urgent"), F.count_if(urgent & (F.col("o_totalprice") < 100000)).alias("urgent_small"),
    )
    owners = i.customer.join(i.nation, i.customer.c_nationkey == i.nation.n_nationkey).select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name"
    )
    return per.join(owners, "o_custkey").groupBy("yr", "c_mktsegment", "n_name").agg(
        F.count("*").alias("customers"),
        F.round(F.sum("spent") / F.sum("n"), 6).alias("avg_price"),
        F.sum("urgent").alias("urgent"),
        F.sum("urgent_small").alias("urgent_small"),
        F.count_if(F.col("top") >= 300000).alias("high_customers"),
    )


_COVERAGE = """
  SELECT p_brand, p_type, count(DISTINCT p_partkey) AS positions,
         count(DISTINCT CASE WHEN l_returnflag = 'N' THEN p_partkey END) AS covered,
         count(DISTINCT CASE WHEN l_quantity >= 48 THEN p_partkey END) AS ready
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL"""


def _coverage(i):
    lines = i.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.bool_or(F.col("l_returnflag") == "N").alias("kept"), F.max("l_quantity").alias("most")
    )
    df = i.part.join(lines, "p_partkey", "left")
    return m.coverage(df, ["p_brand", "p_type"], "p_partkey", F.col("kept"), F.col("most") >= 48)


@FAMILY.add(
    "mq_coverage", f"SELECT *, round(100.0 * covered / positions, 2) AS coverage_pct FROM ({_COVERAGE})"
)
def coverage(i):
    return _coverage(i)


@FAMILY.add(
    "mq_reaggregate",
    f"""SELECT CASE WHEN p_brand = 'Brand#12' THEN 'Brand#12' WHEN p_type LIKE '%PROMO%' THEN 'promo' ELSE 'other' END AS grp,
               CAST(sum(positions) AS BIGINT) AS positions, CAST(sum(covered) AS BIGINT) AS covered,
               round(100.0 * sum(covered) / sum(positions), 1) AS ratio_pct FROM ({_COVERAGE}) GROUP BY 1""",
)
def reaggregate(i):
    group = F.when(F.col("p_brand") == "Brand#12", "Brand#12").when(F.col("p_type").contains("PROMO"), "promo").otherwise("other")
    return m.reaggregate_ratio(_coverage(i), group, "covered", "positions")


@FAMILY.add("mq_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in TABLES))
def table_counts(i):
    return profile.row_counts({t: i.get(t) for t in TABLES})
