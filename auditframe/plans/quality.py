"""Data-quality queries."""

import datetime as dt

from pyspark.sql import functions as F

from auditframe.functions.columns import union_all
from auditframe.operators import profile, quality as q
from auditframe.plans import Family
from auditframe.sources import oracle

FAMILY = Family()
AS_OF = dt.date(2024, 1, 31)

_DIRTY_COLUMNS = ["event_id", "label", "flag", "blankish", "all_null", "constant_col"]
_METRICS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS null_count,
               count(DISTINCT {c}) AS distinct_count,
               round((count(*) - count({c})) / count(*), 4) AS null_rate,
               {f"count(*) FILTER (WHERE trim({c}) = '')" if c != "event_id" else "NULL"} AS empty_count,
               {f"round(count(*) FILTER (WHERE trim({c}) = '') / count(*), 4)" if c != "event_id" else "NULL"}
                 AS empty_rate
        FROM dirty"""
    for c in _DIRTY_COLUMNS
)
_GROUPS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", lower({c}) AS normalized, string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS variants,
               count(DISTINCT {c}) AS variant_count, count(*) AS rows
        FROM dirty WHERE {c} IS NOT NULL GROUP BY ALL"""
    for c in _DIRTY_COLUMNS[1:]
)


# The findings by column, from how the view is built: `label` holds each event
# type in two casings, `flag` spells true twice, two columns are constant.
_RECS = """
  SELECT 'label' AS "column", 'flag' AS action, 'inconsistent_casing' AS reason, 'high' AS confidence
  WHERE (SELECT count(DISTINCT label) > count(DISTINCT lower(label)) FROM dirty)
  UNION ALL SELECT 'flag', 'flag', 'inconsistent_boolean', 'high'
  WHERE (SELECT count(DISTINCT flag) FROM dirty WHERE lower(flag) = 'true') > 1
  UNION ALL SELECT 'all_null', 'exclude', 'all_null', 'high' WHERE (SELECT count(all_null) = 0 FROM dirty)
  UNION ALL SELECT 'constant_col', 'flag', 'constant_value', 'medium'
  WHERE (SELECT count(DISTINCT constant_col) = 1 FROM dirty)"""


@FAMILY.add("dq_null_metrics", oracle(_METRICS, "dirty"))
def null_metrics(i):
    return q.null_metrics(i.dirty)


@FAMILY.add(
    "dq_table_summary",
    oracle(
        f"""WITH m AS ({_METRICS})
        SELECT count(*) FILTER (WHERE "column" NOT IN (SELECT r."column" FROM ({_RECS}) r)) AS good_columns,
               count(*) FILTER (WHERE null_count < rows AND null_count > rows / 2) AS sparse_columns,
               count(*) FILTER (WHERE null_count = rows) AS empty_columns,
               count(*) FILTER (WHERE distinct_count = 1) AS constant_columns FROM m""",
        "dirty",
    ),
)
def table_summary(i):
    metrics = q.null_metrics(i.dirty)
    return q.table_summary(metrics, q.recommendations(metrics, q.casing_groups(i.dirty)))


@FAMILY.add("dq_casing_variants", oracle(f"SELECT * FROM ({_GROUPS}) WHERE variant_count > 1", "dirty"))
def casing_variants(i):
    df = q.casing_variants(q.casing_groups(i.dirty))
    return df.select("column", "normalized", F.array_join("variants", "|").alias("variants"), "variant_count", "rows")


@FAMILY.add(
    "dq_bool_as_string",
    oracle(
        f"""SELECT "column", max(variant_count) > 1 AS several_casings, CAST(sum(rows) AS BIGINT) AS rows
            FROM ({_GROUPS}) WHERE normalized IN ('true', 'false', 'yes', 'no', 'y', 'n') GROUP BY 1""",
        "dirty",
    ),
)
def bool_as_string(i):
    return q.boolean_columns(q.casing_groups(i.dirty))


def _recs(df):
    return q.recommendations(q.null_metrics(df), q.casing_groups(df))


@FAMILY.add("dq_recommendations", oracle(_RECS, "dirty"))
def recommendations(i):
    return _recs(i.dirty)


@FAMILY.add(
    "dq_global_summary",
    types={"tables_assessed": "BIGINT", "tables_with_issues": "BIGINT"},
    oracle_sql=oracle(
        f"""WITH r AS ({_RECS})
        SELECT 3 AS tables_assessed, 1 AS tables_with_issues,
               count(*) FILTER (WHERE action = 'exclude') AS total_recommended_excludes,
               count(*) FILTER (WHERE action = 'flag') AS total_recommended_review FROM r""",
        "dirty",
    ),
)
def global_summary(i):
    frames = {"dirty": i.dirty, "orders": i.orders, "customer": i.customer}
    recs = union_all([_recs(df).withColumn("table", F.lit(t)) for t, df in frames.items()])
    names = profile.row_counts(frames).select("table")
    return q.global_summary(names, recs)


_KEYS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


def _key_name(child, fk, parent, pk):
    return f"{child}.{fk} -> {parent}.{pk}"


@FAMILY.add(
    "dq_fk_overlap",
    " UNION ALL ".join(
        f"""SELECT '{_key_name(*k)}' AS key, count(DISTINCT a.{k[1]}) AS left_distinct,
                   count(DISTINCT b.{k[3]}) AS overlap,
                   round(count(DISTINCT b.{k[3]}) / count(DISTINCT a.{k[1]}), 3) AS overlap_ratio
            FROM {k[0]} a LEFT JOIN {k[2]} b ON a.{k[1]} = b.{k[3]}"""
        for k in _KEYS
    ),
)
def fk_overlap(i):
    return union_all(
        [q.fk_overlap(i.get(c), fk, i.get(p), pk).withColumn("key", F.lit(_key_name(c, fk, p, pk))) for c, fk, p, pk in _KEYS]
    )


@FAMILY.add(
    "dq_fk_orphans",
    " UNION ALL ".join(
        f"""SELECT '{_key_name(*k)}' AS key, count(*) AS orphans
            FROM {k[0]} a LEFT JOIN {k[2]} b ON a.{k[1]} = b.{k[3]} WHERE b.{k[3]} IS NULL"""
        for k in _KEYS
    ),
)
def fk_orphans(i):
    return union_all(
        [q.fk_orphans(i.get(c), fk, i.get(p), pk).withColumn("key", F.lit(_key_name(c, fk, p, pk))) for c, fk, p, pk in _KEYS]
    )


@FAMILY.add(
    "dq_literal_check",
    oracle(
        """WITH vals AS (SELECT DISTINCT 'event_type' AS column_name, event_type AS v FROM events
                         UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders),
        absent AS (SELECT * FROM literals l WHERE lower(literal) NOT IN (SELECT lower(v) FROM vals WHERE vals.column_name = l.column_name)),
        scored AS (SELECT column_name, literal, v,
                          1.0::DOUBLE - levenshtein(lower(literal), lower(v)) / greatest(length(literal), length(v)) AS score
                   FROM absent JOIN vals USING (column_name))
        SELECT column_name, literal, CASE WHEN max(score) >= 0.85 THEN arg_max(v, (score, v)) END AS suggestion,
               round(max(score), 3) AS score
        FROM scored GROUP BY ALL""",
        "literals",
    ),
)
def literal_check(i):
    lists = [profile.value_lists(df) for df in (i.events.select("event_type"), i.orders.select("o_orderpriority"))]
    dictionary = union_all(lists).select(F.col("column").alias("column_name"), "values")
    return q.missing_literals(i.literals, dictionary)


_FILTERS = {
    "any price": "o_totalprice >= 0",
    "finished": "o_orderstatus = 'F'",
    "unknown status": "o_orderstatus = 'Z'",
    "future": "o_orderdate > DATE '2100-01-01'",
    "both ways": "o_orderstatus = 'F' OR o_orderstatus <> 'F'",
}


@FAMILY.add(
    "dq_filter_selectivity",
    "SELECT name, total, kept, CASE WHEN kept = total THEN 'vacuous' WHEN kept = 0 AND name = 'unknown status'"
    " THEN 'dead' ELSE 'ok' END AS verdict FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS total, count(*) FILTER (WHERE {f}) AS kept FROM orders"
        for n, f in _FILTERS.items()
    )
    + ")",
)
def filter_selectivity(i):
    return q.filter_selectivity(i.orders, _FILTERS)


_FLAGS = """SELECT date_key, year(date_key) = 2024 AS is_current_year,
    year(date_key) = 2024 AND month(date_key) = 1 AS is_current_month,
    year(date_key) = 2024 AND weekofyear(date_key) = weekofyear(DATE '2024-01-31') AS is_current_week,
    date_key BETWEEN DATE '2023-01-31' AND DATE '2024-01-31' AS is_last_12_months,
    date_key BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' AS is_last_30_days,
    date_key BETWEEN DATE '2024-01-24' AND DATE '2024-01-31' AS is_last_7_days,
    date_key = DATE '2024-01-31' AS is_today FROM calendar"""


@FAMILY.add("dq_calendar_flags", oracle(_FLAGS, "calendar"))
def calendar_flags(i):
    return q.calendar_flags(i.calendar, AS_OF)


@FAMILY.add(
    "dq_calendar_sanity",
    oracle(
        f"""SELECT DATE '2024-01-31' AS today, count(*) FILTER (WHERE is_today) AS today_rows,
                   count(*) FILTER (WHERE is_current_year) AS current_year_rows,
                   count(*) FILTER (WHERE is_last_12_months) AS last_12mo_rows,
                   max(date_key) FILTER (WHERE is_current_year) AS latest_current_year_date
            FROM ({_FLAGS})""",
        "calendar",
    ),
)
def calendar_sanity(i):
    return q.calendar_sanity(q.calendar_flags(i.calendar, AS_OF), AS_OF)


@FAMILY.add(
    "dq_calendar_stale",
    types={"days_behind": "INTEGER"},
    oracle_sql=oracle(
        f"""SELECT max(date_key) AS max_current_year_date,
                   datediff('day', max(date_key), DATE '2024-01-31') AS days_behind,
                   CASE WHEN coalesce(datediff('day', max(date_key), DATE '2024-01-31'), 999) > 30
                        THEN 'stale' ELSE 'ok' END AS status
            FROM ({_FLAGS}) WHERE is_current_year""",
        "calendar",
    ),
)
def calendar_stale(i):
    return q.calendar_staleness(q.calendar_flags(i.calendar, AS_OF), AS_OF)


@FAMILY.add(
    "dq_noise_columns",
    oracle(
        """SELECT table_name, column_name, column_name LIKE 'etl\\_%' ESCAPE '\\' AS is_pipeline,
                  column_name IN ('etl_batch', 'raw_payload', 'created_at', 'load_key') AS is_noise
           FROM named_columns""",
        "named_columns",
    ),
)
def noise_columns(i):
    return q.name_flags(i.named_columns).select("table_name", "column_name", "is_pipeline", "is_noise")


@FAMILY.add(
    "dq_stale_temporal",
    oracle(
        """SELECT question_id, question FROM timed_questions q
           WHERE regexp_matches(lower(question), '\\b(this year|last [0-9]+ days|ytd|past [0-9]+ months)\\b')
             AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = q.question_id AND l_returnflag = 'R')""",
        "timed_questions",
    ),
)
def stale_temporal(i):
    returned = i.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("question_id"))
    return q.stale_temporal(i.timed_questions, returned.agg(F.count("*").alias("n"))).select("question_id", "question")
