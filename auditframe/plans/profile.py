"""Profiling queries."""

import uuid

from pyspark.sql import functions as F

from auditframe.functions.columns import union_all
from auditframe.functions.storage import session_folder
from auditframe.operators import profile as p
from auditframe.plans import Family
from auditframe.sources import oracle
from auditframe.sources.inputs import TABLES

FAMILY = Family()
# The scalar columns of each table; # marks numbers, @ times.
_COLUMNS = {
    "region": "r_regionkey# r_name",
    "nation": "n_nationkey# n_name n_regionkey#",
    "customer": "c_custkey# c_name c_nationkey# c_acctbal# c_mktsegment",
    "supplier": "s_suppkey# s_name s_nationkey# s_acctbal#",
    "part": "p_partkey# p_name p_brand p_type p_size# p_retailprice#",
    "orders": "o_orderkey# o_custkey# o_orderstatus o_totalprice# o_orderdate@ o_orderpriority",
    "lineitem": "l_orderkey# l_partkey# l_suppkey# l_linenumber# l_quantity# l_extendedprice# l_discount# l_tax#"
    " l_returnflag l_linestatus l_shipdate@",
    "events": "event_id# ts@ user_id# event_type value# props",
    "documents": "doc_id# text lang source n_chars#",
    "embeddings": "vec_id# label#",
    "pages": "page_id# url html",
    "benchmark": "item_id# text",
    "labels": "doc_id# quality# toxic#",
    "conversations": "conv_id# turn# role text",
}


def _profile_oracle() -> str:
    rows = []
    for table, columns in _COLUMNS.items():
        for spec in columns.split():
            c = spec.rstrip("#@")
            num = f"CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE)" if spec.endswith("#") else "NULL, NULL"
            time = f"min({c}), max({c})" if spec.endswith("@") else "CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP)"
            rows.append(f"SELECT '{table}', '{c}', count(DISTINCT {c}), {num}, {time} FROM {table}")
    return (
        'SELECT * FROM (' + " UNION ALL ".join(rows)
        + ') AS p("table", "column", distinct_count, min_number, max_number, min_time, max_time)'
    )


@FAMILY.add("dp_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS row_count FROM {t}" for t in TABLES))
def row_counts(i):
    return p.row_counts({t: i.get(t) for t in TABLES})


@FAMILY.add("dp_column_profile", _profile_oracle())
def column_profile(i):
    return union_all([p.column_profile(i.get(t)).withColumn("table", F.lit(t)) for t in TABLES])


@FAMILY.add("dp_profile_approx")
def profile_approx(i):
    """Sketched profile of every column. Sketches are estimates, which SQL does not repeat; tests hold them to their bounds."""
    return union_all([p.column_profile_approx(i.get(t)).withColumn("table", F.lit(t)) for t in TABLES])


@FAMILY.add("dp_profile_parts")
def profile_parts(i):
    """Profile of lineitem from sketches that are stored as its years arrive."""
    rows = i.lineitem.withColumn("_y", F.year("l_shipdate"))
    years = [r["_y"] for r in rows.select("_y").distinct().orderBy("_y").collect()]
    parts = {str(y): rows.filter(F.col("_y").eqNullSafe(y)).drop("_y") for y in years}
    return p.column_profile_parts(parts, f"{session_folder(i.spark)}/sketches-{uuid.uuid4().hex}")


@FAMILY.add(
    "dp_value_lists",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS distinct_count,
                   string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS "values"
            FROM {t} HAVING count(DISTINCT {c}) BETWEEN 1 AND 20"""
        for t, c in [
            ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("events", "event_type"),
            ("events", "props"), ("documents", "text"), ("documents", "lang"), ("documents", "source"),
        ]
    ),
)
def value_lists(i):
    return union_all(
        [
            p.value_lists(i.get(t)).select(
                F.lit(t).alias("table"), "column", "distinct_count", F.array_join("values", "|").alias("values")
            )
            for t in ("orders", "events", "documents")
        ]
    )


@FAMILY.add(
    "dp_first_values",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY v) FILTER (WHERE rn <= 10) AS "values",
                   count(*) > 10 AS has_more
            FROM (SELECT v, row_number() OVER (ORDER BY v) AS rn
                  FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL))"""
        for t, c in [("part", "p_brand"), ("part", "p_type"), ("part", "p_name")]
    ),
)
def first_values(i):
    df = p.first_distinct_values(i.part, ["p_brand", "p_type", "p_name"])
    return df.withColumn("values", F.array_join("values", "|"))


def _dims():
    return {
        "priority": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"),
        "month": F.to_date(F.date_trunc("month", "o_orderdate")),
    }


def _measures():
    return {"revenue": F.round(F.sum("o_totalprice"), 2), "orders": F.count("*"), "customers": F.countDistinct("o_custkey")}


@FAMILY.add(
    "dp_metric_view",
    """WITH g AS (SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status,
                         date_trunc('month', o_orderdate) AS month FROM orders)
       SELECT 'priority' AS "column", 'dimension' AS role, count(DISTINCT priority) AS distinct_count,
              CAST(NULL AS TIMESTAMP) AS min_time, CAST(NULL AS TIMESTAMP) AS max_time FROM g
       UNION ALL SELECT 'status', 'dimension', count(DISTINCT status), NULL, NULL FROM g
       UNION ALL SELECT 'month', 'dimension', count(DISTINCT month), min(month), max(month) FROM g
       UNION ALL SELECT unnest(['revenue', 'orders', 'customers']), 'measure', NULL, NULL, NULL""",
)
def metric_view_profile(i):
    df = p.metric_view_profile(i.orders, _dims(), _measures())
    return df.select("column", "role", "distinct_count", "min_time", "max_time")


@FAMILY.add(
    "dp_metric_view_rows",
    """SELECT o_orderpriority AS priority, o_orderstatus AS status,
              CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
              round(sum(o_totalprice), 2) AS revenue, count(*) AS orders, count(DISTINCT o_custkey) AS customers
       FROM orders GROUP BY ALL""",
)
def metric_view_rows(i):
    return p.metric_view(i.orders, _dims(), _measures())


@FAMILY.add(
    "dp_hash_sample",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) < '19999999'""",
)
def hash_sample(i):
    return p.hash_sample(i.orders, "o_orderkey", 0.1).select("o_orderkey", "o_totalprice")


@FAMILY.add(
    "dp_exact_sample",
    """SELECT o_orderkey, o_orderstatus FROM orders
       QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0' || chr(31) || CAST(o_orderkey AS VARCHAR))) <= 200""",
)
def exact_sample(i):
    return p.exact_sample(i.orders, ["o_orderkey"], 200, ["o_orderstatus"]).select("o_orderkey", "o_orderstatus")


@FAMILY.add(
    "dp_column_kind",
    oracle(
        """SELECT table_name, column_name,
                  CASE WHEN regexp_matches(column_name, '(_key|_id)$') THEN 'key'
                       WHEN data_type IN ('bigint', 'int') OR data_type LIKE 'decimal%' THEN 'measure'
                       ELSE 'dimension' END AS kind
           FROM named_columns""",
        "named_columns",
    ),
)
def column_kind(i):
    return p.column_kind(i.named_columns).select("table_name", "column_name", "kind")


@FAMILY.add(
    "dp_structural_class",
    oracle(
        """SELECT table_name, column_name,
                  CASE WHEN is_key THEN 'identifier' WHEN data_type = 'timestamp' THEN 'date'
                       WHEN data_type = 'string' THEN 'categorical' ELSE 'numeric' END AS structural_class
           FROM column_inventory""",
        "column_inventory",
    ),
)
def structural_class(i):
    return p.structural_class(i.column_inventory).select("table_name", "column_name", "structural_class")
